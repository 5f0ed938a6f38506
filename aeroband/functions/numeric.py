"""Numeric column helpers: decibels, signal ratios, safe rounding."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FLOOR = 1e-12


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def power_db(p) -> Column:
    return 10 * F.log10(_c(p) + F.lit(FLOOR))


def magnitude_db(m) -> Column:
    return 20 * F.log10(_c(m) + F.lit(FLOOR))


def from_db(x) -> Column:
    return F.pow(F.lit(10.0), _c(x) / 10)


def ratio_or_zero(top, bottom) -> Column:
    return F.when(_c(bottom) == 0, 0.0).otherwise(F.coalesce(_c(top) / F.nullif(_c(bottom), F.lit(0)), F.lit(0.0)))


def snr_db(signal_power, noise_power) -> Column:
    return 10 * F.log10(_c(signal_power) / (_c(noise_power) + F.lit(FLOOR)) + F.lit(FLOOR))


def papr_db(peak_power, mean_power) -> Column:
    return 10 * F.log10(_c(peak_power) / (_c(mean_power) + F.lit(FLOOR)) + F.lit(FLOOR))


def crest_factor(peak_amplitude, rms_amplitude) -> Column:
    return _c(peak_amplitude) / (_c(rms_amplitude) + F.lit(FLOOR))


def rounded(df, digits: int = 6, *names):
    """Round the named double columns, or every double column."""
    targets = set(names) or {f.name for f in df.schema.fields if f.dataType.simpleString() == "double"}
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in targets else F.col(c) for c in df.columns])


def tiered(value, tiers: list[tuple[float, str]], otherwise) -> Column:
    """First label whose lower bound the value reaches; tiers descend."""
    value = _c(value)
    out = None
    for bound, label in tiers:
        test = value >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)
