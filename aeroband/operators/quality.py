"""Data-quality operators: each returns the violating rows or the reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import arrays as X

C = F.col


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(C("copies") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(C(parent_key).alias(child_key)), child_key, "left_anti")


def reasons(**tests: Column) -> Column:
    """Names of the tests that hold (a test describes a fault)."""
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))


def detection_faults(kind="drone_type", confidence="confidence") -> Column:
    return reasons(missing_type=C(kind).isNull(), confidence_range=C(confidence).isNull() | ~C(confidence).between(0, 1))


# Limits of a valid signature.
SIGNATURE_LIMITS = {"freq": (10e6, 10e9), "bandwidth": (1e3, 100e6), "confidence": (0.5, 1.0)}


def signature_faults() -> Column:
    """Reasons over columns manufacturer, model, bands (min_freq, max_freq), bandwidth, confidence_threshold."""
    low, high = SIGNATURE_LIMITS["freq"]
    bw_low, bw_high = SIGNATURE_LIMITS["bandwidth"]
    c_low, c_high = SIGNATURE_LIMITS["confidence"]
    return reasons(
        missing_manufacturer=C("manufacturer").isNull() | (C("manufacturer") == ""), missing_model=C("model").isNull() | (C("model") == ""),
        missing_bands=C("bands").isNull() | (F.size("bands") == 0),
        frequency_low=F.exists("bands", lambda b: b["min_freq"] < low), frequency_high=F.exists("bands", lambda b: b["max_freq"] > high),
        band_order=F.exists("bands", lambda b: b["min_freq"] >= b["max_freq"]),
        bandwidth_low=C("bandwidth") < bw_low, bandwidth_high=C("bandwidth") > bw_high,
        confidence_low=C("confidence_threshold") < c_low, confidence_high=C("confidence_threshold") > c_high)


def polygon_faults(rings="rings") -> Column:
    """Rings of (lon, lat) points: at least one ring, four points each, closed."""
    r = X._c(rings)
    return reasons(no_ring=F.size(r) < 1, too_few_points=F.exists(r, lambda ring: F.size(ring) < 4),
                   not_closed=F.exists(r, lambda ring: F.element_at(ring, 1) != F.element_at(ring, -1)))


def box_faults(south, west, north, east) -> Column:
    return reasons(latitude_order=C(south) >= C(north), longitude_order=C(west) >= C(east))


def checked_range(start, end):
    if start is not None and end is not None and str(end) < str(start):
        raise ValueError("end must not precede start")
    return start, end


# Tunable frequency span of the query interface.
QUERY_SPAN_HZ = (70e6, 6e9)


def query_faults(start, end, low_hz, high_hz) -> Column:
    a, b = QUERY_SPAN_HZ
    return reasons(time_order=C(end) <= C(start), low_frequency=~C(low_hz).between(a, b), high_frequency=~C(high_hz).between(a, b),
                   frequency_order=C(high_hz) <= C(low_hz))


def capture_faults(size="size_bytes", sidecar="has_sidecar", bad_values="bad_values") -> Column:
    return reasons(empty=C(size) == 0, not_multiple_of_8=C(size) % 8 != 0, no_sidecar=~C(sidecar), not_finite=C(bad_values) > 0)


def content_faults(power_db="power_db", clipping="clipping_share") -> Column:
    return reasons(power_range=~((C(power_db) > -120) & (C(power_db) < 0)), clipping=C(clipping) >= 0.01)
