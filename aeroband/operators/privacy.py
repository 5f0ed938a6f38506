"""Anonymisation, retention, erasure and export of personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions.timing import instant
from aeroband.session import small_side

C = F.col

# Retention in days and identifying fields.
RETENTION_DAYS = {"positions": 90, "identifiable_data": 30, "operator_info": 365, "alerts": 730}
MESSAGE_TIERS = {"raw_messages": 7, "processed_data": 30, "aggregated_data": 365}
IDENTIFYING = ("uas_id", "operator_id", "serial_number")
DEFAULT_SALT = "remote_id_salt_2024"


def pseudonym(c, salt: str = DEFAULT_SALT) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def anonymise(df: DataFrame, when: Column | None = None, salt: str = DEFAULT_SALT) -> DataFrame:
    """Replace identifying fields by salted hashes, optionally only on some rows."""
    present = {c: pseudonym(c, salt) for c in IDENTIFYING if c in df.columns}
    return df.withColumns({c: h if when is None else F.when(when, h).otherwise(C(c)) for c, h in present.items()})


def older_than(ts, as_of, days: int) -> Column:
    return F.col(ts) < instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")


def retain_positions(messages: DataFrame, as_of, positions_days: int = 90, identity_days: int = 30, ts: str = "ts") -> DataFrame:
    """Drop positions past their age, hash identities past theirs."""
    kept = messages.filter(~older_than(ts, as_of, positions_days))
    aged = kept.withColumn("anonymised", older_than(ts, as_of, identity_days))
    return anonymise(aged, C("anonymised"))


def retain_by_class(df: DataFrame, class_days: DataFrame, on: str, as_of, ts: str) -> DataFrame:
    """Keep rows younger than their class's limit; unknown classes are kept."""
    joined = df.join(small_side(class_days), on, "left")
    limit = instant(as_of) - F.make_dt_interval(days=C("days"))
    return joined.filter(C("days").isNull() | (C(ts) >= limit)).drop("days")


def erase(tables: dict[str, DataFrame], subject, delete_from: dict[str, str], null_in: dict[str, str]) -> dict[str, DataFrame]:
    """Remove a subject's rows from some tables and blank the id in others."""
    out = {}
    for name, df in tables.items():
        if name in delete_from:
            key = delete_from[name]
            out[name] = df.filter(C(key).isNull() | (C(key) != F.lit(subject)))
        elif name in null_in:
            key = null_in[name]
            out[name] = df.withColumn(key, F.when(C(key) != F.lit(subject), C(key)))
        else:
            out[name] = df
    return out


def export_subject(sections: dict[str, tuple[DataFrame, str]], subject) -> DataFrame:
    """A subject's data as JSON lines, one per record with its section; any volume stays distributed."""
    out = None
    for name, (df, key) in sections.items():
        part = df.filter(C(key) == F.lit(subject)).select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("record"))
        out = part if out is None else out.unionByName(part)
    return out
