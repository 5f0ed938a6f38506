"""Table snapshots, restores, inventories, retention and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroband.functions.timing import instant
from aeroband.operators import ordered

C = F.col


def checksum(df: DataFrame) -> DataFrame:
    """Order-independent content sum with the row count; both fold map-side.  Decimal sums cannot overflow."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("checksum"))


def take(tables: dict[str, DataFrame], path: str, day: str) -> DataFrame:
    """Every table below ``path/dt=day/name`` plus its row count and checksum, computed on what was written."""
    out = None
    for name, df in tables.items():
        target = f"{path}/dt={day}/{name}"
        df.write.parquet(target)
        stored = df.sparkSession.read.schema(df.schema).parquet(target)
        row = checksum(stored).select(F.lit(name).alias("table"), "rows", "checksum")
        out = row if out is None else out.unionByName(row)
    return out


def load(spark: SparkSession, path: str, day: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/dt={day}/{name}")


def restore(spark: SparkSession, path: str, day: str, names: list[str], available: list[str], staging: str) -> list[str]:
    """Named tables copied to a staging folder; the caller swaps once all copies succeeded.

    Names missing from the snapshot are skipped.
    """
    done = []
    for name in names:
        if name in available:
            load(spark, path, day, name).write.parquet(f"{staging}/{name}")
            done.append(name)
    return done


def merge(live: DataFrame, snapshot: DataFrame, keys: list[str], prefer: str = "snapshot", newest: str | None = None) -> DataFrame:
    """Union by key: the preferred side wins, or the newer row when a time column is named.

    The winner is a combined aggregate, not a sort per key.
    """
    sides = [(live, 1 if prefer == "live" else 0), (snapshot, 1 if prefer == "snapshot" else 0)]
    both = None
    for df, rank in sides:
        part = df.withColumn("_rank", F.lit(rank))
        both = part if both is None else both.unionByName(part)
    order = F.struct(newest, "_rank") if newest else F.struct("_rank")
    rest = [c for c in live.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[C(f"_r.{c}").alias(c) for c in rest])


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Row deltas per table; a table missing on one side counts as zero."""
    a, b = before.select("table", C("rows").alias("before")), after.select("table", C("rows").alias("after"))
    zero = F.lit(0).cast("long")
    joined = a.join(b, "table", "full").select("table", F.coalesce("before", zero).alias("before"), F.coalesce("after", zero).alias("after"))
    return joined.withColumn("delta", C("after") - C("before"))


def retained(items: DataFrame, as_of, days: int, keep: int, ts: str = "ts", tie: str = "id", slice_seconds: int = 86400) -> DataFrame:
    """Marks what a policy deletes: older than ``days`` or beyond the newest ``keep``."""
    newest_first = items.withColumn("_neg", -F.unix_micros(C(ts).cast("timestamp")))
    ranked = ordered.row_numbers(newest_first, [], ["_neg", C(tie).desc()], F.floor(C("_neg") / (slice_seconds * 1_000_000)), "position")
    old = C(ts) < instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return ranked.withColumn("deleted", old | (C("position") > keep)).drop("_neg")


def within_quota(items: DataFrame, quota_bytes: int, ts: str = "ts", size: str = "size_bytes", tie: str = "id", slice_seconds: int = 86400) -> DataFrame:
    """Newest items while their running total stays within the quota; the oldest go first."""
    newest_first = items.withColumn("_neg", -F.unix_micros(C(ts).cast("timestamp")))
    summed = ordered.running_sums(newest_first, [], ["_neg", C(tie).desc()], {"running_bytes": C(size)}, F.floor(C("_neg") / (slice_seconds * 1_000_000)))
    return summed.withColumn("kept", C("running_bytes") <= quota_bytes).drop("_neg")
