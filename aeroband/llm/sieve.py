"""A fixed-size bitmap of ids that spares most rows a shuffle before a join on the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BUCKET = 1 << 15  # bits of one bitmap aggregate
BUCKETS = 1 << 10


def _place(key: str):
    return F.pmod(F.xxhash64(key), F.lit(BUCKET * BUCKETS))


def bitmap(ids: DataFrame, key: str) -> DataFrame:
    """At most ``BUCKETS`` rows of 4 KB, whatever the number of ids."""
    place = ids.select(_place(key).alias("p")).distinct()
    return place.groupBy(F.floor(F.col("p") / BUCKET).alias("__bucket")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(BUCKET))).alias("__bits"))


def sifted(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``rows`` with __maybe: false only where the key, or no key, is not among the ids."""
    place = _place(key)
    inner = F.pmod(place, F.lit(BUCKET))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__inner div 8 as int) + 1, 1)")), 16, 10).cast("int")
    joined = rows.withColumn("__bucket", F.floor(place / BUCKET)).withColumn("__inner", inner).join(F.broadcast(bits), "__bucket", "left")
    hit = F.shiftright(byte, 0).bitwiseAND(F.expr("cast(shiftleft(1, cast(__inner % 8 as int)) as int)")) != 0
    maybe = F.coalesce(hit, F.lit(False)) & F.col(key).isNotNull()
    return joined.select(*rows.columns, maybe.alias("__maybe"))
