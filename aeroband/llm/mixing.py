"""Sources mixed to target weights by systematic sampling.

Every source gets a share of the mix by its weight, as words; no source gives more than ``most``
times its own, and what that leaves is shared again among the others.  A document's expected
copies are target over size of its source.  Along the documents of a source, longest first,
expected copies are summed up, one random offset is added, and a document is taken once for
every whole number that its own stretch of the sum crosses.

Longest first, because the words taken then differ from the target by less than the source's
longest document has: with sums of copies never a whole copy off, the error telescopes over
the falling sizes.

Expected copies are equal for all documents of a source, so the sum before a document is its
rank times that.  Ranks come from ranges of the sorted rows: one count a range and source,
summed along the ranges, so a source of any size is dealt over many tasks.  Copies are counted
in integers (rates in units of 2 ** -40), so no document gets one more by rounding.

The offset comes from the source's name and ``seed``, ties are ordered by doc_id and then by the
row's own content, so reruns agree.

Edge cases.  Null and empty texts have no words and give none.  A null source is one of its own,
after all others.  Every row is a document, also repeated ones and those without doc_id.
Sources without any word have the target 0.  Other columns pass through.  An empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroband.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
UNIT = 1 << 40


def n_words(body: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__none", F.col("__source").isNull()).withColumn("__source", F.coalesce("__source", F.lit("")))


def ranked(rows: DataFrame, keys: list[str], order: list, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with __part and __inner, counts by __part and keys with __before): a row's rank among
    those of its keys is __before + __inner, from 0."""
    dealt = rows.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    dealt = materialise(dealt.withColumn("__part", F.spark_partition_id()), label)
    counts = dealt.groupBy("__part", *keys).agg(F.count("*").alias("__count"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    inner = Window.partitionBy("__part", *keys).orderBy(*order)
    return dealt.withColumn("__inner", F.row_number().over(inner) - 1), materialise(counts, f"{label}-before")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(__none, __source, __size) with __target added, a row a source."""
    first, counts = ranked(sizes, [], [F.col("__none"), F.col("__source")], "mixing-sources")
    first = first.join(counts.select("__part", "__before"), "__part").withColumn("__place", F.pmod(F.col("__before") + F.col("__inner"), F.lit(len(weights))))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("__place").cast("int") + 1)
    weighted = materialise(first.select("__none", "__source", "__size", weight.alias("__weight")), "mixing-weights")
    total = weighted.agg(F.sum("__size")).first()[0] or 0
    level, cap = 0.0, F.lit(most) * F.col("__size")
    while True:  # every round fills at least one more source to its limit
        full = cap <= F.lit(level) * F.col("__weight")
        filled, rest = weighted.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("__weight")))).first()
        if not rest:
            break
        now = (share * total - (filled or 0)) / rest
        if now == level:
            break
        level = now
    return weighted.withColumn("__target", F.least(cap.cast("double"), F.lit(level) * F.col("__weight")))


def allocated(rows: DataFrame, size: Column, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(row, size, source_size, target, copies): ``rows`` as a struct with what the mix takes of each."""
    held = rows.select(F.struct(*rows.columns).alias("row"), F.col("source").cast("string").alias("__source"), F.col("doc_id").alias("__id"), size.alias("__words"))
    held = _named(held).withColumn("__tie", F.xxhash64("row"))
    order = [F.desc("__words"), F.col("__id"), F.col("__tie")]
    keys = ["__none", "__source"]
    numbered, counts = ranked(held, keys, order, "mixing-rows")
    sizes = numbered.groupBy(*keys).agg(F.sum("__words").alias("__size"))
    goals = materialise(targets(sizes, weights, share, most), "mixing-targets")
    places = counts.join(goals, keys)  # a row a range and source
    joined = numbered.join(places, ["__part", *keys])
    rate = F.when(F.col("__size") > 0, F.floor(F.col("__target") / F.col("__size") * UNIT)).otherwise(0).cast("decimal(19,0)")
    name = F.concat_ws(":", F.lit(seed), F.when(F.col("__none"), "null").otherwise(F.concat(F.lit("="), F.col("__source"))))
    offset = (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") * (UNIT >> 32)).cast("decimal(19,0)")
    whole = joined.withColumn("__rank", (F.col("__before") + F.col("__inner")).cast("decimal(18,0)")).withColumn("__rate", rate).withColumn("__offset", offset)
    crossed = F.expr(f"(__offset + (__rank + 1) * __rate) div {UNIT} - (__offset + __rank * __rate) div {UNIT}")
    return whole.select("row", F.col("__words").alias("size"), F.col("__size").alias("source_size"), F.col("__target").alias("target"), crossed.alias("copies"))


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them."""
    taken = allocated(docs, n_words(F.col("text").cast("string")), **settings).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
