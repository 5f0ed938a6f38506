"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from aeroband.session import materialise


def _lowest(directed: DataFrame) -> DataFrame:
    return directed.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge only, and is the smaller end of none: nothing is left to move."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("ways"))
    return ends.agg(F.coalesce(F.max("ways"), F.lit(0)) < 2).first()[0]


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for the ends of ``links`` (u, v); component is the smallest node reached.

    Each round moves every edge towards smaller nodes and is written, so neither lineage
    nor lost executors add up.  Rounds end once all edges are stars, found without a further
    round.  A hub's edges are only minimised and joined, never gathered.
    Rows with a null end or two equal ends are no links.  No links give no rows.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, label)
    while not _stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialise(_lowest(both), label)
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.filter("u <> v").distinct(), label)
        least = materialise(large.groupBy("u").agg(F.min("v").alias("m")), label)
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.filter("u <> v").distinct(), label)
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
