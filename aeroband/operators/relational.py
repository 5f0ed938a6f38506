"""Relational surface: projection, joins, aggregation, paging over DataFrames."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroband.functions.timing import instant
from aeroband.operators import filters
from aeroband.session import small_side


def project(df: DataFrame, *names: str, **aliased: str) -> DataFrame:
    """Named columns and ``alias=column`` pairs; all columns when nothing is named."""
    if not names and not aliased:
        return df.select("*")
    return df.select(*names, *[F.col(c).alias(a) for a, c in aliased.items()])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def bound_sql(df: DataFrame, statement: str, **args) -> DataFrame:
    """Parameterised SQL over ``{src}``; values are bound, never spliced into the text."""
    return df.sparkSession.sql(statement, args=args, src=df)


def concat_group(df: DataFrame, keys: list[str], column: str, name: str, separator: str = ",") -> DataFrame:
    """Distinct values per group joined in order; duplicates fold before the shuffle."""
    distinct = df.select(*keys, F.col(column).cast("string").alias(column)).distinct()
    return distinct.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_list(column)), separator).alias(name))


def with_total(df: DataFrame, page: DataFrame, name: str = "total") -> DataFrame:
    """A page plus the row count of the unpaged query, as one plan."""
    return page.withColumn(name, df.select(F.count("*")).scalar())


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """1-indexed page of a total order."""
    if number < 1 or size < 1:
        raise ValueError("page and size start at 1")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_envelope(df: DataFrame, number: int, size: int) -> DataFrame:
    total = F.col("total")
    pages = F.ceil(total / size)
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(number).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"),
        pages.cast("long").alias("total_pages"), (F.lit(number) < pages).alias("has_next"),
        F.lit(number > 1).alias("has_prev"))


def after_cursor(df: DataFrame, ts: str, key: str, cursor_ts, cursor_key, size: int) -> DataFrame:
    """Next page in newest-first order; the leading bound reaches the scan."""
    at = instant(cursor_ts)
    older = (F.col(ts) <= at) & ((F.col(ts) < at) | (F.col(key) < cursor_key))
    return df.filter(older).orderBy(F.col(ts).desc(), F.col(key).desc()).limit(size)


def with_children(parent: DataFrame, child: DataFrame, on: Column, how: str = "left") -> DataFrame:
    return parent.join(child, on, how)


def alerts_with_detections(alerts: DataFrame, detections: DataFrame) -> DataFrame:
    """Every alert with its detection, if any."""
    d = detections.select(F.col("id").alias("detection_id"), "drone_type", "confidence", "threat_level")
    return alerts.join(d, "detection_id", "left")


def interval_join(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str, cell: float,
                  keys: list[str] | None = None, how: str = "inner", closed: bool = True) -> DataFrame:
    """``low <= at <= high`` (or ``< high``) as an equi-join on cells of width ``cell``.

    Each interval is listed under the cells it overlaps; a point has one cell, so every
    match is found exactly once.  Choose ``cell`` near the usual interval length.
    """
    keys = keys or []
    spread = intervals.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col(low) / cell).cast("long"), F.floor(F.col(high) / cell).cast("long"))))
    placed = points.withColumn("_cell", F.floor(F.col(at) / cell).cast("long"))
    p, s = placed.alias("p"), spread.alias("s")
    cond = F.col("p._cell") == F.col("s._cell")
    for k in keys:
        cond = cond & (F.col(f"p.{k}") == F.col(f"s.{k}"))
    top = F.col(f"p.{at}") <= F.col(f"s.{high}") if closed else F.col(f"p.{at}") < F.col(f"s.{high}")
    cond = cond & (F.col(f"p.{at}") >= F.col(f"s.{low}")) & top
    out = p.join(s, cond, how)
    keep = [F.col(f"p.{c}") for c in points.columns] + [F.col(f"s.{c}") for c in intervals.columns if c not in keys]
    return out.select(*keep) if how in ("inner", "left") else out.select(*[F.col(f"p.{c}") for c in points.columns])


def first_match(points: DataFrame, key: str, at: str, height: str, intervals: DataFrame, low: str, high: str, least: str, position: str, keep: list[str]) -> DataFrame:
    """For each point the interval of the lowest ``position`` with ``low <= at <= high`` and
    ``height >= least``: (key, at, height, ``keep``).

    Intervals are listed under cells a quarter of their length class wide, whatever their
    lengths, six at most.  In a cell that an interval covers whole, it matters only if no earlier
    one that does asks for as little; the rest of the skyline falls away before points meet it.
    Of equal intervals that ask for the same only the first is listed, so what is sorted and
    written per cell grows with the different ones.
    """
    carried = [c for c in keep if c not in (low, high, least, position)]
    first = F.min_by(F.struct(position, *carried), position).alias("_i")
    different = intervals.filter(F.col(high) >= F.col(low)).groupBy(low, high, least).agg(first).select(low, high, least, "_i.*")
    lengths = different.withColumn(
        "_level", F.when(F.col(high) > F.col(low), F.ceil(F.log2(F.col(high) - F.col(low))).cast("int") - 2).otherwise(F.lit(-40)))
    width = F.pow(F.lit(2.0), F.col("_level"))
    cells = F.sequence(F.floor(F.col(low) / width).cast("long"), F.floor(F.col(high) / width).cast("long"))
    spread = lengths.withColumn("_cell", F.explode(cells))
    spread = spread.withColumn("_whole", (F.col("_cell") * width >= F.col(low)) & ((F.col("_cell") + 1) * width <= F.col(high)))
    earlier = Window.partitionBy("_level", "_cell").orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    whole = spread.filter("_whole").withColumn("_asked", F.min(least).over(earlier)).filter(F.col("_asked").isNull() | (F.col(least) < F.col("_asked")))
    spread = whole.drop("_asked").unionByName(spread.filter(~F.col("_whole")))
    levels = lengths.agg(F.array_sort(F.collect_set("_level"))).scalar()  # a handful: length classes
    placed = points.select(key, at, height).withColumn("_level", F.explode(levels)).withColumn("_cell", F.floor(F.col(at) / width).cast("long"))
    inside = (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)) & (F.col(height) >= F.col(least))
    met = placed.join(spread.select("_level", "_cell", low, high, least, position, *carried), ["_level", "_cell"]).filter(inside)
    best = met.groupBy(key, at, height).agg(F.min_by(F.struct(*keep), position).alias("_m"))
    return best.select(key, at, height, *[F.col(f"_m.{c}").alias(c) for c in keep])


def merge_live(current: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Partial updates by key: a non-null new field wins, unknown keys are added."""
    c, u = current.alias("c"), updates.alias("u")
    joined = c.join(u, F.col(f"c.{key}") == F.col(f"u.{key}"), "full")
    cols = [F.coalesce(F.col(f"c.{key}"), F.col(f"u.{key}")).alias(key)]
    for name in current.columns:
        if name == key:
            continue
        cols.append(F.coalesce(F.col(f"u.{name}"), F.col(f"c.{name}")).alias(name) if name in updates.columns
                    else F.col(f"c.{name}").alias(name))
    return joined.select(*cols)


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def id_filters(df: DataFrame, key: str, search: str | None = None, search_column: str | None = None,
               ids: DataFrame | None = None, exclude_ids: DataFrame | None = None, active: bool | None = None) -> DataFrame:
    if search:
        df = df.filter(F.lower(F.col(search_column)).contains(search.lower()))
    if active is not None:
        df = df.filter(F.col("is_active") == F.lit(active))
    if ids is not None:
        df = filters.keep_ids(df, ids, key)
    if exclude_ids is not None:
        df = filters.drop_ids(df, exclude_ids, key)
    return df


def lookup(df: DataFrame, names: DataFrame, on: str, how: str = "left") -> DataFrame:
    """Join to a catalogue; broadcast only after its size is proven."""
    return df.join(small_side(names), on, how)
