"""Order-dependent operators that stay balanced when one key holds most of the rows.

A window partitioned by key alone would sort a hot key in a single task.  Everything
here partitions by ``(key, segment)`` instead, where the segment is a slice of the
ordering column (an hour, a day, a score range).  What must cross a slice boundary is
reduced first to one row per slice with a map-side-combined aggregate, scanned along
the slices of a key (their number depends on the time span, not on the row count) and
joined back on ``(key, segment)``.  The join and the window share one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroband.functions.timing import epoch_us
from aeroband.session import materialise

SEG = "_segment"


def _names(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def _along(keys):
    """Order the slices of one key; slices of the whole table use a constant key."""
    cols = [F.col(k) for k in keys] or [F.lit(0)]
    return Window.partitionBy(*cols).orderBy(SEG)


def time_slice(ts: Column | str, seconds: int) -> Column:
    return F.floor(epoch_us(ts) / F.lit(seconds * 1_000_000)).cast("long")


def _attach(df: DataFrame, summary: DataFrame, keys) -> DataFrame:
    return df.join(summary, [*keys, SEG], "left")


def with_previous(df: DataFrame, keys, order, fields: dict[str, Column], segment: Column,
                  following: bool = False) -> DataFrame:
    """Add for each field its value in the preceding (or following) row of the key."""
    keys, order = _names(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    order_key = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    work = df.withColumn(SEG, segment).withColumn("_pay", F.struct(*[c.alias(n) for n, c in fields.items()]))
    edge = F.min_by if following else F.max_by
    edges = work.groupBy(*keys, SEG).agg(edge("_pay", order_key).alias("_edge"))
    step = F.lead if following else F.lag
    carry = edges.select(*keys, SEG, step("_edge").over(_along(keys)).alias("_carry"))
    inside = Window.partitionBy(*keys, SEG).orderBy(*order)
    joined = _attach(work, carry, keys).withColumn("_near", F.coalesce(step("_pay").over(inside), F.col("_carry")))
    return joined.select(*df.columns, *[F.col(f"_near.{n}").alias(n) for n in fields])


def running_sums(df: DataFrame, keys, order, values: dict[str, Column], segment: Column) -> DataFrame:
    """Add cumulative sums (current row included) along the order of each key."""
    keys, order = _names(keys), [F.col(o) if isinstance(o, str) else o for o in order]
    work = df.withColumn(SEG, segment).select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    totals = work.groupBy(*keys, SEG).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = _along(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, SEG, *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in values])
    inside = Window.partitionBy(*keys, SEG).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = _attach(work, carry, keys)
    zero = F.lit(0)
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.col(f"_c_{n}"), zero) + F.coalesce(F.sum(f"_v_{n}").over(inside), zero)).alias(n) for n in values],
    )


def row_numbers(df: DataFrame, keys, order, segment: Column, name: str = "row_no") -> DataFrame:
    return running_sums(df, keys, order, {name: F.lit(1).cast("long")}, segment)


def sessionise(df: DataFrame, keys, ts: str, gap_seconds: float, slice_seconds: int = 3600,
               tie: str | None = None, name: str = "session_no") -> DataFrame:
    """Number the sessions of each key: a gap of at least ``gap_seconds`` opens a new one."""
    order = [ts] + ([tie] if tie else [])
    seg = time_slice(ts, slice_seconds)
    stepped = with_previous(df, keys, order, {"_prev_us": epoch_us(ts)}, seg)
    opens = F.when(
        F.col("_prev_us").isNull() | (epoch_us(ts) - F.col("_prev_us") >= int(gap_seconds * 1_000_000)), 1
    ).otherwise(0).cast("long")
    return running_sums(stepped, keys, order, {name: opens}, seg).drop("_prev_us")


def trailing(df: DataFrame, keys, ts: str, seconds: float, aggregates: dict, slice_seconds: int | None = None,
             open_start: bool = False) -> DataFrame:
    """Aggregates over the preceding ``seconds`` of each key, current row included.

    Rows near the end of a slice are copied into the next slice as context, so a frame
    never needs a neighbour's partition; at most one copy per row is made because the
    slice is at least as long as the frame.
    """
    keys = _names(keys)
    us, span = int(max(slice_seconds or 3600, seconds) * 1_000_000), int(seconds * 1_000_000)
    work = df.withColumn("_us", epoch_us(ts))
    own = F.floor(F.col("_us") / us).cast("long")
    reaches = F.floor((F.col("_us") + span) / us).cast("long")
    copied = work.withColumn("_own", own).withColumn(SEG, F.explode(F.sequence(own, reaches)))
    frame = Window.partitionBy(*keys, SEG).orderBy("_us").rangeBetween(-span + int(open_start), 0)
    out = copied.select("*", *[agg.over(frame).alias(n) for n, agg in aggregates.items()])
    return out.filter(F.col("_own") == F.col(SEG)).drop("_us", "_own", SEG)


def newest_per_key(df: DataFrame, keys, ts: str, tie: str, columns: list[str]) -> DataFrame:
    """Whole newest row per key as a map-side-combined aggregate, no sort."""
    keys = _names(keys)
    rest = [c for c in columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def top_per_key(df: DataFrame, keys, order, n: int, rank: str = "row_no", spread: Column | None = None) -> DataFrame:
    """First ``n`` rows per key.  With ``spread`` each key is first cut down per slice."""
    keys = _names(keys)
    if spread is not None:
        local = Window.partitionBy(*keys, SEG).orderBy(*order)
        df = (df.withColumn(SEG, spread).withColumn("_local", F.row_number().over(local))
                .filter(F.col("_local") <= n).drop("_local", SEG))
    by_key = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(by_key)).filter(F.col(rank) <= n)


def beside(df: DataFrame, facts: DataFrame, keys) -> DataFrame:
    """``df`` with the columns of ``facts``, its one row a key; without keys, its one row."""
    return df.join(facts, list(keys)) if keys else df.crossJoin(F.broadcast(facts))


def order_statistics(df: DataFrame, keys, value: str, ranks: dict[str, Column], buckets: int = 4096) -> DataFrame:
    """Exact order statistics of unbounded groups: (keys, names of ``ranks``); see ``_statistics``."""
    return _statistics(df, keys, value, ranks, buckets).drop("n")


def _statistics(df: DataFrame, keys, value: str, ranks: dict[str, Column], buckets: int = 4096) -> DataFrame:
    """(keys, n, names of ``ranks``).

    ``ranks`` maps an output name to a zero-based rank, an expression over ``n`` (the
    group's row count).  A histogram of fixed width per group finds the bucket holding
    each rank; only rows of those buckets are then counted by distinct value and ranked.
    The input is read three times at any number of ranks: for the groups' extent, for the
    histogram, and for the rows of the buckets; what is known in between is written.
    """
    keys = _names(keys)
    tag = [F.col(k) for k in keys] or [F.lit(0)]
    base = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    span = base.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("n"))
    span = materialise(span, "statistics-span")
    width = (F.col("_hi") - F.col("_lo")) / buckets
    placed = beside(base, span, keys).withColumn(
        "_b", F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(buckets - 1))).cast("int")
    ).select(*keys, "_v", "_b")
    histogram = materialise(placed.groupBy(*keys, "_b").agg(F.count("*").alias("_c")), "statistics-histogram")
    along = Window.partitionBy(*tag).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*tag)
    cum = histogram.select(
        *keys, "_b", "_c",
        F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_before"),
        F.sum("_c").over(whole).alias("n"),
    )
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), r.cast("long").alias("rank")) for name, r in ranks.items()])
    hit = (cum.withColumn("_w", F.explode(wanted))
              .filter((F.col("_w.rank") >= F.col("_before")) & (F.col("_w.rank") < F.col("_before") + F.col("_c"))))
    targets = materialise(hit.groupBy(*keys, "_b", "_before").agg(F.collect_list("_w").alias("_ws")), "statistics-targets")
    values = (placed.join(targets.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
                    .groupBy(*keys, "_b", "_v").agg(F.count("*").alias("_m")))
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = values.withColumn("_prior", F.coalesce(F.sum("_m").over(inside), F.lit(0)))
    found = (ranked.join(targets, [*keys, "_b"])
                   .withColumn("_w", F.explode("_ws"))
                   .withColumn("_at", F.col("_w.rank") - F.col("_before"))
                   .filter((F.col("_at") >= F.col("_prior")) & (F.col("_at") < F.col("_prior") + F.col("_m"))))
    found = found.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_w.name") == name, F.col("_v"))).alias(name) for name in ranks]
    )
    return beside(found, span.select(*keys, "n"), keys)


def interpolated_percentiles(df: DataFrame, keys, value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles of unbounded groups through two order statistics each."""
    keys = _names(keys)
    ranks = {}
    for name, p in points.items():
        at = F.lit(p) * (F.col("n") - 1)
        ranks[f"{name}__lo"], ranks[f"{name}__hi"] = F.floor(at), F.ceil(at)
    joined = _statistics(df, keys, value, ranks)
    out = list(map(F.col, keys))
    for name, p in points.items():
        at = F.lit(p) * (F.col("n") - 1)
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return joined.select(*out)
