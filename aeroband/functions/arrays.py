"""In-row vector algebra.

A frame's spectrum or samples stay one array column, so every per-frame operator below
runs inside the scan stage: no explode, no shuffle, no per-key window.
Positions are zero-based; ``at`` adds the one-based offset of ``element_at``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def let(value, fn) -> Column:
    """Bind a value once and use it many times in ``fn``.

    Expressions are substituted textually into lambdas and would be evaluated again for
    every element; a lambda variable is evaluated once per row.
    """
    return F.get(F.transform(F.array(_c(value)), fn), F.lit(0))


def at(a, i) -> Column:
    return F.get(_c(a), _c(i) if isinstance(i, (str, Column)) else F.lit(i))


def indices(a, start: int = 0, drop: int = 0) -> Column:
    """Positions ``start … size-1-drop``; empty when there are none."""
    last = F.size(_c(a)) - 1 - drop
    return F.when(last >= start, F.sequence(F.lit(start), last)).otherwise(F.array().cast("array<int>"))


def each(a, fn) -> Column:
    return F.transform(_c(a), fn)


def total(a, start=0.0) -> Column:
    return F.aggregate(_c(a), F.lit(start), lambda s, x: s + x)


def mean(a) -> Column:
    a = _c(a)
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def moments(a) -> Column:
    """Mean, population variance and third/fourth central moments as one struct."""
    zero = F.struct(F.lit(0.0).alias("m2"), F.lit(0.0).alias("m3"), F.lit(0.0).alias("m4"))

    def about(a, m):
        n = F.size(a)

        def step(s, x):
            d = x - m
            return F.struct((s["m2"] + d * d).alias("m2"), (s["m3"] + d * d * d).alias("m3"),
                            (s["m4"] + d * d * d * d).alias("m4"))

        return F.aggregate(a, zero, step, lambda s: F.struct(
            m.alias("mean"), (s["m2"] / n).alias("var"), (s["m3"] / n).alias("m3"), (s["m4"] / n).alias("m4")))

    return let(a, lambda v: let(mean(v), lambda m: about(v, m)))


def variance(a) -> Column:
    return let(a, lambda v: let(mean(v), lambda m:
               F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(v)))


def deviation(a) -> Column:
    return F.sqrt(variance(a))


def skewness(a) -> Column:
    return let(moments(a), lambda m: F.when(m["var"] == 0, 0.0).otherwise(m["m3"] / F.pow(m["var"], 1.5)))


def excess_kurtosis(a) -> Column:
    return let(moments(a), lambda m: F.when(m["var"] == 0, 0.0).otherwise(m["m4"] / (m["var"] * m["var"]) - 3))


def sorted_percentile(ordered_values: Column, p: float) -> Column:
    n = F.size(ordered_values)
    where = F.lit(p) * (n - 1)
    low = at(ordered_values, F.floor(where).cast("int"))
    high = at(ordered_values, F.ceil(where).cast("int"))
    return low + (high - low) * (where - F.floor(where))


def percentile(a, p: float) -> Column:
    """Linear interpolation between order statistics."""
    return let(F.sort_array(_c(a)), lambda v: sorted_percentile(v, p))


def median(a) -> Column:
    return percentile(a, 0.5)


def argmax(a) -> Column:
    """Position of the first maximum."""
    return let(a, lambda v: (F.array_position(v, F.array_max(v)) - 1).cast("int"))


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def differences(a) -> Column:
    return let(a, lambda v: F.transform(indices(v, 1), lambda i: at(v, i) - at(v, i - 1)))


def frame_slice(a, i, before: int, after: int) -> Column:
    """Values at positions ``i-before … i+after`` clipped to the array."""
    a = _c(a)
    first = F.greatest(F.lit(0), i - before)
    last = F.least(F.size(a) - 1, i + after)
    return F.slice(a, first + 1, last - first + 1)


def moving(a, before: int, after: int, fn) -> Column:
    return let(a, lambda v: F.transform(indices(v), lambda i: let(frame_slice(v, i, before, after), fn)))


def runs(flags) -> Column:
    """Maximal runs of true as structs ``(first, last)``."""
    def build(v, idx):
        opens = F.filter(idx, lambda i: at(v, i) & ((i == 0) | ~F.coalesce(at(v, i - 1), F.lit(False))))
        closes = F.filter(idx, lambda i: at(v, i) & ~F.coalesce(at(v, i + 1), F.lit(False)))
        return F.zip_with(opens, closes, lambda s, e: F.struct(s.alias("first"), e.alias("last")))

    return let(flags, lambda v: let(indices(v), lambda idx: build(v, idx)))


def closed_runs(flags, close_open: bool = False) -> Column:
    """Runs that end inside the array; a run still open at the end is dropped by default."""
    if close_open:
        return runs(flags)
    return let(flags, lambda v: F.filter(runs(v), lambda r: r["last"] < F.size(v) - 1))


def clusters(positions, gap) -> Column:
    """Groups of ascending positions whose neighbours are at most ``gap`` apart."""
    gap = gap if isinstance(gap, Column) else F.lit(gap)

    def build(p, idx):
        firsts = F.filter(idx, lambda j: (j == 0) | (at(p, j) - at(p, j - 1) > gap))
        lasts = F.filter(idx, lambda j: (j == F.size(p) - 1) | (at(p, j + 1) - at(p, j) > gap))
        return F.zip_with(firsts, lasts, lambda s, e: F.struct(
            at(p, s).alias("first"), at(p, e).alias("last"), (e - s + 1).alias("hits")))

    return let(positions, lambda p: let(indices(p), lambda idx: build(p, idx)))


def first_reaching(a, share: float, weight_total: Column | None = None) -> Column:
    """Position where the running sum first reaches ``share`` of the total."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(-1).alias("hit"))

    def search(v, goal):
        def step(s, x):
            cum = s["sum"] + x
            return F.struct(cum.alias("sum"), (s["i"] + 1).alias("i"),
                            F.when((s["hit"] < 0) & (cum >= goal), s["i"]).otherwise(s["hit"]).alias("hit"))

        return F.aggregate(v, start, step, lambda s: s["hit"])

    return let(a, lambda v: let((total(v) if weight_total is None else weight_total) * share, lambda g: search(v, g)))


def wrap_phase(x) -> Column:
    """Wrap an angle difference into (-π, π]."""
    two_pi = 2 * math.pi
    r = x - two_pi * F.floor((x + math.pi) / two_pi)
    return F.when((r == -math.pi) & (x > 0), math.pi).otherwise(r)


def phase(i, q) -> Column:
    return F.zip_with(_c(i), _c(q), lambda a, b: F.atan2(b, a))


def amplitude(i, q) -> Column:
    return F.zip_with(_c(i), _c(q), lambda a, b: F.sqrt(a * a + b * b))


def power(i, q) -> Column:
    return F.zip_with(_c(i), _c(q), lambda a, b: a * a + b * b)
