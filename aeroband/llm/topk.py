"""Exact top-k inner products by multi-resolution segment statistics.

Components become integers, floor(scale * x).  A vector is cut into 1, 4, 16 ... equal
segments; each segment has a mean and a deviation.  For two segments of n components
    sum (q - v)^2  >=  n * ((mean_q - mean_v)^2 + (dev_q - dev_v)^2),
so with q.v = (|q|^2 + |v|^2 - d^2) / 2 a lower bound on the distance is an upper bound on
the product: n * (mean_q * mean_v + dev_q * dev_v), summed over segments.

Candidates and queries are dealt into cells of bounded blocks.  In a cell each query's k-th
best exact score among the best-bounded candidates is its bar; candidates whose coarse
bound is below the bar go, the rest are bounded finer, and the survivors of the finest
level are scored exactly.  A first pass over one candidate block gives every query a bar
before the cells run, so far blocks are mostly skipped at the coarsest level.  Cells return
at most k rows a query; a ranked window over these gives the result.

Edge cases.  Vectors that are null, empty, or hold a null or non-finite component take no
part; neither do rows without vec_id.  Vectors are compared within their dimension only.
A query meets no row of its own vec_id; equal rows count once, further rows of one vec_id
are candidates of their own.  Blocks whose products may leave the exact range of
doubles use Python's integers; a score beyond a long is an error.  Ties go to the smaller vec_id.  Fewer candidates than k give fewer rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from aeroband.session import materialise

SCALE = 64
CANDIDATES = 4096
QUERIES = 512
LEVELS = (1, 4, 16)


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dim, c): finite vectors as integers."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = x.filter(F.col("vec_id").isNotNull() & (F.size("x") > 0) & finite)
    return x.select("vec_id", F.size("x").alias("dim"), F.transform("x", lambda v: F.floor(v * scale)).alias("c")).distinct()


def statistics(c: np.ndarray, segments: int) -> np.ndarray:
    """Root-weighted means and deviations of each row's segments; their products add up to the bound."""
    edges = np.linspace(0, c.shape[1], min(segments, c.shape[1]) + 1).astype(int)
    n = np.diff(edges)
    sums = np.add.reduceat(c, edges[:-1], axis=1)
    squares = np.add.reduceat(c * c, edges[:-1], axis=1)
    spread = np.sqrt(np.maximum(squares - sums * sums / n, 0))
    return np.hstack([sums / np.sqrt(n), spread])


def best(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, bars: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of at most k best candidates a query that reach its bar."""
    top = max(np.abs(q).max(initial=0), np.abs(v).max(initial=0))
    if int(top) ** 2 * q.shape[1] >= 1 << 52:
        return _wide(q_ids, q, v_ids, v, k)
    q, v = q.astype(np.float64), v.astype(np.float64)
    levels = [(statistics(q, n), statistics(v, n)) for n in LEVELS]
    slack = 1e-9 * (np.sqrt((q * q).sum(1))[:, None] * np.sqrt((v * v).sum(1).max(initial=0)) + 1)
    other = q_ids[:, None] != v_ids[None, :]
    bound = levels[-1][0] @ levels[-1][1].T if len(v) <= 4 * k else levels[0][0] @ levels[0][1].T
    bars = bars.copy()
    if len(v) > k:
        some = np.argpartition(-np.where(other, bound, -np.inf), k, axis=1)[:, :k + 1]
        exact = np.einsum("qd,qkd->qk", q, v[some])
        exact[~np.take_along_axis(other, some, 1)] = -np.inf
        bars = np.maximum(bars, np.sort(exact, axis=1)[:, 1])  # k candidates at least reach it
    alive = other & (bound + slack >= bars[:, None])
    for a, b in levels[1:]:
        i, j = np.nonzero(alive)
        if len(i) > 0.1 * alive.size:
            alive &= a @ b.T + slack >= bars[:, None]
        else:
            alive[i, j] = np.einsum("pd,pd->p", a[i], b[j]) + slack[i, 0] >= bars[i]
    i, j = np.nonzero(alive)
    score = (q @ v.T)[i, j] if len(i) > 0.1 * alive.size else np.einsum("pd,pd->p", q[i], v[j])
    keep = score >= bars[i]
    i, j, score = i[keep], j[keep], np.rint(score[keep]).astype(np.int64)
    order = np.lexsort((v_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    nth = np.arange(len(i)) - np.searchsorted(i, i)
    return i[nth < k], j[nth < k], score[nth < k]


def _wide(q_ids, q, v_ids, v, k):
    """The same for integers too large for exact doubles, with Python's integers."""
    out = []
    for i in range(len(q)):
        own = sorted(((-sum(int(a) * int(b) for a, b in zip(q[i], v[j])), int(v_ids[j]), j) for j in range(len(v)) if v_ids[j] != q_ids[i]))[:k]
        out += [(i, j, -s) for s, _, j in own]
    return tuple(np.array([x[c] for x in out], np.int64) for c in range(3))


def _cell(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(candidates):
        return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0, np.int64)})
    candidates = candidates.sort_values("vec_id", kind="stable")
    q_ids, v_ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    i, j, score = best(q_ids, np.stack(queries["c"].to_numpy()), v_ids, np.stack(candidates["c"].to_numpy()), queries["bar"].to_numpy(np.float64), k)
    return pd.DataFrame({"query_id": q_ids[i], "vec_id": v_ids[j], "score": score})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries`` (vec_id, embedding) its k best of ``vectors``."""
    v = materialise(integers(vectors, scale), "topk-vectors")
    q = materialise(integers(queries, scale), "topk-queries")
    cell = "query_id long, vec_id long, score long"
    sizes = lambda t, name, size: t.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = sizes(v, "v_blocks", CANDIDATES).join(sizes(q, "q_blocks", QUERIES), "dim")
    blocks = materialise(blocks, "topk-blocks")
    dealt = lambda t, name: t.join(F.broadcast(blocks), "dim").withColumn(name, F.pmod(F.xxhash64("vec_id", "c"), F.col(f"{name}s")).cast("int"))  # noqa: E731  a row a dimension
    v_side, q_side = dealt(v, "v_block"), dealt(q, "q_block").withColumn("bar", F.lit(float("-inf")))
    key = ["dim", "v_block", "q_block"]

    def cells(query_side: DataFrame, candidate_side: DataFrame) -> DataFrame:
        left = query_side.select(*key, "vec_id", "c", "bar").groupBy(*key)
        right = candidate_side.select(*key, "vec_id", "c").groupBy(*key)
        return left.cogroup(right).applyInPandas(lambda a, b: _cell(a, b, k), cell)

    def over(t: DataFrame, name: str, first: bool = False) -> DataFrame:
        return t.withColumn(name, F.lit(0) if first else F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)))

    first = materialise(cells(over(q_side, "v_block", True), over(v_side.filter("v_block = 0"), "q_block")), "topk-first")
    bars = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("bar")).filter(F.col("n") == k)
    bars = bars.select(F.col("query_id").alias("vec_id"), F.col("bar").cast("double").alias("bar"))
    later = q_side.drop("bar").join(bars, "vec_id", "left").withColumn("bar", F.coalesce("bar", F.lit(float("-inf")))).withColumn(
        "v_block", F.explode(F.sequence(F.lit(1), F.col("v_blocks")))).filter("v_block < v_blocks")
    found = first.unionByName(cells(later, over(v_side.filter("v_block > 0"), "q_block")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
