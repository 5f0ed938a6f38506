"""Baselines of spectra from their own history.

``history_median`` gives every spectrum the median of all earlier spectra of its band, bin by
bin, at any length of history.  Values are counted in levels of ``step`` dB, so a history is a
histogram: slices of the order are counted independently, their histograms are summed along
the slices of each (band, bin), and every slice then replays its own spectra from the histogram
it starts with.  A band of any size is spread over its slices; a task holds one slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from aeroband.operators.ordered import SEG

C = F.col
STEP = 0.01
#: Levels of histograms that leave together.
ENTRY_LEVELS = 500_000


def _merged(levels: np.ndarray, counts: np.ndarray, more, n) -> tuple[np.ndarray, np.ndarray]:
    joined, at = np.unique(np.concatenate([levels, np.asarray(more, np.int64)]), return_inverse=True)
    summed = np.zeros(len(joined), np.int64)
    np.add.at(summed, at, np.concatenate([counts, np.asarray(n, np.int64)]))
    return joined, summed


def _entries(batches):
    """Rows (band, bin, slice, levels, counts) in that order to the histogram before each slice.

    A histogram grows with its history, so rows leave by their levels, not by the batch.
    """
    held, nothing = None, np.zeros(0, np.int64)
    levels = counts = nothing
    for pdf in batches:
        rows, weight = [], 0
        for band, at, piece, own, n in pdf.itertuples(index=False):
            if (band, at) != held:
                held, levels, counts = (band, at), nothing, nothing
            rows.append((band, at, piece, levels, counts))
            weight += len(levels)
            if weight >= ENTRY_LEVELS:
                yield pd.DataFrame(rows, columns=pdf.columns)
                rows, weight = [], 0
            if len(own):
                levels, counts = _merged(levels, counts, own, n)
        yield pd.DataFrame(rows, columns=pdf.columns)


class RunningMedian:
    """Median of a growing multiset of known levels; ``below`` counts what lies under ``at``."""

    def __init__(self, levels: np.ndarray, start: np.ndarray, counts: np.ndarray):
        self.levels, self.counts = levels, np.zeros(len(levels), np.int64)
        self.counts[np.searchsorted(levels, start)] = counts
        self.n, self.at, self.below = int(self.counts.sum()), 0, 0

    def add(self, level: int) -> None:
        k = int(np.searchsorted(self.levels, level))
        self.counts[k] += 1
        self.n += 1
        self.below += k < self.at

    def median(self) -> float:
        if not self.n:
            return np.nan
        low, high = (self.n - 1) // 2, self.n // 2
        while self.below > low:
            self.at -= 1
            self.below -= int(self.counts[self.at])
        while self.below + self.counts[self.at] <= low:
            self.below += int(self.counts[self.at])
            self.at += 1
        first, last, reached = self.levels[self.at], self.at, self.below + self.counts[self.at]
        while reached <= high:
            last += 1
            reached += self.counts[last]
        return (first + self.levels[last]) / 2


def _replay(order: str, values: str, step: float, columns: list[str]):
    def run(frames: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        frames = frames.sort_values(order, kind="stable").reset_index(drop=True)
        known = {at: (np.array(levels, np.int64), np.array(counts, np.int64)) for at, levels, counts in entry[["_bin", "_levels", "_counts"]].itertuples(index=False)}
        rows = [np.array([np.nan if v is None else v for v in x], float) if x is not None else np.zeros(0) for x in frames[values]]
        out = [np.full(len(x), np.nan) for x in rows]
        for at in range(max(map(len, rows), default=0)):
            own = [i for i, x in enumerate(rows) if at < len(x)]
            x = np.array([rows[i][at] for i in own])
            level = np.where(np.isfinite(x), np.floor(np.where(np.isfinite(x), x, 0) / step + 0.5), 0).astype(np.int64)
            start, counts = known.get(at, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            running = RunningMedian(np.union1d(start, level[np.isfinite(x)]), start, counts)
            for i, v, real in zip(own, level.tolist(), np.isfinite(x).tolist()):
                out[i][at] = running.median() * step
                if real:
                    running.add(v)
        frames["_baseline"] = [None if x is None else [None if np.isnan(v) else float(v) for v in b] for x, b in zip(frames[values], out)]
        return frames[columns]

    return run


def history_median(frames: DataFrame, band: str, order: str, values: str, segment: Column, step: float = STEP, name: str = "baseline") -> DataFrame:
    """``frames`` with the array ``name``: each bin's median over the band's earlier spectra, null without any.

    ``segment`` slices the order; null and non-finite values are no history.
    """
    work = frames.withColumn(SEG, segment.cast("long"))
    level = F.floor(C("_x").cast("double") / step + 0.5)
    bins = work.select(band, SEG, F.posexplode(values).alias("_bin", "_x")).filter(F.col("_x").isNotNull() & ~F.isnan(C("_x").cast("double")) & (F.abs(C("_x").cast("double")) < float("inf")))
    counts = bins.groupBy(band, SEG, "_bin", level.alias("_level")).agg(F.count("*").alias("_n"))
    histograms = counts.groupBy(band, "_bin", SEG).agg(F.collect_list(F.struct("_level", "_n")).alias("_h")).select(
        band, "_bin", SEG, C("_h._level").alias("_levels"), C("_h._n").alias("_counts"))
    # Also slices without a value of the bin start from its history.
    widths = work.groupBy(C(band).alias("_band")).agg(F.max(F.size(values)).alias("_width"))
    pieces = work.select(C(band).alias("_b"), SEG).distinct()
    dense = pieces.join(widths, C("_b").eqNullSafe(C("_band"))).filter("_width > 0").select(C("_b").alias(band), F.explode(F.sequence(F.lit(0), C("_width") - 1)).alias("_bin"), SEG)
    nothing = F.array().cast("array<bigint>")
    histograms = dense.withColumn("_levels", nothing).withColumn("_counts", nothing).unionByName(histograms)
    histograms = histograms.groupBy(band, "_bin", SEG).agg(F.flatten(F.collect_list("_levels")).alias("_levels"), F.flatten(F.collect_list("_counts")).alias("_counts"))
    before = histograms.repartition(band, "_bin").sortWithinPartitions(band, "_bin", SEG).mapInPandas(_entries, histograms.schema)
    out = T.StructType([*frames.schema.fields, T.StructField("_baseline", T.ArrayType(T.DoubleType()))])
    run = _replay(order, values, step, out.names)
    replayed = work.groupBy(band, SEG).cogroup(before.groupBy(band, SEG)).applyInPandas(run, out)
    return replayed.withColumnRenamed("_baseline", name)
