"""Medians of a band's earlier spectra against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroband.operators import baselines


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_history_median(spark, size):
    rng = np.random.default_rng(4)
    rows = [("ab"[k % 3 == 0], k, [None if rng.random() < 0.05 else float(x) for x in np.round(rng.normal(0, 3, 5), 1)]) for k in range(120)]
    rows += [("c", 500, [1.0, float("nan"), 2.0]), ("c", 501, [3.0, 5.0, float("inf"), 9.0]), ("c", 502, None), ("c", 503, []), ("c", 504, [0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(b, k, v, 1) for b, k, v in rows], "band string, k long, psd array<double>, other int")
    out = baselines.history_median(df, "band", "k", "psd", F.floor(F.col("k") / size), step=0.1)
    assert out.columns == [*df.columns, "baseline"]
    got = {r.k: r.baseline for r in out.collect()}
    assert len(got) == len(rows)
    history: dict = {}
    for b, k, v in rows:
        want = None if v is None else [np.median(history[b, i]) if history.get((b, i)) else None for i in range(len(v))]
        if want is None:
            assert got[k] is None
        else:
            assert [x is None for x in got[k]] == [x is None for x in want]
            assert np.allclose([x for x in got[k] if x is not None], [x for x in want if x is not None])
        for i, x in enumerate(v or []):
            if x is not None and np.isfinite(x):
                history.setdefault((b, i), []).append(x)


def test_running_median():
    rng = np.random.default_rng(5)
    for _ in range(30):
        start = np.unique(rng.integers(-20, 20, rng.integers(0, 8)))
        counts, more = rng.integers(1, 5, len(start)), rng.integers(-20, 20, 40)
        running, seen = baselines.RunningMedian(np.union1d(start, more), start, counts), np.repeat(start, counts).tolist()
        for x in more.tolist():
            assert (np.isnan(running.median()) and not seen) or running.median() == np.median(seen)
            running.add(x)
            seen.append(x)


def test_entries_leave_by_their_levels():
    """A batch of long histories held every one of their histograms at once."""
    import tracemalloc

    import pandas as pd
    from aeroband.operators import baselines
    width = 2000
    rows = [(1, 0, k, np.arange(width) + (k % 2) * width, np.ones(width, np.int64)) for k in range(1000)] + [(2, 0, 0, np.array([7, 7]), np.array([1, 2])), (2, 0, 1, np.array([3]), np.array([4])), (2, 0, 2, np.zeros(0), np.zeros(0))]
    pdf = pd.DataFrame(rows, columns=["band", "bin", "slice", "levels", "counts"])
    tracemalloc.start()
    n, last = 0, []
    for out in baselines._entries([pdf]):
        n += len(out)
        last = out.values.tolist()[-3:]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(rows) and peak < 40e6
    assert [(b, s, list(x), list(c)) for b, _, s, x, c in last] == [(2, 0, [], []), (2, 1, [7], [3]), (2, 2, [3, 7], [4, 3])]
