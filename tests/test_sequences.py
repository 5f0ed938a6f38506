"""Order-dependent operators against plain loops, with one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroband.functions.timing import epoch_us
from aeroband.operators import correlation, ordered, relational, scans

START = pd.Timestamp("2024-01-01").value // 1000


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 3000
    key = np.where(rng.random(n) < 0.35, 0, rng.integers(1, 40, n))
    us = START + np.sort(rng.integers(0, 3 * 86_400_000_000, n))
    us[rng.random(n) < 0.05] = us[0]  # ties
    pdf = pd.DataFrame({"id": np.arange(n), "key": key, "us": us, "value": rng.normal(50, 20, n).round(3)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    return pdf.sort_values(["us", "id"]).reset_index(drop=True), df


def test_previous_crosses_slices(skewed):
    pdf, df = skewed
    got = ordered.with_previous(df, "key", ["ts", "id"], {"prev": F.col("id")}, ordered.time_slice("ts", 3600)).select("id", "prev").toPandas().set_index("id")["prev"]
    want = pdf.assign(prev=pdf.groupby("key")["id"].shift()).set_index("id")["prev"]
    pd.testing.assert_series_equal(got.sort_index().astype(float), want.sort_index().astype(float), check_names=False)


def test_following(skewed):
    pdf, df = skewed
    got = ordered.with_previous(df, "key", ["ts", "id"], {"nxt": F.col("id")}, ordered.time_slice("ts", 3600), following=True).select("id", "nxt").toPandas().set_index("id")["nxt"]
    want = pdf.assign(nxt=pdf.groupby("key")["id"].shift(-1)).set_index("id")["nxt"]
    pd.testing.assert_series_equal(got.sort_index().astype(float), want.sort_index().astype(float), check_names=False)


@pytest.mark.parametrize("keys", [["key"], []])
def test_running_sum(skewed, keys):
    pdf, df = skewed
    got = ordered.running_sums(df, keys, ["ts", "id"], {"s": F.col("value")}, ordered.time_slice("ts", 3600)).select("id", "s").toPandas().set_index("id")["s"].sort_index()
    want = (pdf.groupby("key")["value"].cumsum() if keys else pdf["value"].cumsum())
    want.index = pdf["id"]
    assert np.allclose(got, want.sort_index())


def test_sessions_open_at_exact_gap(spark):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:59:59"), (3, "2024-01-01 01:59:59"), (4, "2024-01-03 00:00:00")]
    df = spark.createDataFrame([(i, 1, t) for i, t in rows], "id long, key long, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r.id: r.session_no for r in ordered.sessionise(df, "key", "ts", 3600, 3600, "id").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3}


def test_trailing_counts(skewed):
    pdf, df = skewed
    got = ordered.trailing(df, "key", "ts", 7200, {"n": F.count("*")}, slice_seconds=3600).select("id", "n").toPandas().set_index("id")["n"]
    for key, g in pdf.groupby("key"):
        us = np.sort(g["us"].to_numpy())
        for i, u in zip(g["id"], g["us"]):
            assert got[i] == np.searchsorted(us, u, "right") - np.searchsorted(us, u - 7_200_000_000, "left")


def test_exponential_mean(skewed):
    pdf, df = skewed
    got = scans.exponential_mean(df, ["key"], "ts", "id", "value", slice_seconds=1800).select("id", "ema").toPandas().set_index("id")["ema"]
    for key, g in pdf.groupby("key"):
        state = None
        for i, x in zip(g["id"], g["value"]):
            state = x if state is None else 0.95 * state + 0.05 * x
            assert got[i] == pytest.approx(state, abs=1e-9)


@pytest.mark.parametrize("seconds", [30, 600, 20_000])
def test_cooldown(skewed, seconds):
    pdf, df = skewed
    got = {r.id for r in scans.cooldown(df.withColumn("cool", F.lit(float(seconds))), ["key"], "ts", "id", "cool", 3600).select("id").collect()}
    want = set()
    for key, g in pdf.groupby("key"):
        until = -1
        for i, u in zip(g["id"], g["us"]):
            if u >= until:
                want.add(i)
                until = u + seconds * 1_000_000
    assert got == want


def test_kalman(skewed):
    pdf, df = skewed
    got = scans.kalman_smooth(df, ["key"], "ts", "id", ["value"], slice_seconds=3600).select("id", "value_smooth").toPandas().set_index("id")["value_smooth"]
    dt, q, r = 0.1, 0.1, 1.0
    f, noise = np.array([[1, dt], [0, 1]]), np.diag([q * dt**4 / 4, q * dt**2 / 2])
    for key, g in pdf.groupby("key"):
        x, p, first = np.zeros(2), np.eye(2) * 100, True
        for i, z in zip(g["id"], g["value"]):
            if first:
                x, first = np.array([z, 0.0]), False
            else:
                x, p = f @ x, f @ p @ f.T + noise
                k = p[:, 0] / (p[0, 0] + r)
                x, p = x + k * (z - x[0]), (np.eye(2) - np.outer(k, [1, 0])) @ p
            assert got[i] == pytest.approx(x[0], abs=1e-8)


@pytest.mark.parametrize("same", [False, True])
def test_order_statistics(spark, same):
    rng = np.random.default_rng(3)
    v = np.full(500, 4.0) if same else np.concatenate([np.full(900, 3.25), rng.exponential(10, 1500), [-1e6, 1e6]])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    s = np.sort(v)
    row = ordered.order_statistics(df, [], "v", {"lo": F.lit(0), "mid": F.floor(F.col("n") * 0.5), "hi": F.col("n") - 1}, buckets=64).first()
    assert (row.lo, row.mid, row.hi) == (s[0], s[int(len(s) * 0.5)], s[-1])
    p = ordered.interpolated_percentiles(df, [], "v", {"a": 0.25, "b": 0.9}).first()
    assert p.a == pytest.approx(np.percentile(v, 25)) and p.b == pytest.approx(np.percentile(v, 90))


def test_top_per_key_with_slices(skewed):
    pdf, df = skewed
    got = {r.id for r in ordered.top_per_key(df, "key", [F.col("us").desc(), F.col("id").desc()], 5, spread=ordered.time_slice("ts", 86400)).select("id").collect()}
    want = set(pdf.sort_values(["us", "id"], ascending=False).groupby("key").head(5)["id"])
    assert got == want


def test_interval_join_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pts = pd.DataFrame({"p": np.arange(400), "x": rng.uniform(-50, 50, 400)})
    low = rng.uniform(-50, 50, 60)
    ivs = pd.DataFrame({"v": np.arange(60), "lo": low, "hi": low + rng.exponential(5, 60)})
    got = {(r.p, r.v) for r in relational.interval_join(spark.createDataFrame(pts), "x", spark.createDataFrame(ivs), "lo", "hi", 3.0).collect()}
    want = {(p, v) for p, x in zip(pts.p, pts.x) for v, a, b in zip(ivs.v, ivs.lo, ivs.hi) if a <= x <= b}
    assert got == want


def test_correlation_window_is_open(spark):
    d = spark.createDataFrame([(1, 37.0, -122.0, 2.402e9, 0), (2, 37.0, -122.0, 2.402e9, 10_000_000)], "id long, latitude double, longitude double, frequency double, us long")
    m = spark.createDataFrame([(10, 37.0, -122.0, 499_999), (11, 37.0, -122.0, 500_000), (12, 37.0, -122.0, 9_600_001)], "id long, latitude double, longitude double, us long")
    stamp = lambda x: x.withColumn("ts", F.timestamp_micros("us").cast("timestamp_ntz"))
    got = {(r.id, r.message_id) for r in correlation.candidates(stamp(d), stamp(m)).collect()}
    assert got == {(1, 10), (2, 12)}


def test_slice_covers_negative_times(spark):
    df = spark.createDataFrame([(1,)], "x int").select(F.lit("1969-12-31 23:59:59").cast("timestamp_ntz").alias("ts"))
    assert df.select(ordered.time_slice("ts", 3600)).first()[0] == -1
    assert df.select(epoch_us("ts")).first()[0] == -1_000_000
