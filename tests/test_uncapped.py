"""Results that a cap, a prefix or a size switch would change."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroband.operators import detectors, filters, scans, telemetry, tracking
from aeroband.sources import topics
from aeroband.streaming import jobs


def test_long_track(spark):
    rows = spark.range(5000).select(
        F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("uas_id"), F.timestamp_seconds(F.col("id")).alias("ts"), "id",
        (F.col("id") * 0.001).alias("latitude"), F.lit(5.0).alias("longitude"))  # 111 m apart
    got = tracking.simplify(rows, 50.0)
    assert got.count() == 5000
    wide = {r.id for r in tracking.simplify(rows, 300.0).filter("uas_id = 'hot'").collect()}
    assert wide == set(range(0, 4000, 3))


@pytest.mark.parametrize("rounds", [8, 1])
def test_slices_of_a_track_meet(spark, rounds):
    """Slices folded on trial give the fold of the whole track, also where they never meet."""
    rng = np.random.default_rng(8)
    steps = np.cumsum(rng.normal(0, 0.0004, (20000, 2)), axis=0)
    rows = [("walk", 5 * k, k, *map(float, p)) for k, p in enumerate(steps)] + [("even", 7 * k, k, k * 0.0001, 1.0) for k in range(3000)] + [("one", 5, 1, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "uas_id string, s long, id long, latitude double, longitude double").select("uas_id", F.timestamp_seconds("s").alias("ts"), "id", "latitude", "longitude")
    got = {k: {r.id for r in tracking.simplify(df, 150.0, slice_seconds=1800, rounds=rounds).filter(F.col("uas_id") == k).collect()} for k in ("walk", "even", "one")}
    for key in got:
        want, last = set(), None
        for _, _, i, lat, lon in (r for r in rows if r[0] == key):
            at = np.radians([lat, lon])
            if last is None or tracking.geo.haversine_radians_m(*last, *at) >= 150.0:
                want.add(i)
                last = at
        assert got[key] == want


def test_steps_of_a_hot_key(spark):
    """A cooldown longer than a slice over one key: firings equal a plain loop, steps are few where firings meet."""
    rng = np.random.default_rng(2)
    at = np.unique(rng.integers(0, 400_000, 60_000))
    df = spark.createDataFrame([("hot", int(s), int(k)) for k, s in enumerate(at)], "k string, s long, id long").select("k", F.timestamp_seconds("s").alias("ts"), "id", F.lit(9000.0).alias("c"))
    got = {r.id for r in scans.cooldown(df, ["k"], "ts", "id", "c", slice_seconds=3600).collect()}
    want, until = set(), -1
    for k, s in enumerate(at.tolist()):
        if s >= until:
            want.add(k)
            until = s + 9000
    assert got == want


def test_large_catalogue_keeps_its_types(spark):
    frames = spark.range(3).select(F.col("id").alias("frame_id"), F.lit(2.4e9).alias("f0_hz"), F.lit(1e5).alias("bin_hz"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: -90 + 40.0 * (k == 20).cast("double") + 0.0 * k).alias("psd"))
    sig = spark.range(12_000).select((F.col("id") + (1 << 40)).alias("signature_id"), (2.4e9 + F.col("id") * 10).alias("start_hz"), (2.4e9 + F.col("id") * 10 + 1e6).alias("stop_hz"), (F.lit(-50.0) - F.col("id") % 17).alias("expected_peak"))
    small, large = detectors.rank_signatures(frames, sig.limit(100)), detectors.rank_signatures(frames, sig)
    assert small.schema == large.schema
    assert {r.signature_id >= 1 << 40 for r in large.collect()} == {True}


def test_unknown_type_passes(spark):
    rows = spark.range(50).select("id", F.lit("u").alias("uas_id"), F.lit("NEW_KIND").alias("message_type"), F.timestamp_seconds(F.lit(5)).alias("ts"))
    assert telemetry.rate_limited(rows).count() == 50


@pytest.mark.parametrize("terms, ids", [("wi-fi", {1, 2}), ("RID-12", {3}), ("wi fi", {1, 2, 4}), ("-", {1, 2, 3, 4, 5}), ("wifi", {5})])
def test_phrases(spark, terms, ids):
    docs = spark.createDataFrame([(1, "a Wi-Fi link"), (2, "wi / fi"), (3, "RID 12"), (4, "fi then wi"), (5, "wifi rid 123")], "id int, text string")
    assert {r.id for r in docs.filter(filters.matches_all_terms(terms, "text")).collect()} == ids


def test_gains_settle_late():
    gain = scans.KalmanGains(0.1, 1e-6, 1.0)
    p, f, noise = np.eye(2) * 100.0, np.array([[1, 0.1], [0, 1]]), np.diag([1e-6 * 0.1**4 / 4, 1e-6 * 0.1**2 / 2])
    for k in range(9000):
        p = f @ p @ f.T + noise
        g = p[:, 0] / (p[0, 0] + 1.0)
        p = p - np.outer(g, p[0])
        if k in (5, 4095, 8999):
            assert (gain(k) == g).all()


def test_every_batch_counts(spark, tmp_path):
    spark.range(300).select("id", F.timestamp_seconds(F.col("id")).alias("ts")).repartition(150).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rows, metrics = jobs.monitored(stream, F.col("id") < 50, f"{tmp_path}/out")
    total = jobs.health(metrics).first()
    assert metrics.count() > 100 and (total.received, total.dropped, total.processed) == (300, 50, 250) and rows.count() == 250
    assert total.rows_per_second > 0 and total.max_latency_s >= total.mean_latency_s > 0


def test_failed_rows_are_kept(spark, tmp_path):
    spark.range(20).write.parquet(f"{tmp_path}/in")
    seen = []

    def bad(batch, n):
        raise ValueError("no")

    stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    topics.each_batch(stream, {"bad": bad, "good": lambda b, n: seen.append(b.count())}, f"{tmp_path}/state", f"{tmp_path}/failed").awaitTermination()
    assert sum(seen) == 20 and spark.read.parquet(f"{tmp_path}/failed").filter("handler = 'bad' and _error = 'no'").count() == 20
