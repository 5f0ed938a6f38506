"""Matches by time and place against all pairs."""

import random

from pyspark.sql import functions as F

from aeroband.operators import correlation

DET = "id long, latitude double, longitude double, frequency double, us long"
MSG = "id long, latitude double, longitude double, us long"


def crowd(spark, places, seed=1):
    """Many detections and messages within two seconds, in clusters around ``places``; some without a place."""
    rng = random.Random(seed)
    spot = lambda: (lambda p: (p[0] + rng.uniform(-0.004, 0.004), p[1] + rng.uniform(-0.004, 0.004)))(rng.choice(places))
    base = 1_700_000_000_000_000
    det = [(k, *(spot() if rng.random() < 0.97 else (None, None)), rng.choice([2.402e9, 2.412e9, 5.18e9, 3.3e9]), base + rng.randrange(2_000_000)) for k in range(300)]
    msg = [(1000 + k, *(spot() if rng.random() < 0.97 else (None, 7.0)), base + rng.randrange(2_000_000)) for k in range(300)]
    stamp = lambda df: df.withColumn("ts", F.timestamp_micros("us")).drop("us")
    return stamp(spark.createDataFrame(det, DET)), stamp(spark.createDataFrame(msg, MSG))


def rows(df):
    return sorted((r.id, r.message_id, r.gap_us, round(r.score, 9)) for r in df.collect())


def test_above_equals_all_pairs(spark):
    for places in ([(37.0, -122.0)], [(-37 + k * 0.3, 179.9) for k in range(20)], [(89.99, 10.0), (89.995, -170.0)], [(0.0, 0.0), (0.004, 0.004)]):
        det, msg = crowd(spark, places)
        for minimum in (0.3, 0.5, 0.7, 0.9):
            want = rows(correlation.candidates(det, msg).filter(F.col("score") > minimum))
            assert rows(correlation.above(det, msg, minimum)) == want


def test_crowds_at_other_places_never_meet(spark, monkeypatch):
    det, msg = crowd(spark, [(30 + 0.5 * (k // 10), 5 + 0.5 * (k % 10)) for k in range(100)], seed=2)
    met = []
    scored = correlation._scored
    monkeypatch.setattr(correlation, "_scored", lambda pairs, us: met.append(pairs.count()) or scored(pairs, us))
    every, few = correlation.candidates(det, msg).count(), correlation.above(det, msg, 0.7).count()
    assert few <= met[1] < met[0] / 5 and every > 5 * few


def test_first_match_of_intervals(spark, monkeypatch):
    """Intervals of all lengths, many of them hopeless behind earlier ones."""
    from aeroband.operators import relational
    rng = random.Random(4)
    sigs = [(k, a := rng.uniform(-50, 900), a + rng.choice([0.0, 0.01, 1.0, 30.0, 400.0]) * rng.random(), rng.random()) for k in range(400)] + [(500, 3.0, 2.0, 0.0), (501, 0.0, 1000.0, 0.2)]
    pts = [(k, rng.choice([rng.uniform(-60, 1000), sigs[k % 400][1], sigs[k % 400][2]]), rng.random()) for k in range(500)]
    p = spark.createDataFrame(pts, "id long, x double, c double")
    s = spark.createDataFrame(sigs, "position long, lo double, hi double, least double").withColumn("name", F.col("position") * 10)
    got = {r.id: r.name for r in relational.first_match(p, "id", "x", "c", s, "lo", "hi", "least", "position", ["name"]).collect()}
    want = {}
    for i, x, c in pts:
        hits = [k for k, lo, hi, least in sigs if lo <= x <= hi and c >= least]
        if hits:
            want[i] = 10 * min(hits)
    assert got == want
    assert relational.first_match(p, "id", "x", "c", s.limit(0), "lo", "hi", "least", "position", ["name"]).collect() == []


def test_equal_intervals_are_listed_once(spark):
    """Repeats in a catalogue took disk for every cell of every copy."""
    from aeroband.operators import relational
    s = spark.range(5000).selectExpr("id AS position", "id AS name", "1.0D * (id % 3) AS lo", "1.0D * (id % 3) + 4 AS hi", "(id % 4) / 10.0D AS least").repartition(8)
    p = spark.createDataFrame([(1, 0.5, 0.05), (2, 2.5, 0.35), (3, 5.5, 0.15), (4, 9.0, 1.0)], "id long, x double, c double")
    met = relational.first_match(p, "id", "x", "c", s, "lo", "hi", "least", "position", ["name"])
    want = {}
    for i, x, c in p.collect():
        hits = [k for k in range(5000) if k % 3 <= x <= k % 3 + 4 and c >= (k % 4) / 10]
        if hits:
            want[i] = hits[0]
    assert {r.id: r.name for r in met.collect()} == want
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [lo" in plan[plan.index("Generate explode(sequence"):]
