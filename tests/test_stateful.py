"""Keyed state over several micro-batches in shuffled order."""

import pytest
from pyspark.sql import functions as F

from aeroband.streaming import jobs, stateful


def replay(spark, tmp_path, batches, columns):
    """Batches of (key, id, seconds, value), one file each, in the order given."""
    for n, rows in enumerate(batches):
        df = spark.createDataFrame([(k, i, float(s), float(v)) for k, i, s, v in rows], "key string, id long, s double, value double").select("key", "id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("ts"), "value")
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{n:03d}")
    stream = spark.readStream.schema("key string, id long, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return jobs.timed(stream, "100 seconds").select("key", *columns)


END = [("end", -1, 10_000_000.0, 0.0)]


@pytest.fixture(autouse=True)
def shared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "run_directory", lambda s, label: f"{tmp_path}/{label}")


def test_late_first_alert_fires(spark, tmp_path):
    stream = replay(spark, tmp_path, [[("k", 2, 20.0, 0), ("k", 3, 40.0, 0)], [("k", 1, 1.0, 0)], END], ["id", "ts"])
    assert {r.id for r in jobs.append(stateful.cooldown(stream, "key", "string", 30), "out").collect()} == {1, 3}


def test_presence_in_order(spark, tmp_path):
    stream = replay(spark, tmp_path, [[("k", 3, 200.0, 0)], [("k", 1, 120.0, 0)], [("k", 2, 130.0, 0)], [("k", 4, 900.0, 0)], END], ["id", "ts"])
    got = sorted((r.ts.timestamp() % 10_000, r.state) for r in jobs.append(stateful.presence(stream, "key", 60), "out").filter("key = 'k'").collect())
    base = spark.sql("SELECT timestamp_micros(0) AS t").first().t.timestamp() % 10_000
    assert [(t - base, s) for t, s in got] == [(120, "ACTIVE"), (190, "LOST"), (200, "RECOVERED"), (260, "LOST"), (900, "RECOVERED"), (960, "LOST")]


def test_floor_in_order(spark, tmp_path):
    stream = replay(spark, tmp_path, [[("k", 2, 20.0, 100.0)], [("k", 1, 10.0, 0.0)], END], ["id", "ts", "value"])
    got = {r.id: (round(r.floor, 6), r.triggered) for r in jobs.append(stateful.noise_trigger(stream, "key", "string", "value"), "out").collect()}
    assert got[1] == (0.0, False) and got[2] == (5.0, True)


def test_answer_before_creation(spark, tmp_path):
    rows = replay(spark, tmp_path, [[("a", 1, 1090.0, 1), ("b", 2, 1000.0, 0)], [("a", 1, 1000.0, 0)], END], ["id", "ts", "value"])
    stream = rows.select(F.col("id").alias("alert_id"), F.col("value").cast("int").alias("closes"), "ts")
    got = {(r.alert_id, r.level) for r in jobs.append(stateful.escalation(stream, [60, 60]), "out").collect() if r.alert_id > 0}
    assert got == {(1, 1), (2, 1), (2, 2)}


def test_slots_change_nothing(spark, tmp_path):
    """Short and long slots, and rows dealt over batches out of order, give the same rows."""
    import random
    rng = random.Random(3)
    rows = [("ab"[k % 2], k, 10.0 * k + rng.random(), float(rng.randrange(20))) for k in range(120)]
    late = sorted(rows, key=lambda r: r[2] + rng.random() * 80)
    found = []
    for n, slot in enumerate((1.0, 45.0, 5000.0)):
        stream = replay(spark, tmp_path / f"{n}", [late[k:k + 40] for k in range(0, 120, 40)] + [END], ["id", "ts", "value"])
        out = [stateful.noise_trigger(stream, "key", "string", "value", slot_s=slot), stateful.cooldown(stream, "key", "string", 75, slot_s=slot), stateful.duplicates(stream, "key", 20.2, slot_s=slot)]
        found.append([sorted(map(str, jobs.append(o, f"out-{n}-{k}").filter("id >= 0").collect())) for k, o in enumerate(out)])
    assert found[0] == found[1] == found[2] and all(found[0])
    ordered = {key: sorted((r for r in rows if r[0] == key), key=lambda r: r[2]) for key in "ab"}
    want = []
    for own in ordered.values():
        until = float("-inf")
        for r in own:
            if r[2] >= until:
                want.append(r[1])
                until = r[2] + 75
    assert len(found[0][1]) == len(want)


def test_silent_key_starts_afresh(spark, tmp_path):
    stream = replay(spark, tmp_path, [[("k", 1, 10.0, 50.0)], [("x", 9, 5_000.0, 0.0)], [("k", 2, 6_000.0, 0.0)], END], ["id", "ts", "value"])
    def fold(k, memory, times, ids, values):
        return [memory[0] + len(times)], [(k, int(i), memory[0] + n + 1) for n, i in enumerate(ids)]
    out = stateful.in_order(stream, "key", ["value"], "key string, id long, seen double", [0.0], fold, forget_s=1000.0)
    assert {(r.id, r.seen) for r in jobs.append(out, "out").collect() if r.id > 0 and r.key == "k"} == {(1, 1.0), (2, 1.0)}


def test_state_calls_follow_buckets(spark, tmp_path, monkeypatch):
    """Four hundred keys in four buckets: entries and timers are those of buckets, rows those of keys."""
    monkeypatch.setattr(stateful, "BUCKETS", 4, raising=False)
    rows = [(f"k{k % 400:03d}", k, 10.0 + k / 100, float(k)) for k in range(1200)]
    stream = replay(spark, tmp_path, [rows[::2], rows[1::2], END], ["id", "ts", "value"])
    def fold(k, memory, times, ids, values):
        return [memory[0] + len(ids)], [(k, int(i), memory[0] + n + 1) for n, i in enumerate(ids)]
    out = stateful.in_order(stream, "key", ["value"], "key string, id long, seen double", [0.0], fold, slot_s=1000.0)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = [int(p["stateOperators"][0]["numRowsTotal"]) for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(kept) < 100  # four hundred keys with an entry each were over 400
    got = {(r.key, r.id, r.seen) for r in spark.read.parquet(f"{tmp_path}/out").filter("id >= 0").collect()}
    assert got == {(k, i, 1.0 + i // 400) for k, i, *_ in rows}


def test_keys_of_a_bucket_keep_apart(spark, tmp_path, monkeypatch):
    """Keys of one bucket, a null key among them, are each silent, lost and forgotten by their own times."""
    monkeypatch.setattr(stateful, "BUCKETS", 1, raising=False)
    rows = [[("a", 1, 100.0, 0), (None, 2, 110.0, 0)], [("b", 3, 400.0, 0), (None, 4, 130.0, 0)], [("a", 5, 900.0, 0)], END]
    stream = replay(spark, tmp_path, rows, ["id", "ts"])
    got = {(r.key, r.state, r.s) for r in jobs.append(stateful.presence(stream, "key", 60), "out").selectExpr("key", "state", "unix_seconds(ts) as s").collect()}
    assert {x for x in got if x[0] != "end"} == {
        ("a", "ACTIVE", 100), ("a", "LOST", 160), ("a", "RECOVERED", 900), ("a", "LOST", 960),
        (None, "ACTIVE", 110), (None, "LOST", 190), ("b", "ACTIVE", 400), ("b", "LOST", 460)}
