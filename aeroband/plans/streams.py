"""Registered queries: the streaming operators run to the end of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions.numeric import rounded
from aeroband.operators import geofence as G, spectral
from aeroband.plans import views as V
from aeroband.plans.messages import TOPIC_SQL
from aeroband.plans.registry import query
from aeroband.plans.spectrum import CLASSIFIED
from aeroband.session import run_directory
from aeroband.sources import topics
from aeroband.streaming import consumers, jobs as J, stateful as S

C = F.col
SLOT = 7 * 86400.0  # the replays wait for days, so slots may be long


def events(spark, d):
    return J.given(spark, d, "events")


def detections(spark, d, delay=J.LATE):
    return J.timed(V.detections(spark, d, events(spark, d)), delay)


def replay(spark, d, view):
    """A view of the events as a stream of several shuffled micro-batches."""
    stream, delay = J.replayed(spark, d, "events", "event_id", "event_type")
    return view(spark, d, stream), delay


def alerts(spark, d, delay=J.LATE):
    return J.timed(V.alerts(spark, d, events(spark, d)), delay)


def messages(spark, d, delay=J.LATE):
    return J.timed(V.rid_messages(spark, d, events(spark, d)), delay)


@query("n1_frame_pipeline", CLASSIFIED + """ SELECT frame_id, kind AS drone_type, center_mhz AS frequency_mhz, ch IS NOT NULL AS wifi_channel_aligned FROM w""")
def _(spark, d):
    frames = V.psd_frames(spark, d, J.given(spark, d, "embeddings")).withColumn("bin_hz", F.lit(5e5))
    return J.append(spectral.detect_frames(frames, 2.416e9).select("frame_id", "drone_type", "frequency_mhz", "wifi_channel_aligned"), "frames")


@query("n2_processor_chain", "SELECT id, round(snr * 2 + 1, 6) AS level FROM detections WHERE snr > 10")
def _(spark, d):
    out = J.chain(detections(spark, d), lambda x: x.filter(C("snr") > 10), lambda x: x.withColumn("level", C("snr") * 2), lambda x: x.withColumn("level", F.round(C("level") + 1, 6)))
    return J.append(out.select("id", "level"), "chain")


@query("n3_stale_side_output", "SELECT id, CASE WHEN ts >= TIMESTAMP '2024-01-20' - INTERVAL 5 DAY THEN 'fresh' ELSE 'stale' END AS kind FROM rid_messages")
def _(spark, d):
    fresh, stale, state = (run_directory(spark, f"age-{k}") for k in ("fresh", "stale", "state"))
    J.route_stale(messages(spark, d), "2024-01-20 00:00:00", "5 DAYS", fresh, stale, state).awaitTermination()
    read = lambda p, k: spark.read.parquet(p).select("id", F.lit(k).alias("kind"))
    return read(fresh, "fresh").unionByName(read(stale, "stale"))


@query("n4_tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS avg_confidence FROM detections GROUP BY 1")
def _(spark, d):
    windows = J.append(J.windowed_metrics(J.timed(*replay(spark, d, V.detections)), "1 hour"), "tumbling")
    final = V.detections(spark, d).select(F.max(C("ts").cast("timestamp"))).scalar()
    return rounded(windows.filter(C("start") <= final))


@query("n4_tumbling_all_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS avg_confidence FROM detections GROUP BY 1")
def _(spark, d):
    return rounded(J.upsert(J.windowed_metrics(detections(spark, d), "1 day"), "daily", ["start"]))


@query("n5_sliding_windows", """WITH w AS (SELECT emitter, time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS start FROM alerts, range(4) t(k))
   SELECT start, emitter, CAST(count(*) AS BIGINT) AS n FROM w GROUP BY 1, 2""")
def _(spark, d):
    return J.upsert(J.sliding_counts(alerts(spark, d), "24 hours", "6 hours", ("emitter",)), "sliding", ["start", "emitter"])


@query("n6_session_windows", """WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY uas_id ORDER BY ts, id) AS pts FROM rid_messages),
   n AS (SELECT *, sum(CASE WHEN pts IS NULL OR ts - pts >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY uas_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS s FROM p),
   g AS (SELECT uas_id, s, min(ts) AS start, max(ts) AS last, CAST(count(*) AS BIGINT) AS points FROM n GROUP BY 1, 2)
   SELECT uas_id, start, points FROM g""")
def _(spark, d):
    return J.append(J.session_counts(J.timed(*replay(spark, d, V.rid_messages)), "12 hours", "uas_id"), "sessions").filter("uas_id <> 'UAS--1'")


@query("n7_windowed_deduplication", """SELECT id, uas_id || '/' || message_type AS message FROM (SELECT id, ts, uas_id, message_type, lag(ts) OVER (PARTITION BY uas_id, message_type ORDER BY ts, id) AS p FROM rid_messages)
   WHERE p IS NULL OR ts - p > INTERVAL 5 SECOND""")
def _(spark, d):
    m = J.timed(*replay(spark, d, V.rid_messages)).select(F.concat_ws("/", "uas_id", "message_type").alias("message"), "id", "ts")
    return J.append(S.duplicates(m, "message", 5, slot_s=SLOT), "dedup").filter("id >= 0").select("id", "message")


@query("n7_repeats_in_a_batch", "SELECT uas_id, message_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT uas_id, message_type FROM rid_messages) GROUP BY 1, 2")
def _(spark, d):
    out = J.append(J.deduplicated(messages(spark, d, "5 seconds"), ["uas_id", "message_type"]).select("id", "uas_id", "message_type"), "dedup-batch")
    return out.groupBy("uas_id", "message_type").agg(F.count("*").alias("n"))


@query("n8_stream_stream_correlation", """SELECT d.id AS detection_id, m.id AS message_id FROM detections d JOIN rid_messages m ON m.ts > d.ts - INTERVAL 500 MILLISECOND AND m.ts < d.ts + INTERVAL 500 MILLISECOND""")
def _(spark, d):
    return J.append(J.correlate(detections(spark, d), messages(spark, d)), "correlate").select("detection_id", "message_id")


@query("n9_stream_static_enrichment")
def _(spark, d):
    inside = G.containment(messages(spark, d), V.zones(spark, d).filter("active"))
    return J.append(inside.select("id", "zone_id", "zone_type"), "zones")


FOLD = """WITH k AS (SELECT emitter, list([[epoch_us(ts), id]] ORDER BY ts, id) AS v FROM alerts GROUP BY 1)
   SELECT emitter, CAST(unnest(list_reduce(v, lambda a, b: CASE WHEN b[1][1] - a[-1][1] >= 259200000000 THEN list_concat(a, b) ELSE a END))[2] AS BIGINT) AS id FROM k"""


@query("n10_cooldown_state", FOLD)
def _(spark, d):
    a = J.timed(*replay(spark, d, V.alerts)).select("emitter", "id", "ts")
    return J.append(S.cooldown(a, "emitter", "long", 259200, slot_s=SLOT), "cooldown").filter("id >= 0").select("emitter", "id")


@query("n11_escalation_timers", """WITH o AS (SELECT id, ts, resolved_at FROM alerts) SELECT id AS alert_id, CAST(l.level AS INTEGER) AS level, ts + l.delay * INTERVAL 1 SECOND AS due_ts FROM o, (VALUES (1, 60), (2, 360), (3, 1560)) l(level, delay)
   WHERE resolved_at IS NULL OR ts + l.delay * INTERVAL 1 SECOND < resolved_at""")
def _(spark, d):
    a, delay = replay(spark, d, V.alerts)
    rows = F.array_compact(F.array(F.struct(F.lit(0).alias("closes"), C("ts").cast("timestamp").alias("at")),
                                   F.when(C("resolved"), F.struct(F.lit(1).alias("closes"), C("resolved_at").cast("timestamp").alias("at")))))
    stream = J.timed(a.select(C("id").alias("alert_id"), F.explode(rows).alias("e")).select("alert_id", "e.closes", C("e.at").alias("ts")), delay)
    return J.append(S.escalation(stream, [60, 300, 1200], slot_s=SLOT), "escalation").filter("alert_id >= 0")


@query("n12_latest_positions", "SELECT uas_id, arg_max(latitude, (ts, id)) AS latitude, arg_max(longitude, (ts, id)) AS longitude FROM rid_messages GROUP BY 1")
def _(spark, d):
    return J.upsert(J.latest_positions(messages(spark, d)), "positions", ["uas_id"]).select("uas_id", "latitude", "longitude")


@query("n13_presence", """WITH s AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, lag(ts) OVER w AS pts, lead(ts) OVER w AS nxt FROM rid_messages WINDOW w AS (PARTITION BY uas_id ORDER BY ts, id))
   SELECT uas_id, 'ACTIVE' AS state, ts FROM s WHERE pts IS NULL UNION ALL SELECT uas_id, 'RECOVERED', ts FROM s WHERE gap > 86400000000 UNION ALL SELECT uas_id, 'LOST', pts + INTERVAL 1 DAY FROM s WHERE gap > 86400000000
   UNION ALL SELECT uas_id, 'LOST', ts + INTERVAL 1 DAY FROM s WHERE nxt IS NULL""")
def _(spark, d):
    m = J.timed(*replay(spark, d, V.rid_messages)).select("uas_id", "id", "ts")
    return J.append(S.presence(m, "uas_id", 86400, slot_s=SLOT), "presence").filter("uas_id <> 'UAS--1'")


@query("n14_kalman_state")
def _(spark, d):
    m = J.timed(*replay(spark, d, V.rid_messages)).select("uas_id", "id", "ts", "latitude", "longitude")
    return rounded(J.append(S.kalman(m, "uas_id", slot_s=SLOT), "kalman").filter("id >= 0"))


@query("n15_noise_floor_trigger", """WITH w AS (SELECT id, emitter, value, list(value) OVER (PARTITION BY emitter ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS v FROM detections),
   f AS (SELECT *, list_reduce(v, lambda a, b: 0.95::DOUBLE * a + 0.05::DOUBLE * b) AS floor FROM w) SELECT emitter, id, round(floor + 1e-10, 6) AS floor, value > floor + 10 AS triggered FROM f""")
def _(spark, d):
    v = J.timed(*replay(spark, d, V.detections)).select("emitter", "id", "ts", "value")
    out = J.append(S.noise_trigger(v, "emitter", "long", "value", slot_s=SLOT), "trigger").filter("id >= 0")
    return out.select("emitter", "id", F.round(C("floor") + 1e-10, 6).alias("floor"), "triggered")


def _topic_stream(spark, d):
    tail = F.when(C("id") % 2 == 0, "/raw").otherwise("")
    return detections(spark, d).select("id", "confidence", F.concat(F.lit("site/"), (C("id") % 5).cast("string"), F.lit("/"), C("drone_type"), tail).alias("topic"))


@query("n16_channel_subscription", f"SELECT id FROM (SELECT id, confidence, {TOPIC_SQL} AS t FROM detections) WHERE regexp_matches(t, '^site/[^/]+/click(/.*)?$') AND confidence >= 0.3")
def _(spark, d):
    return J.append(J.channel(_topic_stream(spark, d), "site/+/click/#", 0.3).select("id"), "channel")


@query("n17_notification_rows", "SELECT id AS alert_id, channel, 'pending' AS status FROM alerts, (VALUES ('email'), ('mqtt'), ('sms')) c(channel) WHERE channel <> 'sms' OR severity = 'HIGH'")
def _(spark, d):
    channels = F.when(C("severity") == "HIGH", F.array(F.lit("email"), F.lit("mqtt"), F.lit("sms"))).otherwise(F.array(F.lit("email"), F.lit("mqtt")))
    return J.append(J.notifications(alerts(spark, d), channels), "notify").select("alert_id", "channel", "status")


@query("n18_stream_health", """SELECT CAST(count(*) AS BIGINT) AS received, CAST(count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-10') AS BIGINT) AS dropped,
   CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-10') AS BIGINT) AS processed, true AS rate_of_all, true AS latency_of_all FROM detections""")
def _(spark, d):
    late = C("ts") < F.lit("2024-01-10").cast("timestamp")
    _, metrics = J.monitored(detections(spark, d), late, run_directory(spark, "health"))
    seconds = metrics.agg(F.sum("seconds")).scalar()
    whole = (F.abs(C("rows_per_second") * seconds - C("received")) < 1e-6 * (1 + C("received"))).alias("rate_of_all")
    bounded = ((C("mean_latency_s") > 0) & (C("mean_latency_s") <= C("max_latency_s")) & (C("max_latency_s") <= seconds)).alias("latency_of_all")
    return J.health(metrics).select("received", "dropped", "processed", whole, bounded)


@query("n18_stream_rates")
def _(spark, d):
    _, metrics = J.monitored(detections(spark, d), F.lit(False), run_directory(spark, "rates"))
    return J.health(metrics)


@query("a22_topic_source", f"SELECT CAST(id AS VARCHAR) AS key, t AS topic FROM (SELECT id, {TOPIC_SQL} AS t FROM detections) WHERE regexp_matches(t, '^site/3(/.*)?$')")
def _(spark, d):
    return J.append(topics.subscribe(spark, _published(spark, d), "site/3/#").select("key", "topic"), "subscribe")


def _published(spark, d):
    path = run_directory(spark, "topic-files")
    t = V.detections(spark, d)
    tail = F.when(C("id") % 2 == 0, "/raw").otherwise("")
    t.select(F.concat(F.lit("site/"), (C("id") % 5).cast("string"), F.lit("/"), C("drone_type"), tail).alias("topic"), C("id").cast("string").alias("key"),
             F.to_json(F.struct("confidence")).alias("value"), C("ts").cast("timestamp").alias("ts")).write.json(path)
    return path


@query("a23_topic_sink", f"SELECT CAST(id AS VARCHAR) AS key, t AS topic FROM (SELECT id, {TOPIC_SQL} AS t FROM detections)")
def _(spark, d):
    out, state = run_directory(spark, "topic-out"), run_directory(spark, "topic-state")
    topics.publish(topics.subscribe(spark, _published(spark, d)), out, state).awaitTermination()
    return spark.read.schema("key string, topic string").json(out).select("key", "topic")


def _log(spark, d, part):
    """The detections as messages; ``part`` picks those of an even or odd number."""
    t = V.detections(spark, d).filter(C("id") % 2 == part)
    return t.select(F.concat(F.lit("site/"), (C("id") % 5).cast("string")).alias("topic"), C("id").cast("string").alias("key"), F.to_json(F.struct("confidence")).alias("value"), C("ts").cast("timestamp").alias("ts"))


@query("a24_replay_from_position", "SELECT CAST(id AS VARCHAR) AS key, id % 2 AS run FROM detections WHERE ts > TIMESTAMP '2024-01-15'")
def _(spark, d):
    home = run_directory(spark, "consumers")
    group = consumers.Group(spark, f"{home}/log", home, "late", start="2024-01-15 00:00:00")
    runs = []
    for part in (0, 1):  # the log grows between the runs of the consumer
        consumers.append(_log(spark, d, part), group.log)
        runs.append(group.deliver(f"2024-03-01 00:0{part}:00").select("key", F.lit(part).cast("long").alias("run")))
    return runs[0].unionByName(runs[1])


@query("a24_pending_and_claimed", """SELECT CAST(id AS VARCHAR) AS key, CASE WHEN id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS deliveries, id % 3 = 0 AND id % 5 <> 1 AS pending FROM detections WHERE id % 5 < 3""")
def _(spark, d):
    home = run_directory(spark, "consumers")
    names = [consumers.Group(spark, f"{home}/log", home, "workers", pattern=f"site/{k}") for k in range(3)]
    for part in (0, 1):
        consumers.append(_log(spark, d, part), names[0].log)
    rows = []
    for k, group in enumerate(names):
        group.name = f"workers-{k}"
        got = group.deliver("2024-03-01 00:00:00", members=("a", "b"))
        group.acknowledge(got.filter("cast(key as long) % 3 <> 0"))
        early = group.claim("b", "2024-03-01 00:00:30", idle_seconds=60)  # too early for any
        again = group.claim("b", "2024-03-01 00:02:00", idle_seconds=60)
        if k == 1:
            group.acknowledge(again)
        tries = got.select("key").unionByName(early.select("key")).unionByName(again.select("key")).groupBy("key").agg(F.count("*").alias("deliveries"))
        open_ = group.pending().filter("deliveries = 2 and member = 'b'").select("key", F.lit(True).alias("pending"))
        rows.append(tries.join(open_, "key", "left").select("key", "deliveries", F.coalesce("pending", F.lit(False)).alias("pending")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
