"""Registered queries: threat levels, rules, escalation and suppression."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions.numeric import rounded
from aeroband.operators import correlation, filters as P, geofence as G, rules as L, telemetry as T
from aeroband.plans import views as V
from aeroband.plans.places import MATCH, BAND, in_zone
from aeroband.plans.registry import query
from aeroband.plans.sequences import STEPS, dist_sql

C = F.col


@query("l1_threat_by_confidence", "SELECT id, CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS threat FROM detections")
def _(spark, d):
    return V.detections(spark, d).select("id", L.threat_by_confidence().alias("threat"))


@query("l2_threat_by_type", "SELECT id, CASE WHEN confidence > 0.8 AND drone_type IN ('click','view') THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END AS threat FROM detections")
def _(spark, d):
    return V.detections(spark, d).select("id", L.threat_by_type(listed=("click", "view")).alias("threat"))


@query("l3_scored_threat", """SELECT id, s AS score, CASE WHEN s >= 80 THEN 'CRITICAL' WHEN s >= 60 THEN 'HIGH' WHEN s >= 40 THEN 'MEDIUM' WHEN s >= 20 THEN 'LOW' ELSE 'NONE' END AS threat FROM
   (SELECT id, CAST(CASE WHEN drone_type = 'error' THEN 40 WHEN drone_type IN ('click','view') THEN 20 ELSE 0 END + trunc(confidence * 30)
     + CASE WHEN signal_strength > -30 THEN 20 WHEN signal_strength > -50 THEN 10 ELSE 0 END AS INTEGER) AS s FROM detections)""")
def _(spark, d):
    score = L.threat_score("confidence", "drone_type", "signal_strength", ("error",), ("click", "view"))
    return V.detections(spark, d).select("id", score.alias("score")).withColumn("threat", L.scored_threat("score"))


@query("l4_confidence_tiers", """SELECT id, CASE WHEN confidence >= 0.95 THEN 'critical' WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium'
   WHEN confidence >= 0.5 THEN 'low' WHEN confidence >= 0.3 THEN 'noise' ELSE 'none' END AS tier FROM detections""")
def _(spark, d):
    return V.detections(spark, d).select("id", L.confidence_tier().alias("tier"))


@query("l5_alert_severity", """SELECT id, CASE WHEN confidence >= 0.95 THEN 'CRITICAL' WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.70 THEN 'MEDIUM'
   WHEN confidence >= 0.50 THEN 'LOW' END AS severity FROM detections""")
def _(spark, d):
    return V.detections(spark, d).select("id", L.severity().alias("severity"))


def _facts(spark, d):
    """Detections with the flags the seed rules test."""
    return V.detections(spark, d).select("id", "ts", "emitter", "confidence", "in_restricted_zone", (C("snr") < 1.0).alias("jamming_detected"),
                                         (C("id") % 5).cast("int").alias("drone_count"))


RULES_SQL = """SELECT id, rule_id, rule_severity FROM (
   SELECT id, 'rule_high_confidence' AS rule_id, 'CRITICAL' AS rule_severity FROM detections WHERE confidence > 0.85
   UNION ALL SELECT id, 'rule_medium_confidence', 'ALERT' FROM detections WHERE confidence BETWEEN 0.7 AND 0.85
   UNION ALL SELECT id, 'rule_geofence', 'CRITICAL' FROM detections WHERE in_restricted_zone
   UNION ALL SELECT id, 'rule_jamming', 'EMERGENCY' FROM detections WHERE snr < 1
   UNION ALL SELECT id, 'rule_multiple_drones', 'CRITICAL' FROM detections WHERE id % 5 >= 3)"""


@query("l6_rule_evaluation", RULES_SQL)
def _(spark, d):
    return L.evaluate_rules(_facts(spark, d)).select("id", "rule_id", "rule_severity")


@query("l7_text_condition", "SELECT id FROM detections WHERE threat_level = 'HIGH' AND in_restricted_zone OR snr > 29.5")
def _(spark, d):
    df = V.detections(spark, d)
    return df.filter(L.text_condition("threat_level == 'HIGH' and in_restricted_zone or snr > 29.5", df.columns)).select("id")


@query("l8_multiple_emitters", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", CAST(count(DISTINCT emitter) AS BIGINT) AS emitters
   FROM detections GROUP BY 1, 2 HAVING count(DISTINCT emitter) >= 15""")
def _(spark, d):
    return L.multiple_emitters(V.detections(spark, d), "1 hour", 15)


@query("l9_cooldown_suppression", """WITH k AS (SELECT emitter, coalesce(category, 'none') AS category, list([[epoch_us(ts), id]] ORDER BY ts, id) AS v,
     max(CASE WHEN category = 'CAT-1' THEN 86400000000 WHEN category = 'CAT-2' THEN 10 * 86400000000 ELSE 3 * 86400000000 END) AS c FROM alerts GROUP BY 1, 2)
   SELECT emitter, category, CAST(unnest(list_reduce(v, lambda a, b: CASE WHEN b[1][1] - a[-1][1] >= c THEN list_concat(a, b) ELSE a END))[2] AS BIGINT) AS id FROM k""")
def _(spark, d):
    category = F.coalesce("category", F.lit("none"))
    seconds = F.when(category == "CAT-1", 86400).when(category == "CAT-2", 10 * 86400).otherwise(3 * 86400)
    base = V.alerts(spark, d).select("id", "ts", "emitter", category.alias("category"))
    return L.suppress(base, ["emitter", "category"], seconds, slice_seconds=15 * 86400).select("emitter", "category", "id")


@query("l10_escalation_schedule", """SELECT id, CAST(l.level AS INTEGER) AS level, ts + l.delay * INTERVAL 1 SECOND AS due_ts FROM alerts, (VALUES (1, 60), (2, 360), (3, 1560)) l(level, delay)
   WHERE ts + l.delay * INTERVAL 1 SECOND < coalesce(resolved_at, TIMESTAMP '2024-01-30 23:00:00')""")
def _(spark, d):
    return L.escalations(V.alerts(spark, d), F.array(F.lit(60), F.lit(300), F.lit(1200)), "2024-01-30 23:00:00")


@query("l11_frequency_escalation", """SELECT id FROM (SELECT id, count(*) OVER (PARTITION BY emitter ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) AS n FROM alerts) WHERE n >= 3""")
def _(spark, d):
    from aeroband.operators import ordered
    out = ordered.trailing(V.alerts(spark, d).select("id", "emitter", "ts"), "emitter", "ts", 259200, {"n": F.count("*")}, open_start=True)
    return out.filter(C("n") >= 3).select("id")


@query("l12_alert_life_cycle", """SELECT id AS alert_id, CASE WHEN resolved THEN 'resolve' WHEN escalation_level > 0 THEN 'escalate' WHEN acknowledged THEN 'acknowledge' ELSE 'create' END AS last_action,
   acknowledged, resolved, resolved_at, CAST(escalation_level AS BIGINT) AS escalation_level FROM alerts""")
def _(spark, d):
    a = V.alerts(spark, d)
    event = lambda action, ts, seq: F.struct(F.lit(action).alias("action"), ts.alias("ts"), F.lit(seq).alias("seq"))
    steps = F.array(event("create", C("ts"), 0), event("acknowledge", F.when(C("acknowledged"), C("ts")), 1), event("resolve", F.when(C("resolved"), C("resolved_at")), 9))
    raised = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.struct(
        F.lit("escalate").alias("action"), F.when(C("escalation_level") >= k, C("ts")).alias("ts"), (k + 1).alias("seq")))
    events = a.select(C("id").alias("alert_id"), F.explode(F.concat(steps, raised)).alias("e")).select("alert_id", "e.*").filter("ts is not null")
    return L.life_cycle(events)


@query("l13_condition_alerts", MATCH + f""" SELECT condition, id, severity FROM (SELECT 'no_remote_id' AS condition, id, 'HIGH' AS severity FROM detections WHERE id NOT IN (SELECT id FROM b)
   UNION ALL SELECT 'stale_data', id, 'MEDIUM' FROM rid_messages WHERE ts < TIMESTAMP '2024-01-30' - INTERVAL 5 SECOND
   UNION ALL SELECT DISTINCT 'geofence_violation', m.id, 'CRITICAL' FROM rid_messages m, zones WHERE active AND {in_zone('m.latitude', 'm.longitude')} AND {BAND.replace('{alt}', 'm.altitude')}
   UNION ALL SELECT 'operator_unauthorized', id, 'HIGH' FROM rid_messages WHERE operator_id NOT IN (SELECT 'OP-' || n_nationkey FROM nation))""")
def _(spark, d):
    from aeroband.plans.places import _registry
    det, msg = V.detections(spark, d), V.rid_messages(spark, d)
    stale = msg.filter(F.array_contains(P.message_errors("2024-01-30 00:00:00", 5), "stale"))
    return L.condition_alerts({
        "no_remote_id": correlation.without_message(det, msg), "stale_data": stale,
        "geofence_violation": G.positions_in_zones(msg, V.zones(spark, d).filter("active")).select("id").distinct(),
        "operator_unauthorized": correlation.unregistered(msg, _registry(spark, d))})


@query("l14_spoofing_score", f"""WITH s AS (SELECT *, {dist_sql('plat', 'plon', 'latitude', 'longitude')} / ((epoch_us(ts) - epoch_us(pts)) / 1e6) AS v,
     (altitude - palt) / ((epoch_us(ts) - epoch_us(pts)) / 1e6) AS vs, (speed - pspeed) / ((epoch_us(ts) - epoch_us(pts)) / 1e6) AS acc FROM ({STEPS})),
   k AS (SELECT transport, rssi, epoch_us(ts) // 3600000000 AS slot, count(DISTINCT uas_id) AS ids FROM rid_messages GROUP BY 1, 2, 3),
   p AS (SELECT s.id, CASE WHEN pts IS NOT NULL AND v > 50 THEN 0.35 ELSE 0 END + CASE WHEN pts IS NOT NULL AND (abs(v - speed) > 50 OR abs(acc) > 20) THEN 0.25 ELSE 0 END
     + CASE WHEN coalesce(abs(vs) > 10, false) OR altitude > 5000 THEN 0.15 ELSE 0 END + CASE WHEN k.ids > 1 THEN 0.15 ELSE 0 END + CASE WHEN s.rssi NOT BETWEEN -100 AND -20 THEN 0.10 ELSE 0 END AS score
     FROM s JOIN k ON s.transport = k.transport AND s.rssi = k.rssi AND epoch_us(s.ts) // 3600000000 = k.slot)
   SELECT id, round(score::DOUBLE, 4) AS spoofing_score, CASE WHEN score >= 0.7 - 1e-9 THEN 'spoofed' WHEN score >= 0.4 - 1e-9 THEN 'suspicious' ELSE 'clean' END AS verdict FROM p""")
def _(spark, d):
    return rounded(L.spoofing_scores(V.rid_messages(spark, d)).select("id", "spoofing_score", "verdict"), 4)


@query("l15_deduplicate_by_id", "SELECT DISTINCT detection_id FROM (SELECT detection_id FROM alerts UNION ALL SELECT detection_id FROM alerts)")
def _(spark, d):
    a = V.alerts(spark, d).select("detection_id")
    return a.unionAll(a).dropDuplicates(["detection_id"])


@query("l16_class_threat", """SELECT vec_id AS id, CAST(CASE label WHEN 0 THEN 0.0 WHEN 1 THEN 50.0 WHEN 2 THEN 25.0 WHEN 3 THEN 50.0 WHEN 4 THEN 20.0 WHEN 5 THEN 40.0 WHEN 6 THEN 50.0 WHEN 7 THEN 55.0
   WHEN 8 THEN 17.5 WHEN 9 THEN 15.0 END AS DOUBLE) AS threat FROM embeddings""")
def _(spark, d):
    from aeroband.session import table
    return table(spark, d, "embeddings").select(C("vec_id").alias("id"), F.round(L.class_threat("label"), 6).alias("threat"))


@query("l17_temporal_consistency", """SELECT id, CAST(n AS INTEGER) AS features FROM (SELECT id, (SELECT count(DISTINCT b.drone_type) FROM detections b WHERE b.emitter = a.emitter
     AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 14400000000 AND epoch_us(a.ts)) AS n FROM detections a) WHERE n >= 3""")
def _(spark, d):
    return L.consistent(V.detections(spark, d).select("id", "emitter", "ts", "drone_type"), "drone_type", 14400).select("id", "features")
