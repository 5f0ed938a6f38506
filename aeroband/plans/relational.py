"""Registered queries: projections, predicates, joins, aggregates, order and paging."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from aeroband.functions import timing
from aeroband.functions.numeric import rounded
from aeroband.operators import filters as P, ordered, relational as R
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.session import spread, table

AS_OF = "2024-01-20 12:00:00"
C = F.col


def simple(name, view, cols, cond, where):
    """A filter of one view; ``cond`` builds the predicate when the query runs."""
    sel = ", ".join(cols)

    @query(name, f"SELECT {sel} FROM {view} WHERE {where}")
    def _(spark, d):
        return getattr(V, view)(spark, d).filter(cond()).select(*cols)


# ------------------------------------------------------------------ projections
@query("b1_select_columns", "SELECT id, ts, drone_type FROM detections")
def _(spark, d):
    return R.project(V.detections(spark, d), "id", "ts", "drone_type")


@query("b2_select_alias", "SELECT id, drone_type AS kind, emitter AS track FROM detections")
def _(spark, d):
    return R.project(V.detections(spark, d), "id", kind="drone_type", track="emitter")


@query("b3_select_all", "SELECT * FROM alerts")
def _(spark, d):
    return R.project(V.alerts(spark, d))


@query("b4_distinct", "SELECT DISTINCT drone_type, threat_level FROM detections")
def _(spark, d):
    return R.project(V.detections(spark, d), "drone_type", "threat_level").distinct()


@query("b5_distinct_column", "SELECT DISTINCT uas_id FROM rid_messages")
def _(spark, d):
    return R.distinct_values(V.rid_messages(spark, d), "uas_id")


@query("b6_table_alias", "SELECT d.id, d.source FROM detections d WHERE d.confidence >= 0.5")
def _(spark, d):
    return V.detections(spark, d).alias("d").filter(C("d.confidence") >= 0.5).select("d.id", "d.source")


@query("b7_case_in_aggregate",
       "SELECT drone_type, CAST(SUM(CASE WHEN threat_level = 'HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high FROM detections GROUP BY 1")
def _(spark, d):
    return V.detections(spark, d).groupBy("drone_type").agg(
        F.sum(F.when(C("threat_level") == "HIGH", 1).otherwise(0)).alias("high"))


# ------------------------------------------------------------------- predicates
ID = ["id"]
simple("c1_equal", "detections", ID, lambda: P.equal("drone_type", "click"), "drone_type = 'click'")
simple("c2_not_equal", "alerts", ID, lambda: P.not_equal("severity", "LOW"), "severity != 'LOW'")
simple("c3_greater", "detections", ID, lambda: C("snr") > 15, "snr > 15")
simple("c4_greater_equal", "detections", ID, lambda: C("snr") >= 15, "snr >= 15")
simple("c5_less", "detections", ID, lambda: C("altitude") < 100, "altitude < 100")
simple("c6_less_equal", "detections", ID, lambda: C("altitude") <= 100, "altitude <= 100")
simple("c7_like", "detections", ID, lambda: P.like("drone_type", "%up"), "drone_type LIKE '%up'")
simple("c8_ilike", "detections", ID, lambda: P.ilike("drone_type", "PUR%"), "drone_type ILIKE 'PUR%'")
simple("c9_in", "detections", ID, lambda: P.one_of("drone_type", ["click", "view"]), "drone_type IN ('click','view')")
simple("c10_not_in", "alerts", ID, lambda: P.none_of("severity", ["LOW", "HIGH"]), "severity NOT IN ('LOW','HIGH')")
simple("c11_between", "detections", ID, lambda: P.between("snr", 5, 10), "snr BETWEEN 5 AND 10")
simple("c12_is_null", "detections", ID, lambda: C("remote_id").isNull(), "remote_id IS NULL")
simple("c13_is_not_null", "detections", ID, lambda: P.has_value("remote_id"), "remote_id IS NOT NULL")
simple("c14_json_contains", "detections", ID, lambda: P.json_equals("metadata", "$.k", 42),
       "json_extract_string(metadata, '$.k') = '42'")
simple("c14_json_text_contains", "detections", ID, lambda: P.text_contains("metadata", '"k": 4'),
       "contains(metadata, '\"k\": 4')")
simple("c15_and_group", "detections", ID, lambda: P.all_of(C("snr") > 10, C("threat_level") == "HIGH"),
       "snr > 10 AND threat_level = 'HIGH'")
simple("c16_or_group", "detections", ID,
       lambda: P.all_of(C("snr") > 10, P.any_of(C("threat_level") == "HIGH", C("source") == "scanner-2")),
       "snr > 10 AND (threat_level = 'HIGH' OR source = 'scanner-2')")
simple("c17_date_range", "detections", ID,
       lambda: P.date_range("ts", "2024-01-05 00:00:00", "2024-01-07 00:00:00"),
       "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07'")
simple("c18_last_hours", "detections", ID, lambda: timing.last("ts", AS_OF, 36, "HOUR"),
       f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 36 HOUR AND ts <= TIMESTAMP '{AS_OF}'")
PRESET_SQL = {
    "last_hour": f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR", "last_24h": f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR",
    "last_7d": f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY", "last_30d": f"ts >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY",
    "this_week": f"ts >= date_trunc('week', TIMESTAMP '{AS_OF}')",
    "this_month": f"ts >= date_trunc('month', TIMESTAMP '{AS_OF}')",
}


@query("c19_time_presets", "SELECT " + ", ".join(
    f"CAST(COUNT(*) FILTER (WHERE {s} AND ts <= TIMESTAMP '{AS_OF}') AS BIGINT) AS {n}" for n, s in PRESET_SQL.items())
    + " FROM detections")
def _(spark, d):
    return V.detections(spark, d).agg(*[F.count_if(timing.preset("ts", n, AS_OF)).alias(n) for n in timing.TIME_PRESETS])


@query("c20_bound_parameters", "SELECT id, confidence FROM detections WHERE drone_type = 'view' AND confidence >= 0.25")
def _(spark, d):
    return R.bound_sql(V.detections(spark, d),
                       "SELECT id, confidence FROM {src} WHERE drone_type = :kind AND confidence >= :low", kind="view", low=0.25)


simple("c21_threat_and_type", "detections", ID, lambda: P.detection_filters(drone_type="error", threat_level="HIGH"),
       "drone_type = 'error' AND threat_level = 'HIGH'")
simple("c22_confidence_interval", "detections", ID, lambda: P.confidence_between(0.4, 1.0), "confidence >= 0.4")
simple("c23_has_remote_id", "detections", ["id", "remote_id"], lambda: P.detection_filters(has_remote_id=True),
       "remote_id IS NOT NULL")
simple("c24_known_high_confidence", "detections", ID, P.known_emitters, "confidence >= 0.8 AND drone_type != 'unknown'")
simple("c25_active_alerts", "alerts", ID, P.active_alerts, "NOT acknowledged AND NOT resolved")
simple("c26_severity_escalation", "alerts", ID,
       lambda: P.all_of(P.alert_filters(severity="HIGH"), C("escalation_level") >= 2), "severity = 'HIGH' AND escalation_level >= 2")
simple("c27_spectrum_filters", "detections", ID, lambda: P.spectrum_filters(2.41e9, 2.45e9, 12.0),
       "frequency >= 2.41e9 AND frequency <= 2.45e9 AND snr >= 12")
simple("c28_recording_filters", "recordings", ID,
       lambda: P.recording_filters(file_format="npy", start="1996-01-01", end="1999-12-31", min_megabytes=100),
       "file_format = 'npy' AND start_time >= TIMESTAMP '1996-01-01' AND start_time <= TIMESTAMP '1999-12-31' "
       "AND file_size_bytes >= 104857600")
simple("c28_recent_recordings", "recordings", ID,
       lambda: P.recording_filters(as_of="1998-06-01 00:00:00", recent_days=90),
       "start_time >= TIMESTAMP '1998-06-01' - INTERVAL 90 DAY AND start_time <= TIMESTAMP '1998-06-01'")
simple("c29_detection_filter_set", "detections", ID,
       lambda: P.detection_filters("click", "LOW", 0.1, 0.5, "scanner-3", True, False),
       "drone_type='click' AND threat_level='LOW' AND confidence >= 0.1 AND confidence <= 0.5 AND source='scanner-3' "
       "AND remote_id IS NOT NULL AND NOT in_restricted_zone")
simple("c30_frequency_window", "detections", ID, lambda: P.between("frequency", 2.42e9, 2.43e9),
       "frequency BETWEEN 2.42e9 AND 2.43e9")
simple("c31_alert_filter_set", "alerts", ID, lambda: P.alert_filters("MEDIUM", False, True, "CAT-2"),
       "severity='MEDIUM' AND NOT acknowledged AND resolved AND category='CAT-2'")


@query("c32_id_filters", """SELECT id, drone_type FROM detections WHERE contains(lower(drone_type), 'ew')
       AND id IN (SELECT detection_id FROM alerts UNION ALL SELECT id FROM rid_messages)
       AND id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def _(spark, d):
    wanted = V.alerts(spark, d).select(C("detection_id").alias("id")).union(V.rid_messages(spark, d).select("id"))
    banned = table(spark, d, "orders").filter(C("o_orderstatus") == "P").select(C("o_orderkey").alias("id"))
    return R.id_filters(V.detections(spark, d), "id", "EW", "drone_type", wanted, banned).select("id", "drone_type")


simple("c33_table_view_filter", "detections", ID,
       lambda: P.table_view_filter("RID-1", threat="LOW", start="2024-01-03", min_confidence=0.2),
       "(contains(lower(CAST(id AS VARCHAR)),'rid-1') OR contains(lower(drone_type),'rid-1') OR "
       "coalesce(contains(lower(remote_id),'rid-1'), false)) AND threat_level='LOW' AND ts >= TIMESTAMP '2024-01-03' "
       "AND coalesce(confidence,0) >= 0.2")
simple("c34_minimum_threat", "detections", ID, lambda: P.at_least_threat("threat_level", "MEDIUM"),
       "threat_level IN ('MEDIUM','HIGH','CRITICAL')")
simple("c35_bounding_box", "detections", ID, lambda: P.bounding_box(37.75, -122.45, 37.80, -122.40),
       "latitude BETWEEN 37.75 AND 37.80 AND longitude BETWEEN -122.45 AND -122.40")
simple("c36_great_circle_radius", "detections", ID, lambda: P.within_radius(37.7749, -122.4194, 3.0),
       "6371.0 * acos(least(1.0, greatest(-1.0, cos(radians(37.7749)) * cos(radians(latitude)) * "
       "cos(radians(longitude) - radians(-122.4194)) + sin(radians(37.7749)) * sin(radians(latitude))))) <= 3.0")
simple("c37_rssi_gate", "rid_messages", ID, P.rssi_gate,
       "rssi BETWEEN -100 AND -20 AND rssi >= CASE transport WHEN 'ble' THEN -90 ELSE -85 END")


@query("c38_message_validation", """
  SELECT id, CASE WHEN ts < TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 10 SECOND THEN 'stale' ELSE '' END AS errors
  FROM rid_messages""")
def _(spark, d):
    return V.rid_messages(spark, d).select("id", F.array_join(P.message_errors("2024-01-15 12:00:00"), ",").alias("errors"))


simple("c39_text_search_detections", "detections", ID,
       lambda: P.matches_all_terms("Click HIGH", "id", "drone_type", "threat_level", "remote_id"),
       "drone_type = 'click' AND threat_level = 'HIGH'")


@query("c39_text_search_documents", r"""SELECT doc_id FROM documents
  WHERE list_contains(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), 'the')
    AND list_contains(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), 'that')""")
def _(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text")).filter(P.matches_all_terms("the THAT", "text")).select("doc_id")


# ------------------------------------------------------------------------ joins
@query("d1_inner_join", """SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey""")
def _(spark, d):
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return (o.join(c, C("o_custkey") == C("c_custkey")).join(n, C("c_nationkey") == C("n_nationkey"))
             .select("o_orderkey", "c_name", "n_name"))


JOIN_SQL = "SELECT r.id AS recording, s.id AS session, s.site FROM recordings r {} JOIN recording_sessions s ON r.session_id = s.id"


def _join(spark, d, how):
    r, s = V.recordings(spark, d).alias("r"), V.recording_sessions(spark, d).alias("s")
    return r.join(s, C("r.session_id") == C("s.id"), how).select(C("r.id").alias("recording"), C("s.id").alias("session"), "s.site")


query("d2_left_join", JOIN_SQL.format("LEFT"))(lambda spark, d: _join(spark, d, "left"))
query("d3_right_join", JOIN_SQL.format("RIGHT"))(lambda spark, d: _join(spark, d, "right"))
query("d4_full_join", JOIN_SQL.format("FULL"))(lambda spark, d: _join(spark, d, "full"))


@query("d5_theta_join", """
  SELECT p.p_partkey, z.band FROM part p JOIN (
    SELECT n_nationkey AS band, 895 + n_nationkey * 8.0 AS lo, 905 + n_nationkey * 8.0 AS hi FROM nation) z
  ON p.p_retailprice >= z.lo AND p.p_retailprice < z.hi""")
def _(spark, d):
    bands = table(spark, d, "nation").select(
        C("n_nationkey").alias("band"), (895 + C("n_nationkey") * 8.0).alias("lo"), (905 + C("n_nationkey") * 8.0).alias("hi"))
    return R.interval_join(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice",
                           bands, "lo", "hi", cell=10.0, closed=False).select("p_partkey", "band")


@query("d6_alerts_with_detections", """SELECT a.id, a.severity, d.drone_type, d.threat_level FROM alerts a
       LEFT JOIN detections d ON d.id = a.detection_id""")
def _(spark, d):
    return R.alerts_with_detections(V.alerts(spark, d), V.detections(spark, d)).select("id", "severity", "drone_type", "threat_level")


@query("d19_label_lookup", """SELECT p.id, n.n_name AS label_name, n.n_regionkey AS category FROM predictions p
       JOIN nation n ON p.predicted = n.n_nationkey""")
def _(spark, d):
    names = table(spark, d, "nation").select(C("n_nationkey").alias("predicted"), C("n_name").alias("label_name"),
                                             C("n_regionkey").alias("category"))
    return R.lookup(V.predictions(spark, d), names, "predicted", "inner").select("id", "label_name", "category")


@query("d20_threat_ordinals", """SELECT id, threat_level, CASE threat_level WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2
       WHEN 'LOW' THEN 1 END AS priority FROM detections""")
def _(spark, d):
    return V.detections(spark, d).select("id", "threat_level", P.threat_ordinal("threat_level").alias("priority"))


@query("d23_live_state_merge", """
  SELECT coalesce(c.emitter, u.emitter) AS emitter, coalesce(u.threat_level, c.threat_level) AS threat_level,
         c.total, coalesce(u.altitude, c.altitude) AS altitude
  FROM (SELECT emitter, max(threat_level) AS threat_level, CAST(count(*) AS BIGINT) AS total, max(altitude) AS altitude
        FROM detections WHERE threat_level <> 'HIGH' GROUP BY 1) c
  FULL JOIN (SELECT emitter, CASE WHEN max(altitude) > 300 THEN 'HIGH' END AS threat_level, max(altitude) AS altitude
        FROM rid_messages GROUP BY 1) u ON c.emitter = u.emitter""")
def _(spark, d):
    current = V.detections(spark, d).filter(C("threat_level") != "HIGH").groupBy("emitter").agg(
        F.max("threat_level").alias("threat_level"), F.count("*").alias("total"), F.max("altitude").alias("altitude"))
    updates = V.rid_messages(spark, d).groupBy("emitter").agg(
        F.when(F.max("altitude") > 300, "HIGH").alias("threat_level"), F.max("altitude").alias("altitude"))
    return R.merge_live(current, updates, "emitter")


@query("d24_id_list_semi", "SELECT id FROM detections WHERE id IN (SELECT detection_id FROM alerts WHERE severity = 'HIGH')")
def _(spark, d):
    ids = V.alerts(spark, d).filter(C("severity") == "HIGH").select(C("detection_id").alias("id"))
    return P.keep_ids(V.detections(spark, d).select("id"), ids, "id")


@query("d24_id_list_anti", "SELECT id FROM detections WHERE id NOT IN (SELECT detection_id FROM alerts)")
def _(spark, d):
    return P.drop_ids(V.detections(spark, d).select("id"), V.alerts(spark, d).select(C("detection_id").alias("id")), "id")


# ------------------------------------------------------------------- aggregates
@query("e1_to_e6_aggregates", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(remote_id) AS BIGINT) AS with_id,
   round(sum(snr), 4) AS sum_snr, round(avg(confidence), 6) AS avg_confidence, min(altitude) AS min_altitude,
   max(altitude) AS max_altitude FROM detections""")
def _(spark, d):
    return V.detections(spark, d).agg(
        F.count("*").alias("n"), F.count("remote_id").alias("with_id"), F.round(F.sum("snr"), 4).alias("sum_snr"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.min("altitude").alias("min_altitude"),
        F.max("altitude").alias("max_altitude"))


@query("e7_group_concat", """SELECT drone_type, string_agg(source, ',' ORDER BY source) AS sources
       FROM (SELECT DISTINCT drone_type, source FROM detections) GROUP BY 1""")
def _(spark, d):
    return R.concat_group(V.detections(spark, d), ["drone_type"], "source", "sources")


@query("e8_group_by", """SELECT drone_type, threat_level, CAST(count(*) AS BIGINT) AS n, round(avg(snr), 6) AS avg_snr
       FROM detections GROUP BY 1, 2""")
def _(spark, d):
    return V.detections(spark, d).groupBy("drone_type", "threat_level").agg(
        F.count("*").alias("n"), F.round(F.avg("snr"), 6).alias("avg_snr"))


@query("e9_having", """SELECT emitter, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS conf FROM detections
       GROUP BY 1 HAVING count(*) > 60 AND avg(confidence) > 0.4""")
def _(spark, d):
    return (V.detections(spark, d).groupBy("emitter").agg(F.count("*").alias("n"), F.avg("confidence").alias("conf"))
            .filter((C("n") > 60) & (C("conf") > 0.4)).withColumn("conf", F.round("conf", 6)))


@query("e10_count_twin", """SELECT id, total FROM (SELECT id, ts, CAST(count(*) OVER () AS BIGINT) AS total FROM detections
       WHERE threat_level = 'HIGH') ORDER BY ts DESC, id DESC LIMIT 20""")
def _(spark, d):
    base = V.detections(spark, d).filter(C("threat_level") == "HIGH")
    return R.with_total(base, R.page(base, 1, 20, C("ts").desc(), C("id").desc())).select("id", "total")


@query("e11_threat_summary", """SELECT CAST(count(*) AS BIGINT) AS total,
  CAST(sum(CASE WHEN threat_level='HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high,
  CAST(sum(CASE WHEN threat_level='MEDIUM' THEN 1 ELSE 0 END) AS BIGINT) AS medium,
  CAST(sum(CASE WHEN threat_level='LOW' THEN 1 ELSE 0 END) AS BIGINT) AS low,
  round(avg(confidence), 6) AS avg_confidence FROM detections""")
def _(spark, d):
    from aeroband.operators.analytics import threat_summary
    return rounded(threat_summary(V.detections(spark, d)))


# --------------------------------------------------------------- order and paging
@query("i1_order_by", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderpriority").orderBy(
        C("o_orderpriority").asc(), C("o_orderkey").desc())


@query("i2_limit", "SELECT id, snr FROM detections ORDER BY snr DESC, id LIMIT 50")
def _(spark, d):
    return V.detections(spark, d).select("id", "snr").orderBy(C("snr").desc(), "id").limit(50)


@query("i3_offset", "SELECT id, snr FROM detections ORDER BY snr DESC, id LIMIT 25 OFFSET 100")
def _(spark, d):
    return V.detections(spark, d).select("id", "snr").orderBy(C("snr").desc(), "id").offset(100).limit(25)


@query("i4_page_number", "SELECT id, ts FROM detections ORDER BY ts DESC, id DESC LIMIT 50 OFFSET 150")
def _(spark, d):
    return R.page(V.detections(spark, d).select("id", "ts"), 4, 50, C("ts").desc(), C("id").desc())


@query("i5_page_envelope", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(3 AS BIGINT) AS page, CAST(50 AS BIGINT) AS page_size,
   CAST(ceil(count(*) / 50.0) AS BIGINT) AS total_pages, 3 < ceil(count(*) / 50.0) AS has_next, true AS has_prev FROM detections""")
def _(spark, d):
    return R.page_envelope(V.detections(spark, d), 3, 50)


@query("i6_cursor_page", """SELECT id, ts FROM detections WHERE ts < TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND id < 5000)
   ORDER BY ts DESC, id DESC LIMIT 40""")
def _(spark, d):
    return R.after_cursor(V.detections(spark, d).select("id", "ts"), "ts", "id", "2024-01-10 00:00:00", 5000, 40)


@query("i7_top_k", """SELECT emitter, CAST(count(*) AS BIGINT) AS n FROM detections GROUP BY 1 ORDER BY n DESC, emitter LIMIT 20""")
def _(spark, d):
    return V.detections(spark, d).groupBy("emitter").agg(F.count("*").alias("n")).orderBy(C("n").desc(), "emitter").limit(20)


@query("i8_sort_nulls_as_zero", """SELECT id, escalation_level, coalesce(CASE WHEN resolved THEN escalation_level END, 0) AS key FROM alerts""")
def _(spark, d):
    key = F.coalesce(F.when(C("resolved"), C("escalation_level")), F.lit(0))
    return V.alerts(spark, d).select("id", "escalation_level", key.alias("key")).orderBy(C("key").desc(), "id")


@query("i9_newest_buffer", """SELECT emitter, id, ts FROM (SELECT *, row_number() OVER (PARTITION BY emitter ORDER BY ts DESC, id DESC) AS r
   FROM detections) WHERE r <= 20""")
def _(spark, d):
    base = V.detections(spark, d).select("emitter", "id", "ts")
    return ordered.top_per_key(base, "emitter", [C("ts").desc(), C("id").desc()], 20,
                               spread=ordered.time_slice("ts", 86400)).drop("row_no")


# ------------------------------------------------------------------ set operations
@query("j1_concatenate", """SELECT 'alert' AS kind, id, ts, severity FROM alerts UNION ALL
   SELECT 'rid' AS kind, id, ts, NULL AS severity FROM rid_messages""")
def _(spark, d):
    return R.union_all([V.alerts(spark, d).select(F.lit("alert").alias("kind"), "id", "ts", "severity"),
                        V.rid_messages(spark, d).select(F.lit("rid").alias("kind"), "id", "ts")])


@query("j2_distinct_sorted", "SELECT DISTINCT drone_type FROM detections")
def _(spark, d):
    return R.distinct_values(V.detections(spark, d), "drone_type").orderBy("drone_type")


@query("j3_key_union", """SELECT coalesce(a.emitter, b.emitter) AS emitter, coalesce(a.n, 0) AS alerts, coalesce(b.n, 0) AS messages
   FROM (SELECT emitter, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1) a
   FULL JOIN (SELECT emitter, CAST(count(*) AS BIGINT) AS n FROM rid_messages GROUP BY 1) b ON a.emitter = b.emitter""")
def _(spark, d):
    a = V.alerts(spark, d).groupBy("emitter").agg(F.count("*").alias("alerts"))
    b = V.rid_messages(spark, d).groupBy("emitter").agg(F.count("*").alias("messages"))
    return a.join(b, "emitter", "full").fillna(0, ["alerts", "messages"])
