"""Registered queries: data quality, logs, privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions.numeric import rounded
from aeroband.operators import logs as G, ordered, privacy, quality as Q
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.session import table

C = F.col


def doubled(spark, d):
    """Order keys with the lines that refer to them, so keys repeat."""
    return table(spark, d, "lineitem").select(C("l_orderkey").alias("k"), C("l_linenumber").alias("n"))


@query("q1_key_uniqueness", "SELECT l_orderkey AS k, l_linenumber AS n, CAST(count(*) AS BIGINT) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return Q.duplicate_keys(doubled(spark, d), "k", "n")


@query("q2_referential_integrity", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def _(spark, d):
    live = table(spark, d, "orders").filter(C("o_orderstatus") != "P")
    return Q.orphans(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), live, "l_orderkey", "o_orderkey")


@query("q3_not_null_and_range", """SELECT id, trim(CASE WHEN id % 9 = 0 THEN 'missing_type,' ELSE '' END || CASE WHEN confidence * 1.2 > 1 THEN 'confidence_range' ELSE '' END, ',') AS faults FROM detections
   WHERE id % 9 = 0 OR confidence * 1.2 > 1""")
def _(spark, d):
    df = V.detections(spark, d).select("id", F.when(C("id") % 9 != 0, C("drone_type")).alias("drone_type"), (C("confidence") * 1.2).alias("confidence"))
    return df.withColumn("f", Q.detection_faults()).filter(F.size("f") > 0).select("id", F.array_join("f", ",").alias("faults"))


@query("q4_signature_validation", """SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size * 1e6 < 10e6 THEN 'frequency_low' END, CASE WHEN p_size % 7 = 0 THEN 'band_order' END,
     CASE WHEN p_retailprice > 1000 THEN 'bandwidth_high' END, CASE WHEN p_size / 50.0 < 0.5 THEN 'confidence_low' END], lambda x: x IS NOT NULL), ',') AS faults FROM part""")
def _(spark, d):
    low = C("p_size") * 1e6
    s = table(spark, d, "part").select(
        "p_partkey", C("p_brand").alias("manufacturer"), C("p_name").alias("model"),
        F.array(F.struct(low.alias("min_freq"), F.when(C("p_size") % 7 == 0, low).otherwise(low + 1e6).alias("max_freq"))).alias("bands"),
        (C("p_retailprice") * 1e5).alias("bandwidth"), (C("p_size") / 50.0).alias("confidence_threshold"))
    return s.select("p_partkey", F.array_join(Q.signature_faults(), ",").alias("faults"))


@query("q5_polygon_validation", """SELECT zone_id, CASE WHEN zone_id % 3 = 0 THEN '' WHEN zone_id % 3 = 1 THEN 'not_closed' ELSE 'too_few_points' END AS faults FROM zones""")
def _(spark, d):
    from aeroband.operators.geofence import closed
    z = V.zones(spark, d)
    three = F.concat(F.slice("ring", 1, 2), F.slice("ring", 1, 1))
    ring = F.when(C("zone_id") % 3 == 0, closed("ring")).when(C("zone_id") % 3 == 1, C("ring")).otherwise(three)
    return z.select("zone_id", F.array_join(Q.polygon_faults(F.array(ring)), ",").alias("faults"))


@query("q6_date_range_validity", "SELECT id FROM alerts WHERE resolved_at IS NULL OR resolved_at < ts + INTERVAL 10 MINUTE")
def _(spark, d):
    late = F.coalesce(C("resolved_at") >= C("ts") + F.expr("INTERVAL 10 MINUTES"), F.lit(False))
    return V.alerts(spark, d).filter(~late).select("id")


@query("q7_capture_integrity", """SELECT vec_id, trim(CASE WHEN (len(embedding) * 4 + vec_id % 2) % 8 <> 0 THEN 'not_multiple_of_8,' ELSE '' END || CASE WHEN vec_id % 5 = 0 THEN 'no_sidecar' ELSE '' END, ',') AS faults FROM embeddings""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(
        "vec_id", (F.size("embedding") * 4 + C("vec_id") % 2).alias("size_bytes"), (C("vec_id") % 5 != 0).alias("has_sidecar"),
        F.size(F.filter("embedding", lambda x: F.isnan(x) | x.isNull())).alias("bad_values"))
    return e.select("vec_id", F.array_join(Q.capture_faults(), ",").alias("faults"))


@query("q8_capture_content", """WITH p AS (SELECT frame_id, 10 * log10(avg(i*i+q*q) + 1e-12) AS power_db, avg(CASE WHEN sqrt(i*i+q*q) > 0.3 THEN 1.0 ELSE 0.0 END) AS clip FROM iq_samples GROUP BY 1)
   SELECT frame_id, round(power_db, 6) AS power_db, round(clip::DOUBLE, 6) AS clipping_share, CASE WHEN clip >= 0.01 THEN 'clipping' ELSE '' END AS faults FROM p""")
def _(spark, d):
    from aeroband.functions import arrays as X, numeric
    f = V.iq_frames(spark, d).select("frame_id", X.power("i", "q").alias("p")).select(
        "frame_id", numeric.power_db(X.mean("p")).alias("power_db"), (F.size(F.filter("p", lambda x: F.sqrt(x) > 0.3)) / F.size("p")).alias("clipping_share"))
    return rounded(f.select("frame_id", "power_db", "clipping_share", F.array_join(Q.content_faults(), ",").alias("faults")))


@query("q9_query_parameter_ranges", """SELECT id, array_to_string(list_filter([CASE WHEN id % 4 = 0 THEN 'time_order' END, CASE WHEN frequency - 2.35e9 < 70e6 THEN 'low_frequency' END,
     CASE WHEN frequency + 3.55e9 > 6e9 THEN 'high_frequency' END], lambda x: x IS NOT NULL), ',') AS faults FROM detections""")
def _(spark, d):
    p = V.detections(spark, d).select("id", C("ts").alias("a"), (C("ts") + F.when(C("id") % 4 == 0, F.expr("INTERVAL 0 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR"))).alias("b"),
                                      (C("frequency") - 2.35e9).alias("lo"), (C("frequency") + 3.55e9).alias("hi"))
    return p.select("id", F.array_join(Q.query_faults("a", "b", "lo", "hi"), ",").alias("faults"))


# --------------------------------------------------------------------------------- logs
LOG = r"""SELECT line_no, line, category, regexp_extract(line, '\] \[([A-Z]+) *\] \[', 1) AS level, regexp_extract(line, '\] \[([^\]]*)\] latency', 1) AS logger,
   CAST(src_ts AS TIMESTAMP) AS src_ts, date_trunc('second', src_ts) AS ts, CAST(regexp_extract(line, 'latency=([0-9]+)', 1) AS DOUBLE) AS latency FROM log_lines"""


def _parsed(spark, d):
    return G.parse_text(V.log_lines(spark, d))


@query("u1_log_parse", f"SELECT line_no, level, logger, 'latency=' || CAST(latency AS INTEGER) || ' ms' AS message, ts FROM ({LOG})")
def _(spark, d):
    return _parsed(spark, d).select("line_no", "level", "logger", "message", "ts")


@query("u1_json_log_parse", f"""SELECT line_no, level, logger, CAST(line_no AS VARCHAR) AS extra_id FROM ({LOG})""")
def _(spark, d):
    j = _parsed(spark, d).select("line_no", F.to_json(F.struct("level", "logger", "message", C("line_no").cast("string").alias("detection_id"))).alias("line"))
    return G.parse_json(j.select(C("line_no").alias("_n"), "line")).select(
        C("_n").alias("line_no"), "level", "logger", F.element_at("extra", F.lit("detection_id")).alias("extra_id"))


@query("u1_access_log_parse", "SELECT page_id, 'GET' AS method, url AS path, CAST(200 + page_id % 5 AS INTEGER) AS status, len(html)::BIGINT AS bytes FROM pages")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(
        F.lit('10.0.0.1 - admin [15/Jan/2024:14:30:22 +0000] "GET '), C("url"), F.lit(' HTTP/1.1" '), (200 + C("page_id") % 5).cast("string"), F.lit(" "),
        F.length("html").cast("string"), F.lit(' "http://localhost/" "Mozilla/5.0"')).alias("line"))
    return G.parse_access(p).select("page_id", "method", "path", "status", "bytes")


@query("u2_log_search", f"SELECT line_no FROM ({LOG}) WHERE level = 'ERROR' AND contains(lower(line), 'mod3') AND ts >= TIMESTAMP '2024-01-20' - INTERVAL 240 HOUR AND ts <= TIMESTAMP '2024-01-20'")
def _(spark, d):
    return G.search(_parsed(spark, d), "2024-01-20 00:00:00", "ERROR", "MOD3", 240).select("line_no")


@query("u3_error_rate", f"""WITH h AS (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM ({LOG}) WHERE level = 'ERROR' GROUP BY 1)
   SELECT CAST(sum(n) AS BIGINT) AS total, round(avg(n), 6) AS mean_per_hour, (SELECT hour FROM h ORDER BY n DESC, hour LIMIT 1) AS peak_hour, max(n) AS peak_count FROM h""")
def _(spark, d):
    return rounded(G.error_rate(_parsed(spark, d)))


@query("u4_error_kinds", f"SELECT logger, CAST(count(*) AS BIGINT) AS n FROM ({LOG}) WHERE level = 'ERROR' GROUP BY 1")
def _(spark, d):
    return G.error_kinds(_parsed(spark, d))


@query("u5_latency_from_messages", f"""WITH s AS (SELECT latency, row_number() OVER (ORDER BY latency) - 1 AS i, count(*) OVER () AS n FROM ({LOG}))
   SELECT CAST(count(*) AS BIGINT) AS n, min(latency) AS min, max(latency) AS max, round(avg(latency), 6) AS mean, max(latency) FILTER (WHERE i = floor(n * 0.5)) AS p50,
   max(latency) FILTER (WHERE i = floor(n * 0.95)) AS p95, max(latency) FILTER (WHERE i = floor(n * 0.99)) AS p99 FROM s""")
def _(spark, d):
    from aeroband.operators.analytics import index_percentiles
    from aeroband.operators.ordered import beside
    v = G.latency_values(V.log_lines(spark, d))
    cuts = index_percentiles(v, "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    basic = v.agg(F.count("*").alias("n"), F.min("latency").alias("min"), F.max("latency").alias("max"), F.round(F.avg("latency"), 6).alias("mean"))
    return beside(basic, cuts, [])


@query("u6_merge_by_category", "SELECT category, line_no FROM log_lines")
def _(spark, d):
    p = V.log_lines(spark, d).select("line_no", F.concat(F.lit("/data/logs/"), C("category"), F.lit("/main.log")).alias("path"))
    return p.select(G.category_of(C("path")).alias("category"), "line_no")


@query("u7_log_metrics", f"""SELECT category, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (WHERE level='ERROR') AS BIGINT) AS errors,
   CAST(count(*) FILTER (WHERE level='WARNING') AS BIGINT) AS warnings, CAST(sum(len(line) + 1) AS BIGINT) AS bytes FROM ({LOG}) GROUP BY 1""")
def _(spark, d):
    return G.level_metrics(_parsed(spark, d), "category")


@query("u8_high_error_rate", f"SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) AS BIGINT) AS n FROM ({LOG}) WHERE level = 'ERROR' GROUP BY 1 HAVING count(*) / 86400.0 > 0.0008")
def _(spark, d):
    return G.high_error_rate(_parsed(spark, d), 0.0008, "1 day", 86400)


@query("u9_fast_growth", f"""SELECT category, CAST(date_trunc('hour', src_ts) AS TIMESTAMP) AS hour, arg_max(line_no * 1000000, (src_ts, line_no)) - arg_min(line_no * 1000000, (src_ts, line_no)) AS growth
   FROM log_lines GROUP BY 1, 2 HAVING arg_max(line_no * 1000000, (src_ts, line_no)) - arg_min(line_no * 1000000, (src_ts, line_no)) > 10000000""")
def _(spark, d):
    s = V.log_lines(spark, d).select("category", "line_no", C("src_ts").alias("ts"), (C("line_no") * 1000000).alias("size_bytes"))
    return G.fast_growth(s, "category", 10000000)


@query("u10_silences", """SELECT ts, line_no, gap_s FROM (SELECT src_ts AS ts, line_no, (epoch_us(lead(src_ts) OVER (ORDER BY src_ts, line_no)) - epoch_us(src_ts)) / 1e6 AS gap_s FROM log_lines) WHERE gap_s > 300""")
def _(spark, d):
    return G.silences(V.log_lines(spark, d).select(C("src_ts").alias("ts"), "line_no"))


@query("u11_good_corrupt_split", "SELECT line_no, CASE WHEN line_no % 17 = 0 THEN 'corrupt' ELSE 'good' END AS kind FROM log_lines")
def _(spark, d):
    broken = V.log_lines(spark, d).withColumn("line", F.when(C("line_no") % 17 == 0, F.concat(F.lit("x"), C("line"))).otherwise(C("line")))
    good, bad = G.split_good_bad(broken)
    return good.select("line_no", F.lit("good").alias("kind")).unionByName(bad.select("line_no", F.lit("corrupt").alias("kind")))


@query("u12_noise_exclusion", f"SELECT line_no FROM ({LOG}) WHERE logger NOT IN ('mod1','mod4') AND NOT contains(line, 'latency=99') AND NOT (logger = 'mod2' AND level = 'INFO')")
def _(spark, d):
    return G.without_noise(_parsed(spark, d), ("mod1", "mod4"), ("latency=99",), {"mod2": ("INFO",)}).select("line_no")


@query("u13_systematic_sample", "SELECT line_no FROM (SELECT line_no, row_number() OVER (ORDER BY src_ts, line_no) AS r FROM log_lines) WHERE r % 100 = 0")
def _(spark, d):
    return G.systematic_sample(V.log_lines(spark, d), 0.01, "src_ts", "line_no").select("line_no")


@query("u14_redaction", """SELECT event_id, '[REDACTED]' AS user_token, event_type AS kind FROM events""")
def _(spark, d):
    m = table(spark, d, "events").select("event_id", F.create_map(F.lit("User_Token"), C("user_id").cast("string"), F.lit("kind"), C("event_type")).alias("m"))
    r = m.select("event_id", G.redact("m").alias("m"))
    return r.select("event_id", F.element_at("m", F.lit("User_Token")).alias("user_token"), F.element_at("m", F.lit("kind")).alias("kind"))


@query("u15_log_retention", """SELECT line_no FROM log_lines WHERE src_ts >= TIMESTAMP '2024-02-14' - to_days(CASE category WHEN 'system' THEN 30 WHEN 'api' THEN 90 WHEN 'security' THEN 365
   WHEN 'performance' THEN 30 ELSE 100000 END)""")
def _(spark, d):
    limits = spark.createDataFrame(list(G.LOG_RETENTION.items()), "category string, days int")
    return privacy.retain_by_class(V.log_lines(spark, d), limits, "category", "2024-02-14 00:00:00", "src_ts").select("line_no")


@query("u16_login_bursts", """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 3""")
def _(spark, d):
    return G.bursts(table(spark, d, "events").filter(C("event_type") == "error"), ["user_id"], 3, "1 day")


@query("u16_lockouts", """SELECT event_id, CAST(n AS BIGINT) AS attempts FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW) AS n
   FROM events WHERE event_type = 'error') WHERE n >= 5""")
def _(spark, d):
    f = table(spark, d, "events").filter(C("event_type") == "error").select("event_id", "user_id", "ts")
    return G.lockouts(f, "user_id", 5, 3 * 1440).select("event_id", "attempts")


ATTACKS = r"""CASE WHEN regexp_matches(t, '(?i)(union\s+select|or\s+1=1|drop\s+table)') THEN 'sql_injection' WHEN regexp_matches(t, '(?i)(<script|onerror=|javascript:)') THEN 'xss'
   WHEN regexp_matches(t, '(\.\./|\.\.\\)') THEN 'path_traversal' WHEN regexp_matches(t, '(;|\|\||&&)\s*(cat|ls|rm|wget|curl)\b') THEN 'command_injection' END"""


@query("u17_attack_patterns", f"""SELECT kind, id, {ATTACKS} AS attack FROM (SELECT 'page' AS kind, page_id AS id, url || ' ' || html AS t FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)""")
def _(spark, d):
    pages = table(spark, d, "pages").select(F.lit("page").alias("kind"), C("page_id").alias("id"), F.concat("url", F.lit(" "), "html").alias("t"))
    docs = table(spark, d, "documents").select(F.lit("document").alias("kind"), C("doc_id").alias("id"), C("text").alias("t"))
    return pages.unionByName(docs).select("kind", "id", G.attack_class("t").alias("attack"))


@query("u17_attack_bursts", f"""SELECT attack, time_bucket(INTERVAL 1 HOUR, ts) AS start, CAST(count(*) AS BIGINT) AS n FROM (SELECT ts, {ATTACKS} AS attack
   FROM (SELECT TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 MINUTE AS ts, url || ' ' || html AS t FROM pages)) WHERE attack IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 20""")
def _(spark, d):
    """Pages as requests, one a minute by their number."""
    at = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + C("page_id") * 60)
    e = table(spark, d, "pages").select(at.alias("ts"), G.attack_class(F.concat("url", F.lit(" "), "html")).alias("attack")).filter("attack is not null")
    return G.bursts(e, ["attack"], 20, "1 hour")


@query("u18_subject_erasure", """SELECT 'detections' AS src, id, emitter FROM detections WHERE emitter <> 8 UNION ALL
   SELECT 'alerts', id, CASE WHEN emitter <> 8 THEN emitter END FROM alerts""")
def _(spark, d):
    out = privacy.erase({"detections": V.detections(spark, d), "alerts": V.alerts(spark, d)}, 8, {"detections": "emitter"}, {"alerts": "emitter"})
    return out["detections"].select(F.lit("detections").alias("src"), "id", "emitter").unionByName(
        out["alerts"].select(F.lit("alerts").alias("src"), "id", "emitter"))


@query("u19_subject_export", """SELECT 'detections' AS section, id FROM detections WHERE emitter = 8 UNION ALL SELECT 'alerts', id FROM alerts WHERE emitter = 8""")
def _(spark, d):
    out = privacy.export_subject({"detections": (V.detections(spark, d), "emitter"), "alerts": (V.alerts(spark, d), "emitter")}, 8)
    return out.select("section", F.get_json_object("record", "$.id").cast("long").alias("id"))
