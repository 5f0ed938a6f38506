"""Registered queries: detection, alert and performance analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions.numeric import rounded
from aeroband.operators import analytics as A
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.session import table

C = F.col
AS_OF = "2024-01-20 12:00:00"
START, END = "2024-01-03 06:30:00", "2024-01-17 18:00:00"
COUNTS = ", ".join(f"CAST(count(*) FILTER (WHERE threat_level = '{t.upper()}') AS BIGINT) AS {t}" for t in ("high", "medium", "low"))


@query("f1_period_statistics", f"""SELECT CAST(count(*) AS BIGINT) AS total,
   CAST(count(DISTINCT coalesce(nullif(remote_id,''), nullif(signature_hash,''))) AS BIGINT) AS unique_emitters,
   round(avg(confidence), 6) AS avg_confidence, {COUNTS} FROM detections""")
def _(spark, d):
    return rounded(A.period_statistics(V.detections(spark, d)))


@query("f2_unique_emitters", """SELECT CAST(count(DISTINCT coalesce(nullif(remote_id,''), nullif(signature_hash,''))) AS BIGINT)
   AS unique_emitters FROM detections""")
def _(spark, d):
    return A.unique_emitters(V.detections(spark, d))


@query("f3_top_types", "SELECT signature_hash, CAST(count(*) AS BIGINT) AS n FROM detections GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def _(spark, d):
    return A.top_values(V.detections(spark, d), "signature_hash", 10)


@query("f4_hourly_histogram", """SELECT CAST(h AS INTEGER) AS hour, CAST(count(d.id) AS BIGINT) AS n FROM range(24) t(h)
   LEFT JOIN detections d ON hour(d.ts) = h GROUP BY 1""")
def _(spark, d):
    return A.hourly_histogram(V.detections(spark, d))


@query("f5_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM detections GROUP BY 1")
def _(spark, d):
    return A.daily_counts(V.detections(spark, d))


def trend_sql(unit):
    return f"""WITH spine AS (SELECT unnest(generate_series(date_trunc('{unit}', TIMESTAMP '{START}'),
        date_trunc('{unit}', TIMESTAMP '{END}'), INTERVAL 1 {unit})) AS bucket),
      c AS (SELECT date_trunc('{unit}', ts) AS bucket, count(*) AS total, count(*) FILTER (WHERE threat_level='HIGH') AS high,
        count(*) FILTER (WHERE threat_level='MEDIUM') AS medium FROM detections
        WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1)
      SELECT CAST(s.bucket AS TIMESTAMP) AS bucket, CAST(coalesce(total,0) AS BIGINT) AS total, CAST(coalesce(high,0) AS BIGINT) AS high,
        CAST(coalesce(medium,0) AS BIGINT) AS medium,
        CAST(coalesce(total,0)-coalesce(high,0)-coalesce(medium,0) AS BIGINT) AS low
      FROM spine s LEFT JOIN c ON s.bucket = c.bucket"""


for _unit in ("hour", "day", "week", "month", "year"):
    def _trend(spark, d, unit=_unit):
        return A.threat_trend(V.detections(spark, d), START, END, unit)
    query(f"f6_threat_trend_{_unit}", trend_sql(_unit))(_trend)


@query("f7_type_distribution", """SELECT drone_type, CAST(count(*) AS BIGINT) AS n,
   round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM detections), 6) AS percentage, round(avg(confidence), 6) AS avg_confidence,
   CAST(count(*) FILTER (WHERE threat_level='HIGH') AS BIGINT) AS high FROM detections GROUP BY 1""")
def _(spark, d):
    out = A.type_distribution(V.detections(spark, d))
    high = F.coalesce(F.element_at("threat_distribution", F.lit("HIGH")), F.lit(0)).cast("long")
    return rounded(out.withColumn("high", high).drop("threat_distribution"))


@query("f8_batch_summary", """SELECT 'all' AS scope, 'all' AS name, CAST(count(*) AS BIGINT) AS n, round(avg(confidence),6) AS avg_confidence FROM detections
   UNION ALL SELECT 'type', drone_type, count(*), round(avg(confidence),6) FROM detections GROUP BY 2
   UNION ALL SELECT 'threat', threat_level, count(*), round(avg(confidence),6) FROM detections GROUP BY 2""")
def _(spark, d):
    return rounded(A.batch_summary(V.detections(spark, d)))


@query("f9_band_distribution", """SELECT band, CAST(count(*) AS BIGINT) AS n FROM detections JOIN (VALUES
   ('DJI_OcuSync_2.4G', 2412000000.0, 20000000.0), ('DJI_OcuSync_5.8G', 5825000000.0, 20000000.0),
   ('FPV_5.8G', 5800000000.0, 200000000.0), ('WiFi_2.4G', 2440000000.0, 80000000.0)) b(band, c, w)
   ON frequency BETWEEN c - w / 2 AND c + w / 2 GROUP BY 1""")
def _(spark, d):
    return A.band_distribution(V.detections(spark, d))


@query("f10_peak_times", """WITH h AS (SELECT CAST(hour(ts) AS INTEGER) h, count(*) n FROM detections GROUP BY 1),
   w AS (SELECT CAST(isodow(ts) AS INTEGER) w, count(*) n FROM detections GROUP BY 1)
   SELECT (SELECT h FROM h ORDER BY n DESC, h LIMIT 1) AS peak_hour, (SELECT w FROM w ORDER BY n DESC, w LIMIT 1) AS busiest_weekday,
   round(count(*)::DOUBLE / count(DISTINCT CAST(ts AS DATE)), 6) AS daily_mean FROM detections""")
def _(spark, d):
    return rounded(A.peak_times(V.detections(spark, d)))


DAY_SQL = f"SELECT * FROM detections WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND ts <= TIMESTAMP '{AS_OF}'"


@query("f11_dashboard_summary", f"""WITH day AS ({DAY_SQL}) SELECT CAST(count(*) AS BIGINT) AS total,
   CAST((SELECT count(*) FROM alerts WHERE NOT acknowledged AND NOT resolved) AS BIGINT) AS active_alerts,
   CAST(count(DISTINCT drone_type) AS BIGINT) AS unique_types,
   {COUNTS}, round(count(*) FILTER (WHERE threat_level='HIGH') * 100.0::DOUBLE / count(*), 6) AS high_percent,
   round(count(*) / 24.0::DOUBLE / 60, 6) AS per_minute FROM day""")
def _(spark, d):
    return rounded(A.dashboard_summary(V.detections(spark, d), V.alerts(spark, d), AS_OF))


@query("f11_dashboard_top_types", f"""WITH day AS ({DAY_SQL}) SELECT drone_type, CAST(count(*) AS BIGINT) AS n FROM
   day GROUP BY 1 ORDER BY n DESC, drone_type LIMIT 5""")
def _(spark, d):
    return A.dashboard_top_types(V.detections(spark, d), AS_OF)


def report_sql(unit):
    p = f"date_trunc('{unit}', ts)"
    return f"""WITH hrs AS (SELECT {p} AS period, CAST(hour(ts) AS INTEGER) h, count(*) n FROM detections GROUP BY 1,2)
   SELECT CAST(period AS TIMESTAMP) AS period, section, name, CAST(n AS BIGINT) AS n FROM (
   SELECT {p} AS period, 'total' AS section, 'all' AS name, count(*) AS n FROM detections GROUP BY 1
   UNION ALL SELECT {p}, 'threat', threat_level, count(*) FROM detections GROUP BY 1,3
   UNION ALL SELECT {p}, 'type', drone_type, count(*) FROM detections GROUP BY 1,3
   UNION ALL SELECT period, 'hour', lpad(h::VARCHAR, 2, '0'), n FROM hrs
   UNION ALL SELECT period, 'peak_hour', lpad(h::VARCHAR, 2, '0'), n FROM
     (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, h) r FROM hrs) WHERE r = 1)"""


for _unit in ("day", "week", "month"):
    def _report(spark, d, unit=_unit):
        return A.report_rows(V.detections(spark, d), unit)
    query(f"f12_report_{_unit}", report_sql(_unit))(_report)


@query("f13_live_metrics", """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE threat_level='HIGH') AS BIGINT) AS high_threats,
   round(avg(confidence), 3) AS avg_confidence FROM detections""")
def _(spark, d):
    return A.live_metrics(V.detections(spark, d))


@query("f14_type_threat_counters", "SELECT drone_type, threat_level, CAST(count(*) AS BIGINT) AS n FROM detections GROUP BY 1, 2")
def _(spark, d):
    return A.counters(V.detections(spark, d), "drone_type", "threat_level")


@query("f15_daily_forecast", """WITH c AS (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::DOUBLE AS x, count(*)::DOUBLE AS y
      FROM detections GROUP BY 1),
   m AS (SELECT count(*) n, sum(x) sx, sum(y) sy, sum(x*x) sxx, sum(x*y) sxy, max(x) mx FROM c),
   f AS (SELECT (n*sxy - sx*sy)/(n*sxx - sx*sx) AS b, (sy - (n*sxy - sx*sy)/(n*sxx - sx*sx)*sx)/n AS a, mx FROM m)
   SELECT CAST(DATE '2024-01-02' + CAST(mx AS INTEGER) AS DATE) AS day, round(a + b*(mx+1), 4) AS expected,
     round(a + b*(mx+1) - 1.96*rmse, 4) AS low, round(a + b*(mx+1) + 1.96*rmse, 4) AS high
   FROM f, (SELECT sqrt(avg((y - a - b*x)*(y - a - b*x))) AS rmse FROM c, f)""")
def _(spark, d):
    from aeroband.operators.forecasting import trend_forecast
    return rounded(trend_forecast(V.detections(spark, d), origin="2024-01-01"), 4)


@query("f15_calendar_forecast")
def _(spark, d):
    from aeroband.operators.forecasting import calendar_forecast
    return calendar_forecast(V.detections(spark, d), origin="2024-01-01")


# ---------------------------------------------------------------------------- alerts
@query("g1_alert_statistics", """SELECT CAST(count(*) AS BIGINT) AS total,
   CAST(count(*) FILTER (WHERE NOT acknowledged AND NOT resolved) AS BIGINT) AS active,
   CAST(count(*) FILTER (WHERE resolved) AS BIGINT) AS resolved, CAST(count(*) FILTER (WHERE acknowledged) AS BIGINT) AS acknowledged,
   round(avg((epoch_us(resolved_at) - epoch_us(ts)) / 6e7), 6) AS avg_response_minutes,
   round(avg(CASE WHEN escalation_level > 0 THEN 100.0 ELSE 0.0 END::DOUBLE), 6) AS escalation_rate FROM alerts""")
def _(spark, d):
    return rounded(A.alert_statistics(V.alerts(spark, d)))


@query("g2_severity_category", """SELECT 'severity' AS dimension, coalesce(severity,'UNKNOWN') AS name, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 2
   UNION ALL SELECT 'category', coalesce(category,'UNKNOWN'), count(*) FROM alerts GROUP BY 2""")
def _(spark, d):
    return A.alert_breakdown(V.alerts(spark, d))


@query("g3_mean_response_minutes", """SELECT coalesce(severity,'UNKNOWN') AS severity,
   round(avg((epoch_us(resolved_at) - epoch_us(ts)) / 6e7), 6) AS minutes FROM alerts WHERE resolved GROUP BY 1""")
def _(spark, d):
    return (V.alerts(spark, d).filter("resolved").groupBy(F.coalesce("severity", F.lit("UNKNOWN")).alias("severity"))
            .agg(F.round(F.avg(A.seconds_between("ts", "resolved_at") / 60), 6).alias("minutes")))


@query("g4_escalation_rate", """SELECT source, round(avg(CASE WHEN escalation_level > 0 THEN 100.0 ELSE 0.0 END::DOUBLE), 6) AS rate
   FROM alerts GROUP BY 1""")
def _(spark, d):
    return V.alerts(spark, d).groupBy("source").agg(
        F.round(F.avg(F.when(C("escalation_level") > 0, 100.0).otherwise(0.0)), 6).alias("rate"))


@query("g5_top_sources", "SELECT source, CAST(count(*) AS BIGINT) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, source LIMIT 10")
def _(spark, d):
    return A.top_values(V.alerts(spark, d), "source", 10)


@query("g6_index_percentiles", """WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM detections)
   SELECT max(value) FILTER (WHERE i = floor(n*0.5)) AS p50, max(value) FILTER (WHERE i = floor(n*0.95)) AS p95,
   max(value) FILTER (WHERE i = floor(n*0.99)) AS p99 FROM s""")
def _(spark, d):
    return A.index_percentiles(V.detections(spark, d), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("g6_index_percentiles_by_type", """WITH s AS (SELECT drone_type, value, row_number() OVER (PARTITION BY drone_type ORDER BY value) - 1 AS i,
     count(*) OVER (PARTITION BY drone_type) AS n FROM detections)
   SELECT drone_type, max(value) FILTER (WHERE i = floor(n*0.5)) AS p50, max(value) FILTER (WHERE i = floor(n*0.95)) AS p95,
   max(value) FILTER (WHERE i = floor(n*0.99)) AS p99 FROM s GROUP BY 1""")
def _(spark, d):
    return A.index_percentiles(V.detections(spark, d), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["drone_type"])


@query("g7_rates", f"""WITH p AS (SELECT (epoch_us(TIMESTAMP '{END}') - epoch_us(TIMESTAMP '{START}')) / 6e7 AS m),
   a AS (SELECT count(*) AS r, count(*) FILTER (WHERE NOT resolved) AS e, count(*) FILTER (WHERE severity IS NULL) AS f FROM alerts
         WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'),
   n AS (SELECT count(*) AS n FROM detections WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}')
   SELECT round(n / m, 6) AS detections_per_minute, round(r / m, 6) AS requests_per_minute, round(e * 100.0::DOUBLE / r, 6) AS error_percent,
   round(1200000.0::DOUBLE / (m * 60) * 100, 6) AS uptime_percent, round(f::DOUBLE / r, 6) AS false_positive_rate FROM p, a, n""")
def _(spark, d):
    return rounded(A.rates(V.detections(spark, d), V.alerts(spark, d), START, END, 1200000.0))


for _unit in ("hour", "day", "week"):
    def _periodic(spark, d, unit=_unit):
        return rounded(A.periodic_metrics(V.detections(spark, d), unit))
    query(f"g8_periodic_metrics_{_unit}", f"""SELECT CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS bucket, CAST(count(*) AS BIGINT) AS n,
       round(avg(confidence), 6) AS avg_confidence, {COUNTS}, round(avg(value), 6) AS avg_processing_ms FROM detections GROUP BY 1""")(_periodic)


@query("g9_labelled_counters", """SELECT drone_type, source, CAST(count(*) AS BIGINT) AS n, arg_max(snr, (ts, id)) AS last_value
   FROM detections GROUP BY 1, 2""")
def _(spark, d):
    return A.labelled_counters(V.detections(spark, d), ["drone_type", "source"], "snr")


@query("g10_cumulative_histogram", """SELECT b.le, CAST(count(d.confidence) FILTER (WHERE b.bound IS NULL OR d.confidence <= b.bound) AS BIGINT) AS n
   FROM (VALUES ('0.1',0.1),('0.2',0.2),('0.3',0.3),('0.4',0.4),('0.5',0.5),('0.6',0.6),('0.7',0.7),('0.8',0.8),('0.9',0.9),
     ('0.95',0.95),('0.99',0.99),('+Inf',NULL)) b(le, bound), detections d GROUP BY 1""")
def _(spark, d):
    return A.cumulative_histogram(V.detections(spark, d), "confidence", A.CONFIDENCE_BOUNDS)


@query("g11_latency_summary", """SELECT source, CAST(count(*) AS BIGINT) AS n, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean,
   round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.95),6) AS p95,
   round(quantile_cont(value,0.99),6) AS p99 FROM detections GROUP BY 1""")
def _(spark, d):
    return rounded(A.latency_summary(V.detections(spark, d), "value", ["source"]), 6, "mean", "p50", "p90", "p95", "p99")


@query("g11_latency_overall", """SELECT CAST(count(*) AS BIGINT) AS n, min(value) AS min, max(value) AS max, round(avg(value),6) AS mean,
   round(quantile_cont(value,0.5),6) AS p50, round(quantile_cont(value,0.9),6) AS p90, round(quantile_cont(value,0.95),6) AS p95,
   round(quantile_cont(value,0.99),6) AS p99 FROM detections""")
def _(spark, d):
    return rounded(A.latency_summary(V.detections(spark, d), "value"), 6, "mean", "p50", "p90", "p95", "p99")


@query("g12_identification_coverage", f"""SELECT CAST(count(*) AS BIGINT) AS seen, CAST(count(remote_id) AS BIGINT) AS with_id,
   CAST(count(*) FILTER (WHERE remote_id IS NULL) AS BIGINT) AS without_id,
   CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND ts <= TIMESTAMP '{AS_OF}') AS BIGINT) AS last_hour,
   round(count(remote_id) * 100.0::DOUBLE / count(*), 6) AS coverage_percent FROM detections""")
def _(spark, d):
    return rounded(A.identification_coverage(V.detections(spark, d), AS_OF))


@query("g13_active_emitters", f"""SELECT CAST(count(DISTINCT uas_id) AS BIGINT) AS active FROM rid_messages
   WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 120 MINUTE AND ts <= TIMESTAMP '{AS_OF}'""")
def _(spark, d):
    return A.active_emitters(V.rid_messages(spark, d), AS_OF, 120)


@query("g15_capture_summary", """WITH r AS (SELECT frame_id AS vec_id, CAST(count(*) // 2 AS BIGINT) AS samples, max(psd_db) AS peak, avg(psd_db) AS mean FROM spectra GROUP BY 1)
   SELECT CAST(count(*) AS BIGINT) AS files, CAST(count(*) FILTER (WHERE samples > 0) AS BIGINT) AS ok_files,
   round(sum(samples / 2e6), 6) AS duration_s, CAST(sum(samples) AS BIGINT) AS samples, round(avg(peak - mean), 6) AS mean_snr,
   round(min(peak - mean), 6) AS min_snr, round(max(peak - mean), 6) AS max_snr, round(avg(peak), 6) AS mean_peak FROM r""")
def _(spark, d):
    return rounded(A.capture_batch_summary(_captures(spark, d)))


def _captures(spark, d):
    e = table(spark, d, "embeddings")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 100)
    mean = F.aggregate(scaled, F.lit(0.0), lambda a, x: a + x) / F.size("embedding")
    return e.select("vec_id", "label", F.floor(F.size("embedding") / 2).alias("samples"), F.array_max(scaled).alias("peak_db"),
                    mean.alias("m")).select(
        "vec_id", "label", "samples", "peak_db", (C("samples") > 0).alias("ok"), (C("samples") / 2e6).alias("duration_s"),
        (C("peak_db") - C("m")).alias("snr_db"))


@query("g16_matches_per_type", """SELECT truth AS file_group, predicted AS match, CAST(count(*) AS BIGINT) AS n,
   round(count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY truth), 6) AS rate FROM predictions GROUP BY 1, 2""")
def _(spark, d):
    from pyspark.sql import Window
    n = V.predictions(spark, d).groupBy(C("truth").alias("file_group"), C("predicted").alias("match")).agg(F.count("*").alias("n"))
    share = C("n") / F.sum("n").over(Window.partitionBy("file_group"))
    return n.select("file_group", "match", "n", F.round(share, 6).alias("rate"))


@query("g17_best_captures", """WITH r AS (SELECT frame_id AS vec_id, CAST(count(*) // 2 AS BIGINT) AS samples, max(psd_db) AS peak, avg(psd_db) AS mean FROM spectra GROUP BY 1)
   SELECT (SELECT vec_id FROM r ORDER BY peak - mean DESC, vec_id LIMIT 1) AS best_snr_db,
          (SELECT vec_id FROM r ORDER BY peak DESC, vec_id LIMIT 1) AS best_peak_db""")
def _(spark, d):
    return A.best_captures(_captures(spark, d), ["snr_db", "peak_db"], "vec_id")


@query("g18_spectrum_history", """SELECT frame_id, round(avg(psd_db),6) AS mean, round(min(psd_db),6) AS min, round(max(psd_db),6) AS max,
   round(stddev_pop(psd_db),6) AS std FROM spectra WHERE freq_hz BETWEEN 2.401e9 AND 2.404e9 GROUP BY 1""")
def _(spark, d):
    return rounded(A.history_stats(V.spectra(spark, d), 2.401e9, 2.404e9))


@query("g19_audit_summary", f"""SELECT user_id AS "user", event_type AS action, 'res-' || (event_id % 6) AS resource, CAST(count(*) AS BIGINT) AS n,
   max(ts) AS last_ts FROM events WHERE ts BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY 1, 2, 3""")
def _(spark, d):
    log = table(spark, d, "events").select("ts", C("user_id").alias("user"), C("event_type").alias("action"),
                                           F.concat(F.lit("res-"), (C("event_id") % 6).cast("string")).alias("resource"))
    return A.audit_summary(log, START, END)
