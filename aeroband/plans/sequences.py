"""Registered queries: ordered operators (neighbours, runs, tracks, recurrences)."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from aeroband.functions import arrays as X, geo, numeric
from aeroband.functions.numeric import rounded
from aeroband.operators import ordered, peaks, scans, tracking
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.session import table

C = F.col
FRAME = "PARTITION BY frame_id ORDER BY bin"
MAXIMA = f"""SELECT frame_id, bin, psd_db FROM (SELECT *, lag(psd_db) OVER ({FRAME}) l, lead(psd_db) OVER ({FRAME}) r FROM spectra)
   WHERE psd_db > l AND psd_db > r"""


def dist_sql(a, b, c, d):
    return (f"(2000 * 6371.0 * asin(least(1.0, sqrt(pow(sin((radians({c})-radians({a}))/2),2) + cos(radians({a}))*cos(radians({c}))*"
            f"pow(sin((radians({d})-radians({b}))/2),2)))))")


@query("h1_local_maxima", f"SELECT frame_id, bin FROM ({MAXIMA})")
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", F.explode(peaks.local_maxima("psd")).alias("bin"))


FOLD = f"""WITH c AS (SELECT frame_id, list([bin] ORDER BY bin) AS cand FROM ({MAXIMA}) WHERE psd_db > 5 GROUP BY 1),
   e AS (SELECT c.*, embedding FROM c JOIN embeddings ON vec_id = frame_id)
   SELECT frame_id, unnest(list_reduce(cand, lambda a, b: {{step}})) AS bin FROM e"""


@query("h2_min_distance_peaks", FOLD.format(step="""CASE WHEN b[1] - a[-1] >= 5 THEN list_concat(a, b)
   WHEN embedding[b[1] + 1] > embedding[a[-1] + 1] THEN list_concat(a[1:len(a) - 1], b) ELSE a END"""))
def _(spark, d):
    return V.psd_frames(spark, d).select("frame_id", F.explode(peaks.detect("psd", 5.0, 5)).alias("bin"))


@query("h3_first_wins_merge", FOLD.format(step="CASE WHEN b[1] - a[-1] >= 6 THEN list_concat(a, b) ELSE a END"))
def _(spark, d):
    kept = peaks.thin_first_wins(peaks.local_maxima("psd", 5.0), 6)
    return V.psd_frames(spark, d).select("frame_id", F.explode(kept).alias("bin"))


@query("h4_moving_median", f"""SELECT frame_id, bin, round(median(psd_db) OVER ({FRAME} ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING), 6) AS baseline FROM spectra""")
def _(spark, d):
    return rounded(V.psd_frames(spark, d).select("frame_id", F.posexplode(peaks.moving_median("psd")).alias("bin", "baseline")))


@query("h5_median_sigma_threshold", f"""SELECT frame_id, bin, round(median(psd_db) OVER w + 2.0 * stddev_pop(psd_db) OVER w, 6) AS threshold
   FROM spectra WINDOW w AS ({FRAME} ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)""")
def _(spark, d):
    return rounded(V.psd_frames(spark, d).select("frame_id", F.posexplode(peaks.median_sigma_threshold("psd")).alias("bin", "threshold")))


@query("h6_moving_mean_threshold", f"""SELECT frame_id, bin, round(avg(psd_db) OVER ({FRAME} ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) + 3.0, 6) AS threshold FROM spectra""")
def _(spark, d):
    floor = F.transform(X.moving("psd", 10, 9, X.mean), lambda x: x + 3.0)
    return rounded(V.psd_frames(spark, d).select("frame_id", F.posexplode(floor).alias("bin", "threshold")))


@query("h7_cumulative_power", f"""SELECT frame_id, bin, round(sum(pow(10.0, psd_db / 10)) OVER ({FRAME} ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM spectra""")
def _(spark, d):
    w = Window.partitionBy("frame_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return V.spectra(spark, d).select("frame_id", "bin", F.round(F.sum(numeric.from_db("psd_db")).over(w), 4).alias("cumulative"))


RUNS = """WITH f AS (SELECT frame_id, bin, psd_db > {level} AS above FROM spectra),
   g AS (SELECT *, bin - row_number() OVER (PARTITION BY frame_id ORDER BY bin) AS isle FROM f WHERE above),
   r AS (SELECT frame_id, min(bin) AS first, max(bin) AS last FROM g GROUP BY frame_id, isle)"""


@query("h8_gaps_and_islands", RUNS.format(level="4.0") + " SELECT frame_id, first, last FROM r WHERE last < 63 AND last - first + 1 >= 2")
def _(spark, d):
    found = F.filter(X.closed_runs(F.transform("psd", lambda x: x > 4.0)), lambda r: r["last"] - r["first"] + 1 >= 2)
    return V.psd_frames(spark, d).select("frame_id", F.inline(found))


CLUSTER = """WITH a AS (SELECT frame_id, bin, bin - lag(bin) OVER (PARTITION BY frame_id ORDER BY bin) AS gap FROM spectra WHERE psd_db > 6.0),
   g AS (SELECT *, sum(CASE WHEN gap > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY bin) AS grp FROM a),
   s AS (SELECT frame_id, min(bin) AS first, max(bin) AS last, CAST(count(*) AS INTEGER) AS hits FROM g GROUP BY frame_id, grp),
   b AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY hits DESC, first) AS r FROM s)"""


@query("h9_gap_tolerant_cluster", CLUSTER + """ SELECT frame_id, first, last, hits FROM b WHERE r = 1 AND hits >= 3
   AND hits::DOUBLE / (last - first + 1) >= 0.5""")
def _(spark, d):
    from aeroband.operators.spectral import widest_cluster
    c = widest_cluster("psd", F.lit(6.0), F.lit(3))
    return V.psd_frames(spark, d).select("frame_id", c.alias("c")).filter("c is not null").select("frame_id", "c.first", "c.last", "c.hits")


@query("h10_latest_per_key", """SELECT uas_id, id, ts, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY uas_id ORDER BY ts DESC, id DESC) r
   FROM rid_messages) WHERE r = 1""")
def _(spark, d):
    return ordered.newest_per_key(V.rid_messages(spark, d), "uas_id", "ts", "id", ["uas_id", "id", "ts", "latitude", "longitude"])


GAP_H = 12
SESSION_CTE = f"""WITH p AS (SELECT *, lag(ts) OVER (PARTITION BY uas_id ORDER BY ts, id) AS pts FROM rid_messages),
   n AS (SELECT *, CAST(sum(CASE WHEN pts IS NULL OR ts - pts >= INTERVAL {GAP_H} HOUR THEN 1 ELSE 0 END)
         OVER (PARTITION BY uas_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no FROM p)"""


@query("h11_first_last_per_session", SESSION_CTE + """ SELECT uas_id, session_no, arg_min(latitude, (ts, id)) AS first_lat,
   arg_max(latitude, (ts, id)) AS last_lat, arg_min(longitude, (ts, id)) AS first_lon, arg_max(longitude, (ts, id)) AS last_lon FROM n GROUP BY 1, 2""")
def _(spark, d):
    s = tracking.sessions(V.rid_messages(spark, d), GAP_H * 3600)
    at = F.struct("ts", "id")
    return s.groupBy("uas_id", "session_no").agg(
        F.min_by("latitude", at).alias("first_lat"), F.max_by("latitude", at).alias("last_lat"),
        F.min_by("longitude", at).alias("first_lon"), F.max_by("longitude", at).alias("last_lon"))


STEPS = """SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon, lag(altitude) OVER w AS palt, lag(speed) OVER w AS pspeed,
   lag(ts) OVER w AS pts FROM rid_messages WINDOW w AS (PARTITION BY uas_id ORDER BY ts, id)"""


@query("h12_track_summary", f"""SELECT uas_id, CAST(count(*) AS BIGINT) AS points,
   round(sum(CASE WHEN pts IS NOT NULL THEN {dist_sql('plat', 'plon', 'latitude', 'longitude')} END), 3) AS length_m,
   (max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6 AS duration_s, max(speed) AS max_speed, round(avg(speed), 6) AS mean_speed FROM ({STEPS}) GROUP BY 1""")
def _(spark, d):
    t = tracking.track_summary(V.rid_messages(spark, d), ["uas_id"])
    return t.select("uas_id", "points", F.round("length_m", 3).alias("length_m"), "duration_s", "max_speed",
                    F.round("mean_speed", 6).alias("mean_speed"))


@query("h13_step_kinematics", f"""SELECT id, round({dist_sql('plat', 'plon', 'latitude', 'longitude')} / s, 6) AS implied_speed,
   round((altitude - palt) / s, 6) AS vertical_speed, round((speed - pspeed) / s, 6) AS acceleration
   FROM (SELECT *, (epoch_us(ts) - epoch_us(pts)) / 1e6 AS s FROM ({STEPS}))""")
def _(spark, d):
    return rounded(tracking.kinematics(V.rid_messages(spark, d)).select("id", "implied_speed", "vertical_speed", "acceleration"))


@query("h14_trailing_count", """SELECT id, CAST(count(*) OVER (PARTITION BY emitter ORDER BY epoch_us(ts) RANGE BETWEEN 172799999999 PRECEDING AND CURRENT ROW) AS BIGINT)
   AS recent FROM alerts""")
def _(spark, d):
    return ordered.trailing(V.alerts(spark, d).select("id", "emitter", "ts"), "emitter", "ts", 172800,
                            {"recent": F.count("*")}, open_start=True).select("id", "recent")


@query("h15_exponential_mean", """WITH w AS (SELECT id, list(value) OVER (PARTITION BY emitter ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS v FROM detections)
   SELECT id, round(list_reduce(v, lambda a, b: 0.95::DOUBLE * a + 0.05::DOUBLE * b) + 1e-10, 6) AS ema FROM w""")
def _(spark, d):
    base = V.detections(spark, d).select("id", "emitter", "ts", "value")
    out = scans.exponential_mean(base, ["emitter"], "ts", "id", "value", slice_seconds=7 * 86400)
    return out.select("id", F.round(C("ema") + 1e-10, 6).alias("ema"))


@query("h16_cumulative_mean_removal", """SELECT frame_id, n, round(i - avg(i) OVER w, 6) AS i, round(q - avg(q) OVER w, 6) AS q FROM iq_samples
   WINDOW w AS (PARTITION BY frame_id ORDER BY n ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    w = Window.partitionBy("frame_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(V.iq_samples(spark, d).select("frame_id", "n", (C("i") - F.avg("i").over(w)).alias("i"), (C("q") - F.avg("q").over(w)).alias("q")))


@query("h17_cumulative_importance", """WITH s AS (SELECT p_brand AS feature, sum(p_retailprice) AS importance FROM part GROUP BY 1),
   c AS (SELECT feature, importance, sum(importance) OVER (ORDER BY importance DESC, feature ROWS UNBOUNDED PRECEDING) AS cum, sum(importance) OVER () AS tot,
         row_number() OVER (ORDER BY importance DESC, feature) AS top FROM s)
   SELECT feature, CAST(top AS INTEGER) AS top, round(cum / tot, 6) AS share FROM c""")
def _(spark, d):
    from aeroband.operators.models import cumulative_importance
    s = table(spark, d, "part").groupBy(C("p_brand").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    return rounded(cumulative_importance(s).select("feature", "top", "share"))


WRAP = "(p - lp - 2*pi()*floor((p - lp + pi())/(2*pi())))"
PHASE = """WITH a AS (SELECT frame_id, n, atan2(q, i) AS p, lag(atan2(q, i)) OVER (PARTITION BY frame_id ORDER BY n) AS lp FROM iq_samples)"""


@query("h18_phase_unwrap", PHASE + f""" SELECT frame_id, n, round(first(p) OVER w + sum(coalesce({WRAP}, 0)) OVER w, 6) AS phase FROM a
   WINDOW w AS (PARTITION BY frame_id ORDER BY n ROWS UNBOUNDED PRECEDING)""")
def _(spark, d):
    w = Window.partitionBy("frame_id").orderBy("n")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    p = V.iq_samples(spark, d).select("frame_id", "n", F.atan2("q", "i").alias("p"))
    stepped = p.withColumn("dp", X.wrap_phase(C("p") - F.lag("p").over(w)))
    return rounded(stepped.select("frame_id", "n", (F.first("p").over(run) + F.sum(F.coalesce("dp", F.lit(0.0))).over(run)).alias("phase")))


@query("h19_zero_crossing_rate", PHASE + f""", b AS (SELECT frame_id, n, {WRAP} AS dp FROM a WHERE lp IS NOT NULL),
   c AS (SELECT *, lag(sign(dp)) OVER (PARTITION BY frame_id ORDER BY n) AS ls FROM b)
   SELECT frame_id, round(sum(CASE WHEN ls IS NOT NULL AND sign(dp) <> ls THEN 1 ELSE 0 END)::DOUBLE / count(*), 6) AS zcr FROM c GROUP BY 1""")
def _(spark, d):
    from aeroband.operators.iq import zero_crossing_rate
    return rounded(V.iq_frames(spark, d).select("frame_id", zero_crossing_rate("i", "q").alias("zcr")))


@query("h20_interpolated_positions", f"""WITH s AS (SELECT *, epoch_us(pts) AS a, epoch_us(ts) AS b FROM ({STEPS}) WHERE pts IS NOT NULL),
   g AS (SELECT *, unnest(generate_series(a // 3600000000 + 1, (b - 1) // 3600000000)) AS k FROM s)
   SELECT uas_id, CAST(k * 3600 AS BIGINT) AS epoch_s, round(plat + (latitude - plat) * (k * 3600000000 - a)::DOUBLE / (b - a), 6) AS latitude,
     round(plon + (longitude - plon) * (k * 3600000000 - a)::DOUBLE / (b - a), 6) AS longitude,
     round(palt + (altitude - palt) * (k * 3600000000 - a)::DOUBLE / (b - a), 6) AS altitude FROM g""")
def _(spark, d):
    return rounded(tracking.interpolate(V.rid_messages(spark, d), ["uas_id"], 3600))


@query("h21_frequency_drift", """WITH p AS (SELECT label, vec_id, list_position(embedding, list_max(embedding)) - 1 AS peak FROM embeddings),
   s AS (SELECT label, abs(peak - lag(peak) OVER (PARTITION BY label ORDER BY vec_id)) * 1e5 AS jump FROM p)
   SELECT label, round(avg(jump), 4) AS change_rate, round(stddev_pop(jump) / (avg(jump) + 1e-12), 6) AS consistency FROM s GROUP BY 1""")
def _(spark, d):
    peak = V.psd_frames(spark, d).select("label", "frame_id", (X.argmax("psd") * C("bin_hz")).alias("hz"))
    jumps = ordered.with_previous(peak, "label", ["frame_id"], {"prev_hz": C("hz")}, F.floor(C("frame_id") / 4096))
    jump = F.abs(C("hz") - C("prev_hz"))
    return jumps.groupBy("label").agg(F.round(F.avg(jump), 4).alias("change_rate"),
                                      F.round(F.stddev_pop(jump) / (F.avg(jump) + 1e-12), 6).alias("consistency"))
