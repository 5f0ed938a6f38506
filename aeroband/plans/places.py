"""Registered queries: geodesy, zones, heat maps, tracks and positioning."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions import arrays as X, geo
from aeroband.functions.numeric import rounded
from aeroband.operators import correlation, filters as P, geofence as G, ordered, positioning as T, scans, tracking
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.session import small_side
from aeroband.plans.sequences import SESSION_CTE, STEPS, dist_sql

C = F.col
M_DEG = "(pi() / 180 * 6371.0 * 1000)"
INSIDE = """(len(list_filter(generate_series(1, 5), lambda k: (ring[k].lat > {lat}) <> (ring[k % 5 + 1].lat > {lat}) AND
   {lon} < ring[k].lon + ({lat} - ring[k].lat) / (ring[k % 5 + 1].lat - ring[k].lat) * (ring[k % 5 + 1].lon - ring[k].lon))) % 2 = 1)"""
IN_ZONE = ("(CASE WHEN is_circle THEN " + dist_sql("{lat}", "{lon}", "clat", "clon") + " <= radius_m ELSE " + INSIDE + " END)")
BAND = "(altitude_min IS NULL OR {alt} >= altitude_min) AND (altitude_max IS NULL OR {alt} <= altitude_max)"


def in_zone(lat="latitude", lon="longitude"):
    return IN_ZONE.replace("{lat}", lat).replace("{lon}", lon)


# --------------------------------------------------------------------- scalar geodesy
@query("k3_haversine_distance", f"SELECT id, round({dist_sql('latitude', 'longitude', '37.7749', '-122.4194')}, 4) AS metres FROM detections")
def _(spark, d):
    m = geo.haversine_m("latitude", "longitude", F.lit(37.7749), F.lit(-122.4194))
    return V.detections(spark, d).select("id", F.round(m, 4).alias("metres"))


E2 = "(2 * (1/298.257223563) - pow(1/298.257223563, 2))"
NPHI = f"(6378137.0 / sqrt(1 - {E2} * pow(sin(radians(latitude)), 2)))"
ECEF = f"""SELECT id, latitude, longitude, altitude, ({NPHI} + altitude) * cos(radians(latitude)) * cos(radians(longitude)) AS x,
   ({NPHI} + altitude) * cos(radians(latitude)) * sin(radians(longitude)) AS y,
   ({NPHI} * (1 - {E2}) + altitude) * sin(radians(latitude)) AS z FROM detections"""


@query("k4_geodetic_to_ecef", f"SELECT id, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM ({ECEF})")
def _(spark, d):
    p = geo.geodetic_to_ecef("latitude", "longitude", "altitude")
    return V.detections(spark, d).select("id", p.alias("p")).select("id", *[F.round(f"p.{c}", 4).alias(c) for c in "xyz"])


@query("k5_ecef_to_geodetic", "SELECT id, round(latitude, 7) AS latitude, round(longitude, 7) AS longitude, round(altitude, 3) AS altitude FROM detections")
def _(spark, d):
    p = V.detections(spark, d).select("id", geo.geodetic_to_ecef("latitude", "longitude", "altitude").alias("p")).select("id", "p.*")
    return p.select("id", geo.ecef_to_geodetic("x", "y", "z").alias("g")).select(
        "id", F.round("g.latitude", 7).alias("latitude"), F.round("g.longitude", 7).alias("longitude"), F.round("g.altitude", 3).alias("altitude"))


@query("k6_enu_to_ecef", f"""SELECT id, round(x - sin(radians(longitude)) * 100 - sin(radians(latitude)) * cos(radians(longitude)) * 50
     + cos(radians(latitude)) * cos(radians(longitude)) * 10, 4) AS x,
   round(y + cos(radians(longitude)) * 100 - sin(radians(latitude)) * sin(radians(longitude)) * 50 + cos(radians(latitude)) * sin(radians(longitude)) * 10, 4) AS y,
   round(z + cos(radians(latitude)) * 50 + sin(radians(latitude)) * 10, 4) AS z FROM ({ECEF})""")
def _(spark, d):
    p = geo.enu_to_ecef(F.lit(100.0), F.lit(50.0), F.lit(10.0), "latitude", "longitude", "altitude")
    return V.detections(spark, d).select("id", p.alias("p")).select("id", *[F.round(f"p.{c}", 4).alias(c) for c in "xyz"])


@query("k7_rssi_distance", "SELECT id, round(pow(10.0, (-45 - rssi) / 20.0::DOUBLE), 6) AS docs_m, round(pow(10.0, (-59 - rssi) / 20.0::DOUBLE), 6) AS config_m FROM rid_messages")
def _(spark, d):
    return rounded(V.rid_messages(spark, d).select("id", geo.rssi_distance_m("rssi").alias("docs_m"), geo.rssi_distance_m("rssi", -59.0).alias("config_m")))


@query("k8_bounds_and_centre", """SELECT min(latitude) AS south, min(longitude) AS west, max(latitude) AS north, max(longitude) AS east,
   round((min(latitude) + max(latitude)) / 2, 6) AS center_lat, round((min(longitude) + max(longitude)) / 2, 6) AS center_lon FROM detections""")
def _(spark, d):
    b = G.bounds(V.detections(spark, d))
    return b.select("south", "west", "north", "east", geo.box_centre("south", "west", "north", "east").alias("c")).select(
        "south", "west", "north", "east", F.round("c.latitude", 6).alias("center_lat"), F.round("c.longitude", 6).alias("center_lon"))


@query("k13_coordinate_validation", """SELECT id, (latitude * 2.4 BETWEEN -90 AND 90) AND (longitude * 1.47 BETWEEN -180 AND 180) AS position_ok,
   (altitude * 20 - 600) BETWEEN -500 AND 10000 AS altitude_ok FROM detections""")
def _(spark, d):
    return V.detections(spark, d).select("id", geo.valid_coordinates(C("latitude") * 2.4, C("longitude") * 1.47).alias("position_ok"),
                                         geo.valid_altitude(C("altitude") * 20 - 600).alias("altitude_ok"))


# ----------------------------------------------------------------------- spatial joins
@query("d12_point_in_polygon", f"""SELECT d.id, z.zone_id FROM detections d, zones z WHERE NOT is_circle AND {INSIDE.replace('{lat}', 'latitude').replace('{lon}', 'longitude')}""")
def _(spark, d):
    return G.inside(V.detections(spark, d), V.zones(spark, d).filter(~C("is_circle"))).select("id", "zone_id")


@query("d13_point_in_circle", f"SELECT d.id, z.zone_id FROM detections d, zones z WHERE is_circle AND {dist_sql('latitude', 'longitude', 'clat', 'clon')} <= radius_m")
def _(spark, d):
    return G.inside(V.detections(spark, d), V.zones(spark, d).filter("is_circle")).select("id", "zone_id")


@query("d14_zone_altitude_band", f"SELECT d.id, z.zone_id FROM detections d, zones z WHERE {in_zone()} AND {BAND.replace('{alt}', 'altitude')}")
def _(spark, d):
    return G.containment(V.detections(spark, d), V.zones(spark, d)).select("id", "zone_id")


EDGE = f"""(CASE WHEN is_circle THEN greatest(0.0, {dist_sql('latitude', 'longitude', 'clat', 'clon')} - radius_m)
   WHEN {INSIDE.replace('{lat}', 'latitude').replace('{lon}', 'longitude')} THEN 0.0
   ELSE list_min(list_transform(generate_series(1, 5), lambda k: segdist(latitude, longitude, ring[k].lat, ring[k].lon, ring[k % 5 + 1].lat, ring[k % 5 + 1].lon))) END)"""


def _seg_expr(lat, lon, a, b, c, d):
    ax, ay = f"(({b}) - {lon}) * 0"[:0] + f"((({b}) - ({lon})) * cos(radians({lat})) * {M_DEG})", f"((({a}) - ({lat})) * {M_DEG})"
    bx, by = f"((({d}) - ({lon})) * cos(radians({lat})) * {M_DEG})", f"((({c}) - ({lat})) * {M_DEG})"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    t = f"greatest(0.0, least(1.0, -({ax} * {dx} + {ay} * {dy}) / ({dx} * {dx} + {dy} * {dy})))"
    return f"sqrt(pow({ax} + {t} * {dx}, 2) + pow({ay} + {t} * {dy}, 2))"


EDGE = EDGE.replace("segdist(latitude, longitude, ring[k].lat, ring[k].lon, ring[k % 5 + 1].lat, ring[k % 5 + 1].lon)",
                    _seg_expr("latitude", "longitude", "ring[k].lat", "ring[k].lon", "ring[k % 5 + 1].lat", "ring[k % 5 + 1].lon"))
NEAR = f"""SELECT d.id, z.zone_id, {EDGE} AS distance_m FROM detections d, zones z
   WHERE abs(latitude - clat) < 0.02 AND abs(longitude - clon) < 0.03"""


@query("d15_buffered_proximity", f"""SELECT id, zone_id, round(distance_m, 3) AS distance_m, CASE WHEN distance_m = 0 THEN 'critical' WHEN distance_m <= 25 THEN 'alert'
   ELSE 'warning' END AS severity FROM ({NEAR}) WHERE distance_m <= 50""")
def _(spark, d):
    return G.proximity(V.detections(spark, d), V.zones(spark, d)).select("id", "zone_id", F.round("distance_m", 3).alias("distance_m"), "severity")


@query("d16_nearby_emitters", f"SELECT id, emitter FROM rid_messages WHERE {dist_sql('latitude', 'longitude', '37.78', '-122.41')} <= 2000")
def _(spark, d):
    box = P.within_radius(37.78, -122.41, 2.001)
    exact = geo.haversine_m("latitude", "longitude", F.lit(37.78), F.lit(-122.41)) <= 2000
    return V.rid_messages(spark, d).filter(box & exact).select("id", "emitter")


# ---------------------------------------------------- radio detections and telemetry
MATCH = """WITH p AS (SELECT d.id, m.id AS message_id, abs(epoch_us(d.ts) - epoch_us(m.ts)) AS gap,
     (CASE WHEN least(abs(d.frequency - 2.402e9), abs(d.frequency - 2.426e9), abs(d.frequency - 2.480e9), abs(d.frequency - 2.412e9), abs(d.frequency - 5.180e9)) < 10e6
       THEN 1.0 ELSE 0.0 END + greatest(0.0, 1 - {dist} / 1000)) / 2 AS score
   FROM detections d JOIN rid_messages m ON m.ts > d.ts - INTERVAL 500 MILLISECOND AND m.ts < d.ts + INTERVAL 500 MILLISECOND),
   b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, gap, message_id) AS r FROM p WHERE score > 0.7)""".format(
    dist=dist_sql("d.latitude", "d.longitude", "m.latitude", "m.longitude"))


@query("d7_rf_remote_id_correlation", MATCH + """ SELECT d.id, b.message_id, round(b.score, 6) AS score,
   round(least(1.0, d.confidence + CASE WHEN b.id IS NULL THEN 0 ELSE 0.2 END), 6) AS confidence FROM detections d LEFT JOIN b ON b.id = d.id AND b.r = 1""")
def _(spark, d):
    out = correlation.enhance(V.detections(spark, d), V.rid_messages(spark, d))
    return rounded(out.select("id", "message_id", "score", "confidence"))


@query("d8_nearest_rid_band", """WITH b(name, hz) AS (VALUES ('ble', 2.402e9), ('ble_38', 2.426e9), ('ble_39', 2.480e9), ('wifi_24', 2.412e9), ('wifi_5', 5.180e9))
   SELECT id, (SELECT name FROM b ORDER BY abs(frequency - hz), name LIMIT 1) AS band, round((SELECT min(abs(frequency - hz)) FROM b), 3) AS gap_hz,
     (SELECT min(abs(frequency - hz)) FROM b) < 10e6 AS matched FROM detections""")
def _(spark, d):
    near = correlation.nearest_band(C("frequency"))
    return V.detections(spark, d).select("id", near.alias("b")).select(
        "id", C("b.name").alias("band"), F.round("b.gap_hz", 3).alias("gap_hz"), (C("b.gap_hz") < 10e6).alias("matched"))


@query("d17_missing_remote_id", MATCH + " SELECT id FROM detections WHERE id NOT IN (SELECT id FROM b)")
def _(spark, d):
    return correlation.without_message(V.detections(spark, d), V.rid_messages(spark, d)).select("id")


@query("d18_unregistered_operators", "SELECT id, operator_id FROM rid_messages WHERE operator_id NOT IN (SELECT 'OP-' || n_nationkey FROM nation)")
def _(spark, d):
    registry = _registry(spark, d)
    return correlation.unregistered(V.rid_messages(spark, d), registry).select("id", "operator_id")


def _registry(spark, d):
    from aeroband.session import table
    n = C("n_nationkey")
    return table(spark, d, "nation").select(
        F.concat(F.lit("OP-"), n.cast("string")).alias("operator_id"), C("n_name").alias("operator_name"),
        F.array((n * 4).cast("long"), (n * 3 + 1).cast("long")).alias("allowed_zones"))


@query("d18_unauthorised_zone", f"""SELECT m.id, z.zone_id FROM rid_messages m, zones z, nation n WHERE {in_zone()} AND {BAND.replace('{alt}', 'altitude')}
   AND m.operator_id = 'OP-' || n.n_nationkey AND z.zone_id <> n.n_nationkey * 4 AND z.zone_id <> n.n_nationkey * 3 + 1""")
def _(spark, d):
    inside = G.containment(V.rid_messages(spark, d), V.zones(spark, d))
    return correlation.unauthorised(inside, _registry(spark, d)).select("id", "zone_id")


@query("d21_pair_distances", """SELECT DISTINCT t.array_id, t.ref_id, t.other_id,
   round(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), 6) AS distance_m
   FROM tdoa_measurements t JOIN receivers a ON a.receiver_id = t.ref_id JOIN receivers b ON b.receiver_id = t.other_id""")
def _(spark, d):
    return rounded(T.pair_distances(V.tdoa_measurements(spark, d), V.receivers(spark, d)))


# -------------------------------------------------------------------- maps and hotspots
@query("m1_heatmap_points", "SELECT id, latitude, longitude, confidence AS intensity FROM detections WHERE confidence >= 0.5")
def _(spark, d):
    return G.heatmap_points(V.detections(spark, d))


@query("m2_heatmap_grid", """WITH c AS (SELECT CAST(floor(latitude / 0.005) AS BIGINT) AS row, CAST(floor(longitude / 0.005) AS BIGINT) AS col, CAST(count(*) AS BIGINT) AS n
   FROM detections WHERE confidence >= 0.5 GROUP BY 1, 2) SELECT row, col, n, round(n::DOUBLE / (SELECT max(n) FROM c), 6) AS intensity FROM c""")
def _(spark, d):
    return rounded(G.heatmap_grid(G.heatmap_points(V.detections(spark, d)), 0.005))


@query("m3_hotspots", """SELECT cell_x, cell_y, detection_count, center_lat, center_lon FROM (SELECT CAST(trunc(latitude / (0.5 / 111.0::DOUBLE)) AS BIGINT) AS cell_x,
   CAST(trunc(longitude / (0.5 / 111.0::DOUBLE)) AS BIGINT) AS cell_y, CAST(count(*) AS BIGINT) AS detection_count, round(avg(latitude), 6) AS center_lat,
   round(avg(longitude), 6) AS center_lon FROM detections GROUP BY 1, 2) WHERE detection_count >= 5 ORDER BY detection_count DESC, cell_x, cell_y LIMIT 20""")
def _(spark, d):
    return rounded(G.hotspots(V.detections(spark, d), 0.5, 5))


@query("m4_positions_in_bounds", "SELECT id, uas_id FROM rid_messages WHERE latitude BETWEEN 37.72 AND 37.78 AND longitude BETWEEN -122.46 AND -122.40")
def _(spark, d):
    return V.rid_messages(spark, d).filter(P.bounding_box(37.72, -122.46, 37.78, -122.40)).select("id", "uas_id")


@query("m5_track_of_emitter", "SELECT id, ts FROM rid_messages WHERE uas_id = 'UAS-8' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'")
def _(spark, d):
    return tracking.track_of(V.rid_messages(spark, d), "UAS-8", "2024-01-05", "2024-01-25").select("id", "ts")


@query("m6_tracks_per_type", "SELECT message_type, CAST(count(DISTINCT uas_id) AS BIGINT) AS tracks FROM rid_messages GROUP BY 1")
def _(spark, d):
    return V.rid_messages(spark, d).groupBy("message_type").agg(F.countDistinct("uas_id").alias("tracks"))


SESSIONS = SESSION_CTE + """, s AS (SELECT uas_id, session_no, CAST(count(*) AS BIGINT) AS points, min(ts) AS start_ts, max(ts) AS end_ts FROM n GROUP BY 1, 2)"""


@query("m7_sessions", SESSIONS + " SELECT * FROM s")
def _(spark, d):
    return tracking.sessions(V.rid_messages(spark, d), 43200).groupBy("uas_id", "session_no").agg(
        F.count("*").alias("points"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


@query("m8_session_states", SESSIONS + """ SELECT uas_id, session_no, CASE WHEN end_ts < TIMESTAMP '2024-01-25' - INTERVAL 120 HOUR THEN 'LOST'
   WHEN end_ts < TIMESTAMP '2024-01-25' - INTERVAL 24 HOUR THEN 'INACTIVE' WHEN session_no > 1 THEN 'RECOVERED' ELSE 'ACTIVE' END AS state FROM s""")
def _(spark, d):
    s = tracking.sessions(V.rid_messages(spark, d), 43200).groupBy("uas_id", "session_no").agg(F.max("ts").alias("end_ts"))
    return tracking.session_state(s, "2024-01-25 00:00:00", 24 * 3600, 120 * 3600).select("uas_id", "session_no", "state")


@query("m9_track_simplification", f"""WITH RECURSIVE p AS (SELECT uas_id, id, latitude, longitude, row_number() OVER (PARTITION BY uas_id ORDER BY ts, id) AS k FROM rid_messages),
   f AS (SELECT uas_id, id, latitude, longitude, k, latitude AS klat, longitude AS klon, true AS kept FROM p WHERE k = 1
     UNION ALL SELECT p.uas_id, p.id, p.latitude, p.longitude, p.k,
       CASE WHEN {dist_sql('f.klat', 'f.klon', 'p.latitude', 'p.longitude')} >= 9000 THEN p.latitude ELSE f.klat END,
       CASE WHEN {dist_sql('f.klat', 'f.klon', 'p.latitude', 'p.longitude')} >= 9000 THEN p.longitude ELSE f.klon END,
       {dist_sql('f.klat', 'f.klon', 'p.latitude', 'p.longitude')} >= 9000 FROM f JOIN p ON p.uas_id = f.uas_id AND p.k = f.k + 1)
   SELECT uas_id, id, latitude, longitude FROM f WHERE kept""")
def _(spark, d):
    return tracking.simplify(V.rid_messages(spark, d), 9000.0).select("uas_id", "id", "latitude", "longitude")


@query("m10_newest_track_points", "SELECT uas_id, id FROM (SELECT *, row_number() OVER (PARTITION BY uas_id ORDER BY ts DESC, id DESC) r FROM rid_messages) WHERE r <= 1000")
def _(spark, d):
    return tracking.newest_points(V.rid_messages(spark, d)).select("uas_id", "id")


@query("m11_geofence_violations", f"""SELECT id, zone_id FROM ({STEPS}) m, zones z WHERE active AND {in_zone()} AND {BAND.replace('{alt}', 'altitude')}
   AND NOT (pts IS NOT NULL AND {in_zone('plat', 'plon')} AND {BAND.replace('{alt}', 'palt')})""")
def _(spark, d):
    return G.violations(V.rid_messages(spark, d), V.zones(spark, d)).select("id", "zone_id")


@query("m12_zones_by_type", "SELECT zone_type, CAST(count(*) AS BIGINT) AS n FROM zones WHERE active GROUP BY 1")
def _(spark, d):
    return G.zones_by_type(V.zones(spark, d))


@query("m13_coverage", f"""WITH g AS (SELECT r AS row, c AS col FROM range(40) a(r), range(40) b(c)),
   k AS (SELECT DISTINCT row, col FROM g, zones WHERE {dist_sql('(37.70 + (row + 0.5) * 0.005)', '(-122.50 + (col + 0.5) * 0.005)', 'clat', 'clon')} <= radius_m)
   SELECT CAST(count(*) AS BIGINT) AS covered_cells, CAST(1600 - count(*) AS BIGINT) AS blind_cells, count(*) * 100.0::DOUBLE / 1600 AS coverage_percent FROM k""")
def _(spark, d):
    return G.coverage(V.zones(spark, d), 37.70, -122.50, 40, 40, 0.005)


@query("m14_proximity_severity", f"""SELECT CASE WHEN distance_m = 0 THEN 'critical' WHEN distance_m <= 100 THEN 'alert' ELSE 'warning' END AS severity, CAST(count(*) AS BIGINT) AS n
   FROM ({NEAR}) WHERE distance_m <= 200 GROUP BY 1""")
def _(spark, d):
    return G.proximity(V.detections(spark, d), V.zones(spark, d), 200.0, 100.0).groupBy("severity").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------------- positioning
@query("m15_best_reference", """WITH e AS (SELECT array_id, ref_id AS receiver_id, snr FROM tdoa_measurements UNION ALL SELECT array_id, other_id, snr FROM tdoa_measurements),
   m AS (SELECT array_id, receiver_id, avg(snr) AS s FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY round(s, 9) DESC, receiver_id) k FROM m)
   SELECT array_id, receiver_id, round(s, 6) AS mean_snr FROM r WHERE k = 1""")
def _(spark, d):
    return rounded(T.best_reference(V.tdoa_measurements(spark, d)))


@query("m16_distance_difference", "SELECT event_id, other_id, round(CASE WHEN other_id % 2 = 0 THEN -tdoa_s ELSE tdoa_s END * 299792458.0, 6) AS metres FROM tdoa_measurements")
def _(spark, d):
    return V.tdoa_measurements(spark, d).select("event_id", "other_id", F.round(T.distance_difference("tdoa_s", C("other_id") % 2 == 0), 6).alias("metres"))


def _events(spark, d):
    return T.gathered(V.tdoa_measurements(spark, d), V.receivers(spark, d))


def _flat_events(spark, d):
    """Planar variant: receivers and emissions share one height."""
    r = V.receivers(spark, d).withColumn("z", F.lit(0.0))
    e = V.emissions(spark, d).select("event_id", C("x").alias("ex"), C("y").alias("ey"))
    m = V.tdoa_measurements(spark, d).join(e.hint("merge"), "event_id")  # events grow: none goes whole to the driver
    at = {t: r.select(C("receiver_id").alias(f"{t}_id"), C("x").alias(f"{t}x"), C("y").alias(f"{t}y")) for t in ("ref", "other")}
    j = m.join(at["ref"], "ref_id").join(at["other"], "other_id")

    def rng(t):
        return F.sqrt((C("ex") - C(f"{t}x")) * (C("ex") - C(f"{t}x")) + (C("ey") - C(f"{t}y")) * (C("ey") - C(f"{t}y")))

    flat = j.select("event_id", "array_id", "ref_id", "other_id", ((rng("other") - rng("ref")) / T.LIGHT_M_S).alias("tdoa_s"), "snr", "quality")
    return T.gathered(flat, r)


FULL_ARRAY = "array_id IN (SELECT array_id FROM receivers GROUP BY 1 HAVING count(*) >= {n} AND min(slot) = 0)"


@query("m17_linear_fix_2d", f"SELECT event_id, round(x, 3) AS x, round(y, 3) AS y FROM emissions WHERE {FULL_ARRAY.format(n=4)}")
def _(spark, d):
    return T.linear_fix(_flat_events(spark, d).filter(F.size("m") >= 3), 2).select("event_id", F.round("fix.x", 3).alias("x"), F.round("fix.y", 3).alias("y"))


@query("m18_linear_fix_3d", f"SELECT event_id, round(x, 2) AS x, round(y, 2) AS y, round(z, 2) AS z FROM emissions WHERE {FULL_ARRAY.format(n=5)}")
def _(spark, d):
    return T.linear_fix(_events(spark, d).filter(F.size("m") >= 4), 3).select("event_id", *[F.round(f"fix.{c}", 2).alias(c) for c in "xyz"])


@query("m19_iterative_refinement", f"SELECT event_id, round(x, 3) AS x, round(y, 3) AS y FROM emissions WHERE {FULL_ARRAY.format(n=4)}")
def _(spark, d):
    linear = T.linear_fix(_flat_events(spark, d).filter(F.size("m") >= 3), 2)
    start = F.struct((C("fix.x") + 25.0).alias("x"), (C("fix.y") - 40.0).alias("y"))
    return T.refine(linear.withColumn("start", start), C("start")).select("event_id", F.round("fix.x", 3).alias("x"), F.round("fix.y", 3).alias("y"))


@query("m20_position_residuals", """WITH g AS (SELECT t.event_id, t.tdoa_s * 299792458.0 - (
     sqrt((e.x+5-o.x)*(e.x+5-o.x)+(e.y-3-o.y)*(e.y-3-o.y)+(e.z-o.z)*(e.z-o.z)) - sqrt((e.x+5-r.x)*(e.x+5-r.x)+(e.y-3-r.y)*(e.y-3-r.y)+(e.z-r.z)*(e.z-r.z))) AS miss
   FROM tdoa_measurements t JOIN emissions e ON e.event_id = t.event_id JOIN receivers r ON r.receiver_id = t.ref_id JOIN receivers o ON o.receiver_id = t.other_id)
   SELECT event_id, round(sqrt(avg(miss * miss)), 6) AS residual_m FROM g GROUP BY 1""")
def _(spark, d):
    guess = V.emissions(spark, d).select("event_id", F.struct((C("x") + 5).alias("x"), (C("y") - 3).alias("y"), "z").alias("fix"))
    return rounded(T.residuals(_events(spark, d).join(guess.hint("merge"), "event_id"), 3).select("event_id", "residual_m"))


HROWS = """WITH h AS (SELECT e.event_id, (e.x-r.x)/d AS a, (e.y-r.y)/d AS b, (e.z-r.z)/d AS c FROM (SELECT e.event_id, e.x, e.y, e.z, r.x AS rx, r.y AS ry, r.z AS rz,
     sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z)) AS d FROM emissions e JOIN receivers r ON r.array_id = e.array_id) e, LATERAL (SELECT rx AS x, ry AS y, rz AS z) r),"""
INVERSE = """s AS (SELECT event_id, sum(a*a) aa, sum(a*b) ab, sum(a*c) ac, sum(b*b) bb, sum(b*c) bc, sum(c*c) cc FROM h GROUP BY 1),
   q AS (SELECT event_id, (bb*cc-bc*bc)/det AS q0, (aa*cc-ac*ac)/det AS q1, (aa*bb-ab*ab)/det AS q2 FROM
     (SELECT *, aa*(bb*cc-bc*bc) - ab*(ab*cc-bc*ac) + ac*(ab*bc-bb*ac) AS det FROM s))"""


@query("m21_dilution_of_precision", HROWS + INVERSE + """ SELECT event_id, round(sqrt(q0+q1+q2), 4) AS gdop, round(sqrt(q0+q1+q2), 4) AS pdop, round(sqrt(q0+q1), 4) AS hdop,
   round(sqrt(q2), 4) AS vdop FROM q WHERE event_id IN (SELECT event_id FROM emissions WHERE array_id IN (SELECT array_id FROM receivers GROUP BY 1 HAVING count(*) >= 4))""")
def _(spark, d):
    rs = V.receivers(spark, d).groupBy("array_id").agg(F.array_sort(F.collect_list(F.struct("receiver_id", "x", "y", "z"))).alias("rs")).filter(F.size("rs") >= 4)
    pts = V.emissions(spark, d).select("event_id", "array_id", *[C(c).alias(f"p{c}") for c in "xyz"]).join(rs, "array_id")
    return T.dilution(pts).select("event_id", *[F.round(f"dop.{c}", 4).alias(c) for c in ("gdop", "pdop", "hdop", "vdop")])


@query("m22_cramer_rao_bound", """WITH h AS (SELECT t.event_id, (o.x-e.x)/od-(r.x-e.x)/rd AS a, (o.y-e.y)/od-(r.y-e.y)/rd AS b, (o.z-e.z)/od-(r.z-e.z)/rd AS c
   FROM tdoa_measurements t JOIN emissions e ON e.event_id = t.event_id JOIN receivers r ON r.receiver_id = t.ref_id JOIN receivers o ON o.receiver_id = t.other_id,
   LATERAL (SELECT sqrt((e.x-o.x)*(e.x-o.x)+(e.y-o.y)*(e.y-o.y)+(e.z-o.z)*(e.z-o.z)) AS od, sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z)) AS rd) l),"""
   + INVERSE + f""" SELECT event_id, round(q0 * 4, 3) AS var_x, round(q1 * 4, 3) AS var_y, round(q2 * 4, 3) AS var_z FROM q
   WHERE event_id IN (SELECT event_id FROM emissions WHERE {FULL_ARRAY.format(n=5)})""")
def _(spark, d):
    at = V.emissions(spark, d).select("event_id", *[C(c).alias(f"p{c}") for c in "xyz"])
    out = T.cramer_rao(_events(spark, d).filter(F.size("m") >= 4).join(at, "event_id"), 2.0)
    return out.select("event_id", *[F.round(f"crlb.var_{c}", 3).alias(f"var_{c}") for c in "xyz"])


@query("m23_error_ellipse", """WITH c AS (SELECT emitter, var_pop(latitude) AS a, covar_pop(latitude, longitude) AS b, var_pop(longitude) AS d FROM detections GROUP BY 1),
   e AS (SELECT emitter, (a+d)/2 + sqrt(pow((a-d)/2, 2) + b*b) AS l1, (a+d)/2 - sqrt(pow((a-d)/2, 2) + b*b) AS l2, degrees(0.5*atan2(2*b, a-d)) AS o FROM c)
   SELECT emitter, round(sqrt(l1 * (-2*ln(0.05))), 6) AS major, round(sqrt(l2 * (-2*ln(0.05))), 6) AS minor, round(o, 4) AS orientation_deg,
     round(pi() * sqrt(l1 * (-2*ln(0.05))) * sqrt(l2 * (-2*ln(0.05))), 6) AS area FROM e""")
def _(spark, d):
    cov = V.detections(spark, d).groupBy("emitter").agg(
        F.var_pop("latitude").alias("a"), F.covar_pop("latitude", "longitude").alias("b"), F.var_pop("longitude").alias("d"))
    e = cov.select("emitter", T.error_ellipse("a", "b", "d").alias("e"))
    return e.select("emitter", F.round("e.major", 6).alias("major"), F.round("e.minor", 6).alias("minor"),
                    F.round("e.orientation_deg", 4).alias("orientation_deg"), F.round("e.area", 6).alias("area"))


@query("m24_geometry_validation", """WITH p AS (SELECT a.array_id, avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS baseline FROM receivers a JOIN receivers b
     ON a.array_id = b.array_id AND a.receiver_id <> b.receiver_id GROUP BY 1),
   t AS (SELECT array_id, count(*) AS n, max(CASE WHEN slot = 0 THEN x END) x0, max(CASE WHEN slot = 0 THEN y END) y0, max(CASE WHEN slot = 1 THEN x END) x1,
     max(CASE WHEN slot = 1 THEN y END) y1, max(CASE WHEN slot = 2 THEN x END) x2, max(CASE WHEN slot = 2 THEN y END) y2 FROM receivers GROUP BY 1)
   SELECT t.array_id, CAST(n AS INTEGER) AS n, round(0.5 * abs(x0*(y1-y2) + x1*(y2-y0) + x2*(y0-y1)), 4) AS area_m2, round(baseline, 6) AS baseline_m,
     n >= 3 AND 0.5 * abs(x0*(y1-y2) + x1*(y2-y0) + x2*(y0-y1)) >= 1 AND baseline >= 10 AS valid FROM t JOIN p ON t.array_id = p.array_id""")
def _(spark, d):
    out = T.validate_geometry(V.receivers(spark, d))
    return out.select("array_id", "n", F.round("area_m2", 4).alias("area_m2"), F.round("baseline_m", 6).alias("baseline_m"), "valid")


@query("m25_kalman_track_smoothing")
def _(spark, d):
    base = V.rid_messages(spark, d).select("id", "uas_id", "ts", "latitude", "longitude", "altitude")
    return rounded(scans.kalman_smooth(base, ["uas_id"], "ts", "id", ["latitude", "longitude", "altitude"], slice_seconds=7 * 86400))


@query("m26_fix_statistics", HROWS + INVERSE + f""", f AS (SELECT event_id FROM emissions WHERE {FULL_ARRAY.format(n=4)})
   SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS converged, 0.0::DOUBLE AS mean_residual, 100.0::DOUBLE AS success_percent, round(avg(sqrt(q0+q1+q2)), 3) AS mean_gdop
   FROM f LEFT JOIN q USING (event_id)""")
def _(spark, d):
    linear = T.linear_fix(_flat_events(spark, d).filter(F.size("m") >= 3), 2)
    fixed = T.residuals(T.refine(linear.withColumn("start", C("fix")), C("start")), 2).select("event_id", "fix", "residual_m")
    heights = V.emissions(spark, d).select("event_id", "array_id", C("z").alias("pz"))
    placed = fixed.join(heights.hint("merge"), "event_id").join(small_side(T.installations(V.receivers(spark, d))), "array_id")
    points = placed.withColumn("px", C("fix.x")).withColumn("py", C("fix.y"))
    stats = T.fix_statistics(T.dilution(points).select((C("residual_m") < 1.0).alias("converged"), C("dop.gdop").alias("gdop"), "residual_m"))
    return stats.select("total", "converged", F.round("mean_residual", 4).alias("mean_residual"), "success_percent", F.round("mean_gdop", 3).alias("mean_gdop"))


@query("m27_privacy_retention", """SELECT CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY) AS BIGINT) AS kept,
   CAST(count(*) FILTER (WHERE ts >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY AND ts < TIMESTAMP '2024-04-10' - INTERVAL 80 DAY) AS BIGINT) AS anonymised FROM rid_messages""")
def _(spark, d):
    from aeroband.operators.privacy import retain_positions
    out = retain_positions(V.rid_messages(spark, d), "2024-04-10 00:00:00", positions_days=90, identity_days=80)
    return out.agg(F.count("*").alias("kept"), F.count_if(C("anonymised")).alias("anonymised"))
