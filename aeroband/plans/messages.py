"""Registered queries: scalar functions and broadcast identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions import numeric, text as X, timing
from aeroband.functions.numeric import rounded
from aeroband.operators import ordered, quality, rules, telemetry as T, tracking
from aeroband.operators.privacy import anonymise
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.plans.sequences import SESSION_CTE, dist_sql
from aeroband.session import table

C = F.col


@query("k1_decibel_conversions", """SELECT id, round(10 * log10(value + 1e-12), 6) AS power_db, round(20 * log10(value + 1e-12), 6) AS magnitude_db,
   round(pow(10.0, signal_strength / 10.0::DOUBLE) * 1e6, 6) AS nanowatt FROM detections""")
def _(spark, d):
    return rounded(V.detections(spark, d).select("id", numeric.power_db("value").alias("power_db"), numeric.magnitude_db("value").alias("magnitude_db"),
                                                 (numeric.from_db("signal_strength") * 1e6).alias("nanowatt")))


@query("k2_signal_ratios", """WITH p AS (SELECT frame_id, max(i*i+q*q) AS peak, avg(i*i+q*q) AS mean, min(i*i+q*q) AS low FROM iq_samples GROUP BY 1)
   SELECT frame_id, round(10 * log10(mean / (low + 1e-12) + 1e-12), 4) AS snr_db, round(10 * log10(peak / (mean + 1e-12) + 1e-12), 6) AS papr_db,
   round(sqrt(peak) / (sqrt(mean) + 1e-12), 6) AS crest FROM p""")
def _(spark, d):
    from aeroband.functions import arrays as A
    p = V.iq_frames(spark, d).select("frame_id", A.power("i", "q").alias("p")).select(
        "frame_id", F.array_max("p").alias("peak"), A.mean("p").alias("mean"), F.array_min("p").alias("low"))
    return p.select("frame_id", F.round(numeric.snr_db("mean", "low"), 4).alias("snr_db"), F.round(numeric.papr_db("peak", "mean"), 6).alias("papr_db"),
                    F.round(numeric.crest_factor(F.sqrt("peak"), F.sqrt("mean")), 6).alias("crest"))


@query("k9_packed_numbers", """SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(trunc(x * 1000) AS INTEGER)), ',') AS packed,
   list_sum(list_transform(embedding, lambda x: trunc(x * 1000)::DOUBLE)) AS total FROM embeddings""")
def _(spark, d):
    packed = table(spark, d, "embeddings").select("vec_id", X.pack_numbers(F.transform("embedding", lambda x: (x * 1000).cast("int"))).alias("packed"))
    return packed.select("vec_id", "packed", F.aggregate(X.parse_numbers("packed"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("k10_json_field", "SELECT id, CAST(json_extract_string(metadata, '$.k') AS INTEGER) AS k FROM detections")
def _(spark, d):
    return V.detections(spark, d).select("id", F.get_json_object("metadata", "$.k").cast("int").alias("k"))


@query("k10_variant_field", "SELECT id, CAST(json_extract_string(metadata, '$.k') AS INTEGER) AS k FROM detections")
def _(spark, d):
    return V.detections(spark, d).select("id", F.try_variant_get(F.try_parse_json("metadata"), "$.k", "int").alias("k"))


@query("k11_time_formatting", """SELECT id, strftime(ts, '%Y-%m-%d') AS day, CAST(hour(ts) AS INTEGER) AS hour, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
   CAST(date_trunc('week', ts) AS TIMESTAMP) AS week FROM detections""")
def _(spark, d):
    return V.detections(spark, d).select("id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"),
                                         F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), timing.bucket("week", "ts").alias("week"))


@query("k14_identifier_anonymisation", """SELECT id, sha256('remote_id_salt_2024' || uas_id) AS uas_id, sha256('remote_id_salt_2024' || operator_id) AS operator_id FROM rid_messages""")
def _(spark, d):
    return anonymise(V.rid_messages(spark, d)).select("id", "uas_id", "operator_id")


@query("k15_little_endian_decode", """SELECT id, CAST(trunc(latitude * 1e7) AS BIGINT) AS i32, CAST(rssi AS BIGINT) AS i16, CAST(id % 60000 AS BIGINT) AS u16,
   CAST(id * 7919 % 4000000000 AS BIGINT) AS u32 FROM rid_messages""")
def _(spark, d):
    p = V.rid_messages(spark, d).select("id", F.concat(
        X.to_little_endian((C("latitude") * 1e7).cast("long"), 4), X.to_little_endian("rssi", 2), X.to_little_endian(C("id") % 60000, 2),
        X.to_little_endian(C("id") * 7919 % 4000000000, 4)).alias("payload"))
    return p.select("id", X.little_endian("payload", 0, 4, True).alias("i32"), X.little_endian("payload", 4, 2, True).alias("i16"),
                    X.little_endian("payload", 6, 2, False).alias("u16"), X.little_endian("payload", 8, 4, False).alias("u32"))


@query("k16_ascii_field_decode", "SELECT id, uas_id AS name FROM rid_messages")
def _(spark, d):
    p = V.rid_messages(spark, d).select("id", F.concat(X.to_ascii_field("uas_id", 20), F.unhex(F.lit("FF80"))).alias("payload"))
    return p.select("id", X.ascii_field("payload", 0, 22).alias("name"))


@query("k17_suspicious_identifiers", r"""SELECT id, NOT regexp_matches(u, '^[A-Z0-9][A-Z0-9-]{3,19}$') OR len(replace(u, u[1], '')) = 0 AND len(u) > 1 AS suspicious
   FROM (SELECT id, CASE WHEN id % 11 = 0 THEN lower(uas_id) WHEN id % 13 = 0 THEN 'AAAAAA' ELSE uas_id END AS u FROM rid_messages)""")
def _(spark, d):
    u = F.when(C("id") % 11 == 0, F.lower("uas_id")).when(C("id") % 13 == 0, "AAAAAA").otherwise(C("uas_id"))
    return V.rid_messages(spark, d).select("id", X.suspicious_identifier(u).alias("suspicious"))


TOPIC_SQL = "'site/' || (id % 5) || '/' || drone_type || CASE WHEN id % 2 = 0 THEN '/raw' ELSE '' END"


@query("k18_topic_wildcards", f"""SELECT id, regexp_matches(t, '^site/[^/]+/click$') AS one_level, regexp_matches(t, '^site/3(/.*)?$') AS below,
   starts_with(t, 'site/1') AS prefix FROM (SELECT id, {TOPIC_SQL} AS t FROM detections)""")
def _(spark, d):
    t = _topics(spark, d)
    return t.select("id", X.topic_matches("topic", "site/+/click").alias("one_level"), X.topic_matches("topic", "site/3/#").alias("below"),
                    X.topic_matches("topic", "site/1*").alias("prefix"))


def _topics(spark, d):
    tail = F.when(C("id") % 2 == 0, "/raw").otherwise("")
    return V.detections(spark, d).select("id", "ts", "confidence", F.concat(
        F.lit("site/"), (C("id") % 5).cast("string"), F.lit("/"), C("drone_type"), tail).alias("topic"))


# --------------------------------------------------------------------- packet decoding
def _packed(spark, d):
    """Messages with the integers a transmitter would send."""
    return V.rid_messages(spark, d).select(
        "*", (C("latitude") * 1e7).cast("long").alias("_lat"), (C("longitude") * 1e7).cast("long").alias("_lon"),
        (C("altitude") * 100).cast("long").alias("_alt"), (C("id") % 6).cast("int").alias("_type"))


def le(c, n):
    return X.to_little_endian(c, n)


ENCODED = """SELECT id, uas_id, CAST(trunc(latitude * 1e7) AS BIGINT) AS ilat, CAST(trunc(longitude * 1e7) AS BIGINT) AS ilon, CAST(trunc(altitude * 100) AS BIGINT) AS ialt,
   CAST(trunc(altitude) AS BIGINT) AS ualt, speed, heading, operator_id, id % 6 AS t FROM rid_messages"""


@query("t1_decode_simple_frame", f"SELECT id, CASE WHEN id % 10 <> 0 THEN uas_id END AS uas_id, CASE WHEN id % 10 <> 0 THEN round(ilat * 1e-7, 7) END AS latitude, "
       f"CASE WHEN id % 10 <> 0 THEN round(ilon * 1e-7, 7) END AS longitude, CASE WHEN id % 10 <> 0 THEN ualt END AS altitude FROM ({ENCODED})")
def _(spark, d):
    frame = F.concat(F.unhex(F.lit("02" * 10)), le("_lat", 4), le("_lon", 4), le(C("altitude").cast("long"), 2), X.to_ascii_field("uas_id", 20))
    p = _packed(spark, d).select("id", F.when(C("id") % 10 == 0, F.substring(frame, F.lit(1), F.lit(29))).otherwise(frame).alias("payload"))
    return T.decode_simple(p).select("id", "uas_id", F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"), "altitude")


@query("t2_decode_worker_layout", f"""SELECT id, rpad(lower(hex(uas_id)), 40, '0') AS uas_id, round(ilat / 1e7, 7) AS latitude, round(ilon / 1e7, 7) AS longitude, ualt::DOUBLE AS altitude,
   speed, CASE WHEN id % 4 = 0 THEN 0.0 ELSE heading END AS heading FROM ({ENCODED})""")
def _(spark, d):
    frame = F.concat(F.unhex(F.lit("0A" * 10)), X.to_ascii_field("uas_id", 20), le("_lat", 4), le("_lon", 4), le(C("altitude").cast("long"), 2),
                     le(C("speed") * 100, 2), le(C("heading") * 100, 2))
    p = _packed(spark, d).select("id", F.when(C("id") % 4 == 0, F.substring(frame, F.lit(1), F.lit(43))).otherwise(frame).alias("payload"))
    return T.decode_worker(p).select("id", "uas_id", F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"), "altitude", "speed", "heading")


@query("t3_decode_by_type", f"""SELECT id, CASE WHEN t = 0 THEN uas_id END AS uas_id, CASE WHEN t = 1 THEN round(ilat * 1e-7, 7) END AS latitude,
   CASE WHEN t = 1 THEN round(ialt * 0.01::DOUBLE, 2) END AS altitude_baro, CASE WHEN t = 1 THEN round(-(id % 500) * 0.01::DOUBLE, 2) END AS speed_vertical,
   CASE WHEN t = 3 THEN 'note ' || uas_id END AS description, CASE WHEN t = 4 THEN round(ilon * 1e-7, 7) END AS operator_longitude,
   CASE WHEN t = 4 THEN 7 END AS category, CASE WHEN t = 5 THEN operator_id END AS operator_id, CASE WHEN t = 2 THEN 5 END AS auth_type FROM ({ENCODED})""")
def _(spark, d):
    zero = lambda n: F.unhex(F.lit("00" * n))
    basic = F.concat(le(F.lit(1), 1), X.to_ascii_field("uas_id", 20), le(F.lit(0), 1))
    location = F.concat(le(F.lit(2), 1), le(C("heading") * 100, 2), le(C("speed") * 100, 2), le(-(C("id") % 500), 2), le("_lat", 4), le("_lon", 4),
                        le("_alt", 4), le("_alt", 4), zero(5), le(C("id") % 36000, 4))
    auth = F.concat(le(F.lit(5), 1), zero(23), zero(3), le(F.lit(9), 4))
    self_id = F.concat(le(F.lit(0), 1), X.to_ascii_field(F.concat(F.lit("note "), C("uas_id")), 23))
    system = F.concat(zero(2), le("_lat", 4), le("_lon", 4), zero(12), le(F.lit(7), 1), zero(1), le(F.lit(1), 4))
    operator = F.concat(le(F.lit(0), 1), X.to_ascii_field("operator_id", 20))
    t = C("_type")
    body = F.when(t == 0, basic).when(t == 1, location).when(t == 2, auth).when(t == 3, self_id).when(t == 4, system).otherwise(operator)
    out = T.decode_by_type(_packed(spark, d).select("id", t.alias("type_code"), body.alias("payload")))
    return out.select("id", "uas_id", F.round("latitude", 7).alias("latitude"), F.round("altitude_baro", 2).alias("altitude_baro"),
                      F.round("speed_vertical", 2).alias("speed_vertical"), "description", F.round("operator_longitude", 7).alias("operator_longitude"),
                      C("category").cast("int").alias("category"), "operator_id", C("auth_type").cast("int").alias("auth_type"))


def _ble(spark, d):
    frame = F.concat(F.unhex(F.lit("0201060303FAFF0FFF")), F.when(C("id") % 2 == 0, F.unhex(F.lit("0005"))).otherwise(F.unhex(F.lit("0010"))),
                     le("_type", 1), X.to_ascii_field("uas_id", 20), le("_lat", 4), le("_lon", 4), le("_alt", 4), le(C("speed") * 100, 2),
                     le(C("heading") * 100, 2), le(C("id"), 4))
    return _packed(spark, d).select("id", frame.alias("payload"))


@query("t4_decode_frame_layouts", f"""SELECT id, uas_id, round(ilat * 1e-7, 7) AS latitude, round(ilon * 1e-7, 7) AS longitude, round(ialt * 0.01::DOUBLE, 2) AS altitude,
   speed, heading, id AS message_time, t AS type_code FROM ({ENCODED})""")
def _(spark, d):
    out = T.decode(_ble(spark, d), "BLE_FRAME")
    return out.select("id", "uas_id", *[F.round(c, n).alias(c) for c, n in (("latitude", 7), ("longitude", 7), ("altitude", 2), ("speed", 2), ("heading", 2))],
                      "message_time", "type_code")


@query("t4_decode_wifi_beacon", f"SELECT id, uas_id, round(ilat * 1e-7, 7) AS latitude, round(ilon * 1e-7, 7) AS longitude, round(ialt * 0.01::DOUBLE, 2) AS altitude FROM ({ENCODED})")
def _(spark, d):
    head = F.concat(F.unhex(F.lit("80" + "00" * 15)), le(F.lit(13), 1), F.encode(F.lit("Drone_Network"), "US-ASCII"),
                    F.unhex(F.lit("010882848B960C121824" + "DD1C001122334455")), F.encode(F.lit("RID"), "US-ASCII"), le(F.lit(1), 1))
    frame = F.concat(head, X.to_ascii_field("uas_id", 20), le("_lat", 4), le("_lon", 4), le("_alt", 4))
    out = T.decode(_packed(spark, d).select("id", frame.alias("payload")), "WIFI_BEACON")
    return out.select("id", "uas_id", F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"), F.round("altitude", 2).alias("altitude"))


@query("t5_standard_fields", """SELECT uas_id, operator_id, latitude, longitude, altitude, speed, heading, CAST(NULL AS DOUBLE) AS vertical_speed, ts AS timestamp, rssi,
   CAST(NULL AS DOUBLE) AS frequency FROM rid_messages""")
def _(spark, d):
    return T.standard_fields(V.rid_messages(spark, d))


@query("t6_manufacturer_lookup", "SELECT id, CASE WHEN id % 2 = 0 THEN 'DJI' ELSE 'AUTEL' END AS manufacturer FROM rid_messages")
def _(spark, d):
    return T.decode(_ble(spark, d), "BLE_FRAME").select("id", T.manufacturer(C("company")).alias("manufacturer"))


@query("t7_message_priority", """SELECT id, CASE message_type WHEN 'BASIC_ID' THEN 1 WHEN 'LOCATION' THEN 2 WHEN 'SELF_ID' THEN 3 WHEN 'SYSTEM' THEN 4 WHEN 'OPERATOR_ID' THEN 5
   ELSE 6 END AS priority FROM rid_messages""")
def _(spark, d):
    return V.rid_messages(spark, d).select("id", T.priority().alias("priority"), "ts").orderBy("priority", "ts").select("id", "priority")


@query("t8_duplicate_suppression", """SELECT id FROM (SELECT id, ts, lag(ts) OVER (PARTITION BY uas_id, message_type ORDER BY ts, id) AS p FROM rid_messages)
   WHERE p IS NULL OR ts - p > INTERVAL 36 HOUR""")
def _(spark, d):
    marked = T.mark_duplicates(V.rid_messages(spark, d).select("id", "ts", "uas_id", "message_type"), ["uas_id", "message_type"], 36 * 3600)
    return marked.filter(~C("is_duplicate")).select("id")


@query("t9_rate_limiting", """SELECT id FROM (SELECT id, message_type, row_number() OVER (PARTITION BY uas_id, message_type, epoch_us(ts) // 864000000000 ORDER BY ts, id) AS r FROM rid_messages)
   WHERE r <= CASE message_type WHEN 'LOCATION' THEN 10 ELSE 1 END""")
def _(spark, d):
    return T.rate_limited(V.rid_messages(spark, d), 10 * 86400).select("id")


@query("t10_session_rows", SESSION_CTE + f""", st AS (SELECT *, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon FROM n WINDOW w AS (PARTITION BY uas_id, session_no ORDER BY ts, id))
   SELECT uas_id, session_no, CAST(count(*) AS BIGINT) AS points, round(coalesce(sum(CASE WHEN plat IS NOT NULL THEN {dist_sql('plat', 'plon', 'latitude', 'longitude')} END), 0), 3) AS length_m,
   max(speed) AS max_speed, max(altitude) AS max_altitude, round(avg(altitude), 6) AS mean_altitude, arg_min(latitude, (ts, id)) AS first_lat, arg_max(latitude, (ts, id)) AS last_lat,
   min(ts) AS start_ts, max(ts) AS end_ts FROM st GROUP BY 1, 2""")
def _(spark, d):
    out = tracking.session_rows(V.rid_messages(spark, d), 43200)
    return out.select("uas_id", "session_no", "points", F.round("length_m", 3).alias("length_m"), "max_speed", "max_altitude",
                      F.round("mean_altitude", 6).alias("mean_altitude"), "first_lat", "last_lat", "start_ts", "end_ts")


@query("t11_messages_by_emitter_operator", "SELECT id FROM rid_messages WHERE uas_id = 'UAS-12' OR operator_id = 'OP-7'")
def _(spark, d):
    return V.rid_messages(spark, d).filter((C("uas_id") == "UAS-12") | (C("operator_id") == "OP-7")).select("id")


@query("t12_latest_emitter_info", """SELECT m.uas_id, m.id, m.latitude, m.longitude, n.n_name AS operator_name FROM
   (SELECT *, row_number() OVER (PARTITION BY uas_id ORDER BY ts DESC, id DESC) r FROM rid_messages) m LEFT JOIN nation n ON m.operator_id = 'OP-' || n.n_nationkey WHERE r = 1""")
def _(spark, d):
    from aeroband.plans.places import _registry
    return T.latest_info(V.rid_messages(spark, d), _registry(spark, d)).select("uas_id", "id", "latitude", "longitude", "operator_name")
