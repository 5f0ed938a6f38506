"""Domain tables derived from the given tables, in Spark and in SQL by the same formulas.

The given tables stand in for captures, detections, alerts and telemetry.  Every view
is a projection or an equality filter of a scan, so column pruning and predicates reach
the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroband.session import spread, table

# --------------------------------------------------------------------------- SQL side
SQL: dict[str, str] = {
    "detections": """
        SELECT event_id AS id, ts, user_id AS emitter, event_type AS drone_type, value,
               value / (value + 50) AS confidence,
               CASE WHEN value / (value + 50) > 0.8 THEN 'HIGH'
                    WHEN value / (value + 50) > 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level,
               37.70 + ((event_id * 7919) % 2000) / 10000.0::DOUBLE AS latitude,
               -122.50 + ((event_id * 104729) % 2000) / 10000.0::DOUBLE AS longitude,
               ((event_id * 31) % 6000) / 10.0::DOUBLE AS altitude,
               2.4e9 + ((event_id * 7919) % 835) * 1e5 AS frequency,
               1e6 * (1 + event_id % 25) AS bandwidth,
               CAST(-110 + (event_id * 37) % 100 AS INTEGER) AS signal_strength,
               ((event_id * 13) % 300) / 10.0::DOUBLE AS snr,
               CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'RID-' || user_id END AS remote_id,
               CASE WHEN event_id % 12 = 0 THEN '' ELSE 'SIG-' || (event_id % 97) END AS signature_hash,
               'scanner-' || (event_id % 5) AS source,
               event_id % 10 = 0 AS in_restricted_zone,
               props AS metadata
        FROM events""",
    "alerts": """
        SELECT event_id AS id, event_id AS detection_id, ts, user_id AS emitter,
               CASE WHEN value / (value + 50) >= 0.95 THEN 'CRITICAL'
                    WHEN value / (value + 50) >= 0.85 THEN 'HIGH'
                    WHEN value / (value + 50) >= 0.70 THEN 'MEDIUM'
                    WHEN value / (value + 50) >= 0.50 THEN 'LOW' ELSE NULL END AS severity,
               CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'CAT-' || (event_id % 5) END AS category,
               'station-' || (user_id % 20) AS source,
               event_id % 3 = 0 AS acknowledged,
               CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 2 = 1 AS resolved,
               CASE WHEN CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 2 = 1
                    THEN ts + CAST(regexp_extract(props, '[0-9]+') AS INTEGER) * INTERVAL 1 MINUTE END AS resolved_at,
               CAST(event_id % 4 AS INTEGER) AS escalation_level
        FROM events WHERE event_type = 'error'""",
    "rid_messages": """
        SELECT event_id AS id, 'UAS-' || user_id AS uas_id, user_id AS emitter,
               ts + (event_id % 900) * INTERVAL 1 MILLISECOND AS ts,
               37.70 + ((event_id * 7919 + 13) % 2000) / 10000.0::DOUBLE AS latitude,
               -122.50 + ((event_id * 104729 + 17) % 2000) / 10000.0::DOUBLE AS longitude,
               value AS altitude,
               (event_id % 60)::DOUBLE AS speed,
               (event_id % 360)::DOUBLE AS heading,
               CAST(-105 + (event_id * 41) % 90 AS INTEGER) AS rssi,
               CASE WHEN event_id % 3 = 0 THEN 'wifi' ELSE 'ble' END AS transport,
               CASE event_id % 6 WHEN 0 THEN 'BASIC_ID' WHEN 1 THEN 'LOCATION' WHEN 2 THEN 'AUTHENTICATION'
                    WHEN 3 THEN 'SELF_ID' WHEN 4 THEN 'SYSTEM' ELSE 'OPERATOR_ID' END AS message_type,
               'OP-' || (user_id % 40) AS operator_id
        FROM events WHERE event_type = 'view'""",
    "spectra": """
        SELECT vec_id AS frame_id, label, CAST(pos - 1 AS INTEGER) AS bin,
               2.4e9 + (pos - 1) * 1e5 AS freq_hz, embedding[pos]::DOUBLE * 100 AS psd_db
        FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings)""",
    "iq_samples": """
        SELECT vec_id AS frame_id, label, CAST(pos - 1 AS INTEGER) AS n,
               embedding[2 * pos - 1]::DOUBLE AS i, embedding[2 * pos]::DOUBLE AS q
        FROM (SELECT vec_id, label, embedding, unnest(generate_series(1, len(embedding) // 2)) AS pos FROM embeddings)""",
    "dft": """
        SELECT s.frame_id, CAST((k + 16) % 32 AS INTEGER) AS bin,
               sum(w * (i * cos(2 * pi() * k * n / 32) + q * sin(2 * pi() * k * n / 32))) AS re,
               sum(w * (q * cos(2 * pi() * k * n / 32) - i * sin(2 * pi() * k * n / 32))) AS im
        FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * n / 31) AS w FROM iq_samples) s, range(32) r(k) GROUP BY 1, 2""",
    "dft_rect": """
        SELECT frame_id, CAST((k + 16) % 32 AS INTEGER) AS bin,
               sum(i * cos(2 * pi() * k * n / 32) + q * sin(2 * pi() * k * n / 32)) AS re,
               sum(q * cos(2 * pi() * k * n / 32) - i * sin(2 * pi() * k * n / 32)) AS im
        FROM iq_samples, range(32) r(k) GROUP BY 1, 2""",
    "iq_power": """
        SELECT *, i * i + q * q AS p, sqrt(i * i + q * q) AS amp, atan2(q, i) AS ph FROM iq_samples""",
    "iq_steps": """
        SELECT frame_id, n, ph - lph AS raw, ph - lph - 2 * pi() * floor((ph - lph + pi()) / (2 * pi())) AS dp
        FROM (SELECT *, lag(ph) OVER (PARTITION BY frame_id ORDER BY n) AS lph FROM iq_power) WHERE lph IS NOT NULL""",
    "log_lines": """
        SELECT event_id AS line_no, ts AS src_ts,
               '[' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '] [' ||
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARNING' ELSE 'INFO' END
               || '] [mod' || (user_id % 7) || '] latency=' || (event_id % 977) || ' ms' AS line,
               CASE user_id % 5 WHEN 0 THEN 'system' WHEN 1 THEN 'api' WHEN 2 THEN 'hardware'
                    WHEN 3 THEN 'security' ELSE 'performance' END AS category
        FROM events""",
    "recordings": """
        SELECT o_orderkey AS id, o_custkey AS session_id,
               CASE o_orderstatus WHEN 'O' THEN 'iq' WHEN 'F' THEN 'npy' ELSE 'csv' END AS file_format,
               o_orderdate AS start_time, CAST(floor(o_totalprice * 1000) AS BIGINT) AS file_size_bytes,
               2e6 AS sample_rate
        FROM orders""",
    "recording_sessions": """
        SELECT c_custkey AS id, c_name AS name, c_mktsegment AS site, c_nationkey AS nation_id FROM customer""",
    "receivers": """
        SELECT s_suppkey // 6 AS array_id, s_suppkey AS receiver_id, CAST(s_suppkey % 6 AS INTEGER) AS slot,
               CASE s_suppkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 1000.0 WHEN 2 THEN 500.0 WHEN 3 THEN 1100.0 WHEN 4 THEN -80.0 ELSE 420.0 END::DOUBLE
                 + (s_suppkey * 37) % 50 AS x,
               CASE s_suppkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 60.0 WHEN 2 THEN 1000.0 WHEN 3 THEN 900.0 WHEN 4 THEN 700.0 ELSE -150.0 END::DOUBLE
                 + (s_suppkey * 53) % 40 AS y,
               CASE s_suppkey % 6 WHEN 0 THEN 0.0 WHEN 1 THEN 120.0 WHEN 2 THEN 30.0 WHEN 3 THEN 200.0 WHEN 4 THEN 90.0 ELSE 260.0 END::DOUBLE
                 + (s_suppkey * 17) % 30 AS z,
               s_acctbal / 500.0 AS snr
        FROM supplier""",
    "emissions": """
        SELECT c_custkey AS event_id, c_custkey % (SELECT max(s_suppkey) // 6 + 1 FROM supplier) AS array_id, ((c_custkey * 37) % 900 + 50)::DOUBLE AS x,
               ((c_custkey * 53) % 900 + 50)::DOUBLE AS y, ((c_custkey * 17) % 100 + 10)::DOUBLE AS z
        FROM customer""",
    "tdoa_measurements": """
        SELECT e.event_id, e.array_id, r0.receiver_id AS ref_id, r.receiver_id AS other_id,
               (sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z))
                - sqrt((e.x-r0.x)*(e.x-r0.x)+(e.y-r0.y)*(e.y-r0.y)+(e.z-r0.z)*(e.z-r0.z))) / 299792458.0 AS tdoa_s,
               (r.snr + r0.snr) / 2 AS snr, 1.0::DOUBLE + (r.receiver_id % 3) AS quality
        FROM emissions e JOIN receivers r0 ON r0.array_id = e.array_id AND r0.slot = 0
        JOIN receivers r ON r.array_id = e.array_id AND r.slot > 0""",
    "zones": """
        SELECT s_suppkey AS zone_id, 'zone-' || s_suppkey AS zone_name,
               CASE s_suppkey % 3 WHEN 0 THEN 'restricted' WHEN 1 THEN 'no_fly' ELSE 'warning' END AS zone_type,
               s_suppkey % 2 = 0 AS is_circle, clat, clon, (300 + (s_suppkey * 13) % 700)::DOUBLE AS radius_m,
               [{'lat': clat + 0.004, 'lon': clon}, {'lat': clat + 0.001, 'lon': clon + 0.006}, {'lat': clat - 0.003, 'lon': clon + 0.002},
                {'lat': clat, 'lon': clon - 0.001}, {'lat': clat - 0.002, 'lon': clon - 0.005}] AS ring,
               CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE ((s_suppkey % 5) * 20)::DOUBLE END AS altitude_min,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE (200 + s_suppkey % 300)::DOUBLE END AS altitude_max,
               s_suppkey % 5 <> 0 AS active
        FROM (SELECT *, 37.70 + ((s_suppkey * 7919) % 2000) / 10000.0::DOUBLE AS clat,
                     -122.50 + ((s_suppkey * 104729) % 2000) / 10000.0::DOUBLE AS clon FROM supplier)""",
    "predictions": """
        SELECT vec_id AS id, label AS truth,
               CAST((label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS INTEGER) AS predicted,
               ((vec_id * 37) % 100) / 100.0::DOUBLE AS score
        FROM embeddings""",
}


# ------------------------------------------------------------------------- Spark side
def _rows(spark, d, name, source):
    return table(spark, d, name) if source is None else source


def detections(spark: SparkSession, d: str, source: DataFrame | None = None) -> DataFrame:
    e, conf = F.col("event_id"), F.col("value") / (F.col("value") + 50)
    return _rows(spark, d, "events", source).select(
        e.alias("id"), "ts", F.col("user_id").alias("emitter"), F.col("event_type").alias("drone_type"), "value",
        conf.alias("confidence"),
        F.when(conf > 0.8, "HIGH").when(conf > 0.6, "MEDIUM").otherwise("LOW").alias("threat_level"),
        (37.70 + ((e * 7919) % 2000) / 10000.0).alias("latitude"),
        (-122.50 + ((e * 104729) % 2000) / 10000.0).alias("longitude"),
        (((e * 31) % 6000) / 10.0).alias("altitude"),
        (2.4e9 + ((e * 7919) % 835) * 1e5).alias("frequency"),
        (1e6 * (1 + e % 25)).alias("bandwidth"),
        (-110 + (e * 37) % 100).cast("int").alias("signal_strength"),
        (((e * 13) % 300) / 10.0).alias("snr"),
        F.when(e % 4 != 0, F.concat(F.lit("RID-"), F.col("user_id").cast("string"))).alias("remote_id"),
        F.when(e % 12 == 0, "").otherwise(F.concat(F.lit("SIG-"), (e % 97).cast("string"))).alias("signature_hash"),
        F.concat(F.lit("scanner-"), (e % 5).cast("string")).alias("source"),
        (e % 10 == 0).alias("in_restricted_zone"),
        F.col("props").alias("metadata"),
    )


def alerts(spark: SparkSession, d: str, source: DataFrame | None = None) -> DataFrame:
    e, conf = F.col("event_id"), F.col("value") / (F.col("value") + 50)
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return _rows(spark, d, "events", source).filter(F.col("event_type") == "error").select(
        e.alias("id"), e.alias("detection_id"), "ts", F.col("user_id").alias("emitter"),
        F.when(conf >= 0.95, "CRITICAL").when(conf >= 0.85, "HIGH").when(conf >= 0.70, "MEDIUM")
         .when(conf >= 0.50, "LOW").alias("severity"),
        F.when(e % 5 != 0, F.concat(F.lit("CAT-"), (e % 5).cast("string"))).alias("category"),
        F.concat(F.lit("station-"), (F.col("user_id") % 20).cast("string")).alias("source"),
        (e % 3 == 0).alias("acknowledged"),
        (k % 2 == 1).alias("resolved"),
        F.when(k % 2 == 1, F.col("ts") + F.make_dt_interval(mins=k)).alias("resolved_at"),
        (e % 4).cast("int").alias("escalation_level"),
    )


def rid_messages(spark: SparkSession, d: str, source: DataFrame | None = None) -> DataFrame:
    e = F.col("event_id")
    kind = e % 6
    return _rows(spark, d, "events", source).filter(F.col("event_type") == "view").select(
        e.alias("id"), F.concat(F.lit("UAS-"), F.col("user_id").cast("string")).alias("uas_id"),
        F.col("user_id").alias("emitter"),
        (F.col("ts") + F.make_dt_interval(secs=((e % 900) / 1000).cast("decimal(18,6)"))).alias("ts"),
        (37.70 + ((e * 7919 + 13) % 2000) / 10000.0).alias("latitude"),
        (-122.50 + ((e * 104729 + 17) % 2000) / 10000.0).alias("longitude"),
        F.col("value").alias("altitude"),
        (e % 60).cast("double").alias("speed"), (e % 360).cast("double").alias("heading"),
        (-105 + (e * 41) % 90).cast("int").alias("rssi"),
        F.when(e % 3 == 0, "wifi").otherwise("ble").alias("transport"),
        F.when(kind == 0, "BASIC_ID").when(kind == 1, "LOCATION").when(kind == 2, "AUTHENTICATION")
         .when(kind == 3, "SELF_ID").when(kind == 4, "SYSTEM").otherwise("OPERATOR_ID").alias("message_type"),
        F.concat(F.lit("OP-"), (F.col("user_id") % 40).cast("string")).alias("operator_id"),
    )


def spectra(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("frame_id"), "label", F.posexplode("embedding").alias("bin", "_p"),
    ).select("frame_id", "label", "bin", (2.4e9 + F.col("bin") * 1e5).alias("freq_hz"),
             (F.col("_p").cast("double") * 100).alias("psd_db"))


def psd_frames(spark: SparkSession, d: str, source: DataFrame | None = None) -> DataFrame:
    """One row per frame: spectrum as an array plus its frequency grid."""
    return spread(_rows(spark, d, "embeddings", source)).select(
        F.col("vec_id").alias("frame_id"), "label", F.lit(2.4e9).alias("f0_hz"), F.lit(1e5).alias("bin_hz"),
        F.transform("embedding", lambda x: x.cast("double") * 100).alias("psd"))


def iq_frames(spark: SparkSession, d: str) -> DataFrame:
    half = F.sequence(F.lit(1), (F.size("embedding") / 2).cast("int"))
    return spread(table(spark, d, "embeddings")).select(
        F.col("vec_id").alias("frame_id"), "label",
        F.transform(half, lambda p: F.element_at("embedding", 2 * p - 1).cast("double")).alias("i"),
        F.transform(half, lambda p: F.element_at("embedding", 2 * p).cast("double")).alias("q"),
    )


def iq_samples(spark: SparkSession, d: str) -> DataFrame:
    return iq_frames(spark, d).select(
        "frame_id", "label", F.posexplode(F.arrays_zip("i", "q")).alias("n", "_s"),
    ).select("frame_id", "label", "n", F.col("_s.i").alias("i"), F.col("_s.q").alias("q"))


def log_lines(spark: SparkSession, d: str, source: DataFrame | None = None) -> DataFrame:
    u, t = F.col("user_id"), F.col("event_type")
    level = F.when(t == "error", "ERROR").when(t == "purchase", "WARNING").otherwise("INFO")
    return _rows(spark, d, "events", source).select(
        F.col("event_id").alias("line_no"), F.col("ts").alias("src_ts"),
        F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] [mod"),
                 (u % 7).cast("string"), F.lit("] latency="), (F.col("event_id") % 977).cast("string"),
                 F.lit(" ms")).alias("line"),
        F.when(u % 5 == 0, "system").when(u % 5 == 1, "api").when(u % 5 == 2, "hardware")
         .when(u % 5 == 3, "security").otherwise("performance").alias("category"),
    )


def recordings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"),
        F.when(F.col("o_orderstatus") == "O", "iq").when(F.col("o_orderstatus") == "F", "npy").otherwise("csv")
         .alias("file_format"),
        F.col("o_orderdate").alias("start_time"),
        F.floor(F.col("o_totalprice") * 1000).alias("file_size_bytes"), F.lit(2e6).alias("sample_rate"),
    )


def recording_sessions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("site"),
        F.col("c_nationkey").alias("nation_id"))


def _by_slot(slot, values):
    out = F.lit(float(values[-1]))
    for k in range(len(values) - 2, -1, -1):
        out = F.when(slot == k, float(values[k])).otherwise(out)
    return out


def receivers(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    slot = s % 6
    return table(spark, d, "supplier").select(
        F.floor(s / 6).alias("array_id"), s.alias("receiver_id"), slot.cast("int").alias("slot"),
        (_by_slot(slot, [0, 1000, 500, 1100, -80, 420]) + (s * 37) % 50).alias("x"),
        (_by_slot(slot, [0, 60, 1000, 900, 700, -150]) + (s * 53) % 40).alias("y"),
        (_by_slot(slot, [0, 120, 30, 200, 90, 260]) + (s * 17) % 30).alias("z"),
        (F.col("s_acctbal") / 500.0).alias("snr"),
    )


def emissions(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    arrays = table(spark, d, "supplier").agg(F.floor(F.max("s_suppkey") / 6) + 1).scalar()
    return table(spark, d, "customer").select(
        c.alias("event_id"), (c % arrays).alias("array_id"), ((c * 37) % 900 + 50).cast("double").alias("x"),
        ((c * 53) % 900 + 50).cast("double").alias("y"), ((c * 17) % 100 + 10).cast("double").alias("z"))


def tdoa_measurements(spark: SparkSession, d: str) -> DataFrame:
    e = emissions(spark, d)
    r = receivers(spark, d)
    ref = r.filter("slot = 0").select("array_id", F.col("receiver_id").alias("ref_id"), *[F.col(c).alias(f"_0{c}") for c in ("x", "y", "z", "snr")])
    other = r.filter("slot > 0").select("array_id", F.col("receiver_id").alias("other_id"), *[F.col(c).alias(f"_1{c}") for c in ("x", "y", "z", "snr")])

    def dist(tag):
        return F.sqrt(sum((F.col(c) - F.col(f"_{tag}{c}")) * (F.col(c) - F.col(f"_{tag}{c}")) for c in ("x", "y", "z")))

    return e.join(ref, "array_id").join(other, "array_id").select(
        "event_id", "array_id", "ref_id", "other_id", ((dist("1") - dist("0")) / 299792458.0).alias("tdoa_s"),
        ((F.col("_1snr") + F.col("_0snr")) / 2).alias("snr"), (1.0 + F.col("other_id") % 3).alias("quality"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    base = table(spark, d, "supplier").select(
        s, (37.70 + ((s * 7919) % 2000) / 10000.0).alias("clat"), (-122.50 + ((s * 104729) % 2000) / 10000.0).alias("clon"))

    def at(dlat, dlon):
        return F.struct((F.col("clat") + dlat).alias("lat"), (F.col("clon") + dlon).alias("lon"))

    return base.select(
        s.alias("zone_id"), F.concat(F.lit("zone-"), s.cast("string")).alias("zone_name"),
        F.when(s % 3 == 0, "restricted").when(s % 3 == 1, "no_fly").otherwise("warning").alias("zone_type"),
        (s % 2 == 0).alias("is_circle"), "clat", "clon", (300 + (s * 13) % 700).cast("double").alias("radius_m"),
        F.array(at(0.004, 0.0), at(0.001, 0.006), at(-0.003, 0.002), at(0.0, -0.001), at(-0.002, -0.005)).alias("ring"),
        F.when(s % 4 != 0, ((s % 5) * 20).cast("double")).alias("altitude_min"),
        F.when(s % 6 != 0, (200 + s % 300).cast("double")).alias("altitude_max"),
        (s % 5 != 0).alias("active"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("label").alias("truth"),
        ((F.col("label") + F.when(F.col("vec_id") % 7 == 0, 1).otherwise(0)) % 10).cast("int").alias("predicted"),
        (((F.col("vec_id") * 37) % 100) / 100.0).alias("score"),
    )
