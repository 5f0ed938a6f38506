"""Registered queries: sources, sinks and snapshots.  Each writes what it needs to the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from aeroband.functions.numeric import rounded
from aeroband.operators import geofence as G, ordered, tracking
from aeroband.functions.timing import epoch_us
from aeroband.plans import views as V
from aeroband.plans.registry import query
from aeroband.session import run_directory, table
from aeroband.sources import captures as K, signatures as S, snapshots as N, tables as T

C = F.col


@query("a1_declared_scan", "SELECT CAST(id AS VARCHAR) AS id, ts AS timestamp, drone_type, confidence, threat_level FROM detections")
def _(spark, d):
    root = run_directory(spark, "scan")
    stored = V.detections(spark, d).select(C("id").cast("string").alias("id"), C("ts").cast("timestamp").alias("timestamp"), "drone_type", "confidence", "threat_level")
    T.write_parquet(stored, f"{root}/detections")
    return T.scan(spark, root, "detections").select("id", "timestamp", "drone_type", "confidence", "threat_level")


@query("a2_capture_build", "SELECT frame_id, n, i, q FROM iq_samples")
def _(spark, d):
    folder = run_directory(spark, "captures")
    placed = K.write_captures(V.iq_frames(spark, d), folder, "label")
    manifest_path = run_directory(spark, "manifest")
    placed.write.parquet(manifest_path)
    manifest = spark.read.parquet(manifest_path).select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "sample_offset", "frame_id")
    chunks = K.build_frames(spark, folder, "complex64", chunk=32).filter("_error is null")
    back = chunks.withColumn("file", F.regexp_extract("path", "[^/]+$", 0)).join(manifest, ["file", "sample_offset"])
    z = back.select("frame_id", F.posexplode(F.arrays_zip("i", "q")).alias("n", "z"))
    return z.select("frame_id", "n", C("z.i").cast("double").alias("i"), C("z.q").cast("double").alias("q"))


@query("a5_csv_samples", """SELECT round(sum(i), 4) AS sum_i, round(sum(q), 4) AS sum_q, CAST(count(*) AS BIGINT) AS n, 2e6 AS sample_rate FROM (SELECT round(i, 4) AS i, round(q, 4) AS q FROM iq_samples)""")
def _(spark, d):
    folder = run_directory(spark, "csv-iq")
    s = V.iq_samples(spark, d).select("frame_id", "n", F.round("i", 4).alias("i"), F.round("q", 4).alias("q"))
    K.write_csv(s, folder, ["frame_id", "n"], sample_rate=2e6, center_freq=2.45e9)
    back = K.read_csv(spark, folder, "*.txt")
    return back.agg(F.round(F.sum(C("i").cast("double")), 4).alias("sum_i"), F.round(F.sum(C("q").cast("double")), 4).alias("sum_q"), F.count("*").alias("n"), F.max("sample_rate").alias("sample_rate"))


@query("a8_format_detection", r"""SELECT page_id, CASE WHEN e IN ('iq', 'bin', 'raw') THEN 'raw' WHEN e IN ('csv', 'txt') THEN 'csv' WHEN e = 'npy' THEN 'numpy' WHEN e IN ('h5', 'hdf5') THEN 'hdf5' WHEN e = 'zst' THEN 'zstd'
     WHEN e = 'gz' THEN 'gzip' WHEN e = 'bz2' THEN 'bzip2' WHEN e = 'cfile' THEN 'gnuradio' WHEN e = 'dat' THEN 'uhd' WHEN e IN ('lz4', 'sigmf', 'wav', 'rf64', 'scp') THEN e
     WHEN html LIKE 'SIGM%' THEN 'sigmf' WHEN html LIKE 'RIFF____WAVE%' THEN 'wav' ELSE 'unknown' END AS format
   FROM (SELECT page_id, html, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS e FROM pages)""")
def _(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", K.detect_format(C("url"), F.encode("html", "UTF-8")).alias("format"))


@query("a9_offset_limit_chunks", "SELECT frame_id, n, i, q FROM iq_samples WHERE n >= 5 AND n < 23")
def _(spark, d):
    f = V.iq_frames(spark, d).select(C("frame_id").cast("string").alias("path"), F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("sample_offset"), "i", "q")
    halves = f.select("path", F.posexplode(F.sequence(F.lit(0), F.size("i") - 1, F.lit(16))).alias("chunk", "at"), "i", "q").select(
        "path", "chunk", C("at").cast("long").alias("sample_offset"), F.slice("i", C("at") + 1, F.lit(16)).alias("i"), F.slice("q", C("at") + 1, F.lit(16)).alias("q"))
    cut = K.slice_samples(halves, 5, 18)
    z = cut.select(C("path").cast("long").alias("frame_id"), "sample_offset", F.posexplode(F.arrays_zip("i", "q")).alias("k", "z"))
    return z.select("frame_id", (C("sample_offset") + C("k")).cast("int").alias("n"), C("z.i").alias("i"), C("z.q").alias("q"))


@query("a10_capture_inventory", "SELECT label AS file_group, 'raw' AS format, CAST(sum(len(embedding) // 2) AS BIGINT) AS samples, CAST(sum(len(embedding) // 2) * 8 AS BIGINT) AS size_bytes FROM embeddings GROUP BY 1")
def _(spark, d):
    folder = run_directory(spark, "captures")
    K.write_captures(V.iq_frames(spark, d), folder, "label").write.format("noop").mode("overwrite").save()
    inv = K.inventory(spark, folder)
    group = F.regexp_extract("path", r"/(\d+)-\d+\.iq$", 1).cast("int")
    return inv.groupBy(group.alias("file_group"), "format").agg(F.sum("samples").alias("samples"), F.sum("size_bytes").alias("size_bytes"))


DET = ["id", "drone_type", "confidence", "threat_level"]


@query("a12_csv_sink", "SELECT id, drone_type, round(confidence, 6) AS confidence, threat_level FROM detections")
def _(spark, d):
    path = run_directory(spark, "csv")
    T.write_csv(V.detections(spark, d).select(*DET), path, ";", gzip=True)
    back = spark.read.schema("id long, drone_type string, confidence double, threat_level string").option("header", True).option("sep", ";").csv(path)
    return rounded(back)


@query("a13_json_sink", "SELECT CAST(count(*) AS BIGINT) AS record_count, TIMESTAMP '2024-01-31 00:00:00' AS export_date FROM detections")
def _(spark, d):
    path = run_directory(spark, "json")
    T.write_json(V.detections(spark, d).select(*DET), path, "2024-01-31 00:00:00")
    return spark.read.schema("export_date timestamp, record_count long").json(f"{path}/manifest")


@query("a14_parquet_sink", "SELECT id, drone_type, confidence, threat_level FROM detections WHERE drone_type = 'view'")
def _(spark, d):
    path = run_directory(spark, "parquet")
    T.write_parquet(V.detections(spark, d).select(*DET), path, ["drone_type"])
    return spark.read.parquet(path).filter(C("drone_type") == "view").select(*DET)


@query("a15_geojson_sink", "SELECT id, 'Point' AS kind, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude FROM detections")
def _(spark, d):
    path = run_directory(spark, "geojson")
    T.write_geojson(T.point_features(V.detections(spark, d), ["id", "drone_type"]), path)
    f = spark.read.schema("value string").text(f"{path}/features").select(F.from_json("value", "geometry struct<type:string,coordinates:array<double>>, properties struct<id:bigint>").alias("f"))
    return f.select(C("f.properties.id").alias("id"), C("f.geometry.type").alias("kind"), F.round(F.get("f.geometry.coordinates", F.lit(0)), 6).alias("longitude"),
                    F.round(F.get("f.geometry.coordinates", F.lit(1)), 6).alias("latitude"))


@query("a16_feature_assembly", """SELECT 'Polygon' AS kind, CAST(zone_id AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS part, CAST(6 AS INTEGER) AS points FROM zones
   UNION ALL SELECT 'LineString', uas_id, CAST(epoch_us(ts) // 604800000000 AS BIGINT), CAST(count(*) AS INTEGER) FROM rid_messages GROUP BY 2, 3""")
def _(spark, d):
    polys = V.zones(spark, d).select(G.polygon_feature("ring", F.struct(C("zone_id").cast("string").alias("name"))).alias("value"))
    week = F.floor(epoch_us("ts") / 604_800_000_000)  # a long line is written in parts
    pts = V.rid_messages(spark, d).groupBy("uas_id", week.alias("part")).agg(F.array_sort(F.collect_list(F.struct("ts", "latitude", "longitude"))).alias("p"))
    lines = pts.select(G.line_feature(C("p"), F.struct(C("uas_id").alias("name"), "part")).alias("value"))
    head = F.from_json("value", "geometry struct<type:string>, properties struct<name:string, part:bigint>")
    size = F.when(head["geometry"]["type"] == "Polygon", F.size(F.from_json(F.get_json_object("value", "$.geometry.coordinates[0]"), "array<array<double>>"))).otherwise(
        F.size(F.from_json(F.get_json_object("value", "$.geometry.coordinates"), "array<array<double>>")))
    return polys.unionByName(lines).select(head["geometry"]["type"].alias("kind"), head["properties"]["name"].alias("name"), head["properties"]["part"].alias("part"), size.alias("points"))


@query("a17_field_subset", "SELECT id, drone_type, snr, bandwidth FROM detections")
def _(spark, d):
    return T.subset(V.detections(spark, d), ["id", "drone_type", "snr", "bandwidth", "absent"])


@query("a18_export_detections", """SELECT id, ts FROM detections WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND drone_type = 'click' AND confidence >= 0.5 ORDER BY ts DESC, id DESC LIMIT 100""")
def _(spark, d):
    return T.export_detections(V.detections(spark, d), "2024-01-05", "2024-01-20", "click", None, 0.5, 100).select("id", "ts")


@query("a18_export_alerts", "SELECT id, severity FROM alerts WHERE severity = 'MEDIUM' AND resolved AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts DESC, id DESC LIMIT 50")
def _(spark, d):
    return T.export_alerts(V.alerts(spark, d), "2024-01-05", None, "MEDIUM", True, 50).select("id", "severity")


@query("a18_export_messages", "SELECT id FROM rid_messages WHERE uas_id = 'UAS-9'")
def _(spark, d):
    return T.export_messages(V.rid_messages(spark, d), uas_id="UAS-9").select("id")


def _documents(spark, d):
    """Nested catalogue documents, one per supplier nation."""
    p = table(spark, d, "part")
    band = F.struct(F.lit("2.4 GHz").alias("band"), (C("p_size") * 1e7).alias("min_freq"), (C("p_size") * 1e7 + 5e6).alias("max_freq"))
    sig = F.struct(C("p_partkey").cast("string").alias("model"), F.array(C("p_name")).alias("variants"), F.array(band, band).alias("frequency_bands"), F.lit("OFDM").alias("modulation"),
                   C("p_retailprice").alias("bandwidth"), (0.5 + (C("p_size") % 5) / 10.0).alias("confidence_threshold"))
    maker = F.struct(C("p_brand").alias("manufacturer"), F.array(sig).alias("signatures"))
    return p.select(F.to_json(F.struct(F.create_map(F.lower("p_brand"), maker).alias("signatures"))).alias("value"))


@query("a19_nested_signatures", "SELECT p_brand AS manufacturer, CAST(p_partkey AS VARCHAR) AS model, p_size * 1e7 AS min_freq FROM part, range(2)")
def _(spark, d):
    return S.band_rows(S.flatten_json(_documents(spark, d), "value")).select("manufacturer", "model", "min_freq")


@query("a20_signature_csv", "SELECT p_brand AS manufacturer, CAST(p_partkey AS VARCHAR) AS model, p_size * 1e7 + 2.5e6 AS center_freq, '2.4 GHz,' || CAST(p_size * 10000000 AS BIGINT) || ',' || CAST(p_size * 10000000 + 5000000 AS BIGINT) AS packed FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select(
        C("p_brand").alias("manufacturer"), C("p_partkey").cast("string").alias("model"), C("p_name").alias("variants"), F.concat(
            F.lit("2.4 GHz,"), (C("p_size").cast("long") * 10000000).cast("string"), F.lit(","), (C("p_size").cast("long") * 10000000 + 5000000).cast("string"), F.lit(";bad,1")).alias("frequency_bands"),
        F.lit("OFDM").alias("modulation"), F.lit("20000000").alias("bandwidth"), F.lit("0.8").alias("confidence_threshold"))
    parsed = S.from_csv_rows(rows)
    back = S.to_csv_rows(parsed)
    centre = S.band_rows(parsed).select("manufacturer", "model", "center_freq")
    return centre.join(back.select("manufacturer", "model", C("frequency_bands").alias("packed")), ["manufacturer", "model"])


@query("a21_signature_merge", """SELECT p_brand AS manufacturer, p_partkey AS model, CASE WHEN p_size >= 20 THEN 'new' ELSE 'old' END AS origin FROM part""")
def _(spark, d):
    p = table(spark, d, "part").select(C("p_brand").alias("manufacturer"), C("p_partkey").alias("model"), "p_size")
    old = p.filter(C("p_size") <= 30).select("manufacturer", "model", F.lit("old").alias("origin"))
    new = p.filter(C("p_size") >= 20).select("manufacturer", "model", F.lit("new").alias("origin"))
    return S.merge(old, new)


@query("g14_signature_statistics", """SELECT 'modulation' AS kind, 'OFDM' AS name, CAST(count(*) AS BIGINT) AS n, min(0.5 + (p_size % 5) / 10.0::DOUBLE) AS min_confidence, max(0.5 + (p_size % 5) / 10.0::DOUBLE) AS max_confidence,
   round(avg(0.5 + (p_size % 5) / 10.0::DOUBLE), 6) AS mean_confidence FROM part UNION ALL SELECT 'band', '2.4 GHz', CAST(count(*) * 2 AS BIGINT), min(0.5 + (p_size % 5) / 10.0::DOUBLE), max(0.5 + (p_size % 5) / 10.0::DOUBLE),
   round(avg(0.5 + (p_size % 5) / 10.0::DOUBLE), 6) FROM part""")
def _(spark, d):
    return rounded(S.statistics(S.flatten_json(_documents(spark, d), "value")))


@query("a25_session_catalogue", "SELECT s.id AS session_id, s.name, CAST(count(r.id) AS BIGINT) AS recordings, CAST(coalesce(sum(r.file_size_bytes), 0) AS BIGINT) AS total_bytes FROM recording_sessions s LEFT JOIN recordings r ON r.session_id = s.id GROUP BY 1, 2")
def _(spark, d):
    per = V.recordings(spark, d).groupBy("session_id").agg(F.count("*").alias("recordings"), F.sum("file_size_bytes").alias("total_bytes"))
    s = V.recording_sessions(spark, d).select(C("id").alias("session_id"), "name")
    return s.join(per, "session_id", "left").fillna(0, ["recordings", "total_bytes"])


def _tables(spark, d):
    return {"detections": V.detections(spark, d), "alerts": V.alerts(spark, d), "recordings": V.recordings(spark, d)}


COUNTS = "SELECT 'detections' AS \"table\", CAST(count(*) AS BIGINT) AS rows FROM detections UNION ALL SELECT 'alerts', count(*) FROM alerts UNION ALL SELECT 'recordings', count(*) FROM recordings"


@query("a26_full_snapshot", COUNTS)
def _(spark, d):
    return N.take(_tables(spark, d), run_directory(spark, "snapshot"), "2024-01-31").select("table", "rows")


@query("a27_selective_restore", "SELECT id, severity FROM alerts")
def _(spark, d):
    path, staging = run_directory(spark, "snapshot"), run_directory(spark, "staging")
    N.take({"alerts": V.alerts(spark, d)}, path, "2024-01-31")
    done = N.restore(spark, path, "2024-01-31", ["alerts", "absent"], ["alerts"], staging)
    return spark.read.parquet(f"{staging}/{done[0]}").select("id", "severity")


@query("a28_merge_restore", "SELECT id, CASE WHEN acknowledged THEN 'snapshot' ELSE 'live' END AS side FROM alerts")
def _(spark, d):
    a = V.alerts(spark, d)
    return N.merge(a.select("id", F.lit("live").alias("side")), a.filter("acknowledged").select("id", F.lit("snapshot").alias("side")), ["id"])


@query("a29_snapshot_inventory", COUNTS)
def _(spark, d):
    return N.inventory(_tables(spark, d))


@query("a30_snapshot_difference", """SELECT 'detections' AS "table", CAST(count(*) AS BIGINT) AS before, CAST(count(*) FILTER (WHERE threat_level = 'LOW') AS BIGINT) AS after, CAST(count(*) FILTER (WHERE threat_level = 'LOW') - count(*) AS BIGINT) AS delta FROM detections
   UNION ALL SELECT 'alerts', count(*), 0, -count(*) FROM alerts UNION ALL SELECT 'recordings', 0, count(*), count(*) FROM recordings""")
def _(spark, d):
    t = _tables(spark, d)
    before = N.inventory({k: t[k] for k in ("detections", "alerts")})
    return N.difference(before, N.inventory({"detections": t["detections"].filter(C("threat_level") == "LOW"), "recordings": t["recordings"]}))


@query("a31_retention", """SELECT id, CAST(position AS BIGINT) AS position, ts < TIMESTAMP '2024-01-25' - INTERVAL 10 DAY OR position > 1500 AS deleted FROM (SELECT id, ts, row_number() OVER (ORDER BY ts DESC, id DESC) AS position FROM alerts)""")
def _(spark, d):
    return N.retained(V.alerts(spark, d).select("id", "ts"), "2024-01-25 00:00:00", 10, 1500).select("id", "position", "deleted")


@query("a32_storage_quota", """SELECT id, running <= 1000000000000 AS kept FROM (SELECT id, sum(file_size_bytes) OVER (ORDER BY start_time DESC, id DESC ROWS UNBOUNDED PRECEDING) AS running FROM recordings)""")
def _(spark, d):
    r = V.recordings(spark, d).select("id", C("start_time").alias("ts"), C("file_size_bytes").alias("size_bytes"))
    return N.within_quota(r, 1000000000000, slice_seconds=30 * 86400).select("id", "kept")
