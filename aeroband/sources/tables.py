"""Scans with declared schemas, relational origins, and table sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from aeroband import schema
from aeroband.functions.timing import instant
from aeroband.operators import filters, geofence

C = F.col

# Exportable detection fields.
EXPORT_FIELDS = ("id", "timestamp", "drone_type", "manufacturer", "confidence", "threat_level", "frequency", "signal_strength", "snr", "bandwidth", "modulation",
                 "latitude", "longitude", "altitude", "speed", "heading", "remote_id", "operator_id", "source")


def scan(spark: SparkSession, root: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Stored table by name with its declared schema; partition columns in the path stay available."""
    return spark.read.schema(schema.struct(name)).format(fmt).load(f"{root.rstrip('/')}/{name}")


def scan_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low=None, high=None, parts: int = 32, properties: dict | None = None) -> DataFrame:
    """Relational origin (SQLite, PostgreSQL, MySQL); a numeric or time key splits the read into ranges."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**(properties or {}))
    if key is not None:
        reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.load()


def write_csv(df: DataFrame, path: str, delimiter: str = ",", gzip: bool = False) -> None:
    flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else C(c) for c, t in df.dtypes])
    writer = flat.write.option("header", True).option("sep", delimiter)
    (writer.option("compression", "gzip") if gzip else writer).csv(path)


def write_json(df: DataFrame, path: str, exported_at) -> DataFrame:
    """Records as JSON lines under ``data`` and a one-row manifest with date and count."""
    df.write.json(f"{path}/data")
    stored = df.sparkSession.read.schema(df.schema).json(f"{path}/data")
    manifest = stored.agg(F.count("*").alias("record_count")).select(instant(exported_at).cast("timestamp").alias("export_date"), "record_count")
    manifest.coalesce(1).write.json(f"{path}/manifest")
    return manifest


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def point_features(df: DataFrame, properties: list[str], lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows with coordinates as GeoJSON point features, one per line."""
    located = df.filter(C(lat).isNotNull() & C(lon).isNotNull())
    return located.select(geofence.point_feature(lat, lon, F.struct(*properties)).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Feature lines plus a one-line collection header (EPSG:4326); size is unbounded, so features
    are never gathered into one document."""
    features.select("value").write.text(f"{path}/features")
    head = features.sparkSession.range(1).select(F.to_json(F.struct(
        F.lit("FeatureCollection").alias("type"),
        F.struct(F.lit("name").alias("type"), F.struct(F.lit("EPSG:4326").alias("name")).alias("properties")).alias("crs"))).alias("value"))
    head.coalesce(1).write.text(f"{path}/collection")


def subset(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.select(*[f for f in fields if f in df.columns])


def _window(ts: str, start, end) -> Column | None:
    return filters.optional_range(ts, None if start is None else instant(start), None if end is None else instant(end))


def _newest(df: DataFrame, ts: str, limit: int | None) -> DataFrame:
    out = df.orderBy(C(ts).desc(), C("id").desc())
    return out if limit is None else out.limit(limit)


def export_detections(df: DataFrame, start=None, end=None, drone_type=None, threat=None, min_confidence=0.0, limit=None, ts: str = "ts") -> DataFrame:
    return _newest(df.filter(filters.all_of(_window(ts, start, end), filters.detection_filters(drone_type, threat, min_confidence))), ts, limit)


def export_alerts(df: DataFrame, start=None, end=None, severity=None, resolved=None, limit=None, ts: str = "ts") -> DataFrame:
    return _newest(df.filter(filters.all_of(_window(ts, start, end), filters.alert_filters(severity=severity, resolved=resolved))), ts, limit)


def export_messages(df: DataFrame, start=None, end=None, uas_id=None, limit=None, ts: str = "ts") -> DataFrame:
    cond = filters.all_of(_window(ts, start, end), None if uas_id is None else C("uas_id") == uas_id)
    return _newest(df.filter(cond), ts, limit)
