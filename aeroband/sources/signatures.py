"""Signature catalogues: nested JSON, packed CSV and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

C = F.col
BAND = "struct<band:string,min_freq:double,max_freq:double,center_freq:double,bandwidth:double,modulation:string>"
MAKER = ("struct<manufacturer:string,signatures:array<struct<model:string,variants:array<string>,frequency_bands:array<" + BAND +
         ">,modulation:string,bandwidth:double,confidence_threshold:double>>>")


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """Manufacturer → models → bands, one row per model."""
    return flatten_json(spark.read.text(path, wholetext=True), "value")


def flatten_json(df: DataFrame, column: str) -> DataFrame:
    doc = F.from_json(C(column), f"signatures map<string,{MAKER}>")
    makers = df.select(F.explode(doc["signatures"]).alias("key", "m"))
    models = makers.select(F.coalesce("m.manufacturer", "key").alias("manufacturer"), F.explode("m.signatures").alias("s"))
    return models.select("manufacturer", "s.*").withColumnRenamed("frequency_bands", "bands")


def band_rows(signatures: DataFrame) -> DataFrame:
    return signatures.select("manufacturer", "model", F.explode("bands").alias("b")).select("manufacturer", "model", "b.*")


def parse_bands(packed, modulation) -> Column:
    """``name,min,max;…`` to band structs with the mid-point as centre; shorter entries are ignored."""
    c = F.col(packed) if isinstance(packed, str) else packed
    parts = F.filter(F.transform(F.split(c, ";"), lambda b: F.split(b, ",")), lambda p: F.size(p) >= 3)
    low, high = (lambda p: F.get(p, F.lit(1)).cast("double")), (lambda p: F.get(p, F.lit(2)).cast("double"))
    return F.transform(parts, lambda p: F.struct(F.get(p, F.lit(0)).alias("band"), low(p).alias("min_freq"), high(p).alias("max_freq"),
                                                 ((low(p) + high(p)) / 2).alias("center_freq"), modulation.alias("modulation")))


def pack_bands(bands="bands") -> Column:
    as_text = lambda x: x.cast("decimal(20,0)").cast("string")
    return F.array_join(F.transform(bands, lambda b: F.concat_ws(",", b["band"], as_text(b["min_freq"]), as_text(b["max_freq"]))), ";")


def from_csv_rows(rows: DataFrame) -> DataFrame:
    """Columns manufacturer, model, variants, frequency_bands, modulation, bandwidth, confidence_threshold as text."""
    modulation = F.coalesce("modulation", F.lit("OFDM"))
    return rows.select("manufacturer", "model", F.when(F.coalesce("variants", F.lit("")) != "", F.split("variants", ";")).otherwise(F.array().cast("array<string>")).alias("variants"),
                       F.coalesce(parse_bands("frequency_bands", modulation), F.array().cast("array<" + "struct<band:string,min_freq:double,max_freq:double,center_freq:double,modulation:string>" + ">")).alias("bands"),
                       modulation.alias("modulation"), F.coalesce(C("bandwidth").cast("double"), F.lit(20e6)).alias("bandwidth"),
                       F.coalesce(C("confidence_threshold").cast("double"), F.lit(0.8)).alias("confidence_threshold"))


def to_csv_rows(signatures: DataFrame) -> DataFrame:
    return signatures.select("manufacturer", "model", F.array_join("variants", ";").alias("variants"), pack_bands().alias("frequency_bands"), "modulation",
                             C("bandwidth").alias("bandwidth_hz"), "confidence_threshold")


def merge(current: DataFrame, incoming: DataFrame, keys=("manufacturer", "model")) -> DataFrame:
    """Incoming rows replace those of the same key and add new ones; ordered by key."""
    kept = current.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True).orderBy(*keys)


def statistics(signatures: DataFrame) -> DataFrame:
    """Counts by modulation and by band with confidence extremes, as long rows."""
    items = signatures.select("confidence_threshold", F.explode(F.concat(
        F.array(F.struct(F.lit("modulation").alias("kind"), C("modulation").alias("name"))),
        F.transform("bands", lambda b: F.struct(F.lit("band").alias("kind"), b["band"].alias("name"))))).alias("x"))
    return items.groupBy("x.kind", "x.name").agg(F.count("*").alias("n"), F.min("confidence_threshold").alias("min_confidence"),
                                                 F.max("confidence_threshold").alias("max_confidence"), F.avg("confidence_threshold").alias("mean_confidence"))
