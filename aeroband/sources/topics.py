"""Topic messages as streaming tables ``(topic, key, value, ts)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroband.functions.text import topic_matches

C = F.col
MESSAGE = "topic string, key string, value string, ts timestamp"


def subscribe(spark: SparkSession, path: str, pattern: str = "#", files_per_batch: int = 1000) -> DataFrame:
    """Messages of matching topics from a folder of JSON lines; new files are new messages."""
    stream = spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files_per_batch).json(path)
    return stream.filter(topic_matches("topic", pattern))


def subscribe_kafka(spark: SparkSession, servers: str, topics: str, starting: str = "latest") -> DataFrame:
    """The same rows from a broker; ``starting`` is latest, earliest or per-partition offsets for replay."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topics).option("startingOffsets", starting).load())
    return raw.select("topic", C("key").cast("string").alias("key"), C("value").cast("string").alias("value"), C("timestamp").alias("ts"))


def publish(stream: DataFrame, path: str, checkpoint: str):
    """Messages written under their topic; consumers are isolated by their own checkpoints."""
    return (stream.writeStream.format("json").partitionBy("topic").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def each_batch(stream: DataFrame, handlers: dict, checkpoint: str, failures: str):
    """Every handler sees every micro-batch; one handler's failure does not stop the others.

    The rows a handler failed on are kept under ``failures``/handler/batch with the error, so
    nothing is lost when the batch is committed.
    """
    def run(batch: DataFrame, batch_id: int):
        batch = batch.persist()
        for name, handler in handlers.items():
            try:
                handler(batch, batch_id)
            except Exception as ex:
                batch.withColumn("_error", F.lit(str(ex))).write.mode("overwrite").parquet(f"{failures}/handler={name}/batch_id={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def after_position(messages: DataFrame, ts, key: str) -> DataFrame:
    """Replay: messages later than a (time, key) position."""
    at = F.lit(ts).cast("timestamp")
    return messages.filter((C("ts") > at) | ((C("ts") == at) & (C("key") > key)))
