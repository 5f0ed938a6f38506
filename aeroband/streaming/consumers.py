"""Named consumer groups over an append-only message log.

The log is a folder of Parquet files, partitioned by day.  A message's entry id is the day,
file and row it was written to, so it never changes.  A group reads the log as a stream whose
checkpoint holds the committed offsets: every delivery takes what was appended since the last
one, also after a restart, and each message is delivered once.  A group may start at a position
in time; days before it are pruned, not read.

Delivered entries are pending until they are acknowledged.  Pending entries can be claimed after
a time without answer, which delivers them again, to the claiming member.  Deliveries, claims and
acknowledgements are tables beside the checkpoint, written under the number of the step that made
them, so a repeated step replaces itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroband.functions.text import topic_matches
from aeroband.sources.topics import after_position

C = F.col
MESSAGE = "topic string, key string, value string, ts timestamp"
STORED = f"{MESSAGE}, day date"
DELIVERY = f"entry string, {MESSAGE}, member string, delivered_at timestamp"


def append(messages: DataFrame, log: str) -> None:
    """Messages (topic, key, value, ts) added to the log."""
    messages.select("topic", "key", "value", C("ts").cast("timestamp").alias("ts")).withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(log)


@dataclass
class Group:
    """A group named ``name`` of the log at ``log``; its state lies below ``home``."""
    spark: SparkSession
    log: str
    home: str
    name: str
    pattern: str = "#"
    start: str | None = None
    files_per_batch: int = 1000

    def _path(self, part: str) -> str:
        return f"{self.home}/{self.name}/{part}"

    def _table(self, part: str, schema: str) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(part))
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], f"{schema}, step long")
        return self.spark.read.schema(f"{schema}, step long").parquet(self._path(part))

    def _next(self, part: str) -> int:
        """One more than the last step's number, also where that step had no rows."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(part))
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in system.listStatus(folder)] if system.exists(folder) else []
        return max([int(n.partition("=")[2]) for n in names if n.startswith("step=")], default=0) + 1

    def _entries(self) -> DataFrame:
        stream = self.spark.readStream.schema(STORED).option("maxFilesPerTrigger", self.files_per_batch).parquet(self.log)
        entry = F.concat_ws(":", "day", "_metadata.file_name", "_metadata.row_index")
        rows = stream.withColumn("entry", entry).filter(topic_matches("topic", self.pattern))
        if self.start is not None:
            rows = after_position(rows.filter(C("day") >= F.to_date(F.lit(self.start))), self.start, "")
        return rows.select("entry", "topic", "key", "value", "ts")

    def deliver(self, as_of, members: tuple[str, ...] = ("",)) -> DataFrame:
        """Entries appended since the last delivery, dealt to the members by entry."""
        before = self._table("delivered", DELIVERY).agg(F.max("step")).first()[0]
        dealt = F.element_at(F.array(*[F.lit(m) for m in members]), (F.pmod(F.xxhash64("entry"), F.lit(len(members))) + 1).cast("int"))

        def write(batch: DataFrame, batch_id: int):
            out = batch.withColumn("member", dealt).withColumn("delivered_at", F.lit(as_of).cast("timestamp"))
            out.write.mode("overwrite").parquet(f"{self._path('delivered')}/step={batch_id}")

        query = self._entries().writeStream.foreachBatch(write).option("checkpointLocation", self._path("offsets")).trigger(availableNow=True).start()
        query.awaitTermination()
        return self._table("delivered", DELIVERY).filter(C("step") > (-1 if before is None else before)).drop("step")

    def acknowledge(self, entries: DataFrame) -> None:
        """Entries (column entry) that need no further delivery."""
        entries.select("entry").distinct().write.mode("overwrite").parquet(f"{self._path('acknowledged')}/step={self._next('acknowledged')}")

    def pending(self) -> DataFrame:
        """Delivered entries without an answer: last member and delivery, and how many there were."""
        every = self._table("delivered", DELIVERY).unionByName(self._table("claimed", DELIVERY)).drop("step")
        last = every.groupBy("entry").agg(F.count("*").alias("deliveries"), F.max_by(F.struct(*[c for c in every.columns if c != "entry"]), F.struct("delivered_at", "member")).alias("_last"))
        return last.join(self._table("acknowledged", "entry string").select("entry"), "entry", "left_anti").select("entry", "_last.*", "deliveries")

    def claim(self, member: str, as_of, idle_seconds: float = 60.0) -> DataFrame:
        """Pending entries last delivered ``idle_seconds`` ago or longer, delivered again to ``member``."""
        now, step = F.lit(as_of).cast("timestamp"), self._next("claimed")
        idle = self.pending().filter(F.unix_micros(now) - F.unix_micros("delivered_at") >= int(idle_seconds * 1_000_000))
        again = idle.withColumn("member", F.lit(member)).withColumn("delivered_at", now).select("entry", "topic", "key", "value", "ts", "member", "delivered_at")
        path = f"{self._path('claimed')}/step={step}"
        again.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(DELIVERY).parquet(path)
