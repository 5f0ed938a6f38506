"""Token-id shards compressed document by document with a shared zstandard dictionary.

The dictionary is trained on the serialised ids of a bounded sample of documents
(``SAMPLE`` rows in hash order, ``SAMPLE_BYTES`` of each) and stored once, named by its
SHA-256.  Documents are range-partitioned by doc_id; each task writes one shard:

    magic (8 bytes), dictionary SHA-256 (32), id width (1), then the frames, one a document,
    the index as arrays of 64-bit doc_id, 1-byte doc_id present, 64-bit frame offset,
    32-bit frame length and 64-bit number of ids, and a footer: index offset, documents (64-bit each)

all little-endian, in ascending doc_id order (null first, ties in text order).  Any
document is read by its index entry alone.  A shard appears under its name when whole, so
a lost executor costs one retry.

Edge cases.  Null and empty texts are the end id alone.  Repeated rows are documents of
their own.  Other columns are ignored.  An empty table has no shards and reads as no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from aeroband.llm import encode, files
from aeroband.session import materialise, run_directory

MAGIC = b"AETOKEN1"
SAMPLE = 400
SAMPLE_BYTES = 16_384
DICTIONARY = 65_536
LEVEL = 3
ROWS = 512

SHARDS = "path string, shard int, documents long, tokens long"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; empty where they are too few to train one."""
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _sample(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = encode.encoder(path).encode(batch.column(0).to_pylist(), end)
        yield pa.RecordBatch.from_arrays([pa.array([x[:SAMPLE_BYTES] for x in ids], pa.binary())], ["ids"])


def _write(batches: Iterator[pa.RecordBatch], path: str, end: int, folder: str, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    shard = TaskContext.get().partitionId()
    coder = encode.encoder(path)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)
    uri = f"{folder}/shard-{shard:06d}.ids"
    keys, present, offsets, lengths, counts = [], [], [], [], []
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    with files.written(uri) as out:
        at = out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([coder.dtype.itemsize]))
        while first is not None:
            for k in range(0, first.num_rows, ROWS):
                part = first.slice(k, ROWS)
                for key, ids in zip(part.column(0).to_pylist(), coder.encode(part.column(1).to_pylist(), end)):
                    frame = press.compress(ids)
                    keys.append(key or 0)
                    present.append(key is not None)
                    offsets.append(at)
                    lengths.append(len(frame))
                    counts.append(len(ids) // coder.dtype.itemsize)
                    at += out.write(frame)
            first = next(batches, None)
        for values, kind in ((keys, "<i8"), (present, "u1"), (offsets, "<i8"), (lengths, "<u4"), (counts, "<i8")):
            out.write(np.array(values, kind).tobytes())
        out.write(struct.pack("<qq", at, len(keys)))
    yield pa.RecordBatch.from_pylist([{"path": uri, "shard": shard, "documents": len(keys), "tokens": sum(counts)}], schema=pa.schema([
        ("path", pa.string()), ("shard", pa.int32()), ("documents", pa.int64()), ("tokens", pa.int64())]))


def write(docs: DataFrame, path: str, end: int = 2, folder: str | None = None) -> tuple[str, DataFrame]:
    """The folder written, and its shards (path, shard, documents, tokens)."""
    spark = docs.sparkSession
    folder = files.qualified(spark.sparkContext, folder or run_directory(spark, "token-ids"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.filter("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    sample = texts.join(F.broadcast(chosen), "doc_id", "left_semi").select("text").limit(2 * SAMPLE)
    dictionary = train_dictionary([r[0] for r in sample.mapInArrow(partial(_sample, path=path, end=end), "ids binary").collect()])
    with files.written(f"{folder}/dictionary-{hashlib.sha256(dictionary).hexdigest()}") as out:
        out.write(dictionary)
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ordered.mapInArrow(partial(_write, path=path, end=end, folder=folder, dictionary=dictionary), SHARDS)
    return folder, materialise(shards, "token-shards")


class Shard:
    """Random access to the documents of one shard."""

    def __init__(self, uri: str):
        system, path = files.opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, n = struct.unpack("<qq", self.file.read_at(16, size - 16))
        head = self.file.read_at(41, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.dtype = f"<u{head[40]}"
        index = self.file.read_at(size - 16 - at, at)
        self.columns = []
        for kind in ("<i8", "u1", "<i8", "<u4", "<i8"):
            width = np.dtype(kind).itemsize * n
            self.columns.append(np.frombuffer(index[:width], kind))
            index = index[width:]
        folder = path.rpartition("/")[0]
        name = head[8:40].hex()
        dictionary = system.open_input_file(f"{folder}/dictionary-{name}").read()
        if hashlib.sha256(dictionary).hexdigest() != name:
            raise ValueError(f"the dictionary of {uri} is not the one it was written with")
        self.press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.columns[0])

    def key(self, k: int) -> int | None:
        return int(self.columns[0][k]) if self.columns[1][k] else None

    def find(self, doc_id: int) -> list[int]:
        """Index places of a doc_id."""
        skip = len(self) - int(self.columns[1].sum())  # null ids come first
        keys = self.columns[0][skip:]
        return list(range(skip + int(np.searchsorted(keys, doc_id)), skip + int(np.searchsorted(keys, doc_id, "right"))))

    def ids(self, k: int) -> np.ndarray:
        raw = self.press.decompress(self.file.read_at(int(self.columns[3][k]), int(self.columns[2][k])))
        ids = np.frombuffer(raw, self.dtype)
        if len(ids) != self.columns[4][k]:
            raise ValueError("a frame does not hold the ids its index tells of")
        return ids


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard, start = Shard(row["path"]), row["before"]
            for k in range(0, len(shard), ROWS):
                places = range(k, min(k + ROWS, len(shard)))
                ids = [shard.ids(j) for j in places]
                counts = [len(x) for x in ids]
                starts = start + np.cumsum([0, *counts])
                start = int(starts[-1])
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard.key(j) for j in places], pa.int64()), pa.array(starts[:-1]), pa.array(counts, pa.int64()),
                    pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ids are unsigned 32-bit, little-endian."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    placed = shards.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    count = max(1, shards.count())
    return placed.repartition(count, "path").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
