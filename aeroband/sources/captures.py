"""Capture files to frame tables.

Uncompressed captures are read by byte range, so one very large file becomes many tasks;
compressed ones are streamed chunk by chunk.  The driver handles no file contents.
"""

from __future__ import annotations

import bz2
import gzip
import json
import re
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

C = F.col

# Sample types as (NumPy type, values per sample, divisor) and format names by suffix.
SAMPLE_TYPES = {
    "complex64": ("<f4", 2, 1.0), "complex128": ("<f8", 2, 1.0), "int16": ("<i2", 2, 32768.0), "int32": ("<i4", 2, 2147483648.0),
    "float32": ("<f4", 1, 1.0), "float64": ("<f8", 1, 1.0), "int8": ("i1", 2, 128.0),
}
SUFFIXES = {
    "iq": "raw", "bin": "raw", "raw": "raw", "cfile": "gnuradio", "dat": "uhd", "npy": "numpy", "h5": "hdf5", "hdf5": "hdf5", "zst": "zstd", "gz": "gzip",
    "bz2": "bzip2", "lz4": "lz4", "sigmf": "sigmf", "csv": "csv", "txt": "csv", "wav": "wav", "rf64": "rf64", "scp": "scp",
}
MAGIC = [("\x93NUMPY", 0, "numpy"), ("\x89HDF\r\n\x1a\n", 0, "hdf5"), ("SIGM", 0, "sigmf")]
CHUNK_SAMPLES = 16384
#: Samples of chunk rows that leave together.
FRAME_SAMPLES = 1 << 18

FRAME_SCHEMA = "path string, chunk long, sample_offset long, i array<float>, q array<float>, _error string"


def files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """File listing without contents: only the metadata columns of the scan are read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
    return reader.load(path).select("path", C("length").alias("size_bytes"), "modificationTime")


def suffix_format(path: Column) -> Column:
    """Format named by the last suffix, else null."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.nullif(ext, F.lit("")))


def magic_format(content: Column) -> Column:
    head = F.decode(F.substring(content, 1, 20), "ISO-8859-1")
    out = None
    for text, at, name in MAGIC:
        test = F.substring(head, at + 1, len(text)) == text
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.when((F.substring(head, 1, 4) == "RIFF") & (F.substring(head, 9, 4) == "WAVE"), "wav").otherwise("unknown")


def detect_format(path: Column, content: Column | None = None) -> Column:
    found = suffix_format(path)
    return F.coalesce(found, magic_format(content) if content is not None else F.lit("unknown"))


def _open(path: str):
    """Input stream of a path in any file system Arrow knows; local paths may carry ``file:``."""
    from pyarrow import fs
    system, inner = fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def decode_samples(raw: bytes, dtype: str):
    """Bytes to scaled I and Q; a one-value type is real."""
    kind, per, scale = SAMPLE_TYPES[dtype]
    item = np.dtype(kind).itemsize * per
    values = np.frombuffer(raw[: len(raw) // item * item], dtype=kind).astype(np.float64) / scale
    if per == 1:
        return values.astype(np.float32), np.zeros(len(values), np.float32)
    return values[0::2].astype(np.float32), values[1::2].astype(np.float32)


def _stream(path: str, fmt: str):
    """Whole-file formats as an iterator of byte blocks."""
    source = _open(path)
    if fmt == "gzip":
        reader = gzip.GzipFile(fileobj=source)
    elif fmt == "bzip2":
        reader = bz2.BZ2File(source)
    elif fmt == "zstd":
        import zstandard
        head = source.read(12)
        source.seek(0 if head[:4] == b"\x28\xb5\x2f\xfd" else 8)  # recorder files carry a length prefix
        reader = zstandard.ZstdDecompressor().stream_reader(source)
    else:
        reader = source
    while block := reader.read(1 << 20):
        yield block


def build_frames(spark: SparkSession, path: str, dtype: str = "complex64", chunk: int = CHUNK_SAMPLES, glob: str = "*", chunks_per_task: int = 64) -> DataFrame:
    """Chunk rows of every capture below ``path``; an unreadable file yields one row with ``_error``."""
    kind, per, _ = SAMPLE_TYPES[dtype]
    width = np.dtype(kind).itemsize * per
    listed = files(spark, path, glob).withColumn("format", detect_format(C("path")))
    span = width * chunk * chunks_per_task
    splittable = C("format").isin("raw", "gnuradio", "uhd", "unknown")
    ranges = listed.select("path", "format", F.explode(
        F.when(splittable & (C("size_bytes") > 0), F.sequence(F.lit(0).cast("long"), C("size_bytes") - 1, F.lit(span).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))).alias("start"))

    def rows(p, fmt, start):
        if fmt in ("raw", "gnuradio", "uhd", "unknown"):
            with _open(p) as f:
                f.seek(start)
                blocks = iter([f.read(span)])
            offset = start // width
        elif fmt == "numpy":
            data = np.load(_open(p), allow_pickle=False).ravel()
            z = data.astype(np.complex64)
            for k in range(0, len(z), chunk):
                part = z[k:k + chunk]
                yield k, part.real.astype(np.float32), part.imag.astype(np.float32)
            return
        elif fmt in ("gzip", "bzip2", "zstd"):
            blocks, offset = _stream(p, fmt), 0
        else:
            raise ValueError(f"unsupported format {fmt}")
        pending, size = b"", width * chunk
        for block in blocks:
            pending += block
            while len(pending) >= size:
                i, q = decode_samples(pending[:size], dtype)
                yield offset, i, q
                offset, pending = offset + len(i), pending[size:]
        if len(pending) >= width:
            i, q = decode_samples(pending, dtype)
            yield offset, i, q

    def frame(made):
        return pd.DataFrame(made, columns=["path", "chunk", "sample_offset", "i", "q", "_error"])

    def run(batches):
        made, samples = [], 0
        for pdf in batches:
            for p, fmt, start in zip(pdf["path"], pdf["format"], pdf["start"]):
                try:
                    for offset, i, q in rows(p, fmt, int(start)):
                        made.append((p, offset // chunk, offset, i, q, None))
                        samples += len(i)
                        if samples >= FRAME_SAMPLES:
                            yield frame(made)
                            made, samples = [], 0
                except Exception as ex:  # one bad file must not end the job
                    made.append((p, -1, -1, None, None, f"{type(ex).__name__}: {ex}"))
        if made:
            yield frame(made)

    return ranges.repartition(C("path"), C("start")).mapInPandas(run, FRAME_SCHEMA)


def slice_samples(frames: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Samples ``offset … offset+limit-1`` of each capture, cut inside its chunk rows."""
    end = F.lit(None).cast("long") if limit is None else F.lit(offset + limit).cast("long")
    size = F.size("i")
    lo = F.greatest(F.lit(offset) - C("sample_offset"), F.lit(0)).cast("int")
    hi = F.when(end.isNull(), size).otherwise(F.least(end - C("sample_offset"), size)).cast("int")
    kept = frames.filter(lo < hi)
    return kept.select("path", "chunk", (C("sample_offset") + lo).alias("sample_offset"), F.slice("i", lo + 1, hi - lo).alias("i"), F.slice("q", lo + 1, hi - lo).alias("q"))


def _lines(batches, head: str):
    for k, batch in enumerate(batches):
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array([head]), batch.column(0).cast(pa.string())]) if k == 0 else batch.column(0)], ["value"])


def write_csv(samples: DataFrame, path: str, order: list[str], sample_rate: float, center_freq: float) -> None:
    """I,Q lines in files of consecutive samples by ``order``, each behind a ``#``-JSON line of its own.

    Samples are dealt in ranges of the order, so many tasks write and no file holds them all.
    """
    head = "#" + json.dumps({"sample_rate": sample_rate, "center_freq": center_freq})
    dealt = samples.repartitionByRange(*order).sortWithinPartitions(*order)
    lines = dealt.select(F.concat_ws(",", C("i").cast("string"), C("q").cast("string")).alias("value"))
    lines.mapInArrow(partial(_lines, head=head), "value string").write.text(path)


def read_csv(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """I,Q lines (one column is real) with the rate and centre of a leading ``#``-JSON line.

    ``line`` counts the lines of a block of the file, from 0; (path, block, line) is the order of the samples.
    """
    text = spark.read.option("pathGlobFilter", glob).text(path).select("value", C("_metadata.file_path").alias("path"), C("_metadata.file_block_start").alias("block"),
                                                                     F.monotonically_increasing_id().alias("_at"))
    header = text.filter(C("value").startswith("#")).select("path", F.from_json(F.expr("substring(value, 2)"), "sample_rate double, center_freq double").alias("h"))
    first = text.groupBy("path", "block").agg(F.min("_at").alias("_first"))  # ids rise by one along a block
    parts = F.split("value", ",")
    body = text.join(first, ["path", "block"]).filter(~C("value").startswith("#") & (F.trim("value") != "")).select(
        "path", "block", (C("_at") - C("_first")).alias("line"), F.trim(F.get(parts, F.lit(0))).cast("float").alias("i"),
        F.coalesce(F.trim(F.get(parts, F.lit(1))).cast("float"), F.lit(0.0).cast("float")).alias("q"))
    return body.join(header, "path", "left").select("path", "block", "line", "i", "q", C("h.sample_rate").alias("sample_rate"), C("h.center_freq").alias("center_freq"))


def inventory(spark: SparkSession, path: str, dtype: str = "complex64", sample_rate: float = 2e6, glob: str = "*") -> DataFrame:
    """Per file: format, samples, duration and compression ratio; unreadable files keep their error."""
    listed = files(spark, path, glob).withColumn("format", detect_format(C("path")))
    frames = build_frames(spark, path, dtype, glob=glob)
    kind, per, _ = SAMPLE_TYPES[dtype]
    width = np.dtype(kind).itemsize * per
    counted = frames.groupBy("path").agg(F.sum(F.when(C("_error").isNull(), F.size("i"))).alias("samples"), F.max("_error").alias("_error"))
    joined = listed.join(counted, "path", "left").withColumn("samples", F.coalesce("samples", F.lit(0)))
    return joined.select("path", "format", "size_bytes", "samples", F.lit(sample_rate).alias("sample_rate"), (C("samples") / sample_rate).alias("duration_s"),
                         F.when(C("size_bytes") > 0, C("samples") * width / C("size_bytes")).alias("compression_ratio"), "_error")


def write_captures(frames: DataFrame, directory: str, key: str, dtype: str = "complex64") -> DataFrame:
    """Frames to raw capture files, one per task and key value; returns where each frame went.

    A file is written under an attempt name and renamed, so a retried task leaves one copy.
    """
    kind, per, scale = SAMPLE_TYPES[dtype]
    schema = T.StructType([f for f in frames.schema.fields if f.name in (key, "frame_id")] + list(T.StructType.fromDDL("path string, sample_offset long, samples long").fields))

    def run(batches):
        from pyspark import TaskContext
        from pyarrow import fs
        ctx = TaskContext.get()
        system, root = fs.FileSystem.from_uri(directory) if re.match(r"^[a-z0-9]+:/", directory) else (fs.LocalFileSystem(), directory)
        system.create_dir(root, recursive=True)
        open_files, offsets, placed = {}, {}, []
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                name = f"{getattr(row, key)}-{ctx.partitionId():05d}.iq"
                if name not in open_files:
                    open_files[name] = system.open_output_stream(f"{root}/.{name}.{ctx.taskAttemptId()}")
                    offsets[name] = 0
                values = np.empty(len(row.i) * 2)
                values[0::2], values[1::2] = row.i, row.q
                open_files[name].write((values * scale).round().astype(kind).tobytes() if kind[-2] == "i" else values.astype(kind).tobytes())
                placed.append((getattr(row, key), row.frame_id, f"{directory}/{name}", offsets[name], len(row.i)))
                offsets[name] += len(row.i)
            if placed:
                yield pd.DataFrame(placed, columns=[key, "frame_id", "path", "sample_offset", "samples"])
            placed = []
        for name, f in open_files.items():
            f.close()
            system.move(f"{root}/.{name}.{ctx.taskAttemptId()}", f"{root}/{name}")

    order = [f.name for f in schema.fields]
    return frames.select(key, "frame_id", "i", "q").mapInPandas(lambda b: (p[order] for p in run(b)), schema)
