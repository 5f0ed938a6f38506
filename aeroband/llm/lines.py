"""Passages repeated across documents: runs of lines that one earlier document holds.

A line is a physical line (``unit`` "line") or, as copied passages start and end anywhere in
running text, a word (``unit`` "word": texts are re-lined at every white space).  A window is
``least`` lines in a row.  A line goes if it lies in a window that a document of smaller doc_id
holds as well, and only then; the first document of a window keeps its copy.

Windows are not compared one by one.  Each has an anchor, the least of the rolling hashes of
``ROLL`` lines within it, which depends on its content alone, so equal windows have equal
anchors.  Neighbouring windows of one anchor make a chunk ("block"), whose boundaries are set by
content and survive shifts; in running text there is one in some 20 words.  Blocks whose anchor
no other document has are done with.  Of equal blocks the first document's stays, and the others
are found whole.  Where an anchor has different blocks, the windows of the first copy of each are
compared.  A later copy needs no look at its windows and an anchor of one block has nothing else
to find, so no window is missed.

What hashes have found is then compared byte by byte: spans of one source that follow one
another there too make a run, the run's lines meet the source's lines, and only equal ones go.

Edge cases.  Null texts stay null, empty ones empty.  Repeats within one document are
left alone.  Rows of one doc_id are one document for this, so equal rows stay equal; where
their texts differ, each is cut by itself.  Rows without doc_id stay untouched and are no
source.  Lines without any character are no lines.  Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aeroband.llm import sieve, text
from aeroband.session import materialise

ROLL = 15
LEAST = 50
#: Bytes between lines.
UNITS = {"word": text.WHITE, "line": text._table((0x0A, 0x0D))}


def anchored(w: text.Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, windows, anchor) of the blocks of all documents, in their order."""
    n, roll = len(w.starts), max(1, min(ROLL, least // 3))
    places = np.arange(max(0, n - roll + 1))
    lowest = text.ranges(w.hashes, places, places + roll)
    width = 1
    while width <= least - roll and len(lowest):
        step = min(width, least - roll + 1 - width)
        lowest = np.minimum(lowest[:-step], lowest[step:])
        width += step
    inside = np.zeros(n + 1, np.int64)
    begin, end = w.first[:-1], w.first[1:] - least + 1
    long = end > begin
    np.add.at(inside, begin[long], 1)
    np.add.at(inside, end[long], -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchors = lowest[at] if len(at) else np.zeros(0, np.uint64)
    edge = np.zeros(n + 1, bool)
    edge[w.first] = True
    fresh = edge[at]
    fresh[1:] |= (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)
    kept = np.flatnonzero(fresh)
    return at[kept], np.diff(kept, append=len(at)), anchors[kept]


def _blocks(batches: Iterator[pa.RecordBatch], least: int, unit: str) -> Iterator[pa.RecordBatch]:
    """Columns (doc_id, part, text) to (anchor, block, doc_id, part, line, windows)."""
    for batch in batches:
        ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, data, bounds in text.slices(batch.column(2)):
            w = text.words(data, bounds, UNITS[unit], lower=False)
            starts, windows, anchors = anchored(w, least)
            if not len(starts):
                continue
            prints = text.ranges(w.hashes, starts, starts + windows + least - 1)
            owner = np.searchsorted(w.first, starts, "right") - 1
            yield pa.RecordBatch.from_arrays([
                pa.array(anchors.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(ids[a:b][owner]), pa.array(parts[a:b][owner]),
                pa.array((starts - w.first[owner]).astype(np.int32)), pa.array(windows.astype(np.int32))], ["anchor", "block", "doc_id", "part", "line", "windows"])


def _windows(batches: Iterator[pa.RecordBatch], least: int, unit: str) -> Iterator[pa.RecordBatch]:
    """Columns (doc_id, part, text, its blocks) to (anchor, window, doc_id, part, line) of every window."""
    for batch in batches:
        ids, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for a, b, data, bounds in text.slices(batch.column(2)):
            w = text.words(data, bounds, UNITS[unit], lower=False)
            own = batch.column(3).slice(a, b - a)
            blocks = own.flatten()
            counts = np.diff(own.offsets.to_numpy())
            anchor, line, windows = (blocks.field(k).to_numpy() for k in range(3))
            owner = np.repeat(np.repeat(np.arange(b - a), counts), windows)
            lines = np.repeat(line.astype(np.int64), windows) + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            starts = w.first[owner] + lines
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(anchor, windows)), pa.array(text.ranges(w.hashes, starts, starts + least).view(np.int64)), pa.array(ids[a:b][owner]), pa.array(parts[a:b][owner]),
                pa.array(lines.astype(np.int32))], ["anchor", "window", "doc_id", "part", "line"])


def _merged(found: list[dict]) -> list[tuple[int, int]]:
    """Runs of lines [from, to) that the found ones cover."""
    out: list[list[int]] = []
    for s, e in sorted((f["line"], f["to"]) for f in found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _cut(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    """Columns (row, text, found) to (row, text, n_lines, n_removed, spans)."""
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(1)):
            w = text.words(data, bounds, UNITS[unit], lower=False, hashed=False)
            raw = data.tobytes()
            texts, removed, spans = [], [], []
            nulls = batch.column(1).slice(a, b - a).is_null().to_pylist()
            for d, own in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                i, j = int(w.first[d]), int(w.first[d + 1])
                cuts = _merged(own) if own else []
                at, parts = int(bounds[d]), []
                for s, e in cuts:
                    parts.append(raw[at:int(w.starts[i + s])])
                    at = int(w.starts[i + e]) if i + e < j else int(bounds[d + 1])
                parts.append(raw[at:int(bounds[d + 1])])
                texts.append(None if nulls[d] else b"".join(parts).decode("utf-8"))
                removed.append(sum(e - s for s, e in cuts))
                spans.append([x for c in cuts for x in c])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(texts, pa.string()), pa.array(np.diff(w.first)), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64()))], ["row", "text", "n_lines", "n_removed", "spans"])


def _merged_runs(found: list[dict]) -> list[list]:
    """[line, to, source, source part, source line] of the spans of one source at one distance that overlap or touch."""
    out: list[list] = []
    for f in sorted(found, key=lambda f: (f["source"]["doc_id"], f["source"]["part"], f["line"] - f["source"]["line"], f["line"])):
        s, e, src = f["line"], f["to"], f["source"]
        last = out[-1] if out else None
        if last and last[2:4] == [src["doc_id"], src["part"]] and last[0] - last[4] == s - src["line"] and s <= last[1]:
            last[1] = max(last[1], e)
        else:
            out.append([s, e, src["doc_id"], src["part"], src["line"]])
    return out


def _runs(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    """Columns (doc_id, part, text, found) to the runs of each document with their lines' bytes."""
    for batch in batches:
        ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, data, bounds in text.slices(batch.column(2)):
            w = text.words(data, bounds, UNITS[unit], lower=False, hashed=False)
            rows = []
            for d, found in enumerate(batch.column(3).slice(a, b - a).to_pylist()):
                i = int(w.first[d])
                rows += [(ids[a + d], parts[a + d], *run, w.joined(i + run[0], i + run[1])) for run in _merged_runs(found)]
            yield pa.RecordBatch.from_pylist([dict(zip(RUN.names, r)) for r in rows], RUN)


def _ranges(batches: Iterator[pa.RecordBatch], unit: str) -> Iterator[pa.RecordBatch]:
    """Columns (source, source_part, text, wanted) to the bytes of the wanted lines."""
    for batch in batches:
        ids, parts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b, data, bounds in text.slices(batch.column(2)):
            w = text.words(data, bounds, UNITS[unit], lower=False, hashed=False)
            rows = []
            for d, wanted in enumerate(batch.column(3).slice(a, b - a).to_pylist()):
                i = int(w.first[d])
                rows += [(ids[a + d], parts[a + d], r["source_line"], r["size"], w.joined(i + r["source_line"], i + r["source_line"] + r["size"])) for r in wanted]
            yield pa.RecordBatch.from_pylist([dict(zip(RANGE.names, r)) for r in rows], RANGE)


RUN = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("line", pa.int32()), ("to", pa.int32()), ("source", pa.int64()), ("source_part", pa.int64()),
                 ("source_line", pa.int32()), ("bytes", pa.binary())])
RANGE = pa.schema([("source", pa.int64()), ("source_part", pa.int64()), ("source_line", pa.int32()), ("size", pa.int32()), ("held", pa.binary())])


def compared(spans: DataFrame, texts: DataFrame, unit: str) -> DataFrame:
    """(doc_id, part, line, to): runs of ``spans`` whose bytes are those of the source's lines."""
    found = spans.groupBy("doc_id", "part").agg(F.collect_set(F.struct("line", "to", "source")).alias("found"))  # at most one a line of the document
    held = sieve.sifted(texts, "doc_id", sieve.bitmap(spans, "doc_id")).filter("__maybe").join(found, ["doc_id", "part"]).select("doc_id", "part", "text", "found")
    runs = held.mapInArrow(partial(_runs, unit=unit), "doc_id long, part long, line int, to int, source long, source_part long, source_line int, bytes binary")
    runs = materialise(runs.withColumn("size", F.col("to") - F.col("line")), "line-runs")
    wanted = runs.groupBy("source", "source_part").agg(F.collect_set(F.struct("source_line", "size")).alias("wanted"))
    wanted = materialise(wanted, "line-wanted")
    sources = texts.select(F.col("doc_id").alias("source"), F.col("part").alias("source_part"), "text")
    sources = sieve.sifted(sources, "source", sieve.bitmap(wanted, "source")).filter("__maybe").join(wanted, ["source", "source_part"]).select("source", "source_part", "text", "wanted")
    ranges = sources.dropDuplicates(["source", "source_part"]).mapInArrow(partial(_ranges, unit=unit), "source long, source_part long, source_line int, size int, held binary")
    both = runs.join(materialise(ranges, "line-ranges"), ["source", "source_part", "source_line", "size"])
    return both.filter("bytes = held").select("doc_id", "part", "line", "to")


def repeated(docs: DataFrame, least: int = LEAST, unit: str = "word") -> DataFrame:
    """(row, text, n_lines, n_removed, spans): the other columns as a struct, the text without
    repeated passages, its lines before and the lines removed, [from, to) flat."""
    text.lean(docs.sparkSession)
    ids, body = F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*others).alias("row"), body, ids, F.xxhash64(body).alias("part"))
    texts = docs.filter("doc_id is not null and text is not null").select(ids, F.xxhash64(body).alias("part"), body)
    made = "anchor long, block long, doc_id long, part long, line int, windows int"
    blocks = materialise(texts.mapInArrow(partial(_blocks, least=least, unit=unit), made), "line-blocks")
    repeats = blocks.groupBy("anchor").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), (F.min("block") < F.max("block")).alias("mixed")).filter("source < last")
    uses = materialise(blocks.join(materialise(repeats.select("anchor", "mixed"), "line-repeats"), "anchor"), "line-uses")
    place = F.struct("doc_id", "part", "line")
    uses = materialise(uses.join(uses.groupBy("anchor", "block").agg(F.min(place).alias("source")), ["anchor", "block"]).drop("block"), "line-sources")
    later = F.col("doc_id") > F.col("source.doc_id")
    whole = uses.filter(later).select("doc_id", "part", "line", (F.col("line") + F.col("windows") + (least - 1)).alias("to"), "source")

    first = uses.filter("mixed").filter(~later)
    own = first.groupBy("doc_id", "part").agg(F.collect_set(F.struct("anchor", "line", "windows")).alias("own"))  # at most a document's blocks
    opened = sieve.sifted(texts, "doc_id", sieve.bitmap(first, "doc_id")).filter("__maybe").join(own, ["doc_id", "part"]).select("doc_id", "part", "text", "own")
    windows = materialise(opened.mapInArrow(partial(_windows, least=least, unit=unit), "anchor long, window long, doc_id long, part long, line int"), "line-windows")
    held = windows.groupBy("anchor", "window").agg(F.min(place).alias("source"), F.max("doc_id").alias("last")).filter("source.doc_id < last").drop("last")
    single = windows.join(held, ["anchor", "window"]).filter(later).select("doc_id", "part", "line", (F.col("line") + least).alias("to"), "source")

    spans = materialise(whole.unionByName(single), "line-spans")
    spans = materialise(compared(spans, texts, unit), "line-compared")
    found = spans.groupBy("doc_id", "part").agg(F.collect_set(F.struct("line", "to")).alias("found"))  # at most one a line of the document
    marked = sieve.sifted(rows, "doc_id", sieve.bitmap(spans, "doc_id"))
    touched = marked.filter("__maybe").join(found, ["doc_id", "part"], "left").select("row", "text", "found")
    rest = marked.filter("not __maybe").select("row", "text", F.lit(None).cast(touched.schema["found"].dataType).alias("found"))
    made = f"row {touched.schema['row'].dataType.simpleString()}, text string, n_lines long, n_removed long, spans array<long>"
    cut = partial(_cut, unit=unit)
    return touched.mapInArrow(cut, made).unionByName(rest.mapInArrow(cut, made))


def deduplicated(docs: DataFrame, least: int = LEAST, unit: str = "word") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; documents of which nothing is left go."""
    found = repeated(docs, least, unit).filter("n_removed = 0 or n_removed < n_lines")
    return found.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
