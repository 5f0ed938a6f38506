"""Benchmark passages in documents by a prefix-filtered containment join.

A window is ``width`` consecutive words of an item, or all words of a shorter one.  Its
shingles are ordered by how many corpus positions hold them; for full containment the
necessary prefix is the rarest one.  Document shingles join windows on it; the position
bound fixes where the window would start, the length bound that it ends within the
document; then all its words are compared, by hash and by bytes.

One pass over the documents counts the items' shingles, one marks the words; texts are
never shuffled.  The windows are held in an index of at most ``index_words`` item words.
A larger benchmark makes several indexes, applied one after another to the same rows, so
each worker's memory stays bounded at any benchmark size.

Edge cases.  Null and empty texts have no words; such items have no windows.  Repeated
item rows act as one; items with a null id are named ``null``.  Every document row gets a
row, also repeated ones and those without doc_id.  Other columns, whatever their names,
pass through untouched in ``mark``.  Without windows nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from aeroband.llm import text
from aeroband.session import materialise, release

WIDTH = 10
SHINGLE = 3
INDEX_WORDS = 2_000_000
_FILTER_BITS = 21


def item_windows(texts: list[str | None], width: int) -> list[list[bytes]]:
    """Words of all windows, item by item."""
    column = pa.array(texts, pa.string())
    out = []
    for _, _, data, bounds in text.slices(column):
        w = text.words(data, bounds, text.SYMBOLS)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            out.append([w.joined(i, min(i + width, b)) for i in range(a, max(a + 1, b - width + 1))] if b > a else [])
    return out


class Lookup:
    """Positions of 64-bit values in a sorted table; a bitmap answers most misses."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = np.zeros(1 << _FILTER_BITS, bool)
        self.bits[(self.values >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in hashes, which value)."""
        if not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        which = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        same = self.values[which] == hashes[at]
        return at[same], which[same]


class Windows:
    """Distinct windows of some items with their words, shingles and items."""

    def __init__(self, items: list[tuple[str, str | None]], width: int):
        by_text: dict[bytes, set[str]] = {}
        for (name, _), windows in zip(items, item_windows([t for _, t in items], width)):
            for window in windows:
                by_text.setdefault(window, set()).add(name)
        self.texts = sorted(by_text)
        self.items = [sorted(by_text[t]) for t in self.texts]
        self.length = np.array([t.count(b" ") + 1 for t in self.texts], np.int64)
        column = pa.array([t.decode("utf-8", "surrogateescape") for t in self.texts], pa.string()) if self.texts else pa.array([], pa.string())
        self.words = np.zeros((len(self.texts), width), np.uint64)
        self.shingles: list[np.ndarray] = []
        row = 0
        for _, _, data, bounds in text.slices(column):
            w = text.words(data, bounds, text.SYMBOLS)
            for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                self.words[row, :b - a] = w.hashes[a:b]
                self.shingles.append(text.runs(w.hashes[a:b], min(SHINGLE, b - a)))
                row += 1

    def choose_prefixes(self, counts: dict[int, int]) -> None:
        """Keep of each window its rarest shingle (ties: smaller hash) and that one's place."""
        places = [min(range(len(s)), key=lambda k: (counts.get(int(s[k]), 0), int(s[k]))) for s in self.shingles]
        self.place = np.array(places, np.int64)
        tokens = np.array([s[k] for s, k in zip(self.shingles, places)], np.uint64)
        self.size = np.minimum(self.length, SHINGLE)
        self.by_size = {}
        for n in np.unique(self.size).tolist():
            own = np.flatnonzero(self.size == n)
            lookup = Lookup(tokens[own])
            which = np.searchsorted(lookup.values, tokens[own])
            order = np.argsort(which, kind="stable")
            self.by_size[n] = (lookup, own[order], np.searchsorted(which[order], np.arange(len(lookup.values) + 1)))
        del self.shingles


def _count(batches: Iterator[pa.RecordBatch], lookups: dict[int, Lookup]) -> Iterator[pa.RecordBatch]:
    totals = {n: np.zeros(len(x.values), np.int64) for n, x in lookups.items()}
    for batch in batches:
        for _, _, data, bounds in text.slices(batch.column(0)):
            w = text.words(data, bounds, text.SYMBOLS)
            document = np.repeat(np.arange(len(bounds) - 1), np.diff(w.first))
            for n, lookup in lookups.items():
                at, which = lookup.find(text.runs(w.hashes, n))
                inside = document[at] == document[at + n - 1]
                np.add.at(totals[n], which[inside], 1)
    for n, lookup in lookups.items():
        seen = totals[n] > 0
        yield pa.RecordBatch.from_arrays([pa.array(lookup.values[seen].view(np.int64)), pa.array(totals[n][seen])], ["shingle", "count"])


def matches(w: text.Words, index: Windows) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence."""
    ends_of = w.first[1:][np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))]
    starts_of = w.first[:-1][np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))]
    found_at, found_window = [], []
    for n, (lookup, windows, edges) in index.by_size.items():
        at, which = lookup.find(text.runs(w.hashes, n))
        many = edges[which + 1] - edges[which]
        at = np.repeat(at, many)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        window = windows[np.repeat(edges[which], many) + nth]
        token, start = at, at - index.place[window]
        fits = (start >= starts_of[token]) & (start + index.length[window] <= ends_of[token])
        start, window = start[fits], window[fits]
        equal = np.ones(len(start), bool)
        for k in range(index.words.shape[1]):
            longer = index.length[window] > k
            equal[longer] &= w.hashes[start[longer] + k] == index.words[window[longer], k]
        found_at.append(start[equal])
        found_window.append(window[equal])
    at, window = np.concatenate(found_at), np.concatenate(found_window)
    same = np.array([w.joined(a, a + index.length[v]) == index.texts[v] for a, v in zip(at.tolist(), window.tolist())], bool)
    return (at[same], window[same]) if len(at) else (at, window)


def _mark(batches: Iterator[pa.RecordBatch], index, at_text: int) -> Iterator[pa.RecordBatch]:
    """Extends the last two columns: word spans hit (flat pairs) and items found."""
    windows: Windows = index.value
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(at_text)):
            w = text.words(data, bounds, text.SYMBOLS)
            start, window = matches(w, windows) if windows.texts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            document = np.searchsorted(w.first, start, "right") - 1
            rows = batch.slice(a, b - a)
            spans, items = rows.column(rows.num_columns - 2).to_pylist(), rows.column(rows.num_columns - 1).to_pylist()
            order = np.lexsort((start, document))
            for k in order.tolist():
                d, s = int(document[k]), int(start[k] - w.first[document[k]])
                e = s + int(windows.length[window[k]])
                own = spans[d]
                if own and own[-2] <= s <= own[-1]:
                    own[-1] = max(own[-1], e)
                else:
                    own += [s, e]
                items[d] += [x for x in windows.items[window[k]] if x not in items[d]]
            fields = list(rows.columns[:-2]) + [pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(fields, rows.schema.names)


def _summary(batches: Iterator[pa.RecordBatch], at_text: int) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(at_text)):
            w = text.words(data, bounds, text.SYMBOLS)
            rows = batch.slice(a, b - a)
            hit = []
            for spans in rows.column(rows.num_columns - 2).to_pylist():
                total, reached = 0, 0
                for s, e in sorted(zip(spans[::2], spans[1::2])):
                    total += max(0, e - max(s, reached))
                    reached = max(reached, e)
                hit.append(total)
            items = [sorted(set(x)) for x in rows.column(rows.num_columns - 1).to_pylist()]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            made = [pa.array(np.diff(w.first)), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array([h > 0 for h in hit])]
            yield pa.RecordBatch.from_arrays([*rows.columns[:-2], *made], [*rows.schema.names[:-2], *names])


def _marked(batches: Iterator[pa.RecordBatch], indexes: list, at_text: int) -> Iterator[pa.RecordBatch]:
    """Marks of all indexes and their summary in one pass: one Python worker a task, not one for each step."""
    for index in indexes:
        batches = _mark(batches, index, at_text)
    return _summary(batches, at_text)


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, index_words: int = INDEX_WORDS) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items_sha256 and contaminated in place of columns of these names."""
    text.lean(docs.sparkSession)
    spark = docs.sparkSession
    made = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "__spans", "__items"]
    docs = docs.drop(*made)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0  # no fewer characters than words
    slices = 1 + total // index_words
    at_text = docs.columns.index("text")
    texts = docs.select(F.col("text").cast("string").alias("text"))
    marked = docs.withColumn("text", F.col("text").cast("string")).withColumn("__spans", F.array().cast("array<long>")).withColumn("__items", F.array().cast("array<string>"))
    indexes = []
    for k in range(slices):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(slices)) == k)
        windows = Windows([tuple(r) for r in part.collect()], width)
        by_size: dict[int, list[np.ndarray]] = {}
        for n, s in zip(np.minimum(windows.length, SHINGLE).tolist(), windows.shingles):
            by_size.setdefault(n, []).append(s)
        lookups = {n: Lookup(np.concatenate(s)) for n, s in by_size.items()}
        counts = texts.mapInArrow(partial(_count, lookups=lookups), "shingle long, count long").groupBy("shingle").agg(F.sum("count").alias("count"))
        windows.choose_prefixes({r[0] & (1 << 64) - 1: r[1] for r in counts.collect()})  # no more rows than the index has shingles
        indexes.append(spark.sparkContext.broadcast(windows))
    release()
    schema = T.StructType([*marked.schema.fields[:-2], *T._parse_datatype_string("n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean").fields])
    return marked.mapInArrow(partial(_marked, indexes=indexes, at_text=at_text), schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows of ``docs`` without any word of an item's window."""
    return mark(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), benchmark, width).filter("not contaminated").select("row.*")
