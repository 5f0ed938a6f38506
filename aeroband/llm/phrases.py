"""Collocations: phrases whose words meet far more often than their parts would by chance.

Phrases of up to ``longest`` words are counted exactly, per language, in sorted streams:

1. Words are counted per language.
2. Pairs of neighbouring words are counted in slots of a fixed number of bytes.  A slot under
   ``least`` proves all its pairs rarer than that; the others may be frequent.  This sieve
   only saves work: its memory is bounded and it never decides on a phrase.
3. Windows of neighbouring words, ended by a sentence mark or a pair that is surely rare, are
   counted, and their beginnings summed.  What reaches ``least`` are the counts: with a phrase
   they hold all its beginnings and ends, which are no rarer.
4. The counts are kept twice, in prefix order (by words) and in suffix order (by words from
   the last to the first).  In prefix order a phrase comes after all its beginnings, with
   nothing but their continuations in between, so one walk along the stream hands every phrase
   the counts of its beginnings, and every beginning its extensions by a word to the right.
   The walk in suffix order does it for ends and extensions to the left.  Both streams are
   dealt in ranges; what a range takes over from the ones before is one row for each length.
5. The two walks are merge-joined phrase by phrase, which gives left and right count of every cut.

A phrase's score is the least over its cuts of ``1000 * a * n div (l * r)``, in exact integers.
A phrase goes if one a word longer that holds it is at least ``kept`` percent as frequent; one
longer still is no more frequent than that.

Edge cases.  Null texts are empty; a null language is ``und`` (and joins rows that say so).
Phrases never cross sentence marks, line ends or documents.  Repeated rows count again.  Other
columns are ignored.  An empty table, or one without a phrase that is frequent enough, gives
no rows.  Equal scores rank by count, then by phrase in byte order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroband.llm import text
from aeroband.session import materialise

LEAST = 100
LONGEST = 5
KEPT = 100
#: Slots of the sieve: one for 16 words of the corpus, but no more than 2 ** BITS bytes a worker.
BITS = 27
CHUNK = 1 << 14
SLICE = 1 << 22

BETWEEN = text._table((0x20, 0x20), (0x09, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
STOPS = text._table((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])


def _slices(batches: Iterator[pa.RecordBatch], hashed: bool) -> Iterator[tuple[list[str], np.ndarray, text.Words]]:
    """(languages, language of each word, words) of runs of documents; columns (lang, text)."""
    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        langs, own = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        for a, b, data, bounds in text.slices(batch.column(1), SLICE):
            w = text.words(data, bounds, BETWEEN, hashed=hashed)
            if len(w.starts):
                yield langs, np.repeat(own[a:b], np.diff(w.first)), w


def _counted(langs: list[str], codes: np.ndarray, lengths: np.ndarray, data: np.ndarray, name: str) -> pa.RecordBatch:
    """Strings that lie end to end in ``data``, counted by language and by all their bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    strings = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
    found = pa.table({"lang": codes, name: strings}).group_by(["lang", name], use_threads=False).aggregate([([], "count_all")])
    names = pa.array(langs, pa.string()).take(found.column("lang").combine_chunks())
    return pa.RecordBatch.from_arrays(
        [names, found.column(name).combine_chunks().cast(pa.string()), found.column("count_all").combine_chunks()], ["lang", name, "count"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for langs, codes, w in _slices(batches, hashed=False):
        yield _counted(langs, codes, w.ends - w.starts, w.data[w.inside], "phrase")


def linked(w: text.Words) -> np.ndarray:
    """Whether the next word stands in the same piece."""
    marks = np.flatnonzero(STOPS[w.data] & ~w.inside)
    out = np.zeros(len(w.starts), bool)
    out[:-1] = np.searchsorted(marks, w.starts[1:]) == np.searchsorted(marks, w.ends[:-1])
    last = w.first[1:][np.diff(w.first) > 0] - 1
    out[last] = False
    return out


def _slots(langs: list[str], codes: np.ndarray, w: text.Words, bits: int) -> np.ndarray:
    """Slot of each word with the next one."""
    salts = np.array([crc32(x.encode()) for x in langs], np.uint64)[codes[:-1]]
    pairs = text.mix(w.hashes[:-1] * np.uint64(3) + w.hashes[1:] + salts)
    return (pairs >> np.uint64(64 - bits)).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """(chunk, counts): how often each slot was met, up to 255."""
    counts = np.zeros(1 << bits, np.uint8)
    for langs, codes, w in _slices(batches, hashed=True):
        slots, n = np.unique(_slots(langs, codes, w, bits)[linked(w)[:-1]], return_counts=True)
        counts[slots] = np.minimum(counts[slots] + n, 255)
    size = min(CHUNK, 1 << bits)
    chunks = counts.reshape(-1, size)
    used = np.flatnonzero(chunks.any(axis=1))
    for k in range(0, len(used), 64):
        own = used[k:k + 64]
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array([chunks[c].tobytes() for c in own], pa.binary())], ["chunk", "counts"])


def _summed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk to one a chunk: a bit a slot, set where ``least`` may be reached."""
    chunk, total = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(total >= min(least, 255)).tobytes()], pa.binary())], ["chunk", "bits"])

    for batch in batches:
        for c, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = np.frombuffer(counts.as_buffer(), np.uint8).astype(np.int16)
            if c != chunk:
                if chunk is not None:
                    yield done()
                chunk, total = c, own
            else:
                total = np.minimum(total + own, 255)
    if chunk is not None:
        yield done()


def sieve_of(texts: DataFrame, words: int, least: int) -> tuple[int, np.ndarray]:
    """(bits, a bit a slot); at most 2 ** BITS bits, whatever the corpus."""
    bits = min(BITS, max(10, (words // 16).bit_length()))
    counts = texts.mapInArrow(partial(_pairs, bits=bits), "chunk int, counts binary")
    rows = counts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(partial(_summed, least=least), "chunk int, bits binary").collect()
    size = min(CHUNK, 1 << bits) // 8
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows:
        out[r[0] * size:(r[0] + 1) * size] = np.frombuffer(r[1], np.uint8)
    return bits, out


def _windows(batches: Iterator[pa.RecordBatch], bits: int, sieve, longest: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, count) of the longest windows of words whose neighbours may all be frequent."""
    table = sieve.value
    for langs, codes, w in _slices(batches, hashed=True):
        slots = _slots(langs, codes, w, bits)
        chain = linked(w)
        chain[:-1] &= (table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1).astype(bool)
        words = 1 + chain.astype(np.int64)
        for k in range(1, longest - 1):
            follows = np.zeros(len(chain), bool)
            follows[:-k] = chain[k:]
            words += (words == k + 1) & follows
        at = np.flatnonzero(words > 1)
        if not len(at):
            continue
        spaced, starts, ends = w._single
        begin = starts[at]
        lengths = ends[at + words[at] - 1] - begin
        place = np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
        place += np.arange(len(place))
        yield _counted(langs, codes[at], lengths, np.frombuffer(spaced, np.uint8)[place], "phrase")


def counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of all phrases of up to ``longest`` words met ``least`` times; (lang, n) words."""
    text.lean(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    made = "lang string, phrase string, count long"
    singles = texts.mapInArrow(_words, made).groupBy("lang", "phrase").agg(F.sum("count").alias("a"))
    singles = materialise(singles, "phrase-words")
    totals = materialise(singles.groupBy("lang").agg(F.sum("a").alias("n")), "phrase-totals")
    bits, bitmap = sieve_of(texts, totals.agg(F.sum("n")).first()[0] or 0, least)
    sieve = texts.sparkSession.sparkContext.broadcast(bitmap)
    windows = texts.mapInArrow(partial(_windows, bits=bits, sieve=sieve, longest=longest), made).withColumn("words", F.split("phrase", " "))
    beginnings = F.transform(F.sequence(F.lit(2), F.size("words")), lambda k: F.array_join(F.slice("words", F.lit(1), k), " "))
    phrases = windows.select("lang", "count", F.explode(beginnings).alias("phrase")).groupBy("lang", "phrase").agg(F.sum("count").alias("a"))
    found = materialise(phrases.filter(F.col("a") >= least).unionByName(singles.filter(F.col("a") >= least)), "phrase-counts")
    sieve.destroy()
    return found, totals


def walk(found: DataFrame, order: Column, longest: int, label: str) -> DataFrame:
    """``found`` along the stream sorted by language and ``order`` (an array of words), with
    ``before``: the counts of the row's own beginnings of 1, 2, ... words in that order."""
    stream = found.withColumn("key", order).repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
    stream = materialise(stream.withColumn("part", F.spark_partition_id()), label)
    lengths = range(1, longest)
    at = {j: F.when(F.size("key") == j, F.struct("lang", "key", "a")) for j in lengths}
    ends = stream.groupBy("part").agg(*[F.max(at[j]).alias(f"end_{j}") for j in lengths])  # a row a range
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    taken = ends.select("part", *[F.last(f"end_{j}", ignorenulls=True).over(earlier).alias(f"end_{j}") for j in lengths])
    above = Window.partitionBy("part").orderBy("lang", "key").rowsBetween(Window.unboundedPreceding, -1)
    near = {j: F.coalesce(F.last(at[j], ignorenulls=True).over(above), F.col(f"end_{j}")) for j in lengths}
    walked = stream.join(materialise(taken, f"{label}-taken"), "part").select(
        *found.columns, "key", *[near[j].alias(f"near_{j}") for j in lengths])
    own = [F.when((F.col(f"near_{j}.lang") == F.col("lang")) & (F.col(f"near_{j}.key") == F.slice("key", 1, j)), F.col(f"near_{j}.a")) for j in lengths]
    return walked.select(*found.columns, F.array(*own).alias("before"))


def scored(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, kept: int = KEPT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of every phrase that no longer one replaces."""
    found, totals = counts(docs, least, longest)
    found = found.withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    left = materialise(walk(found, F.col("words"), longest, "phrase-prefixes"), "phrase-left")
    right = materialise(walk(found, F.reverse("words"), longest, "phrase-suffixes"), "phrase-right")

    replaces = (size > 2) & (F.lit(100) * F.col("a") >= F.lit(kept) * F.element_at("before", size - 1))
    replaced = left.filter(replaces).select("lang", F.array_join(F.slice("words", F.lit(1), size - 1), " ").alias("phrase")).unionByName(
        right.filter(replaces).select("lang", F.array_join(F.slice("words", F.lit(2), size - 1), " ").alias("phrase"))).distinct()

    ends = right.filter(size > 1).select("lang", "phrase", F.col("before").alias("after"))
    both = left.filter(size > 1).select("lang", "phrase", "words", "a", "before").join(ends.hint("merge"), ["lang", "phrase"])
    both = both.join(replaced.hint("merge"), ["lang", "phrase"], "left_anti").join(totals, "lang")
    whole = lambda c: c.cast("decimal(19,0)")
    cuts = F.expr("""transform(sequence(1, size(words) - 1), k -> struct(
        cast((cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)))
             div (cast(before[k - 1] as decimal(19,0)) * cast(after[size(words) - k - 1] as decimal(19,0))) as long) as score,
        k as k, before[k - 1] as l, after[size(words) - k - 1] as r))""")
    best = both.withColumn("best", F.array_min(cuts))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, first: int = 2000, least: int = LEAST, longest: int = LONGEST, kept: int = KEPT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(docs, least, longest, kept).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.filter(F.col("rank") <= first).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
