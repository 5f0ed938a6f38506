"""Documents packed into sequences of at most ``limit`` tokens, shortest pack first.

Documents are encoded and numbered where they are read: each row keeps its task, its rank
among the task's documents of the same remainder, and the whole sequences before it.  A
document's full ``limit``-long pieces are sequences of their own; the remainders' lengths
make a histogram of fewer than ``limit`` entries, whatever the number of documents.

The histogram is packed longest length first, each into the pack with most room.  Packs are
kept as patterns with counts, so the work follows the lengths, not the documents.  Then the
emptiest packs are cut up to fill the next emptiest, until padding is under ``SLACK``.  A pattern's slot holds documents of one length with a range of ranks;
documents find their slots, and so sequence and offset, by length and rank.

Edge cases.  Null and empty texts are the end id alone.  Every row is a document of its
own, also repeated ones and those without doc_id.  Other columns are ignored.  An empty
table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from aeroband.llm import encode, files, text
from aeroband.session import materialise, run_directory

LIMIT = 2048
SLACK = 0.0005
ROWS = 512  # documents encoded at once

ENCODED = "doc_id long, ids binary, doc_tokens long, task int, rest int, rank long, whole long"


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int, limit: int) -> Iterator[pa.RecordBatch]:
    task, ranks, whole = TaskContext.get().partitionId(), Counter(), 0
    coder = encode.encoder(path)
    width = coder.dtype.itemsize
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            part = batch.slice(k, ROWS)
            ids = coder.encode(part.column(1).to_pylist(), end)
            tokens = [len(x) // width for x in ids]
            rest, rank, before = [n % limit for n in tokens], [], []
            for n, r in zip(tokens, rest):
                rank.append(ranks[r])
                ranks[r] += 1
                before.append(whole)
                whole += n // limit
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(ids, pa.binary()), pa.array(tokens, pa.int64()), pa.array([task] * len(ids), pa.int32()),
                pa.array(rest, pa.int32()), pa.array(rank, pa.int64()), pa.array(before, pa.int64())], [x.split()[0] for x in ENCODED.split(", ")])


def _split(pattern: list, count: int) -> tuple[list, list]:
    """The first ``count`` packs and the others."""
    n, filled, slots = pattern
    return [count, filled, list(slots)], [n - count, filled, [(m, a, b, r + count) for m, a, b, r in slots]]


def shortest_pack_first(histogram: dict[int, int], limit: int) -> list[list]:
    """Patterns [count, filled, slots]; a slot (length, first rank) holds documents of ``length``
    with ``count`` ranks from the first on, one in each of the pattern's packs."""
    room: list[tuple[int, int, list]] = []  # heap, most room first
    closed, made = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            if room and -room[0][0] >= length:
                pattern = heapq.heappop(room)[2]
                if pattern[0] > left:
                    pattern, rest = _split(pattern, left)
                    made += 1
                    heapq.heappush(room, (rest[1] - limit, made, rest))
            else:
                pattern = [left, 0, []]
            pattern[1] += length
            pattern[2].append((length, 0, length, rank))
            rank += pattern[0]
            left -= pattern[0]
            made += 1
            if pattern[1] == limit:
                closed.append(pattern)
            else:
                heapq.heappush(room, (pattern[1] - limit, made, pattern))
    return closed + [x[2] for x in room]


def fill_gaps(patterns: list[list], limit: int, slack: float = SLACK) -> list[list]:
    """The same documents with the emptiest packs cut up to fill the next emptiest, until
    no more than ``slack`` of all room is padding or one pack has all of it."""
    room = [(p[1], k, p) for k, p in enumerate(patterns)]
    heapq.heapify(room)
    padding = sum(p[0] * (limit - p[1]) for p in patterns)
    total = sum(p[0] * p[1] for p in patterns)
    made = len(room)

    def put(pattern):
        nonlocal made
        if pattern[0] and pattern[1]:
            made += 1
            heapq.heappush(room, (pattern[1], made, pattern))

    while room and padding > slack * (total + padding):
        giver = heapq.heappop(room)[2]
        if room and room[0][0] < limit:
            taker = heapq.heappop(room)[2]
        elif giver[0] > 1:
            giver, taker = _split(giver, giver[0] // 2)
        else:
            put(giver)
            break
        together = min(taker[0], giver[0])
        for group in (taker, giver):
            if group[0] > together:
                put(_split(group, together)[1])
        taker, giver = _split(taker, together)[0], _split(giver, together)[0]
        while taker[1] < limit and giver[1]:
            n, a, b, r = giver[2].pop()
            take = min(limit - taker[1], b - a)
            taker[2].append((n, b - take, b, r))
            if take < b - a:
                giver[2].append((n, a, b - take, r))
            taker[1] += take
            giver[1] -= take
        if not giver[1]:
            padding -= together * limit
        put(taker)
        put(giver)
    return [x[2] for x in room]


class Slots:
    """Where the ranks of each length go: rows (from rank, to rank, begin, end, sequence, offset)."""

    def __init__(self, patterns: list[list]):
        by_length: dict[int, list] = {}
        sequence = 0
        for count, _, slots in patterns:
            offset = 0
            for n, a, b, r in slots:
                by_length.setdefault(n, []).append((r, r + count, a, b, sequence, offset))
                offset += b - a
            sequence += count
        self.sequences = sequence
        self.rows = {n: np.array(sorted(x), np.int64) for n, x in by_length.items()}

    def of(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        rows = self.rows[length]
        own = rows[(rows[:, 0] <= rank) & (rank < rows[:, 1])]
        return sorted((a, b, s + rank - r, o) for r, _, a, b, s, o in own.tolist())


def _write_offsets(batches: Iterator[pa.RecordBatch], folder: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Columns (task, whole, rests, ranks): a file a task, whole sequences before it and ranks before it by length."""
    for batch in batches:
        for r in batch.to_pylist():
            table = np.zeros(limit + 1, "<i8")
            table[r["rests"]] = r["ranks"]
            table[limit] = r["whole"]
            with files.written(f"{folder}/{r['task']}") as out:
                out.write(table.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0)], ["task"])


def _offsets(folder: str, task: int) -> np.ndarray:
    system, path = files.opened(f"{folder}/{task}")
    with system.open_input_stream(path) as source:
        return np.frombuffer(source.read(), "<i8")


def _pieces(batches: Iterator[pa.RecordBatch], slots, limit: int, folder: str) -> Iterator[pa.RecordBatch]:
    slots = slots.value
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    task, before = None, None
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            out = []
            for r in batch.slice(k, ROWS).to_pylist():
                if r["task"] != task:  # rows of one task lie together in its file
                    task, before = r["task"], _offsets(folder, r["task"])
                width = len(r["ids"]) // r["doc_tokens"]  # of an id; the end id is always there
                cut = lambda a, b: np.frombuffer(r["ids"], f"<u{width}")[a:b].astype("<u4").tobytes()  # noqa: E731, B023
                full = r["doc_tokens"] // limit
                whole = r["whole"] + int(before[limit])
                for j in range(full):
                    out.append((r["doc_id"], j * limit, limit, cut(j * limit, (j + 1) * limit), r["doc_tokens"], slots.sequences + whole + j, 0))
                if r["rest"]:
                    for a, b, sequence, offset in slots.of(r["rest"], r["rank"] + int(before[r["rest"]])):
                        out.append((r["doc_id"], full * limit + a, b - a, cut(full * limit + a, full * limit + b), r["doc_tokens"], sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate(types)], names)


def pack(docs: DataFrame, path: str, end: int = 1, limit: int = LIMIT) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids are unsigned 32-bit, little-endian.

    What a task needs to know of the tasks before it is a small file of its own in the shared
    folder, so nothing that grows with the number of tasks is broadcast."""
    text.lean(docs.sparkSession)
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    encoded = materialise(texts.mapInArrow(partial(_encode, path=path, end=end, limit=limit), ENCODED), "packing-encoded")
    counts = materialise(encoded.groupBy("task", "rest").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / limit)).alias("whole")), "packing-counts")
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("task", "rest", F.coalesce(F.sum("n").over(before.partitionBy("rest")), F.lit(0)).alias("rank_before"))
    ranks = ranks.groupBy("task").agg(F.collect_list(F.struct("rest", "rank_before")).alias("r"))  # fewer than ``limit`` a task
    tasks = counts.groupBy("task").agg(F.sum("whole").alias("whole"))  # a row a task
    tasks = tasks.select("task", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("whole_before"))
    histogram = {r[0]: r[1] for r in counts.groupBy("rest").agg(F.sum("n")).collect() if r[0]}  # fewer than ``limit`` rows
    slots = Slots(fill_gaps(shortest_pack_first(histogram, limit), limit))
    folder = run_directory(spark, "packing-offsets")
    offsets = ranks.join(tasks, "task").select("task", F.col("whole_before").alias("whole"), F.col("r.rest").alias("rests"), F.col("r.rank_before").alias("ranks"))
    offsets.mapInArrow(partial(_write_offsets, folder=folder, limit=limit), "task int").count()
    placed = encoded.select("doc_id", "ids", "doc_tokens", "task", "rest", "rank", "whole")
    made = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return placed.mapInArrow(partial(_pieces, slots=spark.sparkContext.broadcast(slots), limit=limit, folder=folder), made)


def with_digest(pieces: DataFrame) -> DataFrame:
    """``ids`` replaced by their unsigned crc32."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
