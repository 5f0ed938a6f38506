"""Ranked lexical search over a length-stratified index.

A term adds ``weight * ((1000000000 * tf) div (1000 * tf + 8 * m))`` to a document's score, where
m, the normaliser, depends on the document's length alone.  So documents of equal m make a
stratum, and within it a term's postings lie by tf: all postings of one tf add the same, which
is computed once for them.

1. One pass over the texts finds the terms of the queries in every document (hash, then bytes)
   and the length of each; the corpus counts follow from its rows.
2. The rows are dealt in ranges of m, so a task holds few strata; one that holds many documents
   is spread over several tasks.
3. A task takes its rows in blocks.  The highest tf of every term bounds what a stratum can give
   each query; a query visits strata from the highest bound down and stops at the first under
   its worst result so far.  In a visit, terms of little effect do not make candidates: only
   documents that hold one of the others can still get in.
4. The best ``k`` of each task and query are ranked once more; no more rows than that leave a task.

Queries are taken in groups of at most ``index_words`` words, each with its own pass over the
documents, so what a worker holds is bounded at any number of queries.

Edge cases.  Null texts have no terms; neither do texts of symbols only: such documents are not
counted and such queries find nothing.  Query rows of one id are one query with the terms of
all; null ids are one query of their own.  Every document row is a document, also repeated ones;
equal scores rank by doc_id, nulls last.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from aeroband.llm import text
from aeroband.llm.decontaminate import Lookup
from aeroband.session import materialise

K = 10
INDEX_WORDS = 2_000_000
BLOCK = 8192  # documents of one block


@dataclass
class Vocabulary:
    """Distinct terms of some queries; term t has the bytes ``data[edges[t]:edges[t + 1]]``."""
    lookup: Lookup
    data: np.ndarray
    edges: np.ndarray

    @classmethod
    def of(cls, terms: list[bytes]) -> Vocabulary:
        """Terms by the order of their hashes; two terms of one hash cannot be held."""
        joined = np.frombuffer(b"".join(terms), np.uint8)
        edges = np.cumsum([0] + [len(t) for t in terms])
        w = text.words(joined, edges, text.SYMBOLS)
        lookup = Lookup(w.hashes)
        if len(lookup.values) < len(terms):
            raise ValueError("two query terms have one hash")
        order = np.argsort(w.hashes)
        sizes = np.diff(edges)[order]
        ends = np.cumsum(sizes)
        place = np.repeat(edges[:-1][order] - (ends - sizes), sizes) + np.arange(len(joined))
        return cls(lookup, joined[place], np.concatenate([[0], ends]))

    def terms(self) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.edges[:-1], self.edges[1:])]

    def find(self, w: text.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of the words that are terms, byte for byte."""
        at, term = self.lookup.find(w.hashes)
        size = w.ends[at] - w.starts[at]
        fits = size == self.edges[term + 1] - self.edges[term]
        at, term, size = at[fits], term[fits], size[fits]
        if not len(at):
            return at, term
        begins = np.cumsum(size) - size
        within = np.arange(size.sum()) - np.repeat(begins, size)
        differs = w.data[np.repeat(w.starts[at], size) + within] != self.data[np.repeat(self.edges[term], size) + within]
        same = ~np.logical_or.reduceat(differs, begins)
        return at[same], term[same]


FOUND = "doc_id long, n long, terms array<int>, tfs array<int>"


def _found(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    size = len(vocabulary.edges) - 1
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(1)):
            w = text.words(data, bounds, text.SYMBOLS)
            at, term = vocabulary.find(w)
            document = np.searchsorted(w.first, at, "right") - 1
            keys, tf = np.unique(document * size + term, return_counts=True)
            edges = pa.array(np.searchsorted(keys, np.arange(b - a + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x.astype(np.int32))) for x in (keys % size, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(w.first).astype(np.int64)), *lists], ["doc_id", "n", "terms", "tfs"])


class Queries:
    """Terms and weights of some queries; query q has ``terms[edges[q]:edges[q + 1]]``."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.weights = weights
        kept = [t[weights[t] > 0] for t in terms]
        self.edges = np.cumsum([0] + [len(t) for t in kept])
        self.terms = np.concatenate([*kept, np.zeros(0, np.int64)]).astype(np.int64)


class Stratum:
    """Postings of documents of one normaliser, by term and tf, with what each adds."""

    def __init__(self, m: int, document: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray):
        order = np.lexsort((tf, term))
        term, tf, self.document = term[order], tf[order], document[order]
        fresh = np.ones(len(term), bool)
        fresh[1:] = (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])
        group = np.flatnonzero(fresh)
        adds = weights[term[group]] * ((1_000_000_000 * tf[group]) // (1000 * tf[group] + 8 * m))
        self.adds = np.repeat(adds, np.diff(group, append=len(term)))
        self.edges = np.searchsorted(term, np.arange(len(weights) + 1))
        self.best = np.zeros(len(weights), np.int64)
        last = self.edges[1:] - 1
        held = np.diff(self.edges) > 0
        self.best[held] = self.adds[last[held]]  # what a term adds grows with tf

    def scores(self, terms: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all that may reach ``least``."""
        terms = terms[self.best[terms] > 0]
        terms = terms[np.argsort(-self.best[terms], kind="stable")]
        left = np.cumsum(self.best[terms][::-1])[::-1]  # what this term and the later ones can add
        needed = terms[left >= least]
        if not len(needed):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ranges = [slice(self.edges[t], self.edges[t + 1]) for t in needed.tolist()]
        documents, place = np.unique(np.concatenate([self.document[r] for r in ranges]), return_inverse=True)
        total = np.zeros(len(documents), np.int64)
        np.add.at(total, place, np.concatenate([self.adds[r] for r in ranges]))
        for t in terms[left < least].tolist():
            own = self.document[self.edges[t]:self.edges[t + 1]]
            at = np.minimum(np.searchsorted(documents, own), len(documents) - 1)
            same = documents[at] == own
            np.add.at(total, at[same], self.adds[self.edges[t]:self.edges[t + 1]][same])
        return documents, total


def _bounds(strata: list[Stratum], queries: Queries) -> np.ndarray:
    """Most that each stratum can give each query."""
    out = np.zeros((len(strata), len(queries.edges) - 1), np.int64)
    for k, s in enumerate(strata):
        sums = np.concatenate([[0], np.cumsum(s.best[queries.terms])])
        out[k] = sums[queries.edges[1:]] - sums[queries.edges[:-1]]
    return out


def _searched(batches: Iterator[pa.RecordBatch], queries, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (m, doc_id, terms, tfs) sorted by m to each query's k best: (query, doc_id, score)."""
    queries: Queries = queries.value
    n = len(queries.edges) - 1
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))] * n  # scores, ids, null ids
    for batch in batches:
        for row in range(0, batch.num_rows, BLOCK):
            block = batch.slice(row, BLOCK)
            m = block.column(0).to_numpy()
            ids, absent = block.column(1).fill_null(0).to_numpy(), block.column(1).is_null().to_numpy(zero_copy_only=False)
            sizes = np.diff(block.column(2).offsets.to_numpy())
            term, tf = (block.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            starts = np.concatenate([[0], np.cumsum(sizes)])
            document = np.repeat(np.arange(len(m)), sizes)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(m)) + 1, [len(m)]])
            strata = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                own = slice(starts[a], starts[b])
                strata.append(Stratum(int(m[a]), document[own], term[own], tf[own], queries.weights))
            bounds = _bounds(strata, queries)
            for q in range(n):
                terms = queries.terms[queries.edges[q]:queries.edges[q + 1]]
                for s in np.argsort(-bounds[:, q], kind="stable").tolist():
                    scores, names, nulls = best[q]
                    least = max(1, int(scores[k - 1]) if len(scores) >= k else 1)
                    if bounds[s, q] < least:
                        break
                    found, total = strata[s].scores(terms, least)
                    may = total >= least
                    if not may.any():
                        continue
                    found, total = found[may], total[may]
                    scores, names, nulls = np.concatenate([scores, total]), np.concatenate([names, ids[found]]), np.concatenate([nulls, absent[found]])
                    first = np.lexsort((names, nulls, -scores))[:k]
                    best[q] = scores[first], names[first], nulls[first]
    for q, (scores, names, nulls) in enumerate(best):
        if len(scores):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array(names, mask=nulls), pa.array(scores)], ["query", "doc_id", "score"])


def _terms_of(items: list[tuple[str | None, str]]) -> tuple[Vocabulary | None, list, list[np.ndarray]]:
    """(vocabulary, query ids, their terms)."""
    by_id: dict = {}
    for a, b, data, bounds in text.slices(pa.array([t for _, t in items], pa.string())):
        w = text.words(data, bounds, text.SYMBOLS)
        for d in range(b - a):
            if w.first[d] < w.first[d + 1]:
                own = by_id.setdefault(items[a + d][0], set())
                own.update(w.data[w.starts[j]:w.ends[j]].tobytes() for j in range(w.first[d], w.first[d + 1]))
    if not by_id:
        return None, [], []
    vocabulary = Vocabulary.of(sorted(set().union(*by_id.values())))
    place = {t: k for k, t in enumerate(vocabulary.terms())}
    return vocabulary, list(by_id), [np.array(sorted(place[t] for t in own), np.int64) for own in by_id.values()]


def _group(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    """(item, doc_id, score): each task's best of every query."""
    spark = docs.sparkSession
    vocabulary, names, terms = _terms_of(items)
    if not names:
        return docs.limit(0).select(F.lit("").alias("item_id"), "doc_id", F.lit(0).cast("long").alias("score"))
    found = materialise(docs.mapInArrow(partial(_found, vocabulary=vocabulary), FOUND).filter("n > 0"), "search-found")
    total = found.agg(F.count("*"), F.sum("n")).first()
    held = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*")).collect()  # no more than the queries' terms
    df = dict(map(tuple, held))
    weights = np.array([math.floor(1000 * math.log((2 * total[0] + 2) / (2 * df.get(t, 0) + 1))) for t in range(len(vocabulary.edges) - 1)], np.int64)
    m = F.expr(f"10 + cast((cast(90 * n as decimal(19,0)) * cast({total[0]} as decimal(19,0))) div {max(total[1] or 1, 1)} as long)")
    strata = found.filter(F.size("terms") > 0).select(m.alias("m"), "doc_id", "terms", "tfs")
    index = materialise(strata.repartitionByRange("m", F.xxhash64("doc_id")).sortWithinPartitions("m"), "search-index")
    queries = spark.sparkContext.broadcast(Queries(terms, weights))
    best = index.mapInArrow(partial(_searched, queries=queries, k=k), "query int, doc_id long, score long")
    ids = spark.createDataFrame([(q, x) for q, x in enumerate(names)], "query int, item_id string")  # one group's queries
    return best.join(F.broadcast(ids), "query").select("item_id", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, index_words: int = INDEX_WORDS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item."""
    text.lean(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item_id"].dataType
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0  # no fewer characters than words
    groups, parts = 1 + size // index_words, []
    for g in range(groups):
        own = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).collect()]
        if own:
            parts.append(_group(texts, own, k))
    if not parts:
        return texts.limit(0).select(F.lit(None).cast(kind).alias("item_id"), F.lit(0).alias("rank"), "doc_id", F.lit(0).cast("long").alias("score"))
    best = parts[0]
    for p in parts[1:]:
        best = best.unionByName(p)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item_id").cast(kind).alias("item_id"), "rank", "doc_id", "score")
