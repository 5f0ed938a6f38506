"""Toxicity by a chain of linear classifiers.

Categories are predicted in order; each later model also sees the probabilities of the
earlier ones.  In training these are out-of-fold predictions, so a later model meets them
as inexact as they will be on new documents.  Every model is a logistic regression over a
few shares of characters and the presence, once or more often, of words and of their beginnings, taken up one after another while they
explain what the model gets wrong.

The chain is fitted on the driver with at most ``SAMPLE`` positive and ``SAMPLE`` negative
labelled documents of each category, in hash order of their ids; of each document only the
hashes of its terms travel, at most ``SAMPLE_TERMS`` in hash order.  Scoring reads
whole texts in one pass without a shuffle.

Edge cases.  Texts without words (null, empty, symbols only) get probability 0 and are no
member of any category.  Labels that are null, of unknown documents or contradictory
(the positive one counts) don't matter for the rest.  A category without both kinds of
labels gets its constant rate, and without any labels 0.  Every row gets a row, repeated
ones and those without doc_id too.  Result columns replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from aeroband.llm import text
from aeroband.llm.decontaminate import Lookup
from aeroband.session import release

SAMPLE = 800
SAMPLE_TERMS = 40_000
VOCABULARY = 3000
FOLDS = 4
L2 = 0.0003
STEP, EVIDENCE, MOST = 16, 3.0, 160  # words taken up at once, their least z-score, columns of a model
SHARES = 6
TWICE = np.uint64(0x9E3779B97F4A7C15)
STEMS = (4, 5, 6, 7, 8)  # bytes


def shares(w: text.Words, raw: np.ndarray) -> np.ndarray:
    """Per document: upper case, digits, symbols and other bytes, all of the text's length; log words; distinct words."""
    kinds = np.zeros((256, 4), np.float64)
    kinds[65:91, 0] = kinds[48:58, 1] = kinds[128:, 3] = 1
    kinds[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 2] = 1
    n = len(w.bounds) - 1
    out = np.zeros((n, SHARES))
    for d in range(n):
        a, b = int(w.bounds[d]), int(w.bounds[d + 1])
        i, j = int(w.first[d]), int(w.first[d + 1])
        if j > i:
            out[d, :4] = np.bincount(raw[a:b], minlength=256) @ kinds / (b - a)
            out[d, 4] = np.log1p(j - i) / 10
            out[d, 5] = len(np.unique(w.hashes[i:j])) / (j - i)
    return out


def terms(w: text.Words) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of each word and of the beginnings of longer ones, as abuse is inflected."""
    length = w.ends - w.starts
    hashes, owner = [w.hashes], [np.arange(len(length))]
    for n in STEMS:
        longer = np.flatnonzero(length > n)
        stem = np.full(len(longer), n, np.uint64)
        for k in range(n):
            stem = stem * np.uint64(0x100000001B3) + w.data[w.starts[longer] + k]
        hashes.append(text.mix(stem))
        owner.append(longer)
    return np.concatenate(hashes), np.concatenate(owner)


def document_terms(w: text.Words, lookup: Lookup | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, term), each once: terms met, and again as another term those met more than once.

    With ``lookup``, terms are its places and others are left out."""
    hashes, owner = terms(w)
    twice = hashes + TWICE
    if lookup is not None:
        once_at, _ = lookup.find(hashes)
        twice_at, _ = lookup.find(twice)
        at = np.union1d(once_at, twice_at)
        hashes, owner, twice = hashes[at], owner[at], twice[at]
    document = np.searchsorted(w.first, owner, "right") - 1
    order = np.lexsort((hashes, document))
    document, hashes, twice = document[order], hashes[order], twice[order]
    head = np.ones(len(order), bool)
    head[1:] = (document[1:] != document[:-1]) | (hashes[1:] != hashes[:-1])
    second = np.zeros(len(order), bool)
    second[1:] = head[:-1] & ~head[1:]
    document, hashes = np.concatenate([document[head], document[second]]), np.concatenate([hashes[head], twice[second]])
    if lookup is None:
        return document, hashes
    at, which = lookup.find(hashes)
    return document[at], which


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(1)):
            w = text.words(data, bounds, text.SYMBOLS)
            document, hashes = document_terms(w)
            order = np.lexsort((hashes, document))
            edges = np.searchsorted(document[order], np.arange(b - a + 1))
            own = [hashes[order[i:min(j, i + SAMPLE_TERMS)]].view(np.int64) for i, j in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(own, pa.list_(pa.int64())), pa.array(list(shares(w, data)), pa.list_(pa.float64()))], ["doc_id", "words", "shares"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _newton(x: np.ndarray, y: np.ndarray, l2: float, rounds: int = 30) -> np.ndarray:
    """Weights of a few columns with a light L2 penalty, the last one free."""
    x = x.astype(np.float64)
    at, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = _sigmoid(x @ at)
        slope = x.T @ (p - y) / len(y) + ridge * at
        curve = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x / len(y) + np.diag(ridge + 1e-9)
        step = np.linalg.solve(curve, slope)
        at = at - step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return at


def fit_linear(presence: np.ndarray, dense: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the presence columns, then the dense ones: the dense ones and, a few at a
    time, the words that explain most of what is left."""
    vocabulary = presence.shape[1]
    out = np.zeros(vocabulary + dense.shape[1])
    if not len(y) or y.min() == y.max():
        out[-1] = -35.0 if not len(y) or y[0] == 0 else 35.0
        return out
    chosen = np.zeros(0, np.int64)
    while True:
        x = np.hstack([presence[:, chosen], dense])
        weights = _newton(x, y, L2)
        p = _sigmoid(x @ weights)
        sides = np.stack([y - p, p * (1 - p)], axis=1).astype(np.float32)
        left = np.zeros(vocabulary)
        for k in range(0, vocabulary, 500):  # bytes become floats a few columns at a time
            slope, spread = sides.T @ presence[:, k:k + 500].astype(np.float32)
            left[k:k + 500] = np.abs(slope) / np.sqrt(spread + 1)
        left[chosen] = 0
        best = np.argsort(-left, kind="stable")[:STEP]
        best = best[left[best] > EVIDENCE]
        if not len(best) or x.shape[1] >= MOST:
            out[chosen], out[vocabulary:] = weights[:len(chosen)], weights[len(chosen):]
            return out
        chosen = np.concatenate([chosen, best])


@dataclass
class Chain:
    """weights[c]: for the vocabulary, the shares, the c earlier probabilities and the intercept."""
    categories: list[str]
    lookup: Lookup
    weights: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def probabilities(self, sums: list[np.ndarray], dense: np.ndarray) -> list[np.ndarray]:
        """``sums[c]``: each document's vocabulary weights for category c."""
        v, found = len(self.lookup.values), []
        for c, weights in enumerate(self.weights):
            z = sums[c] + dense @ weights[v:v + SHARES] + weights[-1]
            for k, p in enumerate(found):
                z = z + weights[v + SHARES + k] * p
            found.append(_sigmoid(z))
        return found


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midway in the gap of out-of-fold probabilities at which the F1 measure is highest."""
    order = np.argsort(-p)
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][p[:-1] == p[1:]] = 0
    best = int(f1.argmax())
    return float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)


def _matrix(documents: list[np.ndarray], lookup: Lookup) -> np.ndarray:
    out = np.zeros((len(documents), len(lookup.values)), np.uint8)
    for row, own in enumerate(documents):
        out[row, lookup.find(own)[1]] = 1
    return out


def fit_chain(documents: list[np.ndarray], dense: np.ndarray, labels: dict[str, np.ndarray]) -> Chain:
    """``labels``: 0, 1 or NaN of each document, by category in chain order."""
    every, counts = np.unique(np.concatenate(documents or [np.zeros(0, np.uint64)]), return_counts=True)
    every, counts = every[counts >= 2], counts[counts >= 2]
    gain = np.zeros(len(every))
    for y in labels.values():
        held = [d for d, v in zip(documents, y) if v == 1]
        inside = np.zeros(len(every))
        if held and len(every):
            words, n = np.unique(np.concatenate(held), return_counts=True)
            at = np.minimum(np.searchsorted(every, words), len(every) - 1)
            same = every[at] == words
            inside[at[same]] = n[same]
        expected = counts * len(held) / max(1, len(documents))
        gain = np.maximum(gain, np.abs(inside - expected) / np.sqrt(counts + 1))
    chain = Chain(list(labels), Lookup(every[np.argsort(-gain, kind="stable")[:VOCABULARY]]))
    presence, known_dense = _matrix(documents, chain.lookup), np.asarray(dense, np.float64)
    fold = np.arange(len(documents)) % FOLDS
    for y in labels.values():
        known = ~np.isnan(y)
        columns = np.hstack([known_dense, np.ones((len(y), 1))])
        chain.weights.append(fit_linear(presence[known], columns[known], y[known]))
        out_of_fold = np.zeros(len(y))
        for k in range(FOLDS):
            there, others = fold == k, known & (fold != k)
            weights = fit_linear(presence[others], columns[others], y[others])
            used = np.flatnonzero(weights[:presence.shape[1]])
            out_of_fold[there] = _sigmoid(presence[there][:, used] @ weights[used] + columns[there] @ weights[presence.shape[1]:])
        both = known.any() and y[known].min() != y[known].max()
        chain.thresholds.append(_threshold(out_of_fold[known], y[known]) if both else 0.5)
        known_dense = np.hstack([known_dense, out_of_fold[:, None]])
    v = len(chain.lookup.values)
    used = np.flatnonzero(sum((np.abs(w[:v]) for w in chain.weights), np.zeros(v)))
    chain.lookup = Lookup(chain.lookup.values[used])
    chain.weights = [np.concatenate([w[:v][used], w[v:]]) for w in chain.weights]
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int = SAMPLE) -> Chain:
    """A chain over ``categories``: name to a condition on ``labels``, in the order predicted."""
    try:
        return _trained(docs, labels, categories, sample)
    finally:
        release()


def _trained(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample: int) -> Chain:
    text.lean(docs.sparkSession)
    names = list(categories)
    truth = labels.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *[c.cast("int").alias(k) for k, c in categories.items()])
    truth = truth.groupBy("doc_id").agg(*[F.max(k).alias(k) for k in names])
    picked = [truth.filter(F.col(k) == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in names for v in (0, 1)]
    chosen = reduce(DataFrame.union, picked).distinct()  # at most 2 * sample rows a category
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]).mapInArrow(_distinct, "doc_id long, words array<long>, shares array<double>")
    rows = rows.filter(F.size("words") > 0).toArrow().combine_chunks().sort_by("doc_id")
    wanted = {r["doc_id"]: r for r in chosen.toArrow().to_pylist()}
    ids = rows["doc_id"].to_pylist()
    given = {k: np.array([np.nan if wanted[i][k] is None else wanted[i][k] for i in ids], float) for k in names}
    own = [np.zeros(0, np.uint64)] * len(ids)
    if ids:
        words = rows["words"].combine_chunks()
        edges, values = words.offsets.to_numpy(), words.values.to_numpy().view(np.uint64)
        own = [values[i:j] for i, j in zip(edges[:-1], edges[1:])]
    return fit_chain(own, np.array(rows["shares"].to_pylist()).reshape(-1, SHARES), given)


def _score(batches: Iterator[pa.RecordBatch], chain: Chain, at_text: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(0).field(at_text)):
            w = text.words(data, bounds, text.SYMBOLS)
            document, word = document_terms(w, chain.lookup)
            sums = [np.bincount(document, weights=weights[word], minlength=b - a) for weights in chain.weights]
            full = np.diff(w.first) > 0
            found = [np.where(full, p, 0.0) for p in chain.probabilities(sums, shares(w, data))]
            member = [full & (p >= t) for p, t in zip(found, chain.thresholds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(p) for p in found], *[pa.array(m) for m in member]],
                                             ["row", *[f"p_{k}" for k in chain.categories], *[f"is_{k}" for k in chain.categories]])


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """(row, p_<category>..., is_<category>...): each row of ``docs`` as a struct and its predictions."""
    text.lean(docs.sparkSession)
    rows = docs.withColumn("text", F.col("text").cast("string")).select(F.struct(*docs.columns).alias("row"))
    made = [T.StructField(f"p_{k}", T.DoubleType()) for k in chain.categories] + [T.StructField(f"is_{k}", T.BooleanType()) for k in chain.categories]
    return rows.mapInArrow(partial(_score, chain=chain, at_text=docs.columns.index("text")), T.StructType([rows.schema["row"], *made]))


def categories() -> dict[str, Column]:
    """The label table's categories: junk first, as abuse is judged beside it."""
    return {"junk": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that the chain does not call toxic."""
    return score(docs, train(docs, labels, categories())).filter("not is_toxic").select("row.*")
