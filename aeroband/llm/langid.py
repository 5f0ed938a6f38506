"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in segments of ``SEGMENT`` bytes.  In each, one recurrent layer runs forwards
and one backwards; every byte position gets language probabilities from both states, and a
document's probabilities are the mean over all its positions.  Gates are clipped lines
instead of sigmoids, which keeps a step cheap.  The network is trained here, on the driver,
by backpropagation through time with Adam, on ``SAMPLE`` documents of each language at most
(in hash order of their ids) and ``PARTS`` pieces of ``LESSON`` bytes of each, in ``UPDATES``
steps for every four languages.  Prediction
reads whole texts in one pass without a shuffle.

Edge cases.  A text that is null or has no letter is ``und`` with score 0.  Without any
labelled document every text is ``und`` with score 0.  Every row gets a row, repeated ones
and those without doc_id too.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroband.llm import text

SEGMENT = 128
HIDDEN = 8
LESSON = 64
PARTS = 4
SAMPLE = 600
UPDATES = 220
BATCH = 256
LANES = 4096  # segments run side by side
PAD = 256


@dataclass
class Direction:
    """Inputs by byte (gates reset, keep, and the candidate), recurrent weights, candidate bias."""
    table: np.ndarray
    inner: np.ndarray
    bias: np.ndarray


@dataclass
class Network:
    languages: list[str]
    ways: list[Direction]
    out: np.ndarray
    shift: np.ndarray


def _hold(table: np.ndarray) -> None:
    """Padding keeps the state: nothing of it enters."""
    h = table.shape[1] // 3
    table[PAD] = 0
    table[PAD, h:2 * h] = 50


def fresh(languages: list[str], hidden: int = HIDDEN) -> Network:
    rng = np.random.default_rng(11)
    ways = []
    for _ in range(2):
        table = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
        table[:, hidden:2 * hidden] += 1.5
        _hold(table)
        ways.append(Direction(table, rng.normal(0, 0.3, (hidden, 3 * hidden)).astype(np.float32), np.zeros(hidden, np.float32)))
    return Network(languages, ways, rng.normal(0, 0.3, (2 * hidden, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))


def _gate(x: np.ndarray) -> np.ndarray:
    x *= np.float32(0.25)
    x += np.float32(0.5)
    return np.clip(x, 0, 1, out=x)


def states(way: Direction, steps: np.ndarray, trace: list | None = None) -> Iterator[np.ndarray]:
    """The state after each row of ``steps`` (time x lanes of byte values or PAD)."""
    hidden = len(way.bias)
    h = np.zeros((steps.shape[1], hidden), np.float32)
    for row in steps:
        a = way.table[row]
        u = h @ way.inner
        gates = _gate(a[:, :2 * hidden] + u[:, :2 * hidden])
        reset, keep = gates[:, :hidden], gates[:, hidden:]
        turned = u[:, 2 * hidden:]
        turned += way.bias
        new = np.tanh(a[:, 2 * hidden:] + reset * turned)
        if trace is not None:
            trace.append((h, reset, keep, turned, new))
        h = new + keep * (h - new)
        yield h


def positions(net: Network, steps: np.ndarray) -> np.ndarray:
    """Language probabilities at each position: time x lanes x languages."""
    hidden = net.out.shape[0] // 2
    scores = np.empty((*steps.shape, len(net.languages)), np.float32)
    for t, h in enumerate(states(net.ways[0], steps)):
        np.dot(h, net.out[:hidden], out=scores[t])
    for t, h in enumerate(states(net.ways[1], steps[::-1])):
        scores[len(steps) - 1 - t] += h @ net.out[hidden:] + net.shift
    scores -= scores.max(axis=2, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=2, keepdims=True)
    return scores


def gradients(net: Network, steps: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over real positions, and its slopes for ``parameters(net)``, through time."""
    hidden, real = net.out.shape[0] // 2, steps != PAD
    total = max(1, int(real.sum()))
    traces: list[list] = [[], []]
    forward = list(states(net.ways[0], steps, traces[0]))
    backward = list(states(net.ways[1], steps[::-1], traces[1]))
    both = np.concatenate([np.stack(forward), np.stack(backward)[::-1]], axis=2)
    scores = both @ net.out + net.shift
    scores -= scores.max(axis=2, keepdims=True)
    p = np.exp(scores)
    p /= p.sum(axis=2, keepdims=True)
    lanes = np.arange(steps.shape[1])
    loss = -float((np.log(p[:, lanes, labels] + 1e-9) * real).sum() / total)
    p[:, lanes, labels] -= 1
    p *= (real / np.float32(total))[:, :, None]
    slopes = [np.einsum("tlh,tlk->hk", both, p, optimize=True), p.sum((0, 1))]
    back = p @ net.out.T
    for w, (way, trace) in enumerate(zip(net.ways, traces)):
        order = steps if w == 0 else steps[::-1]
        given = back[:, :, :hidden] if w == 0 else back[::-1, :, hidden:]
        d_inner, d_bias, d_in = np.zeros_like(way.inner), np.zeros_like(way.bias), []
        d_h = np.zeros_like(given[0])
        for t in range(len(order) - 1, -1, -1):
            h, reset, keep, turned, new = trace[t]
            d = d_h + given[t]
            d_new = d * (1 - keep) * (1 - new * new)
            d_keep = d * (h - new) * ((keep > 0) & (keep < 1)) * np.float32(0.25)
            d_reset = d_new * turned * ((reset > 0) & (reset < 1)) * np.float32(0.25)
            d_u = np.concatenate([d_reset, d_keep, d_new * reset], axis=1)
            d_in.append(np.concatenate([d_reset, d_keep, d_new], axis=1))
            d_inner += h.T @ d_u
            d_bias += d_u[:, 2 * hidden:].sum(0)
            d_h = d * keep + d_u @ way.inner.T
        flat, d_all = order[::-1].reshape(-1), np.concatenate(d_in)
        d_table = np.stack([np.bincount(flat, weights=d_all[:, k], minlength=257) for k in range(3 * hidden)], axis=1)
        slopes += [d_table.astype(np.float32), d_inner, d_bias]
    return loss, slopes


def parameters(net: Network) -> list[np.ndarray]:
    return [net.out, net.shift, *[x for w in net.ways for x in (w.table, w.inner, w.bias)]]


def train_network(pieces: list[bytes], labels: np.ndarray, languages: list[str], updates: int = UPDATES) -> Network:
    net = fresh(languages)
    rng = np.random.default_rng(12)
    grid = _grid(pieces, LESSON)
    values = parameters(net)
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for n in range(1, updates + 1):
        chosen = rng.integers(0, len(pieces), min(BATCH, 4 * len(pieces)))
        _, slopes = gradients(net, grid[:, chosen], labels[chosen])
        size = np.sqrt(sum(float((s * s).sum()) for s in slopes))
        rate = 0.03 * min(1.0, 3 * (1 - n / (updates + 1)))
        for v, s, a, b in zip(values, slopes, first, second):
            s = s * np.float32(min(1.0, 1.0 / max(size, 1e-9)))
            a += np.float32(0.1) * (s - a)
            b += np.float32(0.01) * (s * s - b)
            v -= np.float32(rate) * (a / np.float32(1 - 0.9 ** n)) / (np.sqrt(b / np.float32(1 - 0.99 ** n)) + np.float32(1e-7))
        for way in net.ways:
            _hold(way.table)
    return net


def _grid(pieces: list[bytes], length: int) -> np.ndarray:
    """Time x pieces, padded at the end."""
    out = np.full((len(pieces), length), PAD, np.int64)
    for k, p in enumerate(pieces):
        out[k, :len(p)] = np.frombuffer(p, np.uint8)
    return np.ascontiguousarray(out.T)


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """A network from ``docs`` (doc_id, text, lang); None where no text is labelled."""
    known = docs.filter("lang is not null and text is not null and doc_id is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    languages = [r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]  # one row a language, as the network has
    order = Window.partitionBy("lang", "__part").orderBy("__hash", "doc_id")
    # A language may hold most rows: keep the first of each of many parts, then the first of those.
    ranked = known.withColumn("__hash", F.xxhash64("doc_id")).withColumn("__part", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(64)))
    ranked = ranked.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample).withColumn("__part", F.lit(0))
    chosen = ranked.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= sample).select("doc_id", "lang")
    length = F.length("text")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", k), F.greatest(length - LESSON, F.lit(1))) + 1).cast("int"), F.lit(LESSON)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang"), "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").select("lang", pieces.alias("pieces")).limit(sample * max(1, len(languages))).collect()
    data = [(p.encode()[:LESSON], languages.index(r["lang"])) for r in rows for p in r["pieces"]]
    if not data:
        return None
    data.sort()
    return train_network([p for p, _ in data], np.array([x for _, x in data]), languages, UPDATES * max(1, -(-len(languages) // 4)))


def pooled(net: Network, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Mean probabilities of each document over its positions; zeros for empty ones."""
    lengths = np.diff(bounds)
    many = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = bounds[:-1][owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, bounds[1:][owner] - start)
    padded = np.concatenate([data, np.zeros(SEGMENT, np.uint8)])
    sums = np.zeros((len(owner), len(net.languages)))
    order = np.argsort(-size, kind="stable")
    for k in range(0, len(owner), LANES):
        own = order[k:k + LANES]
        t = np.arange(int(size[own].max()))[:, None]
        steps = padded[start[own][None, :] + t].astype(np.int64)
        outside = t >= size[own][None, :]
        steps[outside] = PAD
        p = positions(net, steps)
        p[outside] = 0
        sums[own] = p.sum(axis=0)
    out = np.zeros((len(lengths), len(net.languages)))
    np.add.at(out, owner, sums)
    return out / np.maximum(lengths, 1)[:, None]


def _predict(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(1)):
            letters = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
            if net is None:
                names, score = ["und"] * (b - a), np.zeros(b - a)
            else:
                p = pooled(net, data, bounds)
                best = p.argmax(axis=1)
                names = [net.languages[k] if y else "und" for k, y in zip(best, letters)]
                score = np.where(letters, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of whole texts."""
    body = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), F.coalesce(body.rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(partial(_predict, net=net), "doc_id long, lang_pred string, score double")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(doc_id.cast("string")) % 3
