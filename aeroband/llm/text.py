"""Words, word hashes and shingles of whole Arrow batches, as NumPy arrays.

Null texts count as empty.  Work goes by slices of whole documents of about ``SLICE``
bytes, so memory follows the slice or the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE = 1 << 19
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


#: Bytes between words: ASCII white space; or all ASCII but digits and lower-case letters.
WHITE = _table((0x20, 0x20), (0x09, 0x0D))
SYMBOLS = _table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

_VALUES = np.random.default_rng(20261).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int):
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1]
    size, made = 1 << int(n - 1).bit_length(), []
    for base in (_BASE, _INVERSE):
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        made.append(np.multiply.accumulate(factors))
    if size <= 2 * SLICE:  # those of a very long text are not kept
        _powers[:] = made
    return made[0][:n], made[1]


@dataclass
class Words:
    """Words of some documents: document d has words ``first[d]`` to ``first[d + 1]``."""
    data: np.ndarray
    inside: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray | None
    first: np.ndarray

    @cached_property
    def _single(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text with one space after each word, and where words start and end in it."""
        kept, data = self.inside.copy(), self.data
        behind = self.ends[self.ends < len(data)]
        behind = behind[~self.inside[behind]]
        kept[behind] = True
        place = np.cumsum(kept)
        spaced = data.copy()
        spaced[behind] = 32
        return spaced[kept].tobytes(), place[self.starts] - 1, place[self.ends - 1]

    def joined(self, i: int, j: int) -> bytes:
        """Words i to j of one document with single spaces."""
        if i >= j:
            return b""
        data, starts, ends = self._single
        return data[starts[i]:ends[j - 1]]


def lean(spark: SparkSession) -> None:
    """Arrow batches of a few megabytes: whole texts would else come ten thousand at a time."""
    if spark.conf.get(BATCH) != str(BATCH_BYTES):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from row, to row, bytes, document bounds) of runs of whole documents, without a copy."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    if column.type not in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        column = column.cast(pa.string())
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
        yield from slices(column.fill_null(""), size)  # bytes under a null
        return
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray, lower: bool = True, hashed: bool = True) -> Words:
    """Words are runs of bytes not in ``between``; they never cross documents."""
    text = LOWER[data] if lower else data
    n = len(text)
    inside = ~between[text]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = np.unique(bounds[(bounds > 0) & (bounds < n)])
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = None
    if hashed:
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[text] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return Words(text, inside, bounds, starts, ends, hashes, np.searchsorted(starts, bounds))


_FACTORS = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on; len - n + 1 values, none if fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64)
    for k in range(n):
        out += hashes[k:k + count] * _FACTORS[k % 256]
    return mix(out)


def ranges(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the words from each start to its end; the ranges may overlap and differ in length."""
    n = len(hashes)
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(w: Words, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; one for its whole sequence of fewer words."""
    every = runs(w.hashes, n)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            yield np.unique(every[a:b - n + 1])
        elif b > a:
            yield runs(w.hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
