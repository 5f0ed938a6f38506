"""Fourier jobs: Arrow batches of frames in, array columns out.

NumPy does only the transform.  A mapped batch is independent of every other one, so the
job is a scan-side stage without a shuffle, and the frame stays the unit of work.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from aeroband.functions import arrays as X

DOUBLES = T.ArrayType(T.DoubleType())

# Cosine-sum window coefficients.
COSINE_WINDOWS = {
    "hann": [0.5, 0.5],
    "hamming": [0.54, 0.46],
    "blackman": [0.42, 0.5, 0.08],
    "blackmanharris": [0.35875, 0.48829, 0.14128, 0.01168],
    "flattop": [0.21557895, 0.41663158, 0.277263158, 0.083578947, 0.006947368],
}


def window_values(name: str, n: int) -> np.ndarray:
    """Symmetric window of ``n`` points."""
    if name == "rect" or n == 1:
        return np.ones(n)
    if name == "bartlett":
        return np.bartlett(n)
    if name.startswith("kaiser"):
        return np.kaiser(n, float(name[6:] or 14))
    k = 2 * np.pi * np.arange(n) / (n - 1)
    return sum((-1) ** j * a * np.cos(j * k) for j, a in enumerate(COSINE_WINDOWS[name]))


def _lists(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as an Arrow list column, without a Python object per row."""
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (rows + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(values, dtype=np.float64).ravel()))


def _map_frames(frames: DataFrame, keep: list[str], extra: list[T.StructField], work, i="i", q="q") -> DataFrame:
    """``work(samples)`` takes a complex matrix of equally long frames and returns a repeat count per
    frame and the new columns.  Sample columns pass from Arrow to NumPy as flat buffers."""
    schema = T.StructType([f for f in frames.schema.fields if f.name in keep] + extra)
    kept = [f.name for f in schema.fields if f.name in keep]

    def run(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(i))
            for n in pc.unique(sizes.drop_null()).to_pylist():
                if n == 0:
                    continue
                part = pa.Table.from_batches([batch]).filter(pc.equal(sizes, n)).combine_chunks().to_batches()[0]
                flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for c in (i, q)]
                repeat, columns = work(flat[0] + 1j * flat[1])
                rows = pa.table({c: part.column(c) for c in kept})
                if repeat != 1:
                    rows = rows.take(pa.array(np.repeat(np.arange(part.num_rows), repeat)))
                for name, column in columns.items():
                    rows = rows.append_column(name, column)
                yield from rows.combine_chunks().to_batches()

    return frames.select(*dict.fromkeys([*keep, i, q])).mapInArrow(run, schema)


def build_spectra(frames: DataFrame, window: str = "hann", fft_size: int | None = None, keep=("frame_id",), i="i", q="q") -> DataFrame:
    """Windowed, shifted complex bins of each frame as arrays ``re`` and ``im``.

    A frame longer than ``fft_size`` is cut, a shorter one zero-padded after windowing.
    """
    def work(z):
        n = fft_size or z.shape[1]
        z = z[:, :n]
        spectrum = np.fft.fftshift(np.fft.fft(z * window_values(window, z.shape[1]), n=n, axis=1), axes=1)
        return 1, {"re": _lists(spectrum.real), "im": _lists(spectrum.imag)}

    return _map_frames(frames, list(keep), [T.StructField("re", DOUBLES), T.StructField("im", DOUBLES)], work, i, q)


def _segment_power(z: np.ndarray, sample_rate: float, size: int, overlap: float, window: str) -> np.ndarray:
    """Power density per (frame, segment, bin); a frame shorter than a segment is zero-padded."""
    if z.shape[1] < size:
        z = np.pad(z, ((0, 0), (0, size - z.shape[1])))
    w = window_values(window, size)
    cut = np.lib.stride_tricks.sliding_window_view(z, size, axis=1)[:, ::max(1, size - int(size * overlap))]
    return np.abs(np.fft.fftshift(np.fft.fft(cut * w, axis=2), axes=2)) ** 2 / (sample_rate * (w**2).sum())


def spectrogram(frames: DataFrame, sample_rate: float, segment: int = 256, overlap: float = 0.5, window: str = "hann",
                keep=("frame_id",)) -> DataFrame:
    """Power density of every segment: one row per (frame, segment)."""
    def work(z):
        p = _segment_power(z, sample_rate, segment, overlap, window)
        count = p.shape[1]
        return count, {"segment": pa.array(np.tile(np.arange(count, dtype=np.int32), len(z))), "psd": _lists(p.reshape(-1, segment))}

    return _map_frames(frames, list(keep), [T.StructField("segment", T.IntegerType()), T.StructField("psd", DOUBLES)], work)


def welch(frames: DataFrame, sample_rate: float, segment: int = 256, overlap: float = 0.5, window: str = "hann", keep=("frame_id",)) -> DataFrame:
    """Mean power density over a frame's overlapping segments; short frames are zero-padded."""
    def work(z):
        return 1, {"psd": _lists(_segment_power(z, sample_rate, segment, overlap, window).mean(axis=1))}

    return _map_frames(frames, list(keep), [T.StructField("psd", DOUBLES)], work)


def average_by(frames: DataFrame, key: str, psd: str = "psd") -> DataFrame:
    """Mean spectrum of a recording from its frames; the mean folds map-side per (key, bin)."""
    bins = frames.select(key, F.posexplode(psd).alias("bin", "_p"))
    return bins.groupBy(key, "bin").agg(F.avg("_p").alias("psd"))


def bin_frequency(bin_column, size, sample_rate, center_hz=0.0):
    return F.lit(center_hz) + (X._c(bin_column) - F.floor(X._c(size) / 2)) * sample_rate / X._c(size)


def power_spectrum(re="re", im="im", decibels: bool = False):
    """|X|² per bin, optionally in dB."""
    return F.zip_with(re, im, (lambda a, b: 10 * F.log10(a * a + b * b + F.lit(1e-12))) if decibels else (lambda a, b: a * a + b * b))


def magnitude_spectrum(re="re", im="im", decibels: bool = False):
    return F.zip_with(re, im, (lambda a, b: 20 * F.log10(F.sqrt(a * a + b * b) + F.lit(1e-12))) if decibels else (lambda a, b: F.sqrt(a * a + b * b)))


def multipath_delay(frames: DataFrame, sample_rate: float, keep=("frame_id",), i="i", q="q", limit: float = 0.1) -> DataFrame:
    """``delay_s``: the first lag whose real autocorrelation falls below ``limit`` of that at zero.

    All lags come from one transform of the zero-padded frame; short frames may use
    ``iq.multipath_delay_s`` in the row.
    """
    def work(x):
        n = x.shape[1]
        size = 1 << (2 * n - 1).bit_length()
        power = np.abs(np.fft.fft(x, size, axis=1)) ** 2
        lags = np.fft.ifft(power, axis=1)[:, :n].real
        low = lags < limit * lags[:, :1]
        low[lags[:, 0] <= 0] = False
        return 1, {"delay_s": pa.array(np.where(low.any(axis=1), low.argmax(axis=1), 0) / sample_rate)}

    return _map_frames(frames, list(keep), [T.StructField("delay_s", T.DoubleType())], work, i, q)


def symbol_rates(spectra: DataFrame, sample_rate: float, keep=("frame_id",), minimum: float = 0.1, candidates: int = 20) -> DataFrame:
    """``symbol_rate``: median of the candidate rates whose spectral correlation passes the limit, else zero.

    Spectra (``re``, ``im``) are matrices; each candidate is one shifted product of all of them.
    """
    low, high = sample_rate / 1000, sample_rate / 10
    rates = np.array([low + (high - low) * k / (candidates - 1) for k in range(candidates)])

    def work(x):
        n = x.shape[1]
        passed = np.zeros((len(x), candidates), bool)
        for k, rate in enumerate(rates):
            shift = int(np.floor(rate * n / sample_rate))
            if 1 <= shift < n:
                passed[:, k] = np.abs((x * np.conj(np.roll(x, shift, axis=1))).sum(axis=1)) / n > minimum
        count = passed.sum(axis=1)
        order = np.sort(np.where(passed, rates, np.inf), axis=1)
        at = lambda k: order[np.arange(len(x)), np.maximum(k, 0)]
        middle = (at((count - 1) // 2) + at(count // 2 - (count == 0))) / 2
        return 1, {"symbol_rate": pa.array(np.where(count > 0, middle, 0.0))}

    return _map_frames(spectra, list(keep), [T.StructField("symbol_rate", T.DoubleType())], work, "re", "im")
