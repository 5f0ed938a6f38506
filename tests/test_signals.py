"""Signal operators against NumPy on known waveforms and edge cases."""

import gzip
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from aeroband.functions import arrays as X, text
from aeroband.operators import features, iq, peaks, spectral, transforms
from aeroband.sources import captures


def frames_of(spark, *signals):
    return spark.createDataFrame([(k, s.real.tolist(), s.imag.tolist()) for k, s in enumerate(signals)], "frame_id long, i array<double>, q array<double>")


def psd_of(spark, *arrays):
    return spark.createDataFrame([(k, [float(x) for x in a]) for k, a in enumerate(arrays)], "frame_id long, psd array<double>").withColumns(
        {"f0_hz": F.lit(2.4e9), "bin_hz": F.lit(1e5)})


@pytest.mark.parametrize("window", ["rect", "hann", "hamming", "blackman", "blackmanharris", "bartlett", "flattop", "kaiser14"])
def test_spectra_match_numpy(spark, window):
    rng = np.random.default_rng(1)
    z = rng.normal(size=64) + 1j * rng.normal(size=64)
    row = transforms.build_spectra(frames_of(spark, z), window).first()
    want = np.fft.fftshift(np.fft.fft(z * transforms.window_values(window, 64)))
    assert np.allclose(np.array(row.re) + 1j * np.array(row.im), want)


def test_tone_lands_in_its_bin(spark):
    n = np.arange(128)
    tone = np.exp(2j * np.pi * 10 * n / 128)
    s = transforms.build_spectra(frames_of(spark, tone), "hann").select(X.argmax(transforms.power_spectrum()).alias("k")).first()
    assert s.k == 64 + 10


def test_welch_pads_short_frames(spark):
    row = transforms.welch(frames_of(spark, np.ones(10, complex)), 1e6, 32).first()
    assert len(row.psd) == 32


def test_frames_of_mixed_length(spark):
    out = transforms.build_spectra(frames_of(spark, np.ones(8, complex), np.ones(16, complex)), "rect").collect()
    assert sorted(len(r.re) for r in out) == [8, 16]


def test_published_peak_case(spark):
    assert psd_of(spark, [-90, -80, -30, -80, -90]).select(peaks.detect("psd", -50.0).alias("p")).first().p == [2]


@pytest.mark.parametrize("values", [[], [1.0], [1.0, 1.0], [5.0] * 20])
def test_degenerate_spectra_have_no_peaks(spark, values):
    df = spark.createDataFrame([(values,)], "psd array<double>")
    assert df.select(peaks.detect("psd").alias("p")).first().p == []


def test_peak_fold_matches_loop(spark):
    rng = np.random.default_rng(2)
    arrays = [rng.normal(0, 10, 200) for _ in range(20)]
    got = {r.frame_id: r.p for r in psd_of(spark, *arrays).select("frame_id", peaks.detect("psd", 3.0, 6).alias("p")).collect()}
    for k, a in enumerate(arrays):
        kept = []
        for i in range(1, len(a) - 1):
            if a[i] > 3 and a[i] > a[i - 1] and a[i] > a[i + 1]:
                if kept and i - kept[-1] < 6:
                    kept[-1] = i if a[i] > a[kept[-1]] else kept[-1]
                else:
                    kept.append(i)
        assert got[k] == kept


def test_open_runs_drop_by_default(spark):
    df = spark.createDataFrame([([False, True, True, False, True],)], "f array<boolean>")
    assert df.select(X.closed_runs("f").alias("r")).first().r == [(1, 2)]
    assert df.select(X.closed_runs("f", True).alias("r")).first().r == [(1, 2), (4, 4)]


def test_percentiles_match_numpy(spark):
    v = np.random.default_rng(3).normal(size=101)
    df = spark.createDataFrame([(v.tolist(),)], "a array<double>")
    row = df.select(*[X.percentile("a", p).alias(f"p{k}") for k, p in enumerate((0.1, 0.5, 0.77))], X.skewness("a").alias("s"), X.excess_kurtosis("a").alias("k")).first()
    assert np.allclose(row[:3], np.percentile(v, [10, 50, 77]))
    d = v - v.mean()
    assert row.s == pytest.approx((d**3).mean() / (d**2).mean() ** 1.5) and row.k == pytest.approx((d**4).mean() / (d**2).mean() ** 2 - 3)


def video_link(width_bins, peak, rolloff):
    rng = np.random.default_rng(4)
    a = rng.normal(-80, 0.5, 400)
    centre = 200
    for j in range(-width_bins // 2, width_bins // 2):
        a[centre + j] = peak - rolloff * (abs(j) / (width_bins / 2)) ** 2
    return a


def test_analog_link_is_detected(spark):
    df = psd_of(spark, video_link(60, -20.0, 30.0), np.random.default_rng(5).normal(-80, 0.5, 400))
    out = spectral.detect_frames(df, 2.405e9).collect()
    assert [r.frame_id for r in out] == [0] and out[0].drone_type == spectral.ANALOG
    # Its centre lies within 3 MHz of a wireless LAN channel, which halves the confidence of 0.95.
    assert out[0].wifi_channel_aligned and out[0].confidence == 0.475 and out[0].threat_level == "low"


def test_flat_wide_link_is_digital(spark):
    df = psd_of(spark, video_link(150, -30.0, 1.0)).withColumn("bin_hz", F.lit(1.2e5))
    out = spectral.detect_frames(df, 2.405e9).collect()
    assert out[0].drone_type == spectral.DIGITAL


def test_interference_matches_shape(spark):
    a = np.zeros(200)
    a[50], a[120:128] = 40, 25 + np.array([0, 1, 2, 3, 3.5, 2.5, 1.5, 0.5])
    rows = psd_of(spark, a).select(F.inline(spectral.interference("psd"))).collect()
    kinds = {r.bin: r.kind for r in rows}
    assert kinds[50] == "narrowband" and kinds[124] == "wideband"


def test_cyclic_prefix_is_found(spark):
    rng = np.random.default_rng(6)
    body = rng.normal(size=64) + 1j * rng.normal(size=64)
    z = np.concatenate([body, body])
    assert frames_of(spark, z).select(iq.cyclic_prefix().alias("p")).first().p == 64


def test_carrier_offset_of_rotated_qpsk(spark):
    rng = np.random.default_rng(7)
    n = np.arange(256)
    symbols = np.exp(1j * (np.pi / 4 + np.pi / 2 * rng.integers(0, 4, 256)))
    z = symbols * np.exp(2j * np.pi * 8 * n / 256)
    s = transforms.build_spectra(iq.fourth_power(frames_of(spark, z)), "rect", i="i4", q="q4")
    assert s.select(iq.carrier_offset(256.0).alias("o")).first().o == pytest.approx(8.0)


def test_normalised_power_is_one(spark):
    z = 3 * np.exp(2j * np.pi * np.arange(32) / 7)
    row = iq.normalise(frames_of(spark, z), "power").select(X.mean(X.power("i", "q")).alias("p")).first()
    assert row.p == pytest.approx(1.0)


def test_augmentation_repeats_and_hits_its_snr(spark):
    z = np.exp(2j * np.pi * np.arange(4096) / 50)
    df = frames_of(spark, z)
    a, b = (features.augment(df, 2e6).first() for _ in range(2))
    assert a.i == b.i
    noise = a.draw.sigma**2 * 2
    assert 10 * np.log10(1 / noise) == pytest.approx(a.draw.snr_db, abs=1e-6)
    power = np.mean(np.square(a.i) + np.square(a.q)) / a.draw.scale**2
    assert power == pytest.approx(1 + noise, rel=0.05)


@pytest.mark.parametrize("dtype", list(captures.SAMPLE_TYPES))
def test_capture_types(spark, tmp_path, dtype):
    kind, per, scale = captures.SAMPLE_TYPES[dtype]
    values = np.linspace(-0.5, 0.5, 40)
    raw = (values * scale).round().astype(kind) if kind[-2] == "i" else values.astype(kind)
    (tmp_path / "x.iq").write_bytes(raw.tobytes())
    rows = captures.build_frames(spark, str(tmp_path), dtype, chunk=7, chunks_per_task=2).orderBy("sample_offset").collect()
    got = np.concatenate([np.column_stack([r.i, r.q]).ravel() if per == 2 else np.array(r.i) for r in rows])
    assert np.allclose(got, values, atol=0.01)


def test_compressed_and_broken_captures(spark, tmp_path):
    import zstandard
    z = (np.arange(50) / 50).astype("<f4").tobytes()
    (tmp_path / "a.gz").write_bytes(gzip.compress(z))
    (tmp_path / "b.zst").write_bytes(struct.pack("<Q", len(z)) + zstandard.ZstdCompressor().compress(z))
    np.save(tmp_path / "c.npy", np.arange(25).astype(np.complex64))
    (tmp_path / "d.npy").write_bytes(b"not an array")
    inv = {r.path.rsplit("/", 1)[1]: r for r in captures.inventory(spark, str(tmp_path)).collect()}
    assert [inv[k].samples for k in ("a.gz", "b.zst", "c.npy")] == [25, 25, 25]
    assert inv["d.npy"].samples == 0 and inv["d.npy"]._error


@pytest.mark.parametrize("pattern,topic,hit", [("a/+/c", "a/b/c", True), ("a/+/c", "a/b/d/c", False), ("a/#", "a", True), ("a/#", "a/b/c", True), ("a/#", "ab", False),
                                               ("a*", "abc", True), ("#", "x/y", True), ("a.b", "axb", False)])
def test_topic_patterns(spark, pattern, topic, hit):
    df = spark.createDataFrame([(topic,)], "t string")
    assert df.select(text.topic_matches("t", pattern).alias("m")).first().m is hit


def test_signed_bytes(spark):
    df = spark.createDataFrame([(bytearray(struct.pack("<iHhI", -1224194000, 65535, -5, 4_000_000_000)),)], "p binary")
    row = df.select(text.little_endian("p", 0, 4, True).alias("a"), text.little_endian("p", 4, 2, False).alias("b"), text.little_endian("p", 6, 2, True).alias("c"),
                    text.little_endian("p", 8, 4, False).alias("d")).first()
    assert tuple(row) == (-1224194000, 65535, -5, 4_000_000_000)


def test_feature_vector_is_complete(spark):
    rng = np.random.default_rng(8)
    df = frames_of(spark, rng.normal(size=64) + 1j * rng.normal(size=64)).withColumn("label", F.lit(1))
    out = features.extract(df, 2e6)
    assert [c for c in out.columns if c in features.FEATURE_RANGES] == features.FEATURES and len(features.FEATURES) == 46
    assert not pd.isna(list(out.first())).any()


def test_catalogue_parts_give_the_same_ranking(spark, monkeypatch):
    from aeroband.operators import detectors
    rng = np.random.default_rng(10)
    df = psd_of(spark, *rng.normal(0, 10, (5, 64)))
    sig = spark.createDataFrame([(k, 2.4e9 + k * 2e5, 2.4e9 + k * 2e5 + 1e6, 15.0 + k % 11) for k in range(40)], "signature_id int, start_hz double, stop_hz double, expected_peak double")
    whole = sorted(tuple(r) for r in detectors.rank_signatures(df, sig).collect())
    monkeypatch.setattr(detectors, "CATALOGUE_PART", 7)
    assert sorted(tuple(r) for r in detectors.rank_signatures(df, sig).collect()) == whole


@pytest.mark.parametrize("n", [32, 100, 2048])
def test_matrix_forms_of_lag_measures(spark, n):
    """Autocorrelation by transform and shifted products of whole matrices against plain loops."""
    rng = np.random.default_rng(n)
    echo = rng.normal(size=n) + 1j * rng.normal(size=n)
    slow = np.convolve(echo, np.ones(9) / 3, "same")
    signals = [echo, slow, np.ones(n) + 0j, np.zeros(n) + 0j, np.exp(2j * np.pi * 3 * np.arange(n) / n)]
    frames = frames_of(spark, *signals)
    delays = {r.frame_id: r.delay_s for r in transforms.multipath_delay(frames, 2e6).collect()}
    spectra = transforms.build_spectra(frames, "hann")
    rates = {r.frame_id: r.symbol_rate for r in transforms.symbol_rates(spectra, 2e6, minimum=0.05).collect()}
    for k, z in enumerate(signals):
        r = np.array([(z[lag:] * np.conj(z[:n - lag])).sum().real for lag in range(n)])
        low = np.flatnonzero(r < 0.1 * r[0]) if r[0] > 0 else []
        assert delays[k] == (low[0] / 2e6 if len(low) else 0.0)
        x = np.fft.fftshift(np.fft.fft(z * transforms.window_values("hann", n)))
        kept = []
        for j in range(20):
            rate = 2e3 + (2e5 - 2e3) * j / 19
            a = int(rate * n / 2e6)
            if 1 <= a < n and abs((x * np.conj(np.roll(x, a))).sum()) / n > 0.05:
                kept.append(rate)
        assert np.isclose(rates[k], np.median(kept) if kept else 0.0)
    if n == 32:
        assert {r.frame_id: r.d for r in frames.select("frame_id", iq.multipath_delay_s(2e6).alias("d")).collect()} == delays
