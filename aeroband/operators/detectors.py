"""Composed detectors: modulation scores, signature ranking, triggered capture, gain choice."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import arrays as X
from aeroband.functions.timing import epoch_us
from aeroband.operators import iq as I, peaks as K, spectral as S, transforms as T

C = F.col
TINY = 1e-12
CATALOGUE_PART = 5000

# Known profiles (name, modulation, bandwidth Hz, cyclic prefix, deviation, spreading).
PROFILES = [
    ("DJI_OcuSync", "OFDM", 20e6, True, False, False), ("DJI_O4", "OFDM", 40e6, True, False, False),
    ("FPV_Analog", "FM", 8e6, False, True, False), ("FPV_Digital_HDZero", "OFDM", 20e6, False, False, False),
    ("LoRa_Telemetry", "Chirp", 125e3, False, False, True),
]


def score_frames(frames: DataFrame, sample_rate: float, segment: int = 16) -> DataFrame:
    """OFDM, FM and chirp scores of each frame, the best of the three and its profile.

    The prefix test is the lag correlation, and the cyclic strength the strongest spectral
    correlation over the candidate rates.
    """
    n = F.size("i")
    wide = T.build_spectra(frames, "hann", keep=("frame_id", "i", "q"))
    drift = slice_drift(frames, sample_rate, segment)
    base = wide.join(drift, "frame_id")
    step = sample_rate / n
    facts = F.struct(T.power_spectrum().alias("p"), X.amplitude("i", "q").alias("a"), I.phase_steps("i", "q").alias("st"),
                     (I.cyclic_prefix("i", "q") > 0).alias("cp"), S.cyclic_features(sample_rate)["cyclic_coherence"].alias("cyc"))

    def scores(f):
        top = F.array_max(f["p"])
        spread = X.variance(F.transform(f["p"], lambda x: x / (top + TINY)))
        lo, hi = X.first_reaching(f["p"], 0.1), X.first_reaching(f["p"], 0.9)
        obw = (X.first_reaching(f["p"], 0.995) - X.first_reaching(f["p"], 0.005)) * step
        peaks = F.size(F.filter(K.local_maxima(f["p"]), lambda i: X.at(f["p"], i) >= 0.7 * top))
        ofdm = ((1 - F.least(spread, F.lit(0.5)) / 0.5) * 0.3 + (1 - F.abs((hi - lo) / (n - 1) - 0.8)) * 0.2 + F.when(f["cp"], 0.25).otherwise(0.0)
                + F.least(peaks / 20, F.lit(1.0)) * 0.15 + F.least(f["cyc"], F.lit(1.0)) * 0.1)
        constancy = X.variance(f["a"]) / (F.pow(X.mean(f["a"]), 2) + TINY)
        fvar = X.variance(f["st"]) * (sample_rate / (2 * math.pi)) ** 2
        deviation = 1 - F.least(F.abs(obw / 2 - 5e6) / 5e6, F.lit(1.0))
        fm = (1 - F.least(constancy, F.lit(1.0))) * 0.3 + F.least(fvar / 1e12, F.lit(1.0)) * 0.3 + deviation * 0.4
        match = 1 - F.least(F.abs(C("change_rate") - 125e3) / 125e3, F.lit(1.0))
        chirp = (1 - F.least(C("consistency"), F.lit(1.0))) * 0.4 + match * 0.4 + F.least(C("change_rate") / 1e6, F.lit(1.0)) * 0.2
        return F.struct(ofdm.alias("ofdm"), fm.alias("fm"), chirp.alias("chirp"), ((hi - lo) * step).alias("ofdm_hz"), obw.alias("fm_hz"), f["cp"].alias("cp"),
                        deviation.alias("deviation"), match.alias("match"))

    scored = base.select("frame_id", X.let(facts, scores).alias("s"), C("chirp_hz"))
    best = F.array_max(F.array(F.struct(C("s.ofdm").alias("v"), F.lit("OFDM").alias("m"), C("s.ofdm_hz").alias("bw")),
                               F.struct(C("s.fm"), F.lit("FM"), C("s.fm_hz")).cast("struct<v:double,m:string,bw:double>"),
                               F.struct(C("s.chirp"), F.lit("Chirp"), C("chirp_hz")).cast("struct<v:double,m:string,bw:double>")))
    chosen = scored.withColumn("_b", best)

    def profile(p):
        name, modulation, width, prefix, dev, spreading = p
        closeness = (1 - F.least(F.abs(C("_b.bw") - width) / width, F.lit(1.0))) * 0.4
        extra = (F.when(C("s.cp") == F.lit(prefix), 0.3).otherwise(0.0) if modulation == "OFDM" else C("s.deviation") * 0.4 if dev else C("s.match") * 0.4 if spreading else F.lit(0.0))
        return F.when(C("_b.m") == modulation, F.struct((closeness + extra).alias("score"), F.lit(name).alias("drone_type")))

    ranked = chosen.withColumn("_p", F.array_max(F.array_compact(F.array(*[profile(p) for p in PROFILES]))))
    known = C("_p.score") > 0.5
    return ranked.select("frame_id", "s.ofdm", "s.fm", "s.chirp", C("_b.m").alias("modulation"), C("_b.v").alias("confidence"), C("_b.bw").alias("bandwidth_hz"),
                         F.when(known, C("_p.drone_type")).otherwise("Unknown").alias("drone_type"), F.when(known, C("_p.score")).otherwise(0.0).alias("match_score"))


def slice_drift(frames: DataFrame, sample_rate: float, segment: int) -> DataFrame:
    """Peak-bin movement between the time slices of a frame (a handful of slices per frame)."""
    slices = T.spectrogram(frames, sample_rate, segment, 0.5).select("frame_id", "segment", X.argmax("psd").alias("peak"))
    per = slices.groupBy("frame_id").agg(F.array_sort(F.collect_list(F.struct("segment", "peak"))).alias("s"))
    jumps = X.let("s", lambda v: F.transform(X.indices(v, 1), lambda k: F.abs(X.at(v, k)["peak"] - X.at(v, k - 1)["peak"]) * (sample_rate / segment)))
    rate = per.withColumn("_j", jumps).withColumn("change_rate", F.coalesce(X.mean("_j"), F.lit(0.0)))
    std = F.coalesce(X.deviation("_j"), F.lit(0.0))
    grid = sample_rate / segment * math.sqrt((segment**2 - 1) / 12)
    return rate.select("frame_id", "change_rate", (std / (C("change_rate") + TINY)).alias("consistency"), F.lit(grid * 4).alias("chirp_hz"))


def gated(scores: DataFrame, gate: float = 0.6) -> DataFrame:
    """Detections of the composed detector: classes below the gate are not reported."""
    return scores.filter(C("confidence") >= gate)


def rank_signatures(frames: DataFrame, signatures: DataFrame, k: int = 3, template: str | None = None) -> DataFrame:
    """Best ``k`` signatures per frame by the mean of band, shape and feature scores.

    Scoring meets the catalogue as arrays of at most ``CATALOGUE_PART`` signatures.  One part
    is a constant of the plan; a larger catalogue is scored part by part through an equi-join
    on the part number and the best of the parts are merged, so every signature counts.
    """
    fields = ["signature_id", "start_hz", "stop_hz", "expected_peak"] + ([template] if template else [])
    parts = max(1, math.ceil(signatures.count() / CATALOGUE_PART))
    entry = F.array_sort(F.collect_list(F.struct(*fields))).alias("sigs")

    def build(v):
        lin = S.linear(v)

        def of(c):
            def score(s):
                parts = [F.when(c["centroid"].between(s["start_hz"], s["stop_hz"]), 1.0).otherwise(0.0), S.feature_score(c["top"], s["expected_peak"], 0.5)]
                if template:
                    parts.append(F.greatest(F.lit(0.0), S.correlation(v, s[template])))
                return S.similarity(parts)

            ranked = F.transform("sigs", lambda s: F.struct((-F.round(score(s), 9)).alias("neg"), s["signature_id"].alias("signature_id"), score(s).alias("score")))
            return F.slice(F.array_sort(ranked), 1, k)

        facts = F.struct(X.let(lin, lambda p: F.aggregate(X.indices(p), F.lit(0.0), lambda s, i: s + X.at(p, i) * S.frequency(i)) / X.total(p)).alias("centroid"), F.array_max(v).alias("top"))
        return X.let(facts, of)

    if parts == 1:
        joined = frames.withColumn("sigs", signatures.agg(entry).scalar())
    else:
        catalogue = signatures.groupBy(F.pmod(F.xxhash64("signature_id"), F.lit(parts)).cast("int").alias("_part")).agg(entry)
        joined = frames.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(catalogue, "_part")
    best = joined.select("frame_id", X.let("psd", build).alias("top"))
    if parts > 1:
        kind = best.schema["top"].dataType
        merged = F.aggregate(F.collect_list("top"), F.array().cast(kind), lambda s, t: F.slice(F.array_sort(F.concat(s, t)), 1, k))
        best = best.groupBy("frame_id").agg(merged.alias("top"))
    out = best.select("frame_id", F.posexplode("top").alias("_r", "m"))
    return out.select("frame_id", "m.signature_id", (C("_r") + 1).alias("rank"), "m.score", S.similarity_confidence(C("m.score")).alias("confidence"))


def triggered_capture(samples: DataFrame, trigger: Column, keys: list[str], before_s: float = 5, after_s: float = 10, spacing_s: float = 5, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Rows from ``before_s`` ahead of to ``after_s`` behind each trigger of the same key.

    Triggers closer than ``spacing_s`` to an accepted one are ignored.  Triggers are listed
    under the time cells they cover, so the interval test runs on an equi-join of (key, cell).
    """
    from aeroband.operators.rules import suppress
    hits = samples.filter(trigger).select(*keys, C(tie).alias("id"), C(ts).alias("ts"))
    if spacing_s:
        hits = suppress(hits, keys, F.lit(float(spacing_s)))
    cell = int((before_s + after_s) * 1_000_000)
    us = epoch_us("ts")
    low, high = us - int(before_s * 1_000_000), us + int(after_s * 1_000_000)
    spread = hits.select(*keys, C("id").alias("trigger_id"), low.alias("_low"), high.alias("_high")).withColumn(
        "_cell", F.explode(F.sequence(F.floor(C("_low") / cell), F.floor(C("_high") / cell))))
    placed = samples.withColumn("_us", epoch_us(ts)).withColumn("_cell", F.floor(C("_us") / cell))
    return placed.join(spread, [*keys, "_cell"]).filter(C("_us").between(C("_low"), C("_high"))).drop("_us", "_cell", "_low", "_high")


def best_gain(frames: DataFrame, frequency: str, gain: str) -> DataFrame:
    """Gain with the best mean SNR (mean power over the median of the lower half) per frequency."""
    def snr(p):
        half = F.slice(F.sort_array(p), F.lit(1), F.floor(F.size(p) / 2).cast("int"))
        return 10 * F.log10(X.mean(p) / X.let(half, lambda h: X.sorted_percentile(h, 0.5)))

    scored = frames.select(frequency, gain, X.let(X.power("i", "q"), snr).alias("snr"))
    means = scored.groupBy(frequency, gain).agg(F.avg("snr").alias("snr"))
    return means.groupBy(frequency).agg(F.max_by(gain, F.struct(F.round("snr", 9), -C(gain))).alias("best_gain"), F.max("snr").alias("snr"))
