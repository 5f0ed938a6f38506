"""Per-frame statistics and corrections of complex samples kept as two arrays, all in-row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import arrays as X

C = F.col
TINY = 1e-12


def phase_steps(i, q) -> Column:
    """Wrapped differences of the instantaneous phase."""
    return F.transform(X.differences(X.phase(i, q)), X.wrap_phase)


def raw_phase_steps(i, q) -> Column:
    return X.differences(X.phase(i, q))


def zero_crossing_rate(i, q) -> Column:
    """Sign changes of the phase derivative over its length."""
    def rate(steps):
        signs = F.transform(steps, F.signum)
        turns = X.let(signs, lambda g: F.size(F.filter(X.indices(g, 1), lambda k: X.at(g, k) != X.at(g, k - 1))))
        return turns / F.size(steps)

    return X.let(phase_steps(i, q), rate)


# ------------------------------------------------------------------------ corrections
def remove_dc(a) -> Column:
    return X.let(a, lambda v: X.let(X.mean(v), lambda m: F.transform(v, lambda x: x - m)))


def _replaced(df: DataFrame, i: Column, q: Column) -> DataFrame:
    """Both sample arrays replaced at once: each expression sees the old arrays."""
    out = df.withColumn("_new", F.struct(i.alias("i"), q.alias("q")))
    return out.withColumn("i", C("_new.i")).withColumn("q", C("_new.q")).drop("_new")


def _scaled(df: DataFrame, factor: Column) -> DataFrame:
    """Both arrays times one per-frame factor."""
    both = F.struct(factor.alias("f"), C("i").alias("i"), C("q").alias("q"))
    return df.withColumn("_new", X.let(both, lambda z: F.struct(
        F.transform(z["i"], lambda x: x * z["f"]).alias("i"), F.transform(z["q"], lambda x: x * z["f"]).alias("q")))).withColumn(
        "i", C("_new.i")).withColumn("q", C("_new.q")).drop("_new")


def normalise(df: DataFrame, method: str) -> DataFrame:
    """z_score, min_max (by largest magnitude), robust (median and quartiles), unit (magnitude one)
    or power (mean power one)."""
    def affine(a, centre, scale):
        return X.let(a, lambda v: X.let(F.struct(centre(v).alias("c"), scale(v).alias("s")), lambda p: F.transform(v, lambda x: (x - p["c"]) / p["s"])))

    if method == "z_score":
        return _replaced(df, *[affine(c, X.mean, lambda v: X.deviation(v) + TINY) for c in ("i", "q")])
    if method == "robust":
        spread = lambda v: X.let(F.sort_array(v), lambda s: X.sorted_percentile(s, 0.75) - X.sorted_percentile(s, 0.25)) + TINY
        return _replaced(df, *[affine(c, X.median, spread) for c in ("i", "q")])
    if method == "min_max":
        scale = F.array_max(X.amplitude("i", "q"))
    elif method == "power":
        scale = F.sqrt(X.mean(X.power("i", "q")))
    elif method == "unit":
        norm = lambda a, b, pick: F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), 0.0).otherwise(pick(x, y) / F.sqrt(x * x + y * y)))
        return _replaced(df, norm("i", "q", lambda x, y: x), norm("i", "q", lambda x, y: y))
    else:
        raise ValueError(f"unknown normalisation {method}")
    return _scaled(df, X.let(scale, lambda s: F.when(s > 0, 1 / s).otherwise(1.0)))


def clip_outliers(df: DataFrame, sigmas: float = 5.0) -> DataFrame:
    """Magnitudes above mean + k·σ are pulled back to that radius."""
    limit = X.let(X.amplitude("i", "q"), lambda a: X.mean(a) + sigmas * X.deviation(a))

    def scaled(pick):
        return X.let(limit, lambda top: F.zip_with("i", "q", lambda x, y: X.let(
            F.sqrt(x * x + y * y), lambda m: F.when(m > top, pick(x, y) * top / m).otherwise(pick(x, y)))))

    return _replaced(df, scaled(lambda x, y: x), scaled(lambda x, y: y))


def imbalance(i="i", q="q") -> Column:
    """Gain √(PQ/PI) and phase asin(E[IQ]/√(PI·PQ))."""
    sums = F.struct(X.mean(F.transform(i, lambda x: x * x)).alias("pi"), X.mean(F.transform(q, lambda x: x * x)).alias("pq"),
                    X.mean(F.zip_with(i, q, lambda x, y: x * y)).alias("c"))
    return X.let(sums, lambda s: F.struct(F.sqrt(s["pq"] / s["pi"]).alias("gain"), F.asin(s["c"] / F.sqrt(s["pi"] * s["pq"])).alias("phase")))


def correct_imbalance(df: DataFrame) -> DataFrame:
    fixed = X.let(imbalance(), lambda p: F.struct(
        F.transform("i", lambda x: x * p["gain"]).alias("i"), F.zip_with("i", "q", lambda x, y: y - x * p["gain"] * p["phase"]).alias("q")))
    return df.withColumn("_fixed", fixed).withColumn("i", C("_fixed.i")).withColumn("q", C("_fixed.q")).drop("_fixed")


def correct_imbalance_covariance(df: DataFrame) -> DataFrame:
    """Unit-variance gains and phase −E[IQ]/(σI·σQ)."""
    stats = F.struct(X.deviation("i").alias("si"), X.deviation("q").alias("sq"), X.mean(F.zip_with("i", "q", lambda x, y: x * y)).alias("c"))
    fixed = X.let(stats, lambda s: F.struct(
        F.transform("i", lambda x: x / s["si"]).alias("i"),
        F.zip_with("i", "q", lambda x, y: (y + s["c"] / (s["si"] * s["sq"]) * x) / s["sq"]).alias("q")))
    return df.withColumn("_fixed", fixed).withColumn("i", C("_fixed.i")).withColumn("q", C("_fixed.q")).drop("_fixed")


def rotate(df: DataFrame, offset_hz, sample_rate: float) -> DataFrame:
    """Multiply by exp(−2πj·offset·t)."""
    turn = X._c(offset_hz) * (-2 * math.pi / sample_rate)

    def part(fn):
        return F.transform(X.indices("i"), lambda k: fn(X.at("i", k), X.at("q", k), turn * k))

    return _replaced(df, part(lambda a, b, t: a * F.cos(t) - b * F.sin(t)), part(lambda a, b, t: a * F.sin(t) + b * F.cos(t)))


def auto_scale(df: DataFrame, ceiling: float = 0.95, target: float = 0.9) -> DataFrame:
    """Scale a frame whose peak magnitude passes the ceiling down to the target."""
    factor = X.let(F.array_max(X.amplitude("i", "q")), lambda m: F.when(m > ceiling, target / m).otherwise(1.0))
    return _scaled(df, factor)


def peak_normalise(df: DataFrame) -> DataFrame:
    return normalise(df, "min_max")


def resample_linear(df: DataFrame, rate_in: float, rate_out: float) -> DataFrame:
    """Linear interpolation on the new time grid."""
    count = F.floor(F.size("i") * rate_out / rate_in).cast("int")
    step = rate_in / rate_out

    def grid(c):
        def value(k):
            return X.let(F.least(k * step, (F.size(c) - 1).cast("double")), lambda p: X.let(F.floor(p).cast("int"), lambda b: X.at(c, b) + (
                X.at(c, F.least(b + 1, F.size(c) - 1)) - X.at(c, b)) * (p - b)))
        return F.transform(F.sequence(F.lit(0), count - 1), value)

    return _replaced(df, grid("i"), grid("q"))


# ------------------------------------------------------------------------- statistics
def capture_statistics(i="i", q="q") -> Column:
    """Means, deviations, extremes, powers, crest factor, skew and raw kurtosis."""
    a2 = X.power(i, q)

    def build(p):
        mean_p, max_p = X.mean(p), F.array_max(p)
        return F.struct(
            X.mean(i).alias("mean_i"), X.mean(q).alias("mean_q"), X.deviation(i).alias("std_i"), X.deviation(q).alias("std_q"),
            F.sqrt(max_p).alias("max_abs"), F.sqrt(F.array_min(p)).alias("min_abs"), (10 * F.log10(mean_p + TINY)).alias("mean_power_db"),
            (10 * F.log10(max_p + TINY)).alias("peak_power_db"), (F.sqrt(max_p) / (F.sqrt(mean_p) + TINY)).alias("crest"),
            X.let(X.moments(i), lambda m: m["m3"] / (F.pow(m["var"], 1.5) + TINY)).alias("skewness"),
            X.let(X.moments(i), lambda m: m["m4"] / (m["var"] * m["var"] + TINY)).alias("kurtosis"))

    return X.let(a2, build)


def mean_power_db(i="i", q="q") -> Column:
    return 10 * F.log10(X.mean(X.power(i, q)) + TINY)


def energy_snr_db(i="i", q="q") -> Column:
    """Mean energy over its 10th percentile in dB, not below zero."""
    return X.let(X.power(i, q), lambda p: X.let(X.percentile(p, 0.1), lambda n: F.when(n <= 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), 10 * F.log10(X.mean(p) / n)))))


def percentile_snr_db(i="i", q="q") -> Column:
    """90th minus 10th percentile of sample power in dB."""
    db = F.transform(X.power(i, q), lambda p: 10 * F.log10(p + TINY))
    return X.let(F.sort_array(db), lambda v: X.sorted_percentile(v, 0.9) - X.sorted_percentile(v, 0.1))


def duty_cycle(i="i", q="q", threshold_db: float = 6.0) -> Column:
    """Share of samples whose dB power passes the 25th percentile by the threshold."""
    db = F.transform(X.power(i, q), lambda p: 10 * F.log10(p + TINY))
    return X.let(db, lambda v: X.let(X.percentile(v, 0.25) + threshold_db, lambda t: F.size(F.filter(v, lambda x: x > t)) / F.size(v)))


def bursts(i="i", q="q", sample_rate: float = 2e6, threshold_db: float = 6.0, min_duration_ms: float = 1.0, close_open: bool = False) -> Column:
    """Runs of energy above the 25th percentile by the threshold, long enough; ends are exclusive."""
    def search(p):
        limit = X.percentile(p, 0.25) * (10 ** (threshold_db / 10))
        return X.let(limit, lambda t: X.closed_runs(F.transform(p, lambda x: x > t), close_open))

    found = X.let(X.power(i, q), search)
    long_enough = F.filter(found, lambda r: (r["last"] - r["first"] + 1) / sample_rate * 1000 >= min_duration_ms)
    return F.transform(long_enough, lambda r: F.struct(r["first"].alias("start"), (r["last"] + 1).alias("stop")))


def envelope_bursts(i="i", q="q") -> Column:
    """Mean/deviation/peak of the envelope, bursts above mean + 2σ, duty cycle and the first ten bursts."""
    def build(e):
        runs = X.let(X.mean(e) + 2 * X.deviation(e), lambda t: X.closed_runs(F.transform(e, lambda x: x > t)))
        described = F.transform(runs, lambda r: F.struct(r["first"].alias("start"), (r["last"] + 1).alias("stop"),
                                                         F.array_max(F.slice(e, r["first"] + 1, r["last"] - r["first"] + 1)).alias("peak")))
        return X.let(described, lambda b: F.struct(
            X.mean(e).alias("mean"), X.deviation(e).alias("std"), F.array_max(e).alias("peak"),
            (F.array_max(e) / (X.mean(e) + TINY)).alias("par"), F.size(b).alias("burst_count"),
            (F.aggregate(b, F.lit(0), lambda s, r: s + r["stop"] - r["start"]) / F.size(e)).alias("duty_cycle"), F.slice(b, 1, 10).alias("bursts")))

    return X.let(X.amplitude(i, q), build)


def signal_regions(i="i", q="q", smooth: int = 5, threshold_db: float = 3.0, minimum: int = 2) -> Column:
    """Runs of smoothed energy above its 25th percentile by the threshold.

    The moving sum is divided by the full window everywhere, so energy falls off at the edges.
    """
    before, after = smooth // 2, (smooth - 1) // 2
    energy = X.moving(X.power(i, q), before, after, lambda w: X.total(w) / smooth)
    found = X.let(energy, lambda e: X.let(X.percentile(e, 0.25) * (10 ** (threshold_db / 10)), lambda t: X.closed_runs(F.transform(e, lambda x: x > t))))
    return F.transform(F.filter(found, lambda r: r["last"] - r["first"] + 1 >= minimum),
                       lambda r: F.struct(r["first"].alias("start"), (r["last"] + 1).alias("stop")))


# ------------------------------------------------------------------------- modulation
def lag_correlation(i, q, lag: int) -> Column:
    """Normalised magnitude of Σ x[n]·conj(x[n+lag]); null when the frame is too short."""
    n = F.size(X._c(i))

    def build(z):
        head = lambda c: F.slice(z[c], F.lit(1), n - lag)
        tail = lambda c: F.slice(z[c], F.lit(lag + 1), n - lag)
        re = X.dot(head("i"), tail("i")) + X.dot(head("q"), tail("q"))
        im = X.dot(head("q"), tail("i")) - X.dot(head("i"), tail("q"))
        norm = F.sqrt((X.dot(head("i"), head("i")) + X.dot(head("q"), head("q"))) * (X.dot(tail("i"), tail("i")) + X.dot(tail("q"), tail("q"))))
        return F.when(norm > 0, F.sqrt(re * re + im * im) / norm)

    return F.when(n > lag, X.let(F.struct(X._c(i).alias("i"), X._c(q).alias("q")), build))


# Prefix lengths tried, in order.
PREFIX_LAGS = (16, 32, 64, 128, 256)


def cyclic_prefix(i="i", q="q", lags=PREFIX_LAGS, minimum: float = 0.3) -> Column:
    """First lag whose correlation passes the limit, else zero."""
    return F.coalesce(*[F.when(lag_correlation(i, q, k) > minimum, k) for k in lags], F.lit(0))


def classify_modulation(i="i", q="q", prefix=None, family=None) -> Column:
    """Rule tree over envelope variance, phase variance and distinct amplitude levels."""
    amp = X.amplitude(i, q)
    facts = F.struct(
        X.let(amp, lambda a: X.variance(a) / F.pow(X.mean(a), 2)).alias("av"), X.variance(raw_phase_steps(i, q)).alias("pv"),
        F.size(F.array_distinct(F.transform(amp, lambda a: F.round(a, 2)))).alias("levels"),
        (prefix if prefix is not None else cyclic_prefix(i, q)).alias("cp"),
        (family if family is not None else F.lit("")).alias("family"))

    def label(name, confidence):
        return F.struct(F.lit(name).alias("modulation"), F.lit(confidence).alias("confidence"))

    return X.let(facts, lambda f: F.when(f["av"] < 0.1, F.when(f["pv"] < 0.1, label("GMSK", 0.7)).otherwise(label("FM", 0.6)))
                 .when(f["levels"] <= 2, label("BPSK", 0.8)).when(f["levels"] <= 4, label("QPSK", 0.7))
                 .when(f["levels"] <= 16, label("QAM16", 0.6)).when(f["levels"] <= 64, label("QAM64", 0.5))
                 .when(f["cp"] > 0, label("OFDM", 0.75)).when(f["family"] == "DJI", label("DRONE_DJI", 0.85))
                 .when(f["family"] == "FPV", label("DRONE_FPV", 0.8)).otherwise(label("UNKNOWN", 0.3)))


def emitter_family(bandwidth_hz, i="i", q="q", prefix=None) -> Column:
    """Prefix 64 with 10-20 MHz is one family, phase-step deviation within (0.5, 2) another."""
    cp = prefix if prefix is not None else cyclic_prefix(i, q)
    wide = (X._c(bandwidth_hz) > 10e6) & (X._c(bandwidth_hz) < 20e6)
    spread = X.deviation(raw_phase_steps(i, q))
    return F.when((cp == 64) & wide, "DJI").when((spread > 0.5) & (spread < 2.0), "FPV").otherwise("")


def spectral_correlation(re, im, shift) -> Column:
    """|mean of X[k]·conj(X[k−shift])| with circular shift."""
    def build(z):
        n = F.size(z["re"])
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))

        def step(s, k):
            return X.let(F.pmod(k - shift, n), lambda j: F.struct(
                (s["a"] + X.at(z["re"], k) * X.at(z["re"], j) + X.at(z["im"], k) * X.at(z["im"], j)).alias("a"),
                (s["b"] + X.at(z["im"], k) * X.at(z["re"], j) - X.at(z["re"], k) * X.at(z["im"], j)).alias("b")))

        return F.aggregate(X.indices(z["re"]), zero, step, lambda s: F.sqrt(s["a"] * s["a"] + s["b"] * s["b"]) / n)

    return X.let(F.struct(X._c(re).alias("re"), X._c(im).alias("im")), build)


def symbol_rate(sample_rate: float, re="re", im="im", minimum: float = 0.1, candidates: int = 20) -> Column:
    """Median of the candidate rates whose spectral correlation passes the limit, else zero."""
    low, high = sample_rate / 1000, sample_rate / 10
    rates = [low + (high - low) * k / (candidates - 1) for k in range(candidates)]
    n = F.size(X._c(re))

    def score(rate):
        shift = F.floor(rate * n / sample_rate).cast("int")
        ok = (shift >= 1) & (shift < n)
        return F.when(ok, spectral_correlation(re, im, shift)).otherwise(0.0)

    kept = F.filter(F.array(*[F.lit(r) for r in rates]), lambda r: score(r) > minimum)
    return X.let(kept, lambda v: F.when(F.size(v) > 0, X.median(v)).otherwise(0.0))


def fourth_power(df: DataFrame) -> DataFrame:
    """x⁴ as arrays ``i4`` and ``q4`` for the carrier-offset spectrum."""
    def part(pick):
        return F.zip_with("i", "q", lambda a, b: X.let(F.struct((a * a - b * b).alias("r"), (2 * a * b).alias("m")), lambda s: pick(s)))

    return df.withColumns({"i4": part(lambda s: s["r"] * s["r"] - s["m"] * s["m"]), "q4": part(lambda s: 2 * s["r"] * s["m"])})


def carrier_offset(sample_rate: float, re="re", im="im") -> Column:
    """Quarter of the strongest non-negative frequency of the (shifted) fourth-power spectrum."""
    power = F.zip_with(re, im, lambda a, b: a * a + b * b)
    upper = X.let(power, lambda p: X.argmax(F.slice(p, (F.floor(F.size(p) / 2) + 1).cast("int"), (F.size(p) - F.floor(F.size(p) / 2)).cast("int"))))
    return upper * sample_rate / F.size(X._c(re)) / 4


# Ideal constellations before scaling, and the scale.
CONSTELLATIONS = {
    "BPSK": ([(1, 0), (-1, 0)], 1.0),
    "QPSK": ([(1, 1), (1, -1), (-1, 1), (-1, -1)], math.sqrt(2)),
    "QAM16": ([(a, b) for a in (-3, -1, 1, 3) for b in (-3, -1, 1, 3)], math.sqrt(10)),
}


def error_vector(kind: str, i="i", q="q") -> Column:
    """RMS distance to the nearest ideal point after power normalisation; 0.3 when unknown."""
    if kind not in CONSTELLATIONS:
        return F.lit(0.3)
    points, scale = CONSTELLATIONS[kind]
    nearest = lambda a, b: F.array_min(F.array(*[F.pow(a - x / scale, 2) + F.pow(b - y / scale, 2) for x, y in points]))
    squared = X.let(F.sqrt(X.mean(X.power(i, q))), lambda s: F.zip_with(i, q, lambda a, b: nearest(a / s, b / s)))
    return F.sqrt(X.mean(squared))


def doppler_hz(sample_rate: float, reference_hz: float, i="i", q="q") -> Column:
    return X.mean(phase_steps(i, q)) * sample_rate / (2 * math.pi) - reference_hz


def multipath_delay_s(sample_rate: float, i="i", q="q") -> Column:
    """First lag where the real autocorrelation falls below a tenth of its value at zero."""
    def build(z):
        n = F.size(z["i"])

        def real(k):
            return X.dot(F.slice(z["i"], k + 1, n - k), F.slice(z["i"], F.lit(1), n - k)) + X.dot(F.slice(z["q"], k + 1, n - k), F.slice(z["q"], F.lit(1), n - k))

        base = X.dot(z["i"], z["i"]) + X.dot(z["q"], z["q"])
        low = X.let(base, lambda b: F.filter(X.indices(z["i"]), lambda k: (b > 0) & (real(k) < 0.1 * b)))
        return F.coalesce(F.array_min(low) / sample_rate, F.lit(0.0))

    return X.let(F.struct(X._c(i).alias("i"), X._c(q).alias("q")), build)


def fingerprint(i="i", q="q") -> Column:
    """Phase noise, imbalance, amplitude variation, cubic ratio and kurtoses."""
    facts = F.struct(phase_steps(i, q).alias("steps"), X.amplitude(i, q).alias("amp"))

    def build(f):
        p2 = X.mean(F.transform(f["amp"], lambda a: a * a))
        p6 = X.mean(F.transform(f["amp"], lambda a: F.pow(a, 6)))
        return F.struct(
            X.deviation(f["steps"]).alias("phase_noise_std"), F.array_max(F.transform(f["steps"], F.abs)).alias("phase_noise_max"),
            (20 * F.log10(F.abs(X.mean(i) / (X.mean(q) + TINY)))).alias("imbalance_db"), (X.deviation(f["amp"]) / X.mean(f["amp"])).alias("amplitude_variation"),
            (10 * F.log10(p6 / (p2 + TINY))).alias("cubic_ratio_db"), X.excess_kurtosis(f["amp"]).alias("amplitude_kurtosis"),
            X.excess_kurtosis(f["steps"]).alias("phase_kurtosis"))

    return X.let(facts, build)


def cumulants(i="i", q="q") -> Column:
    """Magnitudes of the second- and fourth-order cumulants C20, C21, C40, C41, C42."""
    def mean_of(fn):
        return X.mean(F.zip_with(i, q, fn))

    m = F.struct(
        mean_of(lambda a, b: a * a - b * b).alias("r20"), mean_of(lambda a, b: 2 * a * b).alias("i20"), mean_of(lambda a, b: a * a + b * b).alias("m21"),
        mean_of(lambda a, b: F.pow(a * a - b * b, 2) - F.pow(2 * a * b, 2)).alias("r40"), mean_of(lambda a, b: 2 * (a * a - b * b) * 2 * a * b).alias("i40"),
        mean_of(lambda a, b: (a * a + b * b) * a).alias("r41"), mean_of(lambda a, b: (a * a + b * b) * b).alias("i41"),
        mean_of(lambda a, b: F.pow(a * a + b * b, 2)).alias("m42"))

    def build(s):
        c40r = s["r40"] - 3 * (s["r20"] * s["r20"] - s["i20"] * s["i20"])
        c40i = s["i40"] - 6 * s["r20"] * s["i20"]
        c41r, c41i = s["r41"] - 3 * s["r20"] * s["m21"], s["i41"] - 3 * s["i20"] * s["m21"]
        return F.struct(F.hypot(s["r20"], s["i20"]).alias("c20"), s["m21"].alias("c21"), F.hypot(c40r, c40i).alias("c40"), F.hypot(c41r, c41i).alias("c41"),
                        (s["m42"] - (s["r20"] * s["r20"] + s["i20"] * s["i20"]) - 2 * s["m21"] * s["m21"]).alias("c42"))

    return X.let(m, build)


def modulation_extras(sample_rate: float, i="i", q="q") -> Column:
    facts = F.struct(X.amplitude(i, q).alias("amp"), X.phase(i, q).alias("ph"), phase_steps(i, q).alias("st"))
    hz = sample_rate / (2 * math.pi)
    return X.let(facts, lambda f: F.struct(
        (F.array_max(F.transform(X.differences(f["amp"]), F.abs)) / X.mean(f["amp"])).alias("gamma_max"), X.deviation(f["ph"]).alias("sigma_ap"),
        (X.deviation(f["amp"]) / X.mean(f["amp"])).alias("sigma_aa"), (X.deviation(f["st"]) * hz).alias("sigma_af"), (X.mean(f["st"]) * hz).alias("freq_centroid")))


def reference_error_percent(samples: DataFrame, reference: DataFrame, keys=("frame_id", "n")) -> DataFrame:
    """RMS error over RMS reference in percent per frame; samples meet their reference on (frame, index)."""
    r = reference.select(*keys, C("i").alias("ri"), C("q").alias("rq"))
    joined = samples.join(r, list(keys))
    error = F.avg(F.pow(C("i") - C("ri"), 2) + F.pow(C("q") - C("rq"), 2))
    return joined.groupBy(keys[0]).agg((F.sqrt(error / F.avg(C("ri") * C("ri") + C("rq") * C("rq"))) * 100).alias("evm_percent"))


def lagged_products(df: DataFrame, key: str, t: str, value: str, lags: list[int]) -> DataFrame:
    """Σ x[t]·x[t+lag] per key and lag by an equi-join on the shifted index."""
    shifted = df.select(key, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), C(t).alias("_t"), C(value).alias("_y"))
    shifted = shifted.select(key, "lag", (C("_t") - C("lag")).alias(t), "_y")
    return df.join(shifted, [key, t]).groupBy(key, "lag").agg(F.sum(C(value) * C("_y")).alias("correlation"))


def lagged_products_of_bins(df: DataFrame, key: str, t: str, values: str, lags: list[int], bins: int) -> DataFrame:
    """Σ x[t]·x[t+lag] per key, lag and bin of the array ``values``.

    Arrays meet whole, one row for each frame and lag; the sums of all bins are partial
    aggregates of one pass, and only they are taken apart.
    """
    shifted = df.select(key, F.explode(F.array(*[F.lit(k) for k in lags])).alias("lag"), C(t).alias("_t"), C(values).alias("_y"))
    shifted = shifted.select(key, "lag", (C("_t") - C("lag")).alias(t), "_y")
    sums = [F.sum(F.get(C(values), F.lit(b)) * F.get(C("_y"), F.lit(b))).alias(f"_{b}") for b in range(bins)]
    summed = df.join(shifted, [key, t]).groupBy(key, "lag").agg(*sums)
    return summed.select(key, "lag", F.posexplode(F.array(*[f"_{b}" for b in range(bins)])).alias("bin", "correlation")).filter("correlation is not null")
