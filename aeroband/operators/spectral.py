"""Spectrum measurements on array frames, all in-row."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import arrays as X
from aeroband.operators import peaks as K

C = F.col
TINY = 1e-12


def linear(psd) -> Column:
    return F.transform(X._c(psd), lambda x: F.pow(F.lit(10.0), x / 10))


def frequency(i, f0="f0_hz", df="bin_hz") -> Column:
    return X._c(f0) + i * X._c(df)


# ------------------------------------------------------------------------ noise floors
def floor_percentile(psd, p: float = 0.1) -> Column:
    return X.percentile(psd, p)


def floor_median(psd, f0="f0_hz", df="bin_hz", centre_hz=None, exclude_hz: float = 50e3) -> Column:
    """Median, leaving out bins within ``exclude_hz`` of the centre when one is given."""
    if centre_hz is None:
        return X.median(psd)
    return X.let(psd, lambda v: X.median(F.transform(
        F.filter(X.indices(v), lambda i: F.abs(frequency(i, f0, df) - centre_hz) >= exclude_hz), lambda i: X.at(v, i))))


def floor_mode(psd, buckets: int = 100) -> Column:
    """Left edge of the fullest of equal-width buckets; the lowest wins a tie."""
    def build(v, lo, hi):
        width = (hi - lo) / buckets
        slot = F.transform(v, lambda x: F.least(F.floor((x - lo) / width), F.lit(buckets - 1)).cast("int"))

        def count(s):
            best = F.array_max(F.transform(F.array_distinct(s), lambda b: F.struct(F.size(F.filter(s, lambda y: y == b)).alias("n"), (-b).alias("neg"))))
            return lo - best["neg"] * width

        return F.when(hi == lo, lo).otherwise(X.let(slot, count))

    return X.let(psd, lambda v: X.let(F.array_min(v), lambda lo: X.let(F.array_max(v), lambda hi: build(v, lo, hi))))


def floor_iterative(psd, sigmas: float = 2.5, rounds: int = 5, stop_share: float = 0.1) -> Column:
    """Repeatedly drop values at or above mean + k·σ; stop once under a tenth remains."""
    def build(v):
        start = F.struct(v.alias("v"), F.lit(False).alias("done"))

        def step(s, _):
            kept = X.let(X.mean(s["v"]) + sigmas * X.deviation(s["v"]), lambda t: F.filter(s["v"], lambda x: x < t))
            return F.when(s["done"], s).otherwise(X.let(kept, lambda k: F.struct(k.alias("v"), (F.size(k) < F.size(v) * stop_share).alias("done"))))

        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: X.mean(s["v"]))

    return X.let(psd, build)


def floor_low_quarter(psd) -> Column:
    """Mean of the values below the first quartile, else the minimum."""
    return X.let(psd, lambda v: X.let(X.percentile(v, 0.25), lambda q: F.coalesce(X.mean(F.filter(v, lambda x: x < q)), F.array_min(v))))


def calibrate(frames: DataFrame, psd: str = "psd", margin_db: float = 6.0) -> DataFrame:
    """Noise level over frames: statistics of the 10th percentile and the threshold above it."""
    level = frames.select(floor_percentile(psd).alias("level"))
    return level.agg(F.avg("level").alias("mean"), F.stddev_pop("level").alias("std"), F.min("level").alias("min"), F.max("level").alias("max")).withColumn(
        "threshold", C("mean") + margin_db)


# ----------------------------------------------------------------------- measurements
def parameters(psd, f0="f0_hz", df="bin_hz") -> Column:
    """Peak, floor, SNR, centre, spread, 99 % band, powers, peak-to-mean and moments of a dB spectrum."""
    def build(v, lin):
        n = F.size(v)
        step = X._c(df)
        total = F.aggregate(X.indices(v, 1), F.lit(0.0), lambda s, i: s + (X.at(lin, i) + X.at(lin, i - 1)) / 2 * step)
        peak = X.argmax(v)
        floor = floor_percentile(v)

        def region(base):
            keep = F.filter(X.indices(v), lambda i: X.at(v, i) > base["floor"] + 6)

            def of(idx):
                w = F.transform(idx, lambda i: X.at(lin, i))
                f = F.transform(idx, lambda i: frequency(i, f0, df))
                centre = X.dot(w, f) / X.total(w)
                var = X.let(centre, lambda c: F.aggregate(idx, F.lit(0.0), lambda s, i: s + X.at(lin, i) * F.pow(frequency(i, f0, df) - c, 2)) / X.total(w))
                lo, hi = X.first_reaching(w, 0.005), X.first_reaching(w, 0.995)
                some = F.size(idx) > 0
                return F.struct(
                    base["peak_power"].alias("peak_power"), base["peak_frequency"].alias("peak_frequency"), base["floor"].alias("noise_floor"),
                    (base["peak_power"] - base["floor"]).alias("snr_db"), base["avg_power"].alias("avg_power"),
                    F.when(some, centre).alias("center_frequency"), F.when(some, 2 * F.sqrt(var)).alias("bandwidth"),
                    F.when(some, X.let(f, lambda g: X.at(g, hi) - X.at(g, lo))).alias("occupied_bandwidth"),
                    F.when(some, 10 * F.log10(X.total(w))).alias("signal_power"),
                    F.when(some, base["peak_power"] - base["avg_power"]).alias("peak_to_average"),
                    X.skewness(v).alias("skewness"), X.excess_kurtosis(v).alias("kurtosis"))

            return X.let(keep, of)

        base = F.struct(X.at(v, peak).alias("peak_power"), frequency(peak, f0, df).alias("peak_frequency"), floor.alias("floor"),
                        (10 * F.log10(total / n)).alias("avg_power"))
        return X.let(base, region)

    return X.let(psd, lambda v: X.let(linear(v), lambda lin: build(v, lin)))


def occupied_bandwidth(lin, df="bin_hz", share: float = 0.99) -> Column:
    edge = (1 - share) / 2
    return X.let(lin, lambda v: (X.first_reaching(v, 1 - edge) - X.first_reaching(v, edge)) * X._c(df))


def band_occupancy(psd, df="bin_hz", threshold_db: float = 6.0) -> Column:
    """Occupied width and share, number and width of holes (a hole may end at the last bin)."""
    def build(v):
        level = floor_percentile(v) + threshold_db
        return X.let(X.let(level, lambda t: F.transform(v, lambda x: x > t)), lambda occ: X.let(
            X.runs(F.transform(occ, lambda o: ~o)), lambda holes: F.struct(
                (F.size(v) * X._c(df)).alias("total_hz"), (F.size(F.filter(occ, lambda o: o)) * X._c(df)).alias("occupied_hz"),
                (F.size(F.filter(occ, lambda o: o)) * 100.0 / F.size(v)).alias("occupancy_percent"), F.size(holes).alias("holes"),
                F.coalesce(F.array_max(F.transform(holes, lambda h: (h["last"] - h["first"] + 1) * X._c(df))), F.lit(0.0)).alias("largest_hole_hz"))))

    return X.let(psd, build)


def spectral_regions(psd, f0="f0_hz", df="bin_hz", threshold_db: float = 6.0, close_open: bool = True) -> Column:
    """Contiguous bins above the 10th percentile by the threshold, as frequency intervals."""
    runs = X.let(psd, lambda v: X.let(floor_percentile(v) + threshold_db, lambda t: X.closed_runs(F.transform(v, lambda x: x > t), close_open)))
    return F.transform(runs, lambda r: F.struct(frequency(r["first"], f0, df).alias("start_hz"), frequency(r["last"], f0, df).alias("stop_hz"),
                                                ((r["last"] - r["first"]) * X._c(df)).alias("bandwidth_hz")))


# --------------------------------------------------------------- cluster → video link
def widest_cluster(psd, threshold: Column, gap_bins: Column, minimum: int = 3, density: float = 0.5) -> Column:
    """Widest group of bins above the threshold, gaps up to ``gap_bins`` merged; null when too
    small or too sparse.  The first group wins a tie."""
    def pick(v):
        above = F.filter(X.indices(v), lambda i: X.at(v, i) > threshold)
        return F.array_max(F.transform(X.clusters(above, gap_bins), lambda g: F.struct(
            g["hits"].alias("hits"), (-g["first"]).alias("neg"), g["last"].alias("last"))))

    def accept(best):
        span = best["last"] + best["neg"] + 1
        ok = (best["hits"] >= minimum) & (best["hits"] / span >= density)
        return F.when(ok, F.struct((-best["neg"]).alias("first"), best["last"].alias("last"), best["hits"].alias("hits")))

    return X.let(X.let(psd, pick), accept)


GAP_TOLERANCE_HZ = 300_000.0
MARGIN_DB = 6.0
DC_EXCLUSION_HZ = 50_000.0


def mask_centre(psd, f0, df, centre_hz, exclude_hz: float = DC_EXCLUSION_HZ) -> Column:
    """Bins near the centre pushed far below any threshold."""
    return X.let(psd, lambda v: F.transform(v, lambda x, i: F.when(F.abs(frequency(i, f0, df) - centre_hz) < exclude_hz, F.lit(-999.0)).otherwise(x)))


def cluster_shape(psd, cluster: Column, f0="f0_hz", df="bin_hz") -> Column:
    """Centre, peak, crest, edge drop, gradient and bandwidth of a cluster, rounded as published."""
    def build(v, c):
        part = F.slice(v, c["first"] + 1, c["last"] - c["first"] + 1)

        def of(s):
            n = F.size(s)
            edge = F.greatest(F.lit(1), F.floor(n / 10).cast("int"))
            peak = F.array_max(s)
            left = X.mean(F.slice(s, F.lit(1), edge))
            right = X.mean(F.slice(s, n - edge + 1, edge))
            drop = F.least(peak - left, peak - right)
            width = (n - 1) * X._c(df) / 1e6
            centre = (frequency(c["first"], f0, df) + frequency(c["last"], f0, df)) / 2 / 1e6
            return F.struct(
                F.round(centre, 3).alias("center_mhz"), F.round(peak, 1).alias("peak_db"), F.round(peak - X.mean(s), 1).alias("crest_factor_db"),
                F.round(drop, 1).alias("edge_drop_db"), F.round(F.when(width > 0, drop / (width / 2)).otherwise(0.0), 2).alias("gradient_db_per_mhz"),
                F.round(width, 1).alias("bandwidth_mhz"))

        return X.let(part, of)

    return X.let(psd, lambda v: X.let(cluster, lambda c: F.when(c.isNotNull(), build(v, c))))


ANALOG, DIGITAL = "Analog Video Link", "Digital Video Link"


def classify_cluster(shape: Column) -> Column:
    """Video-link class and confidence from crest factor and edge drop; null when neither fits."""
    def build(s):
        crest, edge, width = s["crest_factor_db"], s["edge_drop_db"], s["bandwidth_mhz"]
        analog = F.least(F.lit(0.95), 0.5 + (crest - 7.0) / 20.0 + (edge - 10.0) / 40.0)
        digital = F.least(F.lit(0.90), 0.5 + (5.0 - crest) / 20.0 + (8.0 - edge) / 40.0)
        return (F.when((crest >= 7.0) & (edge >= 10.0), F.struct(F.lit(ANALOG).alias("drone_type"), F.round(analog, 3).alias("confidence")))
                 .when((crest < 5.0) & (edge < 8.0) & width.between(10.0, 40.0),
                       F.struct(F.lit(DIGITAL).alias("drone_type"), F.round(digital, 3).alias("confidence"))))

    return X.let(shape, build)


# Wireless LAN channel centres in MHz and the alignment tolerance.
WIFI_CHANNELS_MHZ = [2412, 2417, 2422, 2427, 2432, 2437, 2442, 2447, 2452, 2457, 2462, 2467, 2472, 2484]
WIFI_TOLERANCE_MHZ = 3.0


def wifi_channel(center_mhz: Column) -> Column:
    """First channel centre within the tolerance, else null; constants stay in the row."""
    return F.get(F.filter(F.array(*[F.lit(c) for c in WIFI_CHANNELS_MHZ]), lambda c: F.abs(center_mhz - c) <= WIFI_TOLERANCE_MHZ), F.lit(0))


def detect_frames(frames: DataFrame, centre_hz: float, psd: str = "psd", keep=("frame_id",)) -> DataFrame:
    """Spectrum frames to classified detections: floor, cluster, shape, class, channel alignment, threat.

    The whole chain is projections and filters over the scan: no shuffle at any scale.
    """
    from aeroband.operators.rules import threat_by_confidence
    gap = F.greatest(F.lit(1), F.round(F.lit(GAP_TOLERANCE_HZ) / C("bin_hz")).cast("int"))
    nothing = "array<struct<drone_type:string,confidence:double,threat_level:string,frequency_mhz:double,power_db:double,crest_factor_db:double," \
              "edge_drop_db:double,gradient_db_per_mhz:double,bandwidth_mhz:double,wifi_channel_aligned:boolean,wifi_channel_mhz:int,noise_floor:double>>"

    def report(floor, shape, kind, channel):
        confidence = F.when(channel.isNotNull(), F.round(kind["confidence"] * 0.5, 3)).otherwise(kind["confidence"])
        row = X.let(confidence, lambda c: F.struct(
            kind["drone_type"].alias("drone_type"), c.alias("confidence"), threat_by_confidence(c).alias("threat_level"), shape["center_mhz"].alias("frequency_mhz"),
            shape["peak_db"].alias("power_db"), shape["crest_factor_db"].alias("crest_factor_db"), shape["edge_drop_db"].alias("edge_drop_db"),
            shape["gradient_db_per_mhz"].alias("gradient_db_per_mhz"), shape["bandwidth_mhz"].alias("bandwidth_mhz"), channel.isNotNull().alias("wifi_channel_aligned"),
            channel.alias("wifi_channel_mhz"), floor.alias("noise_floor")))
        return F.when(kind.isNotNull(), F.array(row)).otherwise(F.array().cast(nothing))

    def shaped(floor, shape):
        return F.when(shape.isNotNull(), X.let(classify_cluster(shape), lambda kind: X.let(
            wifi_channel(shape["center_mhz"]), lambda ch: report(floor, shape, kind, ch)))).otherwise(F.array().cast(nothing))

    def detect(v):
        return X.let(floor_median(v, centre_hz=centre_hz, exclude_hz=DC_EXCLUSION_HZ), lambda floor: X.let(
            mask_centre(v, "f0_hz", "bin_hz", centre_hz), lambda m: X.let(
                X.let(widest_cluster(m, floor + MARGIN_DB, gap), lambda c: cluster_shape(m, c)), lambda shape: shaped(floor, shape))))

    # One generator per frame: filters between the steps would repeat the work before them.
    return frames.select(*keep, F.inline(X.let(psd, detect)))


# ------------------------------------------------------------------------ interference
def interference(psd, f0="f0_hz", df="bin_hz", baseline=None, threshold_db: float = 10.0) -> Column:
    """Peaks over a baseline (moving median unless given) with type and severity."""
    def build(v, dev):
        found = K.filtered(dev, height=threshold_db, min_prominence=5.0, min_width=1.0)

        def describe(p):
            i = p["bin"]
            region = X.frame_slice(dev, i, 10, 9)
            kind = (F.when(p["width"] < 3, "narrowband").when(p["width"] < 20, "wideband")
                     .when(X.deviation(region) > 5, "impulse").otherwise("intermodulation"))
            return F.struct(i.alias("bin"), frequency(i, f0, df).alias("freq_hz"), X.at(v, i).alias("power"), (p["width"] * X._c(df)).alias("bandwidth_hz"),
                            kind.alias("kind"), F.least(F.lit(1.0), X.at(dev, i) / 30.0).alias("severity"))

        return F.transform(found, describe)

    base = baseline if baseline is not None else (lambda v: K.moving_median(v))
    return X.let(psd, lambda v: X.let(base(v), lambda b: X.let(F.zip_with(v, b, lambda x, y: x - y), lambda dev: build(v, dev))))


def periodicity(series, update_hz: float = 10.0, minimum: int = 10) -> Column:
    """Period from the spacing of the first two autocorrelation peaks at or above 0.3 of the maximum.

    ``series`` is the bounded history of one bin (newest spectra of a waterfall).
    """
    def build(v):
        n = F.size(v)
        auto = F.transform(X.indices(v), lambda k: X.dot(F.slice(v, F.lit(1), n - k), F.slice(v, k + 1, n - k)))

        def peaks(a):
            top = F.array_max(a)
            return F.filter(K.local_maxima(a), lambda i: X.at(a, i) >= 0.3 * top)

        found = X.let(auto, peaks)
        return X.let(found, lambda p: F.when((n >= minimum) & (F.size(p) > 1), (X.at(p, 1) - X.at(p, 0)) / update_hz))

    return X.let(series, build)


def _periods(batches, scale: float, update_hz: float, minimum: int):
    for pdf in batches:
        rows = []
        for band, history in pdf.itertuples(index=False):
            x = np.array([list(r) for r in history], float) * scale  # spectra by bins
            n = len(x)
            lags = np.array([(x[:n - k] * x[k:]).sum(axis=0) for k in range(n)])
            inner = lags[1:-1]
            peak = (inner > lags[:-2]) & (inner > lags[2:]) & (inner >= 0.3 * lags.max(axis=0)) if n > 2 else np.zeros((0, x.shape[1]), bool)
            for b in range(x.shape[1]):
                at = np.flatnonzero(peak[:, b])
                rows.append((band, b, float(at[1] - at[0]) / update_hz if n >= minimum and len(at) > 1 else None))
        yield pd.DataFrame(rows, columns=["band", "bin", "period_s"])


def bin_periods(newest: DataFrame, band: str, order: str, values: str, scale: float = 1.0, update_hz: float = 10.0, minimum: int = 10) -> DataFrame:
    """(band, bin, period_s): ``periodicity`` of every bin of the bounded histories of a waterfall."""
    history = newest.groupBy(band).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, values))), lambda r: r[values]).alias("_history"))  # the waterfall's rows
    kind = newest.schema[band].dataType.simpleString()
    found = history.mapInPandas(partial(_periods, scale=scale, update_hz=update_hz, minimum=minimum), f"band {kind}, bin int, period_s double")
    return found.withColumnRenamed("band", band)


# Channel bands (Hz).
DRONE_BANDS = {"2.4GHz": (2.4e9, 2.4835e9), "5.2GHz": (5.15e9, 5.25e9), "5.8GHz": (5.725e9, 5.875e9)}


def channel_analysis(psd, f0="f0_hz", df="bin_hz") -> Column:
    """Totals, peak, floor, SNR, occupied width, power per band and the strong-band flag."""
    def build(v, floor):
        above = F.filter(X.indices(v), lambda i: X.at(v, i) > floor + 6)

        def band(name, low, high):
            inside = F.filter(X.indices(v), lambda i: frequency(i, f0, df).between(low, high))
            return X.let(inside, lambda p: F.struct(
                F.lit(name).alias("band"), X.total(F.transform(p, lambda i: X.at(v, i))).alias("power"), F.size(p).alias("bins")))

        bands = F.array(*[band(name, *edges) for name, edges in DRONE_BANDS.items()])

        def finish(b):
            seen = F.filter(b, lambda r: r["bins"] > 0)
            return F.struct(
                X.total(v).alias("total_power"), F.array_max(v).alias("peak_power"), frequency(X.argmax(v), f0, df).alias("peak_frequency"), X.mean(v).alias("average_power"),
                floor.alias("noise_floor"), F.when(floor > 0, F.array_max(v) - floor).otherwise(0.0).alias("snr"),
                F.when(F.size(above) > 0, (F.array_max(above) - F.array_min(above)) * X._c(df)).otherwise(0.0).alias("occupied_bandwidth"),
                F.map_from_entries(F.transform(seen, lambda r: F.struct(r["band"], r["power"]))).alias("channel_power"),
                F.exists(seen, lambda r: r["power"] > floor * r["bins"] * 10).alias("interference_detected"))

        return X.let(bands, finish)

    return X.let(psd, lambda v: X.let(floor_percentile(v), lambda floor: build(v, floor)))


# ---------------------------------------------------------------------------- features
def basic_features(psd, threshold_db: float = -60.0, min_distance: int = 5) -> Column:
    def build(v, p):
        powers = F.transform(p, lambda i: X.at(v, i))
        return F.struct(F.size(p).cast("double").alias("peak_count"), X.mean(v).alias("mean_power"), F.array_max(v).alias("max_power"),
                        X.variance(v).alias("power_variance"), X.mean(powers).alias("peak_mean_power"), F.array_max(powers).alias("peak_max_power"))

    return X.let(psd, lambda v: X.let(K.detect(v, threshold_db, min_distance), lambda p: build(v, p)))


def signature_confidence(psd, peaks) -> Column:
    """(mean peak − minimum) / range; zero without peaks."""
    return X.let(psd, lambda v: X.let(peaks(v), lambda p: F.when(F.size(p) == 0, 0.0).otherwise(
        (X.mean(F.transform(p, lambda i: X.at(v, i))) - F.array_min(v)) / (F.array_max(v) - F.array_min(v) + TINY))))


def peak_bandwidth_hz(peaks, df="bin_hz") -> Column:
    return F.when(F.size(peaks) < 2, 0.0).otherwise((F.array_max(peaks) - F.array_min(peaks)) * X._c(df))


def match_signatures(frames: DataFrame, signatures: DataFrame, threshold_db: float, min_distance: int) -> DataFrame:
    """First signature, in catalogue order, whose bandwidth interval holds and whose confidence is met.

    Intervals meet frames through cells of their length class, thinned to those that can be
    first, so the catalogue may grow freely.
    """
    from aeroband.operators.relational import first_match
    found = frames.withColumn("_p", K.detect("psd", threshold_db, min_distance)).filter(F.size("_p") > 0)
    scored = found.select("frame_id", peak_bandwidth_hz(C("_p")).alias("bandwidth"), signature_confidence("psd", lambda v: K.detect(v, threshold_db, min_distance)).alias("confidence"))
    met = first_match(scored, "frame_id", "bandwidth", "confidence", signatures, "min_bandwidth", "max_bandwidth", "min_confidence", "position", ["signature_id"])
    return met.select("frame_id", "signature_id", "bandwidth", "confidence")


def spectral_features(psd, f0="f0_hz", df="bin_hz") -> Column:
    """Twenty features of a linear power density."""
    def build(p, db):
        n = F.size(p)
        step = X._c(df)
        base = F.struct(
            X.total(p).alias("total"), F.array_max(db).alias("top"), X.mean(db).alias("mean"),
            K.filtered(db, min_prominence=5.0, min_width=1.0).alias("pk"),
            (F.aggregate(X.indices(p), F.lit(0.0), lambda s, i: s + X.at(p, i) * frequency(i, f0, df)) / X.total(p)).alias("centroid"),
            floor_low_quarter(db).alias("floor"))

        def of(b):
            main = F.element_at(F.array_sort(F.transform(b["pk"], lambda r: F.struct(r["power"].alias("power"), (-r["bin"]).alias("neg"), r["prominence"].alias("prominence"), r["width"].alias("width")))), -1)
            any_peak = F.size(b["pk"]) > 0
            m = lambda c: F.when(any_peak, main[c]).otherwise(0.0)
            peak_freq = F.when(any_peak, frequency(-main["neg"], f0, df)).otherwise(0.0)
            peak_mag = F.when(any_peak, main["power"]).otherwise(b["top"])
            wide = lambda drop: F.size(F.filter(db, lambda x: x > b["top"] - drop)) * step
            spread = F.sqrt(F.aggregate(X.indices(p), F.lit(0.0), lambda s, i: s + X.at(p, i) * F.pow(frequency(i, f0, df) - b["centroid"], 2)) / b["total"])
            last_f = frequency(n - 1, f0, df)

            def harmonics(at):
                hit = F.transform(F.array(*[F.lit(h) for h in (2, 3, 4, 5)]), lambda h: X.let(F.round((at["f"] * h - X._c(f0)) / step).cast("int"), lambda k: F.when(
                    (k >= 0) & (k < n) & (at["f"] * h < last_f), F.pow(F.lit(10.0), X.at(db, k) / 10)).otherwise(0.0)))
                return F.sqrt(X.total(hit) / F.pow(F.lit(10.0), at["mag"] / 10))

            thd = X.let(F.struct(peak_freq.alias("f"), peak_mag.alias("mag")), harmonics)
            return F.struct(
                peak_freq.alias("peak_freq"), peak_mag.alias("peak_magnitude"), m("width").alias("peak_width"), m("prominence").alias("peak_prominence"),
                b["mean"].alias("power_spectral_density_mean"), X.deviation(db).alias("power_spectral_density_std"), X.skewness(db).alias("power_spectral_density_skew"),
                X.excess_kurtosis(db).alias("power_spectral_density_kurtosis"), wide(3).alias("bandwidth_3db"), wide(6).alias("bandwidth_6db"), wide(20).alias("bandwidth_20db"),
                (frequency(X.first_reaching(p, 0.95), f0, df) / last_f).alias("roll_off_factor"),
                (F.exp(X.mean(F.transform(p, lambda x: F.log(x + TINY)))) / X.mean(p)).alias("spectral_flatness"), b["centroid"].alias("spectral_centroid"),
                spread.alias("spectral_spread"), frequency(X.first_reaching(p, 0.85), f0, df).alias("spectral_rolloff"), b["floor"].alias("noise_floor"),
                (peak_mag - b["floor"]).alias("signal_to_noise_ratio"), (peak_mag - b["mean"]).alias("peak_to_average_power_ratio"), thd.alias("total_harmonic_distortion"))

        return X.let(base, of)

    return X.let(psd, lambda p: X.let(F.transform(p, lambda x: 10 * F.log10(x + TINY)), lambda db: build(p, db)))


def cyclic_features(sample_rate: float, re="re", im="im", candidates: int = 20) -> Column:
    """Top three of the non-zero cycle frequencies with amplitudes, coherence and spacing."""
    from aeroband.operators.iq import spectral_correlation
    spacing = sample_rate / 2 / (candidates - 1)
    n = F.size(X._c(re))

    def score(alpha):
        shift = F.floor(alpha * n / sample_rate).cast("int")
        return F.when((shift >= 1) & (shift < n), F.struct(spectral_correlation(re, im, shift).alias("amplitude"), (-alpha).alias("neg")))

    scored = F.array_compact(F.transform(F.array(*[F.lit(spacing * k) for k in range(1, candidates)]), score))

    def build(s):
        top = [F.get(s, F.lit(k)) for k in range(3)]
        cols = []
        for k in range(3):
            cols += [F.coalesce(-top[2 - k]["neg"], F.lit(0.0)).alias(f"cyclic_frequency_{k + 1}"), F.coalesce(top[2 - k]["amplitude"], F.lit(0.0)).alias(f"cyclic_amplitude_{k + 1}")]
        return F.struct(*cols, F.coalesce(top[0]["amplitude"], F.lit(0.0)).alias("cyclic_coherence"), F.lit(spacing).alias("cycle_frequency_spacing"))

    return X.let(F.sort_array(scored, asc=False), build)


def statistical_features(i="i", q="q") -> Column:
    facts = F.struct(X.amplitude(i, q).alias("a"), X.phase(i, q).alias("p"), X.moments(i).alias("mi"), X.moments(q).alias("mq"))
    return X.let(facts, lambda f: F.struct(
        f["mi"]["mean"].alias("iq_mean_real"), f["mq"]["mean"].alias("iq_mean_imag"), F.sqrt(f["mi"]["var"]).alias("iq_std_real"), F.sqrt(f["mq"]["var"]).alias("iq_std_imag"),
        (f["mi"]["var"] + f["mq"]["var"]).alias("iq_variance"), (f["mi"]["m3"] / F.pow(f["mi"]["var"], 1.5)).alias("iq_skewness"),
        (f["mi"]["m4"] / F.pow(f["mi"]["var"], 2) - 3).alias("iq_kurtosis"), X.variance(f["a"]).alias("amplitude_variance"), X.variance(f["p"]).alias("phase_variance"),
        X.deviation(X.differences(f["p"])).alias("instantaneous_frequency_std")))


def modulation_features(sample_rate: float, carrier_hz, rate, i="i", q="q") -> Column:
    """Index, deviation, symbol rate, carrier offset and error vector against the cycled QPSK points."""
    from aeroband.operators.iq import CONSTELLATIONS, phase_steps
    points, scale = CONSTELLATIONS["QPSK"]

    def unwrapped(steps, first):
        return F.transform(X.indices(steps), lambda k: first + X.total(F.slice(steps, F.lit(1), k + 1)))

    px = F.array(*[F.lit(x / scale) for x, _ in points])
    py = F.array(*[F.lit(y / scale) for _, y in points])

    def build(f):
        a = F.transform(F.slice(f["i"], 1, 100), lambda x: x / f["rms"])
        b = F.transform(F.slice(f["q"], 1, 100), lambda x: x / f["rms"])

        def of(r):
            errors = F.transform(X.indices(r["a"]), lambda k: F.sqrt(F.pow(X.at(r["a"], k) - F.get(px, F.pmod(k, F.lit(4))), 2) + F.pow(X.at(r["b"], k) - F.get(py, F.pmod(k, F.lit(4))), 2)))
            total_phase = F.concat(F.array(f["first"]), unwrapped(f["steps"], f["first"]))
            return F.struct(
                X.deviation(total_phase).alias("modulation_index"), (X.deviation(f["steps"]) * (sample_rate / (2 * math.pi))).alias("frequency_deviation"),
                X._c(rate).alias("symbol_rate"), X._c(carrier_hz).alias("carrier_offset"), X.let(errors, lambda e: F.sqrt(X.mean(F.transform(e, lambda x: x * x)))).alias("evm_rms"),
                F.array_max(errors).alias("evm_peak"), X.deviation(X.phase(r["a"], r["b"])).alias("phase_error_rms"),
                X.deviation(X.amplitude(r["a"], r["b"])).alias("magnitude_error_rms"))

        return X.let(F.struct(a.alias("a"), b.alias("b")), of)

    facts = F.struct(X._c(i).alias("i"), X._c(q).alias("q"), F.sqrt(X.mean(X.power(i, q))).alias("rms"), phase_steps(i, q).alias("steps"),
                     F.atan2(X.at(q, 0), X.at(i, 0)).alias("first"))
    return X.let(facts, build)


def documented_extras(psd, df="bin_hz", bands: int = 8) -> Column:
    """Contrast over eight bands, entropy, peak spread and the central band-power ratio of a linear spectrum."""
    def build(v):
        size = F.floor(F.size(v) / bands).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.sort_array(F.slice(v, k * size + 1, size)))
        usable = F.filter(parts, lambda p: F.size(p) > 10)
        high = F.transform(usable, lambda p: X.mean(F.slice(p, F.size(p) - 4, F.lit(5))))
        low = F.transform(usable, lambda p: X.mean(F.slice(p, F.lit(1), F.lit(5))))
        entropy = X.let(X.total(v) + F.size(v) * TINY, lambda t: F.aggregate(v, F.lit(0.0), lambda s, x: s - (x + TINY) / t * F.log((x + TINY) / t)))
        inside = X.let(X.first_reaching(v, 0.25), lambda a: X.let(X.first_reaching(v, 0.75), lambda b: X.total(F.slice(v, a + 2, b - a)) / X.total(v)))
        return F.struct((X.mean(high) / (X.mean(low) + TINY)).alias("contrast"), entropy.alias("entropy"), inside.alias("band_power_ratio"))

    return X.let(psd, build)


def window_statistics(psd, f0="f0_hz", df="bin_hz") -> Column:
    return X.let(psd, lambda v: F.struct(F.array_max(v).alias("peak"), F.array_min(v).alias("floor"), X.mean(v).alias("average"),
                                         (F.array_max(v) - F.array_min(v)).alias("dynamic_range"), X._c(f0).alias("start_hz"),
                                         (X._c(f0) + (F.size(v) - 1) * X._c(df)).alias("stop_hz")))


def waterfall(frames: DataFrame, band: str, order: str, n: int = 100) -> DataFrame:
    """Newest ``n`` spectra per band, cut per slice of the order first."""
    from aeroband.operators.ordered import top_per_key
    return top_per_key(frames, [band], [C(order).desc()], n, rank="age", spread=F.floor(C(order) / 4096))


def twenty_db_bandwidth(psd, expected_hz: float, df="bin_hz", tolerance: float = 0.1) -> Column:
    """Span of bins within 20 dB of the peak and whether it is the expected width."""
    def build(v):
        span = X.let(F.array_max(v) - 20, lambda t: X.let(F.filter(X.indices(v), lambda i: X.at(v, i) > t), lambda k: (F.array_max(k) - F.array_min(k)) * X._c(df)))
        return X.let(span, lambda s: F.struct(s.alias("measured_hz"), (F.abs(s - expected_hz) < expected_hz * tolerance).alias("valid"), (F.abs(s - expected_hz) / expected_hz * 100).alias("error_percent")))

    return X.let(psd, build)


def similarity(feature_scores: list[Column]) -> Column:
    """Mean of the available scores; 0.5 when there is none."""
    return X.let(F.array_compact(F.array(*feature_scores)), lambda v: F.coalesce(X.mean(v), F.lit(0.5)))


def similarity_confidence(score: Column) -> Column:
    return (F.when(score >= 0.9, 0.95 + (score - 0.9) * 0.5).when(score >= 0.7, 0.7 + (score - 0.7) * 1.25)
             .when(score >= 0.5, 0.5 + (score - 0.5) * 1.0).otherwise(score))


def feature_score(actual: Column, expected: Column, tolerance: float = 0.1) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(actual - expected) / (expected + TINY) / tolerance)


def correlation(a, b) -> Column:
    """Pearson correlation of two equally long arrays."""
    def build(z):
        ma, mb = X.mean(z["a"]), X.mean(z["b"])
        cov = X.let(F.struct(ma.alias("m"), mb.alias("k")), lambda m: X.total(F.zip_with(z["a"], z["b"], lambda x, y: (x - m["m"]) * (y - m["k"]))) / F.size(z["a"]))
        return cov / (X.deviation(z["a"]) * X.deviation(z["b"]))

    return X.let(F.struct(X._c(a).alias("a"), X._c(b).alias("b")), build)
