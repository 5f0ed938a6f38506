"""Peak finding on array spectra, all in-row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import arrays as X


def local_maxima(psd, threshold=None) -> Column:
    """Interior positions above both neighbours and the threshold.

    The threshold is a number, a Column, or a one-tuple holding a function from the
    spectrum to an array of per-bin thresholds.
    """
    def keep(v, i, level):
        test = (X.at(v, i) > X.at(v, i - 1)) & (X.at(v, i) > X.at(v, i + 1))
        return test if level is None else test & (X.at(v, i) > level(i))

    def search(v):
        if isinstance(threshold, tuple):
            return X.let(threshold[0](v), lambda t: F.filter(X.indices(v, 1, 1), lambda i: keep(v, i, lambda k: X.at(t, k))))
        level = None if threshold is None else (lambda k: threshold if isinstance(threshold, Column) else F.lit(threshold))
        return F.filter(X.indices(v, 1, 1), lambda i: keep(v, i, level))

    return X.let(psd, search)


def thin_keep_highest(candidates, psd, distance: int) -> Column:
    """Left to right: a candidate close to the last kept one replaces it if higher, else is dropped."""
    def fold(v):
        def step(kept, i):
            last = F.element_at(kept, -1)
            near = (F.size(kept) > 0) & (i - last < distance)
            replaced = F.concat(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))), F.array(i))
            return (F.when(~near, F.concat(kept, F.array(i)))
                     .when(X.at(v, i) > X.at(v, last), replaced).otherwise(kept))

        return F.aggregate(candidates if isinstance(candidates, Column) else candidates(v), F.array().cast("array<int>"), step)

    return X.let(psd, fold)


def thin_first_wins(candidates, distance: int) -> Column:
    def step(kept, i):
        far = (F.size(kept) == 0) | (i - F.element_at(kept, -1) >= distance)
        return F.when(far, F.concat(kept, F.array(i))).otherwise(kept)

    return F.aggregate(candidates, F.array().cast("array<int>"), step)


def detect(psd, threshold_db: float = -60.0, min_distance: int = 5) -> Column:
    return thin_keep_highest(lambda v: local_maxima(v, threshold_db), psd, min_distance)


def adaptive(psd, offset_db: float) -> Column:
    """Local maxima above the half-open 21-bin moving mean plus an offset."""
    return local_maxima(psd, (lambda v: F.transform(X.moving(v, 10, 9, X.mean), lambda x: x + offset_db),))


def moving_median(psd, width: int = 51) -> Column:
    half = width // 2
    return X.moving(psd, half, half, X.median)


def median_sigma_threshold(psd, sensitivity: float = 2.0, width: int = 51) -> Column:
    """Median plus k population deviations over the half-open window ``[i-25, i+25)``."""
    half = width // 2
    return X.moving(psd, half, half - 1, lambda w: X.median(w) + sensitivity * X.deviation(w))


def prominence(psd, i) -> Column:
    """Height over the higher of the two side minima, each taken up to the next higher bin."""
    def measure(v, here):
        n = F.size(v)
        idx = X.indices(v)
        higher_left = F.array_max(F.filter(idx, lambda j: (j < i) & (X.at(v, j) > here)))
        higher_right = F.array_min(F.filter(idx, lambda j: (j > i) & (X.at(v, j) > here)))
        left_from = F.coalesce(higher_left + 1, F.lit(0))
        right_to = F.coalesce(higher_right - 1, n - 1)
        left_min = F.array_min(F.slice(v, left_from + 1, i - left_from + 1))
        right_min = F.array_min(F.slice(v, i + 1, right_to - i + 1))
        return here - F.greatest(left_min, right_min)

    return X.let(psd, lambda v: X.let(X.at(v, i), lambda here: measure(v, here)))


def crossing_width(psd, i, level) -> Column:
    """Interpolated width in bins between the crossings of ``level`` around a peak."""
    def measure(v, lv):
        n, idx = F.size(v), X.indices(v)

        def blend(outer, inner):
            return (lv - X.at(v, outer)) / (X.at(v, inner) - X.at(v, outer))

        left = F.array_max(F.filter(idx, lambda j: (j < i) & (X.at(v, j) <= lv)))
        right = F.array_min(F.filter(idx, lambda j: (j > i) & (X.at(v, j) <= lv)))
        lo = X.let(left, lambda k: F.when(k.isNull(), F.lit(0.0)).otherwise(k + blend(k, k + 1)))
        hi = X.let(right, lambda k: F.when(k.isNull(), (n - 1).cast("double")).otherwise(k - blend(k, k - 1)))
        return hi - lo

    return X.let(psd, lambda v: X.let(level, lambda lv: measure(v, lv)))


def filtered(psd, height=None, distance: int = 1, min_prominence: float = 0.0, min_width: float = 0.0) -> Column:
    """Peaks with height, distance, prominence and half-prominence width, as structs."""
    def search(v):
        base = local_maxima(v)
        if height is not None:
            base = F.filter(base, lambda i: X.at(v, i) >= height)
        spaced = base if distance <= 1 else thin_by_height(base, v, distance)
        described = F.transform(spaced, lambda i: F.struct(i.alias("bin"), X.at(v, i).alias("power"), prominence(v, i).alias("prominence")))
        widened = F.transform(described, lambda p: F.struct(
            p["bin"].alias("bin"), p["power"].alias("power"), p["prominence"].alias("prominence"),
            crossing_width(v, p["bin"], p["power"] - p["prominence"] / 2).alias("width")))
        return F.filter(widened, lambda p: (p["prominence"] >= min_prominence) & (p["width"] >= min_width))

    return X.let(psd, search)


def thin_by_height(candidates, psd, distance: int) -> Column:
    """Keep candidates in falling height, dropping those within ``distance`` of one already kept."""
    ranked = F.array_sort(F.transform(candidates, lambda i: F.struct((-X.at(psd, i)).alias("h"), (-i).alias("i"))))

    def step(kept, s):
        i = -s["i"]
        clash = F.exists(kept, lambda k: F.abs(k - i) < distance)
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(i)))

    return F.array_sort(F.aggregate(ranked, F.array().cast("array<int>"), step))


def characterise(psd, i, bin_hz: float) -> Column:
    """-3 dB walk, 0.5 % energy walk and edge contrast of one peak."""
    return X.let(psd, lambda v: _characterise(v, i, bin_hz))


def _characterise(psd: Column, i: Column, bin_hz: float) -> Column:
    n = F.size(psd)
    here = X.at(psd, i)
    low = here - 3
    left = F.coalesce(F.array_max(F.filter(X.indices(psd), lambda j: (j <= i) & (X.at(psd, j) <= low))), F.lit(0))
    right = F.coalesce(F.array_min(F.filter(X.indices(psd), lambda j: (j >= i) & (X.at(psd, j) <= low))), n - 1)
    def reach(values):
        return X.let(X.total(psd), lambda energy: reach_of(values, energy))

    def reach_of(values, energy):
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(-1).alias("hit"))

        def step(st, x):
            s = st["s"] + x
            return F.struct(s.alias("s"), (st["k"] + 1).alias("k"),
                            F.when((st["hit"] < 0) & (s / energy > 0.005), st["k"]).otherwise(st["hit"]).alias("hit"))

        return F.aggregate(values, start, step, lambda st: st["hit"])

    back = reach(F.reverse(F.slice(psd, F.lit(1), i + 1)))
    fore = reach(F.slice(psd, i + 1, n - i))
    left99 = F.when(back < 0, 0).otherwise(i - back)
    right99 = F.when(fore < 0, n - 1).otherwise(i + fore)
    edges = (X.at(psd, i - 5) + X.at(psd, i + 5)) / 2
    return F.struct(i.alias("bin"), here.alias("power"), ((right - left) * bin_hz).alias("bandwidth_3db"),
                    ((right99 - left99) * bin_hz).alias("occupied_bandwidth"), (right - left).alias("width_bins"),
                    (here - edges).alias("edge_contrast"))


def explode_peaks(df: DataFrame, peaks: Column, *keep: str) -> DataFrame:
    return df.select(*keep, F.inline(peaks))
