"""Time-difference positioning.

An event's measurements (one per receiver pair, a handful) are gathered once into an
array; every solver below is arithmetic over that array in the row, iterations included,
so all events are solved in one pass without joins per step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import arrays as X
from aeroband.session import small_side

C = F.col
LIGHT_M_S = 299792458.0


def distance_difference(tdoa="tdoa_s", flipped: Column | None = None) -> Column:
    """Metres; the sign turns when the pair is listed in reverse."""
    d = X._c(tdoa) * LIGHT_M_S
    return d if flipped is None else F.when(flipped, -d).otherwise(d)


def pair_distances(measurements: DataFrame, receivers: DataFrame) -> DataFrame:
    """Baseline of every receiver pair in use: linear in the measurements, no pair is invented."""
    pairs = measurements.select("array_id", "ref_id", "other_id").distinct()
    ref = receivers.select(C("receiver_id").alias("ref_id"), *[C(c).alias(f"r{c}") for c in "xyz"])
    other = receivers.select(C("receiver_id").alias("other_id"), *[C(c).alias(f"o{c}") for c in "xyz"])
    gap = F.sqrt(sum((C(f"r{c}") - C(f"o{c}")) * (C(f"r{c}") - C(f"o{c}")) for c in "xyz"))
    return pairs.join(ref, "ref_id").join(other, "other_id").select("array_id", "ref_id", "other_id", gap.alias("distance_m"))


def best_reference(measurements: DataFrame) -> DataFrame:
    """Receiver with the highest mean SNR over the pairs it takes part in, per array."""
    ends = measurements.select("array_id", F.explode(F.array("ref_id", "other_id")).alias("receiver_id"), "snr")
    means = ends.groupBy("array_id", "receiver_id").agg(F.avg("snr").alias("mean_snr"))
    return means.groupBy("array_id").agg(
        F.max_by("receiver_id", F.struct("mean_snr", -C("receiver_id"))).alias("receiver_id"), F.max("mean_snr").alias("mean_snr"))


def installations(receivers: DataFrame) -> DataFrame:
    """(array_id, rs): the receivers of each installation, a handful, as one array."""
    return receivers.groupBy("array_id").agg(F.array_sort(F.collect_list(F.struct("receiver_id", "x", "y", "z"))).alias("rs"))


def gathered(measurements: DataFrame, receivers: DataFrame) -> DataFrame:
    """One row per event: reference coordinates and rows ``m`` of (x, y, z, d, w).

    Measurements meet by event, so a busy installation's events are spread over all tasks;
    its receivers come to them as one array and are looked up in the row.
    """
    row = F.struct("other_id", distance_difference().alias("d"), C("quality").alias("w"))
    events = measurements.groupBy("event_id", "array_id", "ref_id").agg(F.collect_list(row).alias("_m"))
    if "array_id" not in receivers.columns:  # then by the measurements they take part in
        used = measurements.select("array_id", F.explode(F.array("ref_id", "other_id")).alias("receiver_id")).distinct()
        receivers = receivers.join(used, "receiver_id")
    placed = events.join(small_side(installations(receivers)), "array_id")
    at = lambda i: F.get(F.filter("rs", lambda r: r["receiver_id"] == i), F.lit(0))
    met = F.transform("_m", lambda r: F.struct(r["other_id"].alias("other_id"), at(r["other_id"]).alias("p"), r["d"].alias("d"), r["w"].alias("w")))
    known = F.filter(met, lambda r: r["p"].isNotNull())
    m = F.transform(known, lambda r: F.struct(r["other_id"].alias("other_id"), *[r["p"][c].alias(c) for c in "xyz"], r["d"].alias("d"), r["w"].alias("w")))
    found = placed.withColumn("_ref", at(C("ref_id"))).filter(C("_ref").isNotNull()).withColumn("m", F.array_sort(m)).filter(F.size("m") > 0)
    return found.select("event_id", "array_id", "ref_id", *[C(f"_ref.{c}").alias(f"r{c}") for c in "xyz"], "m")


def _sum(m: Column, fn) -> Column:
    return F.aggregate(m, F.lit(0.0), lambda s, r: s + fn(r))


def _solve(matrix: list[list[Column]], rhs: list[Column]) -> list[Column]:
    """Determinant ratios of a small symmetric system."""
    det = _det(matrix)
    out = []
    for k in range(len(rhs)):
        swapped = [[rhs[i] if j == k else matrix[i][j] for j in range(len(rhs))] for i in range(len(rhs))]
        out.append(_det(swapped) / F.nullif(det, F.lit(0.0)))
    return out


def _det(m) -> Column:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    total = None
    for k in range(len(m)):
        minor = [[row[j] for j in range(len(m)) if j != k] for row in m[1:]]
        term = m[0][k] * _det(minor)
        total = term if total is None else (total + term if k % 2 == 0 else total - term)
    return total


def _normal(m: Column, design, target, size: int):
    """Weighted normal equations as a struct of sums, bound once."""
    names = [f"a{i}{j}" for i in range(size) for j in range(i, size)] + [f"b{i}" for i in range(size)]

    def parts(r):
        h, t, w = design(r), target(r), r["w"]
        return [h[i] * h[j] * w for i in range(size) for j in range(i, size)] + [h[i] * t * w for i in range(size)]

    zero = F.struct(*[F.lit(0.0).alias(n) for n in names])
    return F.aggregate(m, zero, lambda s, r: F.struct(*[(s[n] + p).alias(n) for n, p in zip(names, parts(r))]))


def _unpack(s: Column, size: int):
    a = [[s[f"a{min(i, j)}{max(i, j)}"] for j in range(size)] for i in range(size)]
    return a, [s[f"b{i}"] for i in range(size)]


def linear_fix(events: DataFrame, dimensions: int = 2) -> DataFrame:
    """Linearised hyperbolic least squares with the reference range as an extra unknown.

    Needs at least ``dimensions + 1`` differences; fewer give null.
    """
    axes = "xyz"[:dimensions]
    size = dimensions + 1

    def design(r):
        return [r[c] - C(f"r{c}") for c in axes] + [r["d"]]

    def target(r):
        return 0.5 * (sum((r[c] - C(f"r{c}")) * (r[c] - C(f"r{c}")) for c in axes) - r["d"] * r["d"])

    def solved(s):
        a, b = _unpack(s, size)
        u = _solve(a, b)
        return F.struct(*[(u[k] + C(f"r{c}")).alias(c) for k, c in enumerate(axes)])

    fix = X.let(_normal(C("m"), design, target, size), solved)
    return events.withColumn("fix", F.when(F.size("m") >= size, fix))


def refine(events: DataFrame, start: Column, dimensions: int = 2, steps: int = 10, tolerance: float = 1e-6) -> DataFrame:
    """Gauss-Newton from ``start``, at most ``steps`` updates, stopped below the tolerance."""
    axes = "xyz"[:dimensions]

    def ranges(p, r):
        own = F.sqrt(sum((p[c] - r[c]) * (p[c] - r[c]) for c in axes))
        ref = F.sqrt(sum((p[c] - C(f"r{c}")) * (p[c] - C(f"r{c}")) for c in axes))
        return own, ref

    def update(p):
        def design(r):
            own, ref = ranges(p, r)
            return [(p[c] - r[c]) / own - (p[c] - C(f"r{c}")) / ref for c in axes]

        def target(r):
            own, ref = ranges(p, r)
            return r["d"] - (own - ref)

        def moved(s):
            a, b = _unpack(s, dimensions)
            delta = _solve(a, b)
            size = F.sqrt(sum(v * v for v in delta))
            bad = size.isNull() | F.isnan(size)
            return F.struct(*[F.when(bad, p[c]).otherwise(p[c] + delta[k]).alias(c) for k, c in enumerate(axes)],
                            (p["steps"] + 1).alias("steps"), (bad | (size < tolerance)).alias("done"))

        return X.let(_normal(C("m"), design, target, dimensions), moved)

    first = F.struct(*[start[c].alias(c) for c in axes], F.lit(0).alias("steps"), F.lit(False).alias("done"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda p, _: F.when(p["done"], p).otherwise(update(p)))
    return events.withColumn("fix", fitted)


def residuals(fixed: DataFrame, dimensions: int = 2) -> DataFrame:
    """Root-mean-square of measured minus computed differences."""
    axes = "xyz"[:dimensions]

    def miss(r):
        own = F.sqrt(sum((C("fix")[c] - r[c]) * (C("fix")[c] - r[c]) for c in axes))
        ref = F.sqrt(sum((C("fix")[c] - C(f"r{c}")) * (C("fix")[c] - C(f"r{c}")) for c in axes))
        return r["d"] - (own - ref)

    return fixed.withColumn("residual_m", F.sqrt(_sum(C("m"), lambda r: miss(r) * miss(r)) / F.size("m")))


def _inverse_diagonal(a) -> list[Column]:
    det = F.nullif(_det(a), F.lit(0.0))
    out = []
    for k in range(len(a)):
        minor = [[a[i][j] for j in range(len(a)) if j != k] for i in range(len(a)) if i != k]
        out.append(_det(minor) / det)
    return out


def dilution(points: DataFrame) -> DataFrame:
    """Geometric, position, horizontal and vertical dilution at (px, py, pz) over receivers ``rs``.

    There is no clock column, so the geometric value equals the position value.
    """
    def design(r):
        d = F.sqrt(sum((C(f"p{c}") - r[c]) * (C(f"p{c}") - r[c]) for c in "xyz"))
        return [F.when(d > 0, (C(f"p{c}") - r[c]) / d).otherwise(0.0) for c in "xyz"]

    def scores(s):
        q = _inverse_diagonal(_unpack(s, 3)[0])
        return F.struct(F.sqrt(q[0] + q[1] + q[2]).alias("gdop"), F.sqrt(q[0] + q[1] + q[2]).alias("pdop"),
                        F.sqrt(q[0] + q[1]).alias("hdop"), F.sqrt(q[2]).alias("vdop"))

    rows = F.transform("rs", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["z"].alias("z"), F.lit(1.0).alias("w")))
    return points.withColumn("dop", X.let(_normal(rows, design, lambda r: F.lit(0.0), 3), scores))


def cramer_rao(events: DataFrame, sigma_m: float) -> DataFrame:
    """Variance bounds of (x, y, z) at the fix from the difference rows."""
    def design(r):
        own = F.sqrt(sum((C(f"p{c}") - r[c]) * (C(f"p{c}") - r[c]) for c in "xyz"))
        ref = F.sqrt(sum((C(f"p{c}") - C(f"r{c}")) * (C(f"p{c}") - C(f"r{c}")) for c in "xyz"))
        return [(r[c] - C(f"p{c}")) / own - (C(f"r{c}") - C(f"p{c}")) / ref for c in "xyz"]

    rows = F.transform("m", lambda r: F.struct(r["x"].alias("x"), r["y"].alias("y"), r["z"].alias("z"), F.lit(1.0).alias("w")))

    def bound(s):
        q = _inverse_diagonal(_unpack(s, 3)[0])
        return F.struct(*[(v * sigma_m**2).alias(f"var_{c}") for v, c in zip(q, "xyz")])

    return events.withColumn("crlb", X.let(_normal(rows, design, lambda r: F.lit(0.0), 3), bound))


def error_ellipse(cxx, cxy, cyy, confidence: float = 0.95) -> Column:
    """Axes and orientation from the closed-form 2x2 eigen decomposition."""
    a, b, d = map(X._c, (cxx, cxy, cyy))
    chi2 = -2 * math.log(1 - confidence)
    mid, half = (a + d) / 2, F.sqrt(F.pow((a - d) / 2, 2) + b * b)
    major, minor = F.sqrt((mid + half) * chi2), F.sqrt(F.greatest(mid - half, F.lit(0.0)) * chi2)
    return F.struct(major.alias("major"), minor.alias("minor"), F.degrees(0.5 * F.atan2(2 * b, a - d)).alias("orientation_deg"),
                    (math.pi * major * minor).alias("area"))


def validate_geometry(receivers: DataFrame) -> DataFrame:
    """At least 3 receivers, the first three not collinear, mean baseline at least 10 m."""
    r = F.struct("receiver_id", "x", "y")
    arrays = receivers.groupBy("array_id").agg(F.array_sort(F.collect_list(r)).alias("rs"))
    a, b, c = (X.at("rs", k) for k in range(3))
    area = 0.5 * F.abs(a["x"] * (b["y"] - c["y"]) + b["x"] * (c["y"] - a["y"]) + c["x"] * (a["y"] - b["y"]))

    def gap(p, q):
        return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))

    gaps = X.let("rs", lambda v: F.filter(F.flatten(F.transform(v, lambda p: F.transform(v, lambda q: gap(p, q)))), lambda g: g > 0))
    out = arrays.select("array_id", F.size("rs").alias("n"), area.alias("area_m2"), X.let(gaps, X.mean).alias("baseline_m"))
    reason = (F.when(C("n") < 3, "too few receivers").when(C("area_m2") < 1.0, "nearly collinear")
               .when(C("baseline_m") < 10, "too close"))
    return out.withColumn("reason", reason).withColumn("valid", C("reason").isNull())


def fix_statistics(fixes: DataFrame) -> DataFrame:
    return fixes.agg(F.count("*").alias("total"), F.count_if("converged").alias("converged"), F.avg("gdop").alias("mean_gdop"),
                     F.avg("residual_m").alias("mean_residual"),
                     (F.avg(F.when(C("converged"), 100.0).otherwise(0.0))).alias("success_percent"))
