"""Tracks and sessions of moving emitters."""

from __future__ import annotations

from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from aeroband.functions import geo
from aeroband.functions.timing import epoch_us, instant
from aeroband.operators import ordered
from aeroband.operators.ordered import SEG
from aeroband.session import materialise

C = F.col
STEP_FIELDS = ("_plat", "_plon", "_palt", "_pspeed", "_pus")


def with_steps(messages: DataFrame, keys: list[str], slice_seconds: int = 3600, tie: str = "id") -> DataFrame:
    """Each fix with its predecessor's position, speed and time."""
    return ordered.with_previous(
        messages, keys, ["ts", tie],
        {"_plat": C("latitude"), "_plon": C("longitude"), "_palt": C("altitude"), "_pspeed": C("speed"), "_pus": epoch_us("ts")},
        ordered.time_slice("ts", slice_seconds))


def step_distance() -> Column:
    return F.when(C("_pus").isNotNull(), geo.haversine_m("_plat", "_plon", "latitude", "longitude"))


def step_seconds() -> Column:
    return (epoch_us("ts") - C("_pus")) / 1e6


def kinematics(messages: DataFrame, keys=("uas_id",), slice_seconds: int = 3600) -> DataFrame:
    """Implied ground speed, vertical speed and acceleration of every step."""
    dt = F.nullif(step_seconds(), F.lit(0.0))
    return with_steps(messages, list(keys), slice_seconds).select(
        "*", step_distance().alias("step_m"), step_seconds().alias("step_s"),
        (step_distance() / dt).alias("implied_speed"), ((C("altitude") - C("_palt")) / dt).alias("vertical_speed"),
        ((C("speed") - C("_pspeed")) / dt).alias("acceleration")).drop(*STEP_FIELDS)


def track_summary(messages: DataFrame, keys: list[str], slice_seconds: int = 3600) -> DataFrame:
    """Length, duration, speeds and altitudes; one map-side-combined aggregate after the step join."""
    steps = with_steps(messages, keys, slice_seconds)
    first, last = F.struct("ts", "id"), F.struct("ts", "id")
    return steps.groupBy(*keys).agg(
        F.count("*").alias("points"), F.coalesce(F.sum(step_distance()), F.lit(0.0)).alias("length_m"),
        ((F.max(epoch_us("ts")) - F.min(epoch_us("ts"))) / 1e6).alias("duration_s"),
        F.max("speed").alias("max_speed"), F.avg("speed").alias("mean_speed"),
        F.max("altitude").alias("max_altitude"), F.avg("altitude").alias("mean_altitude"),
        F.min_by("latitude", first).alias("first_lat"), F.min_by("longitude", first).alias("first_lon"),
        F.max_by("latitude", last).alias("last_lat"), F.max_by("longitude", last).alias("last_lon"),
        F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"))


def sessions(messages: DataFrame, gap_seconds: float, key: str = "uas_id", slice_seconds: int = 3600) -> DataFrame:
    return ordered.sessionise(messages, [key], "ts", gap_seconds, slice_seconds, "id")


def session_rows(messages: DataFrame, gap_seconds: float = 300, key: str = "uas_id", slice_seconds: int = 3600) -> DataFrame:
    """One row per session.  Steps never cross a session because the session is part of the key."""
    numbered = sessions(messages, gap_seconds, key, slice_seconds)
    return track_summary(numbered, [key, "session_no"], slice_seconds)


def session_state(session_table: DataFrame, as_of, inactive_after: float = 60, lost_after: float = 300) -> DataFrame:
    """ACTIVE, INACTIVE or LOST by silence at ``as_of``; RECOVERED when a live session follows a lost one."""
    silence = (epoch_us(instant(as_of)) - epoch_us("end_ts")) / 1e6
    state = (F.when(silence > lost_after, "LOST").when(silence > inactive_after, "INACTIVE")
              .when(C("session_no") > 1, "RECOVERED").otherwise("ACTIVE"))
    return session_table.withColumn("state", state)


def interpolate(messages: DataFrame, keys: list[str], step_seconds_: int, slice_seconds: int = 3600) -> DataFrame:
    """Linear positions at whole multiples of the step between consecutive fixes."""
    steps = with_steps(messages, keys, slice_seconds).filter(C("_pus").isNotNull())
    us = step_seconds_ * 1_000_000
    first, last = F.floor(C("_pus") / us) + 1, F.floor((epoch_us("ts") - 1) / us)
    grid = steps.filter(first <= last).withColumn("_g", F.explode(F.sequence(first, last)))
    share = (C("_g") * us - C("_pus")) / (epoch_us("ts") - C("_pus"))

    def blend(a, b):
        return C(a) + (C(b) - C(a)) * share

    return grid.select(*keys, (C("_g") * step_seconds_).alias("epoch_s"), blend("_plat", "latitude").alias("latitude"),
                       blend("_plon", "longitude").alias("longitude"), blend("_palt", "altitude").alias("altitude"))


def newest_points(messages: DataFrame, key: str = "uas_id", n: int = 1000) -> DataFrame:
    """Last ``n`` fixes of each track, thinned per day first so no task sorts a whole hot track."""
    return ordered.top_per_key(messages, [key], [C("ts").desc(), C("id").desc()], n, spread=ordered.time_slice("ts", 86400))


def simplify(messages: DataFrame, tolerance_m: float, key: str = "uas_id", slice_seconds: int = 86400, rounds: int = 8) -> DataFrame:
    """Radial-distance simplification of whole tracks.

    The first point is kept; a later one is kept when it lies at least the tolerance from the
    last kept point.  That point depends on all before it, so slices are folded on trial: first
    each from its own first point, then again from the last point that the slice before it has
    kept, until no slice's last kept point changes.  Once a slice keeps a point that it had kept
    before, all that follows is the same, so few slices change a second time.  Tracks that still
    change after ``rounds`` are folded from end to end, each in one task that holds one point.
    """
    points = messages.select(key, "ts", "id", "latitude", "longitude").withColumn(SEG, ordered.time_slice("ts", slice_seconds))
    points = materialise(points, "simplify-points")
    group, point = [key, SEG], F.struct("latitude", "longitude", "ts", "id")
    last = lambda kept: kept.groupBy(*group).agg(F.max_by(point, F.struct("ts", "id")).alias("leaves"))
    kept = [materialise(_folded(points, group, tolerance_m), "simplify-kept")]
    state = last(kept[0]).select(*group, F.lit(None).cast("struct<latitude:double,longitude:double,ts:timestamp,id:bigint>").alias("enters"), "leaves", F.lit(0).alias("round"))
    state = materialise(state.withColumn("leaves", C("leaves").cast(state.schema["enters"].dataType)), "simplify-state")
    along = Window.partitionBy(key).orderBy(SEG)  # a row a slice
    for turn in range(1, rounds + 2):
        due = state.withColumn("due", F.lag("leaves").over(along))
        changed = materialise(due.filter(~C("due").eqNullSafe(C("enters"))), "simplify-changed")
        if changed.isEmpty() or turn > rounds:
            break
        entries = changed.select(key, C("due.ts").cast(points.schema["ts"].dataType).alias("ts"), C("due.id").alias("id"), C("due.latitude").alias("latitude"), C("due.longitude").alias("longitude"), SEG, F.lit(True).alias("_entry"))
        again = points.join(changed.select(*group), group, "left_semi").withColumn("_entry", F.lit(False))
        kept.append(materialise(_folded(again.unionByName(entries), group, tolerance_m), "simplify-kept"))
        leaves = last(kept[-1]).withColumn("leaves", C("leaves").cast(state.schema["leaves"].dataType))
        new = changed.drop("leaves").join(leaves, group, "left").select(*group, C("due").alias("enters"), F.coalesce("leaves", "due").alias("leaves"), F.lit(turn).alias("round"))
        state = materialise(state.join(changed.select(*group), group, "left_anti").unionByName(new), "simplify-state")
    every = reduce(DataFrame.unionByName, [k.withColumn("round", F.lit(n)) for n, k in enumerate(kept)])
    unsettled = changed.select(key).distinct()
    settled = every.join(state.select(*group, "round"), [*group, "round"], "left_semi").join(unsettled, key, "left_anti")
    whole = _folded(points.join(unsettled, key, "left_semi").withColumn(SEG, F.lit(0).cast("long")), group, tolerance_m)
    return settled.select(key, "ts", "id", "latitude", "longitude").unionByName(whole.select(key, "ts", "id", "latitude", "longitude"))


def _folded(points: DataFrame, group: list[str], tolerance_m: float) -> DataFrame:
    """Kept points of every group; a group's entry row (``_entry``) comes first and is not kept again."""
    key, seg = group
    if "_entry" not in points.columns:
        points = points.withColumn("_entry", F.lit(False))
    rows = points.select(key, "ts", "id", "latitude", "longitude", seg, "_entry").repartition(*group).sortWithinPartitions(*group, C("_entry").desc(), "ts", "id")
    return rows.mapInArrow(partial(_kept_points, tolerance_m=tolerance_m), rows.schema).drop("_entry")


def _kept_points(batches, tolerance_m: float):
    begun, current, lat, lon = False, None, 0.0, 0.0
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist()))
        entry = batch.column(6).to_numpy(zero_copy_only=False)
        lats, lons = (np.radians(batch.column(k).to_numpy(zero_copy_only=False).astype(float)) for k in (3, 4))
        edges = [k for k in range(1, len(keys)) if keys[k] != keys[k - 1]]
        kept = []
        for at, stop in zip([0, *edges], [*edges, len(keys)]):
            if at < stop and (not begun or keys[at] != current):
                begun, current, lat, lon = True, keys[at], lats[at], lons[at]
                if not entry[at]:
                    kept.append(at)
                at += 1
            width = 32
            while at < stop:  # look ahead in growing steps
                end = min(stop, at + width)
                far = np.flatnonzero(geo.haversine_radians_m(lat, lon, lats[at:end], lons[at:end]) >= tolerance_m)
                if len(far):
                    at += int(far[0])
                    lat, lon, width = lats[at], lons[at], 32
                    kept.append(at)
                    at += 1
                else:
                    at, width = at + width, width * 4
        yield batch.take(pa.array(kept, pa.int64()))


def track_of(messages: DataFrame, uas_id: str, start, end) -> DataFrame:
    return messages.filter((C("uas_id") == uas_id) & C("ts").between(instant(start), instant(end))).orderBy("ts", "id")
