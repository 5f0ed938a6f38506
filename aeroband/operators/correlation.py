"""Matching radio detections with broadcast telemetry and registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import geo
from aeroband.functions.timing import epoch_us
from aeroband.session import small_side

C = F.col

# Carrier frequencies of broadcast identification (Hz).
RID_BANDS = {"ble": 2.402e9, "ble_38": 2.426e9, "ble_39": 2.480e9, "wifi_24": 2.412e9, "wifi_5": 5.180e9}
BAND_TOLERANCE_HZ = 10e6
#: Distance at which places no longer speak for a match (m).
REACH_M = 1000.0


def nearest_band(frequency: Column) -> Column:
    """Name and distance of the nearest carrier, computed in the row over the constant list."""
    best = F.array_min(F.array(*[F.struct(F.abs(frequency - hz).alias("gap_hz"), F.lit(n).alias("name")) for n, hz in RID_BANDS.items()]))
    return best


def _slotted(detections: DataFrame, messages: DataFrame, us: int) -> tuple[DataFrame, DataFrame]:
    det = detections.select("id", C("latitude").alias("dlat"), C("longitude").alias("dlon"), "frequency", epoch_us("ts").alias("_dus"))
    msg = messages.select(C("id").alias("message_id"), C("latitude").alias("mlat"), C("longitude").alias("mlon"), epoch_us("ts").alias("_mus"))
    home = F.floor(C("_mus") / us)
    return det.withColumn("_slot", F.floor(C("_dus") / us)), msg.withColumn("_slot", F.explode(F.array(home - 1, home, home + 1)))


def _scored(pairs: DataFrame, us: int) -> DataFrame:
    gap = F.abs(C("_dus") - C("_mus"))
    near = F.when(nearest_band(C("frequency"))["gap_hz"] < BAND_TOLERANCE_HZ, 1.0).otherwise(0.0)
    unknown = C("dlat").isNull() | C("mlat").isNull()
    place = F.when(unknown, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - geo.haversine_m("dlat", "dlon", "mlat", "mlon") / REACH_M))
    return pairs.filter(gap < us).select("id", "message_id", gap.alias("gap_us"), ((near + place) / 2).alias("score"))


def candidates(detections: DataFrame, messages: DataFrame, window_ms: int = 500) -> DataFrame:
    """Scored pairs closer than the window.

    Time is cut into buckets of the window's length; a message is listed in its bucket and
    both neighbours, so the range condition becomes an equi-join on the bucket.  Buckets are
    half a second long, which keeps even a hot emitter's load spread over time.
    """
    us = window_ms * 1000
    det, msg = _slotted(detections, messages, us)
    return _scored(det.join(msg, "_slot"), us)


def _axes(lat: str, lon: str) -> list[Column]:
    """A place as metres along three axes; straight distances are no longer than those over ground."""
    a, o = F.radians(lat), F.radians(lon)
    return [F.lit(1000 * geo.EARTH_KM) * c for c in (F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))]


def above(detections: DataFrame, messages: DataFrame, minimum: float, window_ms: int = 500) -> DataFrame:
    """The candidates scored above ``minimum``.

    From a minimum of one half on, only detections near a carrier count, and places at most
    some hundred metres apart, so pairs also share a cell of space: a detection lies in one,
    a message is listed in those within reach, two along each axis at most.  Rows without a
    place meet by time alone.  Crowds at one time and different places never meet.
    """
    if minimum < 0.5:
        return candidates(detections, messages, window_ms).filter(C("score") > minimum)
    us, reach = window_ms * 1000, (2 - 2 * minimum) * REACH_M * 1.001 + 1
    det, msg = _slotted(detections.filter(nearest_band(C("frequency"))["gap_hz"] < BAND_TOLERANCE_HZ), messages, us)
    dplace, mplace = C("dlat").isNotNull(), C("mlat").isNotNull()
    cell = lambda x: F.floor(x / (2 * reach))
    dcells, mcells = det.filter(dplace), msg.filter(mplace)
    for k, (d, m) in enumerate(zip(_axes("dlat", "dlon"), _axes("mlat", "mlon"))):
        dcells = dcells.withColumn(f"_c{k}", cell(d))
        mcells = mcells.withColumn(f"_c{k}", F.explode(F.sequence(cell(m - reach), cell(m + reach))))
    near = dcells.join(mcells, ["_slot", "_c0", "_c1", "_c2"]).drop("_c0", "_c1", "_c2")
    unplaced = det.join(msg.filter(~mplace), "_slot").unionByName(det.filter(~dplace).join(msg.filter(mplace), "_slot"))
    return _scored(near.unionByName(unplaced), us).filter(C("score") > minimum)


def best_matches(detections: DataFrame, messages: DataFrame, minimum: float = 0.7) -> DataFrame:
    """Best message per detection by score, then time, as one combined aggregate."""
    return (above(detections, messages, minimum).groupBy("id")
            .agg(F.max_by(F.struct("message_id", "score"), F.struct("score", -C("gap_us"), -C("message_id"))).alias("b"))
            .select("id", "b.message_id", "b.score"))


def enhance(detections: DataFrame, messages: DataFrame) -> DataFrame:
    """Detections with their best message; a match adds 0.2 confidence, capped at one."""
    joined = detections.join(best_matches(detections, messages), "id", "left")
    bonus = F.when(C("message_id").isNotNull(), 0.2).otherwise(0.0)
    return joined.withColumn("confidence", F.least(F.lit(1.0), C("confidence") + bonus))


def without_message(detections: DataFrame, messages: DataFrame) -> DataFrame:
    return detections.join(best_matches(detections, messages).select("id"), "id", "left_anti")


def unregistered(messages: DataFrame, registry: DataFrame) -> DataFrame:
    return messages.join(small_side(registry.select("operator_id")), "operator_id", "left_anti")


def unauthorised(inside: DataFrame, registry: DataFrame) -> DataFrame:
    """Containment rows whose registered operator may not use the zone."""
    joined = inside.join(small_side(registry.select("operator_id", "allowed_zones")), "operator_id")
    return joined.filter(~F.array_contains("allowed_zones", C("zone_id")))
