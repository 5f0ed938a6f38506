"""Predicates as Columns.  Combine with ``all_of`` / ``any_of`` and pass to ``df.filter``.

Optional bounds that are ``None`` (or neutral) add nothing, so the optimizer sees only
the predicates in force and pushes them to the scan.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions import geo
from aeroband.functions.timing import instant, last
from aeroband.session import small_side


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def all_of(*conds: Column | None) -> Column:
    kept = [c for c in conds if c is not None]
    return functools.reduce(lambda a, b: a & b, kept, F.lit(True)) if kept else F.lit(True)


def any_of(*conds: Column | None) -> Column:
    kept = [c for c in conds if c is not None]
    return functools.reduce(lambda a, b: a | b, kept) if kept else F.lit(True)


def equal(c, value):
    return _c(c) == value


def not_equal(c, value):
    return _c(c) != value


def like(c, pattern: str):
    return _c(c).like(pattern)


def ilike(c, pattern: str):
    return _c(c).ilike(pattern)


def one_of(c, values):
    return _c(c).isin(list(values))


def none_of(c, values):
    return ~_c(c).isin(list(values))


def between(c, low, high):
    return _c(c).between(low, high)


def optional_range(c, low=None, high=None):
    return all_of(None if low is None else _c(c) >= low, None if high is None else _c(c) <= high)


def confidence_between(low: float = 0.0, high: float = 1.0, c="confidence"):
    """Bounds at the ends of the scale are neutral."""
    return optional_range(c, low if low > 0 else None, high if high < 1 else None)


def date_range(c, start, end):
    return _c(c).between(instant(start), instant(end))


def json_equals(c, path: str, value):
    return F.get_json_object(_c(c), path) == F.lit(str(value))


def json_array_contains(c, value, element: str = "string"):
    return F.array_contains(F.from_json(_c(c), f"array<{element}>"), value)


def text_contains(c, fragment: str):
    return _c(c).contains(fragment)


def has_value(c):
    return _c(c).isNotNull()


def known_emitters(confidence="confidence", kind="drone_type"):
    return (_c(confidence) >= 0.8) & (_c(kind) != "unknown")


def active_alerts():
    return ~F.col("acknowledged") & ~F.col("resolved")


def detection_filters(drone_type=None, threat_level=None, min_confidence=0.0, max_confidence=1.0, source=None,
                      has_remote_id=None, in_restricted_zone=None) -> Column:
    return all_of(
        None if drone_type is None else F.col("drone_type") == drone_type,
        None if threat_level is None else F.col("threat_level") == threat_level,
        confidence_between(min_confidence, max_confidence),
        None if source is None else F.col("source") == source,
        None if has_remote_id is None else (
            F.col("remote_id").isNotNull() if has_remote_id else F.col("remote_id").isNull()),
        None if in_restricted_zone is None else F.col("in_restricted_zone") == F.lit(in_restricted_zone),
    )


def alert_filters(severity=None, acknowledged=None, resolved=None, category=None) -> Column:
    return all_of(
        None if severity is None else F.col("severity") == severity,
        None if acknowledged is None else F.col("acknowledged") == F.lit(acknowledged),
        None if resolved is None else F.col("resolved") == F.lit(resolved),
        None if category is None else F.col("category") == category,
    )


def recording_filters(session_id=None, file_format=None, start=None, end=None, min_megabytes=None,
                      as_of=None, recent_days=None) -> Column:
    return all_of(
        None if session_id is None else F.col("session_id") == session_id,
        None if file_format is None else F.col("file_format") == file_format,
        optional_range("start_time", None if start is None else instant(start), None if end is None else instant(end)),
        None if min_megabytes is None else F.col("file_size_bytes") >= int(min_megabytes * 1024 * 1024),
        None if recent_days is None else last("start_time", as_of, recent_days, "DAY"),
    )


def spectrum_filters(min_hz=None, max_hz=None, min_snr=None, linked_only=False, frequency="frequency") -> Column:
    return all_of(
        optional_range(frequency, min_hz, max_hz),
        None if min_snr is None else F.col("snr") >= min_snr,
        F.col("detection_id").isNotNull() if linked_only else None,
    )


# Ordinal scale of threat levels.
THREAT_ORDINALS = {"NONE": 0, "LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}


def threat_ordinal(c) -> Column:
    """Ordinal of a level; the scale is a constant, so no join is needed."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in THREAT_ORDINALS.items() for x in kv]), F.upper(_c(c)))


def at_least_threat(c, minimum: str) -> Column:
    """Membership in the levels at or above the minimum; stays pushable to the scan."""
    return _c(c).isin([k for k, v in THREAT_ORDINALS.items() if v >= THREAT_ORDINALS[minimum]])


def table_view_filter(search="", columns=("id", "drone_type", "remote_id"), threat=None, kind=None, start=None,
                      end=None, min_confidence=None) -> Column:
    term = search.lower()
    hit = any_of(*[F.coalesce(F.lower(F.col(c).cast("string")).contains(term), F.lit(False)) for c in columns])
    return all_of(
        hit if term else None,
        None if threat is None else F.col("threat_level") == threat,
        None if kind is None else F.col("drone_type") == kind,
        optional_range("ts", None if start is None else instant(start), None if end is None else instant(end)),
        None if min_confidence is None else F.coalesce(F.col("confidence"), F.lit(0.0)) >= min_confidence,
    )


def bounding_box(south, west, north, east, lat="latitude", lon="longitude") -> Column:
    return _c(lat).between(south, north) & _c(lon).between(west, east)


def within_radius(lat0: float, lon0: float, km: float, lat="latitude", lon="longitude") -> Column:
    """Great-circle test behind a latitude/longitude box that row-group statistics can prune."""
    south, west, north, east = geo.radius_box(lat0, lon0, km)
    exact = geo.great_circle_km(_c(lat), _c(lon), F.lit(lat0), F.lit(lon0)) <= km
    if west < -180 or east > 180 or south <= -90 or north >= 90:
        return _c(lat).between(south, north) & exact
    return bounding_box(south, west, north, east, lat, lon) & exact


# Signal-strength gates in dBm.
RSSI_RANGE = (-100, -20)
RSSI_FLOORS = {"ble": -90, "wifi": -85}


def rssi_gate(rssi="rssi", transport="transport") -> Column:
    floor = F.when(_c(transport) == "ble", RSSI_FLOORS["ble"]).when(_c(transport) == "wifi", RSSI_FLOORS["wifi"])
    return _c(rssi).between(*RSSI_RANGE) & (_c(rssi) >= F.coalesce(floor, F.lit(RSSI_RANGE[0])))


def message_errors(as_of, max_age_seconds: int = 10, uas="uas_id", ts="ts", lat="latitude", lon="longitude") -> Column:
    """Reasons a telemetry message is invalid; empty when valid."""
    stale = _c(ts) < instant(as_of) - F.expr(f"INTERVAL {max_age_seconds} SECONDS")
    return F.array_compact(F.array(
        F.when(_c(uas).isNull() | (F.trim(_c(uas)) == ""), F.lit("missing_id")),
        F.when(_c(ts).isNull(), F.lit("missing_timestamp")).when(stale, F.lit("stale")),
        F.when(_c(lat).isNull() | _c(lon).isNull(), F.lit("missing_position"))
         .when(~geo.valid_coordinates(_c(lat), _c(lon)), F.lit("invalid_position")),
    ))


def matches_all_terms(terms: str, *columns) -> Column:
    """Every term is a whole token, or a phrase of them, in the row's text.

    A token is a run of letters and digits; a term with other characters between such runs
    (``wi-fi``) is the phrase of its runs, whatever separates them in the text.  A bounded
    search per term stops at the first hit; no token list is built.  Terms without letters
    or digits ask for nothing.
    """
    wanted = {tuple("".join(c if c.isalnum() else " " for c in t).split()) for t in terms.lower().split()}
    text = F.lower(F.concat_ws(" ", *[_c(c).cast("string") for c in columns]))
    return all_of(*[all_of(*[text.contains(p) for p in t], text.rlike(r"(?<![\p{L}\p{N}])" + r"[^\p{L}\p{N}]+".join(t) + r"(?![\p{L}\p{N}])")) for t in sorted(wanted) if t])


def keep_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(small_side(ids.select(on)), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    return df.join(small_side(ids.select(on)), on, "left_anti")
