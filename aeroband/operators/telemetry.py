"""Broadcast identification: packet decoding, filtering and per-emitter views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from aeroband.functions.text import ascii_field, bytes_at, little_endian
from aeroband.functions.timing import epoch_us
from aeroband.operators import ordered
from aeroband.session import small_side

C = F.col

# Message type codes, priorities, per-second limits and company identifiers.
MESSAGE_TYPES = {0: "BASIC_ID", 1: "LOCATION", 2: "AUTHENTICATION", 3: "SELF_ID", 4: "SYSTEM", 5: "OPERATOR_ID"}
PRIORITY = {"BASIC_ID": 1, "LOCATION": 2, "SELF_ID": 3, "SYSTEM": 4, "OPERATOR_ID": 5, "AUTHENTICATION": 6}
RATE_LIMITS = {"BASIC_ID": 1, "LOCATION": 10, "SELF_ID": 1, "SYSTEM": 1, "OPERATOR_ID": 1, "AUTHENTICATION": 1}
MANUFACTURERS = {0x0005: "DJI", 0x0010: "AUTEL", 0x0020: "SKYDIO", 0x0030: "PARROT", 0x0040: "HUBSAN"}

# Field layouts as (name, offset, type, scale).
LAYOUTS = {
    "BASIC_ID": [("uas_id_type", 0, "uint8", 1), ("uas_id", 1, "string20", 1), ("id_type", 21, "uint8", 1)],
    "LOCATION": [
        ("status", 0, "uint8", 1), ("direction", 1, "uint16", 0.01), ("speed_horizontal", 3, "uint16", 0.01),
        ("speed_vertical", 5, "int16", 0.01), ("latitude", 7, "int32", 1e-7), ("longitude", 11, "int32", 1e-7),
        ("altitude_baro", 15, "int32", 0.01), ("altitude_geo", 19, "int32", 0.01), ("height_type", 23, "uint8", 1),
        ("horiz_accuracy", 24, "uint8", 1), ("vert_accuracy", 25, "uint8", 1), ("baro_accuracy", 26, "uint8", 1),
        ("speed_accuracy", 27, "uint8", 1), ("message_time", 28, "uint32", 0.1)],
    "AUTHENTICATION": [
        ("auth_type", 0, "uint8", 1), ("auth_data", 1, "bytes23", 1), ("auth_page", 24, "uint8", 1),
        ("last_page_index", 25, "uint8", 1), ("length", 26, "uint8", 1), ("message_time", 27, "uint32", 0.1)],
    "SELF_ID": [("description_type", 0, "uint8", 1), ("description", 1, "string23", 1)],
    "SYSTEM": [
        ("operator_location_type", 0, "uint8", 1), ("classification_type", 1, "uint8", 1),
        ("operator_latitude", 2, "int32", 1e-7), ("operator_longitude", 6, "int32", 1e-7), ("area_count", 10, "uint16", 1),
        ("area_radius", 12, "uint16", 0.1), ("area_ceiling", 14, "int32", 0.01), ("area_floor", 18, "int32", 0.01),
        ("category", 22, "uint8", 1), ("class", 23, "uint8", 1), ("message_time", 24, "uint32", 0.1)],
    "OPERATOR_ID": [("operator_id_type", 0, "uint8", 1), ("operator_id", 1, "string20", 1)],
    "BLE_FRAME": [
        ("company", 9, "uint16be", 1), ("type_code", 11, "uint8", 1), ("uas_id", 12, "string20", 1), ("latitude", 32, "int32", 1e-7),
        ("longitude", 36, "int32", 1e-7), ("altitude", 40, "int32", 0.01), ("speed", 44, "uint16", 0.01),
        ("heading", 46, "uint16", 0.01), ("message_time", 48, "uint32", 1)],
    "WIFI_BEACON": [("uas_id", 52, "string20", 1), ("latitude", 72, "int32", 1e-7), ("longitude", 76, "int32", 1e-7),
                    ("altitude", 80, "int32", 0.01)],
}
WIDTHS = {"uint8": 1, "uint16": 2, "int16": 2, "uint32": 4, "int32": 4}


def field(payload, offset: int, kind: str, scale: float = 1) -> Column:
    if kind.startswith("string"):
        return ascii_field(payload, offset, int(kind[6:]))
    if kind.startswith("bytes"):
        return bytes_at(payload, offset, int(kind[5:]))
    if kind == "uint16be":
        return F.conv(F.hex(bytes_at(payload, offset, 2)), 16, 10).cast("long")
    value = little_endian(payload, offset, WIDTHS[kind], kind.startswith("int"))
    return value if scale == 1 else value * F.lit(float(scale))


def needed_bytes(layout: str) -> int:
    def width(kind):
        return int(kind.lstrip("stringbye")) if kind[0] in "sb" else WIDTHS.get(kind, 2)
    return max(offset + width(kind) for _, offset, kind, _ in LAYOUTS[layout])


def decode(df: DataFrame, layout: str, payload: str = "payload") -> DataFrame:
    """Fields of one layout; a payload too short for it gives nulls."""
    whole = F.length(C(payload)) >= needed_bytes(layout)
    return df.select("*", *[F.when(whole, field(payload, o, k, s)).alias(n) for n, o, k, s in LAYOUTS[layout]])


def decode_by_type(df: DataFrame, payload: str = "payload", code: str = "type_code") -> DataFrame:
    """Rows of mixed types: a union of all layouts' fields, null where the type has none."""
    names: dict[str, list] = {}
    for number, layout in MESSAGE_TYPES.items():
        for name, offset, kind, scale in LAYOUTS[layout]:
            names.setdefault(name, []).append((number, layout, field(payload, offset, kind, scale)))
    out = []
    for name, parts in names.items():
        value = None
        for number, layout, expr in parts:
            test = (C(code) == number) & (F.length(C(payload)) >= needed_bytes(layout))
            value = F.when(test, expr) if value is None else value.when(test, expr)
        out.append(value.alias(name))
    return df.select(*[c for c in df.columns if c not in names], *out)


def decode_simple(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Fixed-offset frame of at least 30 bytes."""
    p, ok = payload, F.length(C(payload)) >= 30
    return df.select(
        "*", F.when(ok, ascii_field(p, 20, 20)).alias("uas_id"), F.when(ok, little_endian(p, 10, 4, True) * 1e-7).alias("latitude"),
        F.when(ok, little_endian(p, 14, 4, True) * 1e-7).alias("longitude"), F.when(ok, little_endian(p, 18, 2, False)).alias("altitude"))


def decode_worker(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Layout with a 20-byte id at offset 10; fields past the end of the payload are zero."""
    p, n = payload, F.length(C(payload))

    def part(offset, size, signed, divisor, name):
        value = little_endian(p, offset, size, signed) / float(divisor)
        return F.when(n >= offset + size, value).otherwise(0.0).alias(name)

    return df.filter(n >= 20).select(
        "*", F.lower(F.hex(bytes_at(p, 10, 20))).alias("uas_id"), part(30, 4, True, 1e7, "latitude"),
        part(34, 4, True, 1e7, "longitude"), part(38, 2, False, 1, "altitude"), part(40, 2, False, 100, "speed"),
        part(42, 2, False, 100, "heading"))


STANDARD_FIELDS = ("uas_id", "operator_id", "latitude", "longitude", "altitude", "speed", "heading", "vertical_speed",
                   "timestamp", "rssi", "frequency")


def standard_fields(df: DataFrame) -> DataFrame:
    """The published field set; fields the source lacks are null."""
    types = {"uas_id": "string", "operator_id": "string", "timestamp": "timestamp", "rssi": "int"}
    have = set(df.columns)
    return df.select(*[
        C("ts").alias("timestamp") if c == "timestamp" and c not in have and "ts" in have
        else C(c) if c in have else F.lit(None).cast(types.get(c, "double")).alias(c) for c in STANDARD_FIELDS])


def _constant_lookup(mapping: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def manufacturer(company: Column) -> Column:
    return _constant_lookup(MANUFACTURERS, company.cast("int"))


def priority(message_type="message_type") -> Column:
    return _constant_lookup(PRIORITY, C(message_type))


def mark_duplicates(messages: DataFrame, fields: list[str], window_seconds: float = 5, tie: str = "id", slice_seconds: int = 3600) -> DataFrame:
    """Flag a message equal to the previous equal one within the window; signal strength and time are not compared."""
    stepped = ordered.with_previous(messages, fields, ["ts", tie], {"_prev_us": epoch_us("ts")}, ordered.time_slice("ts", slice_seconds))
    near = F.coalesce(epoch_us("ts") - C("_prev_us") <= int(window_seconds * 1_000_000), F.lit(False))
    return stepped.withColumn("is_duplicate", near).drop("_prev_us")


def rate_limited(messages: DataFrame, window_seconds: int = 1, tie: str = "id") -> DataFrame:
    """First n messages per emitter, type and tumbling window; types without a limit all pass."""
    from pyspark.sql import Window
    slot = ordered.time_slice("ts", window_seconds)
    work = messages.withColumn("_slot", slot)
    w = Window.partitionBy("uas_id", "message_type", "_slot").orderBy("ts", tie)
    limit = _constant_lookup(RATE_LIMITS, C("message_type"))
    ranked = work.filter(limit.isNotNull()).withColumn("_r", F.row_number().over(w)).filter(C("_r") <= limit).drop("_slot", "_r")
    return ranked.unionByName(messages.filter(limit.isNull()))


def latest_info(messages: DataFrame, registry: DataFrame) -> DataFrame:
    """Last known position and registry columns of every emitter."""
    newest = ordered.newest_per_key(messages, "uas_id", "ts", "id", ["uas_id", "id", "ts", "latitude", "longitude", "altitude", "operator_id"])
    return newest.join(small_side(registry), "operator_id", "left")
