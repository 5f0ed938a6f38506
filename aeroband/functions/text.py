"""Binary fields, packed lists, topic patterns and identifier checks as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def bytes_at(payload, offset, size: int) -> Column:
    """Bytes ``offset … offset+size-1`` (zero-based offset)."""
    start = offset + 1 if isinstance(offset, int) else offset + F.lit(1)
    return F.substring(_c(payload), F.lit(start) if isinstance(start, int) else start, F.lit(size))


def little_endian(payload, offset, size: int, signed: bool) -> Column:
    """Integer of 1-4 bytes, least significant byte first."""
    raw = F.hex(bytes_at(payload, offset, size))
    turned = F.concat(*[F.substring(raw, 2 * k + 1, 2) for k in range(size - 1, -1, -1)])
    value = F.conv(turned, 16, 10).cast("long")
    if not signed:
        return value
    return F.when(value >= 1 << (8 * size - 1), value - (1 << (8 * size))).otherwise(value)


def to_little_endian(value, size: int) -> Column:
    raw = F.lpad(F.hex(_c(value).cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(raw, 17 - 2 * k, 2) for k in range(1, size + 1)]))


def ascii_field(payload, offset, size: int) -> Column:
    """Fixed-width text: bytes above 127 are dropped, trailing NULs and blanks trimmed."""
    latin = F.decode(bytes_at(payload, offset, size), "ISO-8859-1")
    return F.rtrim(F.regexp_replace(F.regexp_replace(latin, r"[^\x00-\x7f]", ""), r"\x00+$", ""))


def to_ascii_field(value, size: int) -> Column:
    text = F.encode(F.substring(_c(value), 1, size), "US-ASCII")
    return F.unhex(F.rpad(F.hex(text), 2 * size, "0"))


def pack_numbers(a) -> Column:
    return F.array_join(F.transform(_c(a), lambda x: x.cast("string")), ",")


def parse_numbers(c) -> Column:
    return F.transform(F.filter(F.split(_c(c), ","), lambda x: F.trim(x) != ""), lambda x: x.cast("double"))


def topic_pattern(pattern: str) -> str:
    """Regex for ``+`` (one level), ``#`` (this level and below) and a trailing ``*`` (prefix)."""
    if pattern == "#":
        return "^.*$"
    if pattern.endswith("*") and "/" not in pattern[-2:]:
        return "^" + re.escape(pattern[:-1]) + ".*$"
    tail = ""
    if pattern.endswith("/#"):
        pattern, tail = pattern[:-2], "(/.*)?"
    return "^" + "/".join("[^/]+" if p == "+" else re.escape(p) for p in pattern.split("/")) + tail + "$"


def topic_matches(topic, pattern: str) -> Column:
    return _c(topic).rlike(topic_pattern(pattern))


# What a broadcast identifier may look like.
IDENTIFIER_PATTERN = r"^[A-Z0-9][A-Z0-9-]{3,19}$"


def suspicious_identifier(c) -> Column:
    """Wrong alphabet or length, or one character repeated throughout."""
    c = _c(c)
    return ~c.rlike(IDENTIFIER_PATTERN) | c.rlike(r"^(.)\1+$")
