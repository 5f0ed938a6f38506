"""WARC archives written and read by tasks, with boundary-chain verification.

Writing.  Records of equal payloads of at least ``REVISIT`` bytes form a group; the one with
the smallest page_id is a response, the others are revisits without a body that name it.
Each task streams one archive into the shared folder; it appears when whole.  A body is the
bare html as ``text/html``, without the lines of an HTTP answer.  A response is named by its
page_id and digest, which is what its revisits refer to; rows equal in both share the name.

Reading.  Archives are read in byte ranges.  A payload may hold anything, whole WARC records
too, so a range cannot trust the version line alone.  Each task emits, for every version
line with a parsable header that starts in its range, the offset of the record that would
follow, and how far that chain leads within the range.  Pointer jumping over these, from
offset 0 of each file, finds the one true record at which each range is entered; no other
is reachable.  A last pass walks the records from there, checks each, and parses it.

Edge cases.  A null html is an empty payload, a null url an empty target.  Repeated pages
get a record each; rows of a response's page_id and payload are responses too, and different
payloads of one page_id are judged each.  Rows without page_id are written as responses of
their own.  Other columns are ignored.  No pages, no archives, no rows.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from aeroband.llm import files
from aeroband.session import materialise, run_directory

VERSION = b"WARC/1.1\r\n"
REVISIT = 100
RANGE = 4 << 20
LOOK = 1 << 16  # bytes read at once beyond a range for a header
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

ROWS = 256


def header(fields: list[tuple[str, str]]) -> bytes:
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogateescape") + b"\r\n"


def parse_header(raw: bytes) -> dict[str, str] | None:
    """Fields of a header without its blank line; None where it is no WARC header."""
    fields = {}
    for line in raw[len(VERSION):].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon or not name:
            return None
        fields[name.decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return fields if fields.get("content-length", "").isdecimal() and len(fields["content-length"]) < 19 else None


def record_id(page_id, digest: str) -> str:
    """Of a response: by page and payload, so a revisit can name it."""
    return f"<urn:page:{page_id}:{digest}>"


def _quoted(url: str) -> str:
    """A target that cannot break the header: white space and controls are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    uri, size, count = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc", 0, 0
    with files.written(uri) as out:
        while first is not None:
            for k in range(0, first.num_rows, ROWS):
                for r in first.slice(k, ROWS).to_pylist():
                    body = b"" if r["refers_to"] is not None else r["payload"]
                    key = "" if r["page_id"] is None else str(r["page_id"])
                    own = record_id(key, r["payload_digest"]) if r["refers_to"] is None else f"<urn:revisit:{key}:{TaskContext.get().partitionId()}:{count}>"
                    fields = [("WARC-Type", r["record_type"]), ("WARC-Record-ID", own), ("WARC-Date", DATE),
                              ("WARC-Target-URI", _quoted(r["url"] or "")), ("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"), ("X-Page-Id", key), ("X-Payload-Length", str(len(r["payload"])))]
                    if r["refers_to"] is not None:
                        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(r["refers_to"], r["payload_digest"]))]
                    size += out.write(header([*fields, ("Content-Type", "text/html"), ("Content-Length", str(len(body)))]))
                    size += out.write(body)
                    size += out.write(b"\r\n\r\n")
                    count += 1
            first = next(batches, None)
    yield pa.RecordBatch.from_pylist([{"path": uri, "size": size, "records": count}], schema=pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))


def write(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives (path, size, records) of ``pages`` (page_id, url, html)."""
    spark = pages.sparkSession
    folder = files.qualified(spark.sparkContext, folder or run_directory(spark, "warc"))
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    prints = pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload")).filter((F.length("payload") >= REVISIT) & F.col("page_id").isNotNull())
    prints = materialise(prints.select("page_id", F.sha2("payload", 256).alias("payload_digest")), "warc-prints")
    first = materialise(prints.groupBy("payload_digest").agg(F.min("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("payload_digest", "response"), "warc-responses")
    again = prints.join(first, "payload_digest").filter("page_id <> response").select("page_id", "payload_digest", F.col("response").alias("refers_to")).distinct()
    again = materialise(again, "warc-revisits")
    typed = rows.join(again, ["page_id", "payload_digest"], "left").withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))
    return materialise(typed.mapInArrow(partial(_write, folder=folder), "path string, size long, records long"), "warc-archives")


def _header_at(file, at: int, size: int, data: bytes, base: int) -> tuple[dict[str, str], int] | None:
    """(fields, offset of the body) of a header at ``at``; ``data`` are the file's bytes from ``base`` on."""
    raw, look = data[at - base:], LOOK
    while b"\r\n\r\n" not in raw:
        if at + len(raw) >= size:
            return None
        raw += file.read_at(min(look, size - at - len(raw)), at + len(raw))
        look *= 2
    if not raw.startswith(VERSION):
        return None
    end = raw.index(b"\r\n\r\n")
    fields = parse_header(raw[:end])
    return None if fields is None else (fields, at + end + 4)


class Lines:
    """The lines up to a blank line, read once for all version lines that stand in them."""

    def __init__(self, raw: bytes, begin: int):
        lines = raw.split(b"\r\n")
        self.starts = list(accumulate((len(line) + 2 for line in lines), initial=begin))[:-1]
        self.whole, self.length_at, self.length = len(lines), -1, -1
        for k in range(len(lines) - 1, -1, -1):
            name, colon, value = lines[k].partition(b":")
            if not colon or not name:
                break
            self.whole = k  # from here on every line is a field
            if self.length_at < 0 and name.lower() == b"content-length":
                text = value.strip().decode("utf-8", "replace")
                self.length_at, self.length = k, int(text) if text.isdecimal() and len(text) < 19 else -1

    def content_length(self, at: int) -> int:
        """What a header whose version line begins at ``at`` says; -1 where it is none."""
        first = bisect_left(self.starts, at + len(VERSION))
        return self.length if first < len(self.starts) and first >= self.whole and self.length_at >= first else -1


def _blank(file, begin: int, size: int, data: bytes, base: int) -> tuple[int, bytes]:
    """Offset of the next blank line from ``begin`` on (-1: none) and the bytes before it."""
    raw, look, seen = data[begin - base:], LOOK, 0
    while (at := raw.find(b"\r\n\r\n", seen)) < 0:
        if begin + len(raw) >= size:
            return -1, b""
        seen = max(0, len(raw) - 3)
        raw += file.read_at(min(look, size - begin - len(raw)), begin + len(raw))
        look *= 2
    return begin + at, raw[:at]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to (path, at, onward): each possible record and the first one of its chain outside the range."""
    for batch in batches:
        for r in batch.to_pylist():
            system, path = files.opened(r["path"])
            with system.open_input_file(path) as file:
                stop = min(r["size"], r["stop"] + LOOK)
                data = file.read_at(stop - r["start"], r["start"])
                follow: dict[int, int] = {}
                blank, lines, k = -1, None, data.find(VERSION)
                while 0 <= k < r["stop"] - r["start"]:
                    at = r["start"] + k
                    if blank < at:  # else it ends where the version line before it ended
                        blank, raw = _blank(file, at, r["size"], data, r["start"])
                        if blank < 0:
                            break
                        lines = Lines(raw, at)
                    length = lines.content_length(at)
                    if length >= 0:
                        follow[at] = blank + 4 + length + 4
                    k = data.find(VERSION, k + 1)
            onward: dict[int, int] = {}
            for at in sorted(follow, reverse=True):
                onward[at] = onward.get(follow[at], follow[at])
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(onward), pa.string()), pa.array(list(onward), pa.int64()), pa.array(list(onward.values()), pa.int64())], ["path", "at", "onward"])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges with the offset of their first record to parsed records."""
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for batch in batches:
        for r in batch.to_pylist():
            system, path = files.opened(r["path"])
            out: list[tuple] = []
            with system.open_input_file(path) as file:
                at, held = r["entry"], 0
                while at < r["stop"]:
                    data = file.read_at(min(LOOK, r["size"] - at), at)
                    found = _header_at(file, at, r["size"], data, at)
                    if found is None:
                        raise ValueError(f"{r['path']} has no record at {at}")
                    fields, begin = found
                    length = int(fields["content-length"])
                    body = data[begin - at:begin - at + length + 4]
                    if len(body) < length + 4:
                        body += file.read_at(length + 4 - len(body), begin + len(body))
                    if body[length:] != b"\r\n\r\n":
                        raise ValueError(f"{r['path']}: the record at {at} is not closed")
                    payload = body[:length] if fields["warc-type"] == "response" else None
                    digest = fields["warc-payload-digest"].removeprefix("sha256:")
                    if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{r['path']}: the record at {at} differs from its digest")
                    refers = fields.get("warc-refers-to", "").removeprefix("<urn:page:").partition(":")[0]
                    out.append((int(fields["x-page-id"]) if fields["x-page-id"] else None, fields["warc-target-uri"], fields["warc-type"], int(refers) if refers else None,
                                digest, length if payload is not None else int(fields["x-payload-length"]), payload))
                    held += length
                    at = begin + length + 4
                    if held > RANGE:
                        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)
                        out, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)


def entries(ranges: DataFrame, width: int) -> DataFrame:
    """(path, range, entry): the first true record of each range that one starts in.

    ``reached`` doubles along the chain each round: what is reached jumps by 2^k ranges.
    """
    most = ranges.agg(F.max("range")).first()[0]
    spread = max(1, min(2000, ranges.count()))
    jumps = materialise(ranges.repartition(spread, "path", "range").mapInArrow(_candidates, "path string, at long, onward long"), "warc-candidates")
    reached = ranges.filter("range = 0").select("path", F.lit(0).cast("long").alias("at"))
    for _ in range(math.ceil(math.log2((most or 0) + 2))):
        reached = materialise(reached.union(reached.join(jumps, ["path", "at"]).select("path", F.col("onward").alias("at"))).distinct(), "warc-reached")
        there = jumps.select("path", F.col("at").alias("onward"), F.col("onward").alias("beyond"))
        jumps = materialise(jumps.join(there, ["path", "onward"], "left").select("path", "at", F.coalesce("beyond", "onward").alias("onward")), "warc-jumps")
    return reached.groupBy("path", F.floor(F.col("at") / width).cast("int").alias("range")).agg(F.min("at").alias("entry"))


def read(archives: DataFrame, width: int = RANGE) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload) of every record; a revisit's payload is null."""
    ranges = archives.filter("size > 0").withColumn("range", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / width).cast("int"))))
    ranges = ranges.select("path", "size", "range", (F.col("range").cast("long") * width).alias("start"), F.least("size", (F.col("range") + 1).cast("long") * width).alias("stop"))
    ranges = materialise(ranges, "warc-ranges")
    made = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
    entered = ranges.join(entries(ranges, width), ["path", "range"]).filter("entry < stop")
    return entered.repartition(max(1, min(2000, ranges.count())), "path", "range").mapInArrow(_records, made)
