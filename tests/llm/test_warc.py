"""Archives read back against the pages, with records inside payloads."""

import hashlib

import duckdb

from aeroband.llm import queries, warc

SF = "/root/testdata/sf0.001"


def want(pages):
    first = {}
    for i, h in pages:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(i, first.get(raw, i))
    out = []
    for i, h in pages:
        raw = (h or "").encode()
        again = i is not None and len(raw) >= 100 and first[raw] != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query(spark):
    got = rows(queries.op2_warc(spark, SF))
    assert got == want(duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    assert got == sorted(con.execute(queries.SQL["op2_warc"]).fetchall(), key=str)


def test_magic_in_payloads(spark):
    fake = warc.header([("WARC-Type", "response"), ("X-Page-Id", "666"), ("Content-Length", "30")]).decode()
    endless = warc.header([("WARC-Type", "response"), ("Content-Length", "9")]).decode()
    pages = [(k, f"http://h/{k} \r\nX: y", ("ä" * (k % 50) + fake * (k % 4) + endless * 3 + warc.VERSION.decode() + "junk: \r\n\r\n") * (1 + k % 9)) for k in range(200)]
    pages += [(300 + k, "u", pages[3][2]) for k in range(5)] + [(3, "u", pages[3][2]), (400, None, None), (401, "u", ""), (402, "u", "x" * 99), (403, "u", "x" * 99), (None, "u", pages[3][2]), (404, "u", "z" * 300_000)]
    df = spark.createDataFrame([(i, u, h, 0, "n") for i, u, h in pages], "page_id long, url string, html string, payload int, size string").repartition(3)
    archives = warc.write(df)
    assert archives.count() >= 1
    for width in (997, 20_000, warc.RANGE):
        found = warc.read(archives, width)
        assert rows(found) == want([(i, h) for i, _, h in pages])
    payloads = {r.page_id: r.payload for r in found.collect() if r.record_type == "response" and r.page_id is not None}
    assert all(bytes(payloads[i]).decode() == (h or "") for i, _, h in pages if i in payloads and i not in (3,))


def test_no_pages(spark):
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).collect() == []


def test_different_payloads_of_one_page(spark):
    a, b, alone = "a" * 150, "b" * 150, "c" * 150
    pages = [(1, a), (2, b), (9, a), (9, b), (9, alone), (9, alone), (9, "short"), (8, a)]
    found = warc.read(warc.write(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string")))
    assert rows(found) == want(pages)
    assert sorted(bytes(r.payload).decode() for r in found.collect() if r.payload is not None) == sorted([a, b, alone, alone, "short"])


def test_version_lines_without_a_blank_line(spark):
    """Megabytes of version lines, alone or within fields, take time in proportion."""
    import time
    version = warc.VERSION.decode()
    pages = [(1, version * 300_000), (2, f"X: {version}" * 200_000 + "Content-Length: 5\r\n\r\nhello"), (3, "plain")]
    df = spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").coalesce(1)
    archives = warc.write(df)
    began = time.time()
    assert rows(warc.read(archives)) == want(pages)
    assert time.time() - began < 60


def test_revisits_name_records(spark):
    pages = [(k, "h" * (150 + k // 10)) for k in range(30)]
    archives = warc.write(spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").repartition(3))
    ids, named = set(), set()
    for r in archives.collect():
        for line in open(r.path.removeprefix("file:"), "rb").read().split(b"\r\n"):
            if line.startswith(b"WARC-Record-ID: "):
                ids.add(line.split(b": ")[1])
            if line.startswith(b"WARC-Refers-To: "):
                named.add(line.split(b": ")[1])
    assert len(ids) == 30 and len(named) == 3 and named <= ids


def test_lines_agree_with_the_parser():
    import random
    rng = random.Random(1)
    parts = [warc.VERSION, b"A: b\r\n", b"Content-Length: 7\r\n", b"content-length: x\r\n", b"junk\r\n", b": v\r\n", b"X: WARC/1.1\r\n", b"Content-Length:12\r\n"]
    for _ in range(2000):
        raw = warc.VERSION + b"".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))
        raw = raw[:-2]  # its blank line is cut off
        lines, at = warc.Lines(raw, 1000), raw.find(warc.VERSION)
        while at >= 0:
            fields = warc.parse_header(raw[at:])
            assert lines.content_length(1000 + at) == (-1 if fields is None else int(fields["content-length"])), raw[at:]
            at = raw.find(warc.VERSION, at + 1)
