"""Hosts, paths and rules against plain Python; mined rules against counting."""

import re
from itertools import combinations

import duckdb

from aeroband.llm import queries, urls

SF = "/root/testdata/sf0.001"
ODD = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "http://example.com", "http://example.com/en/1", "http://a.b.example.com/en/", "http://example.com?x=/en/",
       "http://notexample.com/en/", "http://x.net/es/1#a", "http://x.net/FR/1", "http://x.net/fr", "http://x.NET/fr/?a://b", "ftp://ü.com/ä", "://com/", "http://com", "http://com/x", "http://a..net/es/", "x://y\nz.com/en/a?b", "http://u:p@example.com:80/en/", "http://example.com//en/"]


def plain(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def check(rows, pages):
    assert len(rows) == len(pages)
    for r in rows:
        assert r.verdict in ("allow", "block")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in rows), key=str)
    assert got == sorted(((i, *plain(u)) for i, u in pages), key=str)


def test_query(spark):
    check(queries.op7_url_filters(spark, SF).collect(), duckdb.sql(f"SELECT page_id, url FROM '{SF}/pages.parquet'").fetchall())


def test_edges(spark):
    pages = [*enumerate(ODD), (3, "http://x.net/es/1"), (3, "http://x.net/es/1"), (None, "http://q.org/a")]
    df = spark.createDataFrame([(i, u, 1, "z") for i, u in pages], "page_id long, url string, host int, rule string")
    labels = spark.createDataFrame([(1, None, None), (1, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    check(urls.judged(df, labels).collect(), pages)
    check(urls.judged(df, labels.limit(0)).collect(), pages)
    assert urls.judged(df.limit(0), labels).collect() == []


def test_mined_rules(spark):
    pages = [(k, f"https://{'spam' if k % 4 == 0 else 'fine'}.{'a' if k % 3 else 'b'}.org/{'x' if k % 2 else 'y'}/{k}") for k in range(400)]
    bad = {k for k in range(400) if k % 4 == 0 and (k % 3 or k % 5)}
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, int(k in bad)) for k in range(0, 400)], "doc_id long, quality int, toxic int")
    found = {tuple(r.tokens): r for r in urls.mined_rules(urls.labelled(urls.parsed(df), labels)).collect()}
    baskets = [(set(r.t), k in bad) for (k, _), r in zip(pages, df.orderBy("page_id").select(urls.tokens(df.url).alias("t")).collect())]
    base = len(bad) / 400
    sure = {}
    for n in (1, 2, 3):
        for s in {c for b, _ in baskets for c in combinations(sorted(b), n)}:
            hits = [bad_ for b, bad_ in baskets if set(s) <= b]
            if sum(hits) / 400 >= urls.SUPPORT and sum(hits) / len(hits) >= urls.CONFIDENCE and sum(hits) / len(hits) / base >= urls.LIFT:
                sure[s] = sum(hits) / len(hits)
    want = {s for s, c in sure.items() if not any(set(t) < set(s) and d >= c for t, d in sure.items())}
    assert set(found) == want and want
    assert all(abs(found[s].confidence - sure[s]) < 1e-12 for s in want)
    got = {r.page_id: r.verdict for r in urls.judged(df, labels).collect()}
    assert all(got[k] == ("block" if any(set(s) <= b for s in want) else "allow") for (k, _), (b, _) in zip(pages, baskets))


def test_four_tokens_together(spark):
    """Any three of scheme, host, segment and query key are bad in half the cases, all four always."""
    pages = [(k, f"http{'s' if k & 1 else ''}://{'a' if k & 2 else 'b'}.org/{'x' if k & 4 else 'y'}/{k}?{'p' if k & 8 else 'q'}=1") for k in range(320)]
    bad = {k for k in range(320) if k & 15 == 15}
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, int(k in bad)) for k in range(320)], "doc_id long, quality int, toxic int")
    found = {tuple(r.tokens) for r in urls.mined_rules(urls.labelled(urls.parsed(df), labels)).collect()}
    assert found == {("host:a.org", "key:p", "path:x", "scheme:https")}
    got = {r.page_id: r.verdict for r in urls.judged(df, labels, [("allow", "none.example", "/")]).collect()}
    assert {k for k, v in got.items() if v == "block"} == bad


def test_deep_hosts(spark):
    """Twenty host labels, with and without branches at every depth: no combinations of suffixes are listed."""
    import time
    deep = [f"l{k}" for k in range(20)]
    branch = lambda k: ".".join(["other", *deep[-(k % 19 + 1):]]) if k % 3 == 0 else ".".join(deep)
    pages = [(k, f"https://{branch(k) if k % 2 else 'good.org'}/{k}") for k in range(1200)]
    df = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, int(k % 2 and k % 3 > 0)) for k in range(1200)], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: r.verdict for r in urls.judged(df, labels).collect()}
    assert time.time() - began < 60
    assert {k for k, v in got.items() if v == "block"} >= {k for k in range(1200) if k % 2 and k % 3}
    assert all(v == "allow" for k, v in got.items() if k % 2 == 0)
    found = urls.mined_rules(urls.labelled(urls.parsed(df), labels)).collect()
    assert all(sum(t.startswith("host:") for t in r.tokens) <= 1 for r in found)
