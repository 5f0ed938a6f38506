"""Marked words against a search for every window."""

import hashlib
import re

import duckdb

from aeroband.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def split(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(str(i))
    lengths = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, found = split(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def test_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    want = brute(docs, items)
    assert any(r[5] for r in want)
    assert rows(queries.op8_benchmark_decontamination(spark, SF)) == want


def test_edges_and_index_slices(spark):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (2, "Two words"), (3, "a b a b a b a b a b a b"), (4, None), (5, ""), (6, "--"), (7, "ünö"), (2, "Two words"), (8, "tail end of item"), (None, "lonely one")]
    docs = [(1, f"x {long.upper()} y two-WORDS"), (2, None), (3, ""), (4, "a b " * 3000), (5, "tail end of"), (6, "the ÜNÖ ünö"), (6, "the ÜNÖ ünö"), (None, "a lonely one"),
            (7, "w0 w1 w2 w3 w4 w5 w6 w7 w8"), (8, "w20 w21 w22 w23 w24 w25 w26 w27 w28 w29"), (9, "tail"), (10, "end of item")]
    want = brute(docs, [(("null" if i is None else i), t) for i, t in items])
    d = spark.createDataFrame([(i, t, True, [1]) for i, t in docs], "doc_id long, text string, contaminated boolean, __spans array<long>")
    b = spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")
    assert rows(decontaminate.mark(d, b)) == want
    assert rows(decontaminate.mark(d, b, index_words=40)) == want
    kept = decontaminate.decontaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not r[5] for r in want)
    assert decontaminate.mark(d.limit(0), b).collect() == []
    assert not any(r.contaminated for r in decontaminate.mark(d, b.limit(0)).collect())


def test_one_python_pass(spark):
    """Marks of several indexes and their summary come from one pass over the texts."""
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven")], "doc_id long, text string")
    items = spark.createDataFrame([(str(k), f"{w} x{k}") for k, w in enumerate(("one", "two", "three", "seven"))] + [("9", "two three")], "item_id string, text string")
    out = decontaminate.mark(docs, items, index_words=8)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items) for r in out.collect()} == {(1, 6, 2, 1), (2, 1, 0, 0)}
