"""Ranked results against scoring every document."""

import math
import random
import re
from collections import Counter

import pytest

from aeroband.llm import queries, search
from compare import _rows, connect

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for q, t in items:
        asked.setdefault(q, set()).update(terms(t))
    out = []
    for q, ts in asked.items():
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_query(spark):
    df, con = queries.op13_ranked_search(spark, SF), connect(SF)
    cur = con.execute(queries.SQL["op13_ranked_search"])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in cur.description], cur.fetchall())
    docs, items = (con.execute(f"SELECT {c}, text FROM {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert result(df) == brute(docs, items, 10)


@pytest.mark.parametrize("index_words", [2_000_000, 300])
def test_blocks_and_groups(spark, monkeypatch, index_words):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(80)]
    text = lambda n: " ".join(vocabulary[min(79, int(rng.expovariate(0.08)))] for _ in range(n))
    docs = [(k, text(rng.choice((3, 5, 8, 30, 31, 32, 200)))) for k in range(500)] + [(600 + k, "w1 w40 w41") for k in range(80)]
    items = [(q, text(rng.choice((1, 3, 12)))) for q in range(40)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert result(search.search(d, i, k=7, index_words=index_words)) == brute(docs, items, 7)


def test_edges(spark):
    docs = [(1, "Alpha, beta"), (1, "alpha"), (None, "alpha!"), (2, None), (3, "..."), (4, "É9 x" * 3000), (5, "alpha beta gamma"), (5, "alpha beta gamma"), (6, "q r s"), (7, "q t")]
    items = [(1, "ALPHA alpha é9"), (1, "beta"), (None, "É9"), (2, ""), (3, None), (4, "unseen"), (5, "É9")]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, score int, n int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    assert result(search.search(d, q)) == brute(docs, [x for x in items if x[1] is not None], 10)
    assert result(search.search(d.limit(0), q)) == []
    assert result(search.search(d, q.limit(0))) == []
    assert result(search.search(d, q.filter("text = ''"))) == []
