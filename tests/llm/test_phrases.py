"""Collocations against counting every phrase, and against the registered SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest

from aeroband.llm import phrases, queries
from compare import _rows, connect

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, longest, kept=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", (text or "").translate(LOWER)):
            w = re.findall("[^\\x20\\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for (lang, p), a in found.items():
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        held = any(l == lang and len(q) > len(p) and 100 * b >= kept * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for (l, q), b in found.items())
        if not held:
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return sorted(out)


def rows_of(df):
    return sorted((r.lang, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


@pytest.mark.parametrize("kept", [100, 70])
def test_all_phrases(spark, kept):
    rows = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet'").fetchall()
    df = spark.createDataFrame(rows, "lang string, text string")
    got = rows_of(phrases.scored(df, least=6, kept=kept))
    assert got == brute(rows, 6, 5, kept) and len(got) > 100


def test_small_ranges(spark):
    """Streams cut into many ranges: beginnings and ends lie in earlier ones."""
    rng = random.Random(2)
    rows = [("ab"[k % 2], " ".join(rng.choice("xyz") for _ in range(60))) for k in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert rows_of(phrases.scored(spark.createDataFrame(rows, "lang string, text string"), least=3)) == brute(rows, 3, 5)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_edges(spark):
    rows = [(None, "A b. a B! a b"), ("und", "a b\x01 a b\xa0c a\tb"), ("x", None), ("x", ""), ("y", "q " * 5000), ("y", "...,;"), ("z", "É é É é")] * 3
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "lang string, text string, count int, phrase int")
    assert rows_of(phrases.scored(df, least=3)) == brute(rows, 3, 5)
    top = phrases.collocations(df, first=2, least=3).collect()
    assert max(r["rank"] for r in top) == 2 and min(r["rank"] for r in top) == 1
    assert phrases.collocations(df.limit(0)).collect() == []
    assert phrases.collocations(df, least=10 ** 6).collect() == []


def test_query(spark):
    df, con = queries.op11_phrase_collocations(spark, SF), connect(SF)
    cur = con.execute(queries.SQL["op11_phrase_collocations"])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in cur.description], cur.fetchall())
