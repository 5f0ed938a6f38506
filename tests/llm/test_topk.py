"""Top-k rows against all products."""

import math

import duckdb
import numpy as np

from aeroband.llm import queries, topk

SF = "/root/testdata/sf0.001"


def brute(rows, chosen, k):
    ints = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, list(v)) for i, v in sorted({(i, tuple(v)) for i, v in ints})]
    out = []
    for i, q in ints:
        if chosen(i):
            own = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(own)]
    return sorted(out)


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_query(spark):
    got = rows(queries.op3_exact_top_k(spark, SF))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(queries.SQL["op3_exact_top_k"]).fetchall())
    assert got == brute(con.execute("SELECT vec_id, embedding FROM embeddings").fetchall(), lambda i: i % 20 == 0, 20)


def test_many_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    monkeypatch.setattr(topk, "QUERIES", 8)
    rng = np.random.default_rng(4)
    base = [[float(x) for x in v] for v in np.round(rng.normal(0, 0.05, (300, 20)), 2)]
    data = [(i, v) for i, v in enumerate(base)] + [(300 + i, base[7]) for i in range(60)] + [(400 + i, [0.0] * 20) for i in range(5)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    assert rows(topk.top_k(df, df.filter("vec_id % 20 = 0"), 7)) == brute(data, lambda i: i % 20 == 0, 7)


def test_edges(spark):
    inf, nan = float("inf"), float("nan")
    data = [(0, [1.0, -2.0]), (20, [0.5, 0.01]), (20, [0.5, 0.01]), (40, None), (60, []), (80, [1.0, None]), (100, [inf, 1.0]), (120, [nan, 1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0]), (1, [3.0, 2.0]), (2, [1.0, 2.0, 3.0]), (140, [1.0, 0.0, 0.0]), (160, [2e6, 1.0]), (3, [-2e6, 7.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in data], "vec_id long, embedding array<double>, score int, dim int")
    assert rows(topk.top_k(df, df.filter("vec_id % 20 = 0"), 20)) == brute(data, lambda i: i % 20 == 0, 20)
    assert topk.top_k(df.limit(0), df).collect() == []
    assert topk.top_k(df, df.limit(0)).collect() == []
