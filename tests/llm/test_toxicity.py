"""The chain on held-out labels, planted words and odd rows."""

import random

import duckdb

from aeroband.llm import queries, toxicity

SF = "/root/testdata/sf0.1"  # enough labels for each word and stem


def test_query(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{SF}/labels.parquet'").fetchall())
    got = queries.op4_toxicity(spark, SF).collect()
    assert len(got) == 10000 and all(0 <= r.p_toxic <= 1 and 0 <= r.p_junk <= 1 for r in got)
    wrong = [r for r in got if r.doc_id in truth and r.toxic != bool(truth[r.doc_id])]
    assert len(wrong) <= 0.02 * len(truth)


def _planted(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [f"plain{rng.randrange(400)}" for _ in range(rng.choice((5, 40, 400)))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(("Badwort", "badwortlich", "NASTY,", "nasty")))
        if i % 7 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), int(i % 7 != 0), int(toxic)))
    return rows


def test_held_out(spark):
    rows = _planted(1, 1200)
    docs = spark.createDataFrame([(i, t, "x", False) for i, t, _, _ in rows], "doc_id long, text string, p_toxic string, is_toxic boolean")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 700], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, labels, toxicity.categories(), sample=300)
    got = {r.row.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert sum(got[i].is_toxic != bool(x) for i, _, _, x in rows if i >= 700) <= 3
    assert sum(got[i].is_junk == bool(q) for i, _, q, _ in rows if i >= 700) <= 10
    clean = toxicity.clean(docs, labels)
    assert clean.columns == docs.columns
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1  # the later model sees the earlier one


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "nasty"), (4, "nasty nasty"), (4, "nasty nasty"), (5, "fine " * 9000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r.p_toxic, r.is_toxic) for r in toxicity.score(docs, toxicity.train(docs, none, toxicity.categories())).filter("row.doc_id < 4").collect()] == [(0.0, False)] * 3
    odd = spark.createDataFrame([(4, None, 1), (4, None, 0), (99, 1, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd, toxicity.categories())).count() == 7
    assert toxicity.clean(docs.limit(0), none).collect() == []
