"""The network's slopes, its accuracy on held-out documents, and odd texts."""

import zlib

import duckdb
import numpy as np

from aeroband.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_slopes():
    net = langid.fresh(["a", "b", "c"], 3)
    steps = langid._grid([b"hello wor", b"xyz", b"abc d"], 9)
    labels = np.array([0, 1, 2])
    _, slopes = langid.gradients(net, steps, labels)
    for v, s in zip(langid.parameters(net), slopes):
        usable = np.abs(s[:256]) if v.shape[0] == 257 else np.abs(s)
        i = np.unravel_index(usable.argmax(), usable.shape)
        was, ends = v[i], []
        for step in (1e-2, -1e-2):
            v[i] = was + step
            ends.append(langid.gradients(net, steps, labels)[0])
        v[i] = was
        assert abs((ends[0] - ends[1]) / 2e-2 - s[i]) < 1e-3 + 0.02 * abs(s[i])


def test_padding_and_segments_do_not_matter():
    net = langid.fresh(["a", "b"])
    alone = langid.positions(net, langid._grid([b"some text"], 9))
    padded = langid.positions(net, langid._grid([b"some text", b"a much longer piece of text"], 27))
    assert np.allclose(alone[:, 0], padded[:9, 0], atol=1e-6)
    data = np.frombuffer(b"x" * 300 + b"yz", np.uint8)
    got = langid.pooled(net, data, np.array([0, 300, 300, 302]))
    want = np.concatenate([langid.positions(net, langid._grid([bytes(data[k:min(k + langid.SEGMENT, 300)])], min(langid.SEGMENT, 300 - k)))[:, 0] for k in range(0, 300, langid.SEGMENT)]).mean(0)
    assert np.allclose(got[0], want, atol=1e-5) and not got[1].any()


def test_query(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    got = queries.op5_language_id(spark, SF).collect()
    assert {r.doc_id for r in got} == set(truth) and len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !?", None), (None, "abc", "x"), (4, "ünö", "y"), (4, "ünö", "y"), (5, "ab " * 9000, "x"), (6, "q", None)], "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "'z' AS score", "1 AS letter")
    got = sorted(((r.doc_id, r.lang_pred) for r in langid.predict(docs, langid.train(docs, 5)).collect()), key=str)
    assert len(got) == 8 and {p for _, p in got} <= {"x", "y", "und"}
    assert [p for i, p in got if i in (1, 2, 3)] == ["und"] * 3 and [p for i, p in got if i == 4] == ["y"] * 2 and (5, "x") in got
    none = langid.train(docs.filter("lang is null"))
    assert none is None and {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    assert langid.predict(docs.limit(0), none).collect() == []
