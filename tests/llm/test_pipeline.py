"""Each stage of the pipeline against brute force on its own input."""

import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_decontaminate import brute as hits  # noqa: E402
from test_lines import shared
from test_minhash import brute as groups
from test_tokens import plain

import corpus_pipeline
from aeroband.llm import queries
from aeroband.session import materialise, table

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    docs = table(spark, SF, "documents")
    columns, was = docs.columns, texts(docs)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, SF), "test-stage")
        if name == "packing":
            break
        assert out.columns == columns
        now = texts(out)
        seen.append(len(now))
        if name == "toxicity":
            rejected = {r.doc_id for r in queries.op4_toxicity(spark, SF).collect() if r.toxic}
            assert now == {i: t for i, t in was.items() if i not in rejected}
        elif name == "line dedup":
            repeats = shared(was.items(), 50)
            for i, t in was.items():
                words = t.split()
                left = [x for k, x in enumerate(words) if k not in repeats[i]]
                if repeats[i]:
                    assert i not in now or set(now[i].split()) <= set(words) and len(now[i].split()) <= len(left)
                else:
                    assert now[i] == t
        elif name == "MinHash near-dedup":
            kept = {i for i, (_, _, keep) in groups(list(was.items()), 5, 80, 100).items() if keep}
            assert now == {i: was[i] for i in kept}
        else:
            assert now == {i: was[i] for i, *_, hit in hits(was.items(), items) if not hit}
        docs, was = out, now
    ids = {}
    for r in out.orderBy("doc_id", "start").collect():
        ids.setdefault(r.doc_id, b"")
        ids[r.doc_id] += bytes(r.ids)
    want = dict(zip(was, plain("word_bpe_49k.json", was.values(), 1)))
    assert {i: len(x) // 4 for i, x in ids.items()} == {i: len(x) for i, x in want.items()}
    assert seen[-1] < seen[0]


def test_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and len([n for n in names if n.startswith("op")]) == 10
