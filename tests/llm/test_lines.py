"""Removed passages against a search of all shared runs of words."""

import random

import duckdb

from aeroband.llm import lines, queries

SF = "/root/testdata/sf0.001"


def shared(rows, least):
    """Word positions that belong to a run of ``least`` words of an earlier document (by id)."""
    first = {}
    for i, t in sorted((i, t) for i, t in rows if t is not None and i is not None):
        w = t.split()
        for k in range(len(w) - least + 1):
            first.setdefault(tuple(w[k:k + least]), i)
    out = {}
    for i, t in rows:
        w, hit = (t or "").split(), set()
        for k in range(len(w) - least + 1):
            if i is not None and first[tuple(w[k:k + least])] != i:
                hit.update(range(k, k + least))
        out[i] = hit
    return out


def removed(r):
    return {k for s, e in zip(r.spans[::2], r.spans[1::2]) for k in range(s, e)}


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want, texts = shared(rows, 50), dict(rows)
    assert any(want.values())
    got = {r.doc_id: r for r in queries.op9_line_dedup(spark, SF).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        words = texts[i].split()
        assert removed(r) >= want[i], i
        assert r.n_removed == len(removed(r)) and r.n_lines == len(words)
        assert r.text.split() == [x for k, x in enumerate(words) if k not in removed(r)]
        if not want[i]:
            assert r.text == texts[i]


def test_passages_anywhere(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10 ** 7)}" for _ in range(n)]
    passage, short = fresh(52), fresh(40)
    rows = []
    for i in range(60):
        a, b = fresh(rng.randrange(0, 70)), fresh(rng.randrange(0, 70))
        middle = passage if i % 2 else short
        rows.append((i, " ".join(a) + ("\n" if i % 3 else " ") + (" " if i % 5 else "\n\t").join(middle) + " " + " ".join(b)))
    want, texts = shared(rows, 50), dict(rows)
    df = spark.createDataFrame([(i, t, 1, "n") for i, t in rows], "doc_id long, text string, found int, row string")
    for r in lines.repeated(df).collect():
        assert removed(r) == want[r.row.doc_id]
    out = lines.deduplicated(df)
    assert out.columns == df.columns and out.count() == 60
    assert sum(" ".join(passage[:50]) in " ".join(r.text.split()) for r in out.collect()) == 1
    assert all(r.text == texts[r.doc_id] for r in out.collect() if r.doc_id % 2 == 0)


def test_edges(spark):
    long = " ".join(f"q{k}" for k in range(3000))
    rows = [(4, long), (2, long), (None, long), (1, None), (3, ""), (5, "a " * 400), (6, "a " * 400), (6, "a " * 400), (7, "short one")]
    got = sorted(((r.row.doc_id, r.n_lines, r.n_removed) for r in lines.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(4, 3000, 3000), (2, 3000, 0), (None, 3000, 0), (1, 0, 0), (3, 0, 0), (5, 400, 0), (6, 400, 400), (6, 400, 400), (7, 2, 0)], key=str)
    assert {r.doc_id for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {2, None, 1, 3, 5, 7}
    assert lines.repeated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_removed_is_what_an_earlier_document_holds(spark):
    """Passages whose ends an unrelated earlier document holds; few words, many chance repeats."""
    rng = random.Random(7)
    fresh = lambda n: [f"w{rng.randrange(10 ** 7)}" for _ in range(n)]
    rows, decoys = [], []
    for k in range(60):
        passage = fresh(50 + k % 22)
        decoys += [x for at in range(len(passage) - 8) for x in (*passage[at:at + 2 + at % 8], *fresh(1))]
        rows += [(100 + 2 * k, " ".join(fresh(40) + passage + fresh(40))), (101 + 2 * k, " ".join(fresh(30) + passage + fresh(50)))]
    rows.append((1, " ".join(decoys)))
    rows += [(400 + k, " ".join(rng.choice("ab") if rng.random() < 0.03 else "a" for _ in range(200))) for k in range(40)]
    rows += [(500 + k, " ".join("ab"[j % 2] for j in range(k, 150 + 3 * k))) for k in range(10)]
    want = shared(rows, 50)
    assert len(want[101]) == 50
    got = {r.row.doc_id: removed(r) for r in lines.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_neighbours_of_two_documents(spark):
    """Short lines of different documents side by side stay, unless one document holds both."""
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10 ** 7)}" for _ in range(n)]
    one, other = fresh(40), fresh(35)
    rows = [(k, " ".join(w)) for k, w in enumerate([fresh(60) + one + fresh(60), fresh(60) + other + fresh(60), fresh(20) + one + other + fresh(20), one + other, fresh(9) + one + other[:9]])]
    want = shared(rows, 50)
    assert not want[2] and len(want[3]) == 75 and not want[4]
    got = {r.row.doc_id: removed(r) for r in lines.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_query_removes_no_more(spark):
    want = shared(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall(), 50)
    assert {r.doc_id: removed(r) for r in queries.op9_line_dedup(spark, SF).collect()} == want


def test_differing_texts_of_one_document(spark):
    long = " ".join(f"q{k}" for k in range(80))
    rows = [(1, long), (2, "new words before " + long), (2, long), (2, "x")]
    got = sorted((r.n_lines, r.n_removed, r.text.strip()) for r in lines.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.row.doc_id == 2)
    assert got == [(1, 0, "x"), (80, 80, ""), (83, 80, "new words before")]


def test_physical_lines(spark):
    """A block of three short lines repeats; single lines that repeat stay."""
    block = "Copyright A B\nAll rights reserved\n  see the file"
    rows = [(1, f"one text\n{block}\nmore of one"), (2, f"two text\n\n{block}\r\nmore of two"), (3, "All rights reserved\nthree"), (4, block.replace("reserved", "Reserved")), (5, block)]
    got = {r.row.doc_id: (r.n_lines, r.spans, r.text) for r in lines.repeated(spark.createDataFrame(rows, "doc_id long, text string"), 3, "line").collect()}
    assert got[1] == (5, [], rows[0][1]) and got[3][1] == [] and got[4][1] == []
    assert got[2] == (5, [1, 4], "two text\n\nmore of two") and got[5][:2] == (3, [0, 3])
    assert {r.doc_id for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 3, "line").collect()} == {1, 2, 3, 4}


def test_forged_hashes(spark, monkeypatch):
    """Different passages of equal hashes are told apart by their bytes."""
    from pyspark.sql import functions as F
    words = [[f"{c}{k}" for k in range(70)] for c in "xyz"]
    rows = [(1, " ".join(words[0])), (2, " ".join(words[1])), (3, " ".join(words[0])), (4, " ".join(words[2][:60]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = df.select("doc_id", F.xxhash64("text").alias("part"), "text")
    part = {r.doc_id: r.part for r in texts.collect()}
    claims = [(i, part[i], 5, 65, (1, part[1], 5)) for i in (2, 3)] + [(4, part[4], 0, 60, (2, part[2], 10)), (3, part[3], 0, 52, (1, part[1], 1))]
    spans = spark.createDataFrame(claims, "doc_id long, part long, line int, to int, source struct<doc_id long, part long, line int>")
    assert {(r.doc_id, r.line, r.to) for r in lines.compared(spans, texts, "word").collect()} == {(3, 5, 65)}
