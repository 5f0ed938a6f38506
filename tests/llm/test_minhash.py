"""Near-duplicate groups against all pairs of sets."""

import random
import re

import duckdb
from pyspark.sql import Row

from aeroband.llm import minhash, queries

SF = "/root/testdata/sf0.001"


def brute(rows, n, num, den):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    assert result(queries.op1_minhash_near_dedup(spark, SF)) == brute(rows, 3, 85, 100)


def test_chain_of_edits(spark):
    """Neighbours are similar, ends are not; every bucket holds many unlinked sets."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        words[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}" if i % 3 else words[0]
        rows.append((i * 7 % 1000, " ".join(words)))
    for n, num in ((3, 85), (5, 80)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(minhash.near_duplicates(df, n, num, 100)) == brute(rows, n, num, 100)


def test_edges(spark):
    rows = [Row(5, "a b", 1), Row(3, "A  b\n", 2), Row(9, None, 3), Row(10, "", 4), Row(11, " \t", 5), Row(None, "a b", 6), Row(5, "a b", 7), Row(12, "y " * 5000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept long")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 3, 85, 100).collect()), key=str)
    assert got == sorted([(5, 1, 3, False), (5, 1, 3, False), (3, 1, 3, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (None, 1, None, True), (12, 1, 12, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).collect() == []
    assert minhash.deduplicated(df).columns == df.columns


def test_differing_texts_of_one_document(spark):
    """Each text of a document links, whichever row comes first; documents join what they hold."""
    rng = random.Random(9)
    one, other, third = ([f"v{rng.randrange(10 ** 7)}" for _ in range(60)] for _ in range(3))
    near = lambda w: " ".join([*w[:-1], "changed"])
    rows = [(1, " ".join(one)), (1, " ".join(other)), (2, near(one)), (3, near(other)), (5, " ".join(one)), (7, " ".join(third)), (5, near(third)), (8, " ".join(rng.sample(one, 60)))]
    for order in (rows, rows[::-1]):
        got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(order, "doc_id long, text string"), 3, 85, 100).collect()}
        assert got == {(1, 1), (2, 1), (3, 1), (5, 1), (7, 1), (8, 8)}


def test_crowd_around_one_text(spark):
    """Near copies of one text with edits of their own, at both sides of the threshold; some share edits."""
    rng = random.Random(11)
    base = [f"b{k}" for k in range(160)]
    rows, shared = [(0, " ".join(base))], [rng.sample(range(160), 9) for _ in range(4)]
    for i in range(1, 130):
        w = list(base)
        for p in (shared[i % 4] if i % 3 == 0 else []) + rng.sample(range(160), rng.choice([3, 5, 6, 8, 10])):
            w[p] = f"{'s' if i % 6 == 0 else f'u{i}_'}{p}"
        rows.append((i, " ".join(w)))
    for n, num in ((5, 80), (3, 85)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert result(minhash.near_duplicates(df, n, num, 100)) == brute(rows, n, num, 100)


def test_pieces_of_one_text(spark, monkeypatch):
    """Texts that keep different pieces of one text differ by what they lack; few of their pairs are compared."""
    rng = random.Random(17)
    base = [f"b{k}" for k in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 500):
        if i % 20 == 0:  # close to the one before, far from the hub
            w = rows[-1][1].split()
            w[rng.randrange(len(w))] = f"v{i}"
        else:
            w = [x for k in rng.sample(range(10), rng.choice([4, 5, 6])) for x in base[k * 30:k * 30 + rng.randrange(12, 30)]]
        rows.append((i, " ".join(w)))
    made, written = {}, minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, label: made.setdefault(label, written(df, label)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(df, 5, 80, 100)) == brute(rows, 5, 80, 100)
    assert made["minhash-more"].count() <= 5 * len(rows)


def test_written_tables_leave_no_shuffle_files(spark):
    """Shuffle files of a written table go with the write, whenever the driver collects garbage."""
    from aeroband.session import materialise
    kept = lambda: {b.toString() for b in _blocks(spark) if b.isShuffle() or "shuffle" in b.toString()}
    before = kept()
    df = spark.range(1000).selectExpr("id % 7 as k", "id").groupBy("k").count()
    out = materialise(df, "shuffle-files")
    assert not kept() - before
    assert out.count() == df.count() == 7 and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def _blocks(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return [found.apply(k) for k in range(found.length())]
