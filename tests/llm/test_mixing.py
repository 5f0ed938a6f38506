"""Mixes against the registered SQL, their targets and their bounds."""

from collections import Counter, defaultdict

from aeroband.llm import mixing, queries
from compare import _rows, connect
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_query(spark):
    df, con = queries.op12_source_mixing(spark, SF), connect(SF)
    cur = con.execute(queries.SQL["op12_source_mixing"])
    assert _rows(df.columns, df.collect()) == _rows([c[0] for c in cur.description], cur.fetchall())


def brute_targets(sizes, weights, share, most):
    """Shared again and again until no source is over its limit."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in open_}
        out |= {s: most * sizes[s] for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_targets_and_bounds(spark):
    rows = [(k, "w " * (1 + k * k % 97), f"s{k % 7}" if k % 11 else None) for k in range(900)]
    rows += [(2000 + k, "w " * 5, "a") for k in range(3000)] + [(9000, "w " * 4000, "s1"), (9001, None, "s2"), (9002, "", "none"), (None, "w w", "a"), (5, "w", "a"), (5, "w", "a")]
    df = spark.createDataFrame([(i, t, s, 7) for i, t, s in rows], "doc_id long, text string, source string, size int")
    out = mixing.allocated(df, mixing.n_words(F.col("text"))).collect()
    assert len(out) == len(rows)
    sizes, taken, longest, target = Counter(), Counter(), defaultdict(int), {}
    for r in out:
        s = r.row.source
        sizes[s] += r["size"]
        taken[s] += r.copies * r["size"]
        longest[s] = max(longest[s], r["size"])
        target[s] = r.target
        assert 0 <= r.copies <= 2
    assert all(r.source_size == sizes[r.row.source] for r in out)
    want = brute_targets(sizes, mixing.WEIGHTS, 1.5, 2)
    assert target.keys() == want.keys() and all(abs(target[s] - want[s]) <= 1e-6 * (1 + want[s]) for s in want)
    assert abs(sum(target.values()) - 1.5 * sum(sizes.values())) < 1e-3
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in sizes)
    again = mixing.allocated(df.repartition(5), mixing.n_words(F.col("text"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    texts = mixing.mixed(df)
    assert texts.columns == df.columns
    assert Counter(r.doc_id for r in texts.collect()) == Counter({k: v for k, v in sum((Counter({r.row.doc_id: r.copies}) for r in out), Counter()).items() if v})


def test_edges(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.allocated(spark.createDataFrame([], schema), F.lit(1)).collect() == []
    nothing = spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)
    assert {(r.row.doc_id, r.target, r.copies) for r in mixing.allocated(nothing, mixing.n_words(F.col("text"))).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}
