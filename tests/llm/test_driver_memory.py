"""What the driver's own process keeps, and how many tables it has written for components."""

import random
import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

from aeroband import session
from aeroband.llm import decontaminate, encode, graph, packing, toxicity


def test_packing_loads_no_tokenizer(spark, monkeypatch):
    monkeypatch.setattr(encode, "_encoders", {})
    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "x " * 300)], "doc_id long, text string")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        rows = packing.pack(docs, public_tokenizers.path(name), limit=64).collect()
        assert not encode._encoders
        assert all(len(r.ids) == 4 * r.length for r in rows) and {r.doc_id for r in rows} == {1, 2, 3}


@pytest.mark.skipif(sys.platform != "linux" or not Path("/proc/self/smaps_rollup").exists(), reason="reads /proc")
def test_freed_memory_goes_back():
    held = lambda: int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024
    arrays = [np.ones(8000) for _ in range(2000)]  # 122 MB in parts that the allocator keeps
    last = np.ones(8000)  # above them
    full = held()
    arrays.clear()
    session.release()
    assert held() < full - 100 and last.all()


def test_driver_work_ends_with_release(spark, monkeypatch):
    calls = []
    for module in (toxicity, decontaminate):
        monkeypatch.setattr(module, "release", lambda m=module: calls.append(m))
    docs = spark.createDataFrame([(k, f"word{k} other text") for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, k % 3 % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, labels, toxicity.categories())
    decontaminate.mark(docs, spark.createDataFrame([("a", "word1 other text")], "item_id string, text string"))
    assert calls == [toxicity, decontaminate]


def reached(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for u, v in links:
        if u is not None and v is not None and u != v:
            low, high = sorted((find(u), find(v)))
            root[high] = low
    return {x: find(x) for x in root}


def test_components_end_with_stars(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "materialise", lambda df, label, f=session.materialise: (written.append(label), f(df, label))[1])

    def components(links):
        written.clear()
        rows = graph.components(spark.createDataFrame(links, "u long, v long")).collect()
        assert len(rows) == len({r.node for r in rows})
        return {r.node: r.component for r in rows}

    rng = random.Random(5)
    stars = [(k % 3, k) for k in range(3, 40)] + [(7, 1), (4, None), (None, 4), (9, 9), (1, 7)]
    assert components(stars) == reached(stars) and len(written) == 1  # nothing is left to do
    chain = [(k, k + 1) for k in range(12)]
    mixed = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    tails = [(k, 50 - k) for k in range(20)] + [(50, 49), (60, 31), (60, 70)]
    for links in (chain, mixed, tails, chain + [(20, 3), (21, 20)]):
        assert components(links) == reached(links)
    assert components([]) == {} and components([(None, 3), (2, 2)]) == {}
