"""Encoded, stored and packed ids against the tokenizer itself."""

import zlib

import duckdb
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from aeroband.llm import packing, queries, tokenfiles
from aeroband.llm.encode import Encoder

SF = "/root/testdata/sf0.001"
ODD = ["a  b", "\n\na b", " x", "x ", "a\tb c d", "a \n b", "it's don't 're", "a\x1cb c", "a\xa0b c", "é \xe9", "<|endoftext|> hi", "a <|endoftext|> b", "A b<|ENDOFTEXT|> c. <|startoftext|>", "Hello,world. ok! 12.5 3,4 x.",
       "　a b", "Σας ΣΑΣ. ΟΔΟΣ", "a\r\nb c", "x..", "x.. y", "ﬁ. Ǆ, İ. İ", "a​. b", "“q”. …", "", "a\n\nb. c\n", "\x85a b", "ñ. n", "日本. 語,", " .", "a ,b", "É. ÉA ßß", "word 'll", "a" * 9000]


def plain(name, texts, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_equals_tokenizer():
    texts = [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + ODD
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        coder = Encoder(public_tokenizers.path(name))
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts, 2)] == plain(name, texts, 2)


def test_forgetful_encoder(monkeypatch):
    from aeroband.llm import encode
    monkeypatch.setattr(encode, "KEPT", 40)
    texts = [" ".join(f"wo{k * j % 97}rd." for k in range(60)) for j in range(20)]
    coder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):
        assert [np.frombuffer(x, coder.dtype).tolist() for x in coder.encode(texts, 2)] == plain("byte_bpe_50k.json", texts, 2)


def check_files(got, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids, start, want = plain("byte_bpe_50k.json", [t for _, t in rows], 2), 0, []
    for (i, _), x in zip(rows, ids):
        want.append((i, start, len(x), crc(x)))
        start += len(x)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)


def test_token_files(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    check_files(queries.op6_token_id_output(spark, SF).collect(), rows)


def test_token_files_edges(spark):
    from pyspark.sql import functions as F
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "again"), (3, "again"), (None, "no id"), (50, None)]
    df = spark.createDataFrame([(i, t, b"") for i, t in rows], "doc_id long, text string, ids binary")
    path = public_tokenizers.path("byte_bpe_50k.json")
    _, shards = tokenfiles.write(df, path)
    check_files(tokenfiles.read(shards).withColumn("ids_crc32", F.crc32("ids")).collect(), rows)
    found = 0
    for r in shards.collect():
        shard = tokenfiles.Shard(r.path)
        for k in shard.find(3):
            found += 1
            assert shard.ids(k).tolist() in plain("byte_bpe_50k.json", [ODD[3], "again"], 2)
    assert found == 3
    assert tokenfiles.read(tokenfiles.write(df.limit(0), path)[1]).collect() == []


def check_pieces(got, rows, limit, most_padding):
    texts = plain("word_bpe_49k.json", [t for _, t in rows], 1)
    kept = {}
    for r in got:
        kept.setdefault(r.doc_id, []).append(r)
    assert set(kept) == {i for i, _ in rows}
    for (i, _), ids in zip(rows, texts):
        at = 0
        for r in sorted(kept[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= limit and set(ends) == set(range(len(ends)))
    assert sum(limit - e for e in ends.values()) <= most_padding


def test_packing(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    check_pieces(queries.op10_packing(spark, SF).collect(), rows, 2048, 2047)


def test_packing_edges(spark):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(50, None), (51, "a " * 3000), (52, "a " * 63), (53, "a " * 64)] + [(k, "b " * 40) for k in range(100, 160)] + [(None, "no id")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, offset int").repartition(5)
    path = public_tokenizers.path("word_bpe_49k.json")
    check_pieces(packing.with_digest(packing.pack(df, path, limit=64)).collect(), rows, 64, 63)
    assert packing.pack(df.limit(0), path).collect() == []
    twice = packing.pack(spark.createDataFrame([(1, "x y"), (1, "x y")], "doc_id long, text string"), path)
    assert [(r.doc_id, r.length) for r in twice.collect()] == [(1, 3), (1, 3)]
