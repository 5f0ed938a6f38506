"""Documents to packed training sequences, stage by stage.

Each stage reads what the one before it wrote.  Rows of documents lose what the stage's
operator rejects: toxic documents, passages that earlier documents hold (a document of
which nothing is left goes), all but one of each near-duplicate group (five-word shingles,
similarity of 0.8 or more), and documents with benchmark passages.  The last stage packs
token ids into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aeroband.llm import decontaminate, lines, minhash, packing, queries, toxicity
from aeroband.session import materialise, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicated(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs, words=5, numerator=80, denominator=100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"), end=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", cut_repeats),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Trained models, tokenizers and set joins have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
