"""Near-duplicate groups by b-bit MinHash.

1. Each document's shingle set gives ``bands x rows`` minima.  Bands are hashed to bucket
   keys; of each minimum the low ``BITS`` bits are packed into a signature.
2. Documents of equal sets form a class, represented by its smallest doc_id; copies take no
   further part until the end.
3. A bucket's hub is the class that meets most others in all its buckets, which is close to
   the text its group was copied from.  Every other class of the bucket is paired with it.
   The signatures' equal lanes, corrected for accidental equality, estimate the similarity;
   in buckets of two, pairs whose estimate is six deviations short are dropped.  The others
   are measured on full sets: links, and how each class differs from its hub.
4. What is left are pairs of classes around one hub in different components.  Shingles come in
   one order for all, those that the fewest of these classes hold first, so the prefix that
   linked sets must share holds few common shingles, and a join on it, with length and
   positional bounds, names few pairs even in a group of any size, whether its texts differ by
   what they add or by what they lack.  These are confirmed on full sets as well.
   Pairs within one component need no check, so no link that matters is lost.

The number of bands follows from the threshold so that a pair at the threshold shares no
bucket with a probability under 1e-7.

Edge cases.  Null and empty texts have an empty set, are linked with nothing and kept.
Fewer words than a shingle: the whole sequence is one shingle.  Rows of one doc_id are one
document: where their texts differ, a link of one counts for all (rows without words keep to
themselves); each gets a row in the result.  A row
without doc_id keeps to itself: its component is null and it is kept.  Other columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from aeroband.llm import graph, sieve, text
from aeroband.session import materialise

ROWS = 5
BITS = 2
MISS = 1e-7
SPLIT = 256  # pairs of one hub that are measured together
RARE = 8  # a shingle of no more classes needs no levels of size


def bands_for(threshold: float, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold ** rows))


def lanes_least(threshold: float, count: int) -> int:
    """Fewest equal lanes at which a pair may still reach the threshold (six deviations)."""
    chance = 2.0 ** -BITS
    equal = chance + (1 - chance) * threshold
    return max(0, math.floor(count * equal - 6 * math.sqrt(count * equal * (1 - equal))))


def signature(shingles: np.ndarray, bands: int, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys, one a band, and the packed low bits of all minima as 64-bit values."""
    count = bands * rows
    rng = np.random.default_rng(7)
    salts = rng.integers(0, 1 << 32, (count, 1), dtype=np.uint64).astype(np.uint32)
    factors = rng.integers(0, 1 << 32, (count, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(count, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(short), 2048):
        np.minimum(least, (((short[None, k:k + 2048] ^ salts) * factors) ^ (salts >> np.uint32(7))).min(axis=1), out=least)
    grid = least.reshape(bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        keys = text.mix(keys + grid[:, k])
    lanes = 64 // BITS
    padded = np.zeros(-(-count // lanes) * lanes, np.uint64)
    padded[:count] = least & np.uint32((1 << BITS) - 1)
    shifts = (np.arange(lanes, dtype=np.uint64) * np.uint64(BITS))
    packed = np.bitwise_or.reduce(padded.reshape(-1, lanes) << shifts, axis=1)
    return keys.view(np.int64), packed.view(np.int64)


def fingerprint(shingles: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two hashes of a set."""
    if not len(shingles):
        return np.uint64(0), np.uint64(0)
    return np.add.reduce(text.mix(shingles)), np.bitwise_xor.reduce(text.mix(shingles + np.uint64(77)))


SIGNED = "doc_id long, n long, print_a long, print_b long, bits array<long>, keys array<long>"


def _sign(batches: Iterator[pa.RecordBatch], n: int, bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(1)):
            size, prints, bits, keys = [], [], [], []
            for shingles in text.shingle_sets(text.words(data, bounds, text.WHITE), n):
                size.append(len(shingles))
                prints.append(fingerprint(shingles))
                k, s = signature(shingles, bands) if len(shingles) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                keys.append(k)
                bits.append(s)
            pairs = np.array(prints, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(size, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                pa.array(bits, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "print_a", "print_b", "bits", "keys"])


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, bounds in text.slices(batch.column(1)):
            sets = list(text.shingle_sets(text.words(data, bounds, text.WHITE), n))
            pairs = np.array([fingerprint(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(a, b - a), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "print_a", "print_b", "n", "shingles"])


def _equal_lanes(count: int):
    """Column: lanes in which the arrays bits_u and bits_v agree."""
    ones = 0x5555555555555555
    differing = F.aggregate(
        F.zip_with("bits_u", "bits_v", lambda a, b: a.bitwiseXOR(b)), F.lit(0),
        lambda acc, z: acc + F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(ones))).cast("int"))
    return F.lit(count) - differing


def beside_hubs(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    """``pairs`` (u, v, ...) with ``side``'s value (by doc_id) of both ends.

    A hub's pairs are split into parts, each with its own copy of the hub's value.
    """
    degree = pairs.groupBy("u").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("__parts"))
    hubs = degree.join(side.select(F.col("doc_id").alias("u"), F.col(value).alias(f"{value}_u")), "u").withColumn(
        "__part", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1))).drop("__parts")
    spokes = pairs.join(degree, "u").withColumn("__part", F.pmod(F.xxhash64("v"), F.col("__parts")).cast("int")).drop("__parts")
    spokes = spokes.join(side.select(F.col("doc_id").alias("v"), F.col(value).alias(f"{value}_v")), "v")
    return spokes.join(hubs, ["u", "__part"]).drop("__part")


def _ratio(common, numerator: int, denominator: int):
    sizes = F.size("shingles_u") + F.size("shingles_v")
    return denominator * common >= numerator * (sizes - common)


def measured(spokes: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(u, v, crowded, linked) of spokes, from full sets."""
    both = beside_hubs(spokes, sets, "shingles")
    return both.select("u", "v", "crowded", _ratio(F.size(F.array_intersect("shingles_v", "shingles_u")), numerator, denominator).alias("linked"))


def necessary(spokes: DataFrame, parts: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(v, n, part, outside, at, shingle, met): the shingles at places ``at`` of each class's prefix that other classes hold.

    ``met`` classes hold the shingle.  Only classes of crowded buckets around a hub take part, and of hubs
    with a class in another component; ``outside`` tells those whose component is not that of every hub.
    """
    part = parts.withColumnRenamed("component", "part")
    known = spokes.filter("crowded").join(part.withColumnRenamed("node", "v"), "v", "left").withColumnRenamed("part", "own_part")
    known = known.join(part.withColumnRenamed("node", "u"), "u", "left").select("u", "v", F.coalesce("own_part", "v").alias("part"), (F.coalesce("own_part", "v") != F.coalesce("part", "u")).alias("outside"))
    nodes = known.join(known.filter("outside").select("u").distinct(), "u", "left_semi").groupBy("v", "part").agg(F.max("outside").alias("outside"))
    members = sets.withColumnRenamed("doc_id", "v").join(nodes, "v")
    held = materialise(members.select("v", F.explode("shingles").alias("shingle")), "minhash-held")
    met = held.groupBy("shingle").agg(F.count("*").alias("met")).filter("met > 1")
    shared = held.join(met, "shingle").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("met", "shingle"))).alias("shared"))
    n, alone = F.col("n"), F.col("n") - F.size("shared")  # shingles of no other class come first
    length = n - F.ceil(F.lit(numerator) * n / F.lit(denominator)).cast("int") + 1
    prefix = members.select("v", F.size("shingles").alias("n"), "part", "outside").join(shared, "v")
    prefix = prefix.select("v", "n", "part", "outside", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), F.greatest(length - alone, F.lit(0)))).alias("place", "s"))
    return prefix.select("v", "n", "part", "outside", (F.col("alone") + F.col("place")).alias("at"), "s.shingle", "s.met")


def across_parts(index: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Pairs (u, v) of ``necessary`` classes in different components that may reach the threshold."""
    t = numerator / denominator
    # Sizes of linked sets differ by a factor of 1/t at most: a probe meets three levels of that ratio.
    level = lambda n: F.floor(F.log(n) / math.log(max(1 / t, 1.04))).cast("int")
    n, rare = F.col("n"), F.col("met") <= RARE
    most = F.least(n / t, (n - F.col("at")) * (1 + t) / t - n)  # what follows in both sets bounds the other's size
    levels = F.when(rare, F.array(F.lit(-1))).when(most >= n * t - 1, F.sequence(level(F.greatest(n * t - 1, F.lit(1.0))), level(F.greatest(most + 1, n * t)))).otherwise(F.array().cast("array<int>"))
    probes = index.filter("outside").withColumn("level", F.explode(levels))
    index = index.withColumn("level", F.when(rare, -1).otherwise(level(n)))
    key = ["shingle", "level"]
    mixed = index.select(*key, "part").union(probes.select(*key, "part")).groupBy(*key).agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low <> high").select(*key)
    x, y = probes.join(mixed, key, "left_semi").alias("x"), index.join(mixed, key, "left_semi").alias("y")
    met = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in key]
    may = (F.col("x.part") != F.col("y.part")) & (~F.col("y.outside") | (F.col("x.v") < F.col("y.v"))) & (
        F.lit(numerator) * F.greatest("x.n", "y.n") <= F.lit(denominator) * F.least("x.n", "y.n")) & (
        (numerator + denominator) * F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at")) >= numerator * (F.col("x.n") + F.col("y.n")))
    return x.join(y, [*met, may]).select(F.least("x.v", "y.v").alias("u"), F.greatest("x.v", "y.v").alias("v")).distinct()


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """``parts`` (node, component) after further links (u, v): components of whole components."""
    ends = links.select("u", "v")
    for end in ("u", "v"):
        ends = ends.join(parts.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    merged = materialise(graph.components(ends), "minhash-joined").withColumnRenamed("component", "least")
    nodes = parts.unionByName(merged.select("node", F.col("node").alias("component"))).distinct()
    nodes = nodes.join(merged.withColumnRenamed("node", "component"), "component", "left")
    return nodes.select("node", F.coalesce("least", "component").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, class_id, component_id, kept.

    Sets are linked when ``denominator * |A and B| >= numerator * |A or B|``.  class_id is the
    smallest doc_id of equal sets, component_id the smallest one reachable over links.
    """
    text.lean(docs.sparkSession)
    threshold = numerator / denominator
    bands = bands_for(threshold)
    count = bands * ROWS
    least = lanes_least(threshold, count)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = materialise(texts.mapInArrow(partial(_sign, n=words, bands=bands), SIGNED), "minhash-signed")

    known = signed.filter("n > 0 and doc_id is not null")
    prints = ["print_a", "print_b", "n"]
    several = known.groupBy("doc_id").agg(F.min(F.struct(*prints)).alias("low"), F.max(F.struct(*prints)).alias("high"))
    several = materialise(several.filter("low <> high").select("doc_id"), "minhash-several")  # documents of several sets
    classes = known.groupBy(*prints).agg(F.min("doc_id").alias("first_id"))
    classes = classes.join(several.select(F.col("doc_id").alias("first_id"), F.lit(True).alias("several")), "first_id", "left")
    classes = materialise(classes.select(*prints, "first_id", F.when(F.col("several"), F.xxhash64(*prints)).otherwise(F.col("first_id")).alias("class_id")), "minhash-classes")
    heads = known.join(classes.select(*prints, F.col("first_id").alias("doc_id"), "class_id"), [*prints, "doc_id"]).dropDuplicates(["doc_id", *prints])
    heads = materialise(heads.select("class_id", "bits", "keys"), "minhash-heads")
    entries = heads.select("class_id", F.explode("keys").alias("key"))
    buckets = materialise(entries.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "minhash-buckets")
    shared = materialise(entries.join(buckets, "key"), "minhash-shared")
    weight = shared.groupBy("class_id").agg(F.sum("members").alias("weight"))
    hubs = shared.join(weight, "class_id").groupBy("key").agg(F.max(F.struct("weight", (-F.col("class_id")).alias("hub"))).alias("h"))
    hubs = materialise(hubs.select("key", (-F.col("h.hub")).alias("u")), "minhash-hubs")
    spokes = shared.join(hubs, "key").filter("class_id <> u").groupBy("u", F.col("class_id").alias("v")).agg((F.max("members") > 2).alias("crowded"))
    bits = heads.select(F.col("class_id").alias("doc_id"), "bits")
    spokes = beside_hubs(materialise(spokes, "minhash-met"), bits, "bits").filter((_equal_lanes(count) >= least) | F.col("crowded")).select("u", "v", "crowded")
    spokes = materialise(spokes, "minhash-spokes")

    involved = spokes.select("u").union(spokes.select("v")).distinct().withColumnRenamed("u", "class_id")
    involved = materialise(classes.join(involved, "class_id").withColumnRenamed("first_id", "doc_id"), "minhash-involved")
    # The sieve lets some others through; their sets go in the join, so texts themselves are not shuffled.
    candidates = sieve.sifted(texts, "doc_id", sieve.bitmap(involved, "doc_id")).filter("__maybe").select("doc_id", "text")
    sets = candidates.mapInArrow(partial(_sets, n=words), "doc_id long, print_a long, print_b long, n long, shingles array<long>")
    sets = sets.join(involved, ["doc_id", *prints]).dropDuplicates(["doc_id", *prints])
    sets = materialise(sets.select(F.col("class_id").alias("doc_id"), "shingles"), "minhash-sets")
    spokes = materialise(measured(spokes, sets, numerator, denominator), "minhash-measured")
    links = spokes.filter("linked").select("u", "v")
    tied = not several.isEmpty()
    if tied:  # a document's sets hold together
        own = materialise(known.join(several, "doc_id", "left_semi").join(classes, prints).select("doc_id", F.col("class_id").alias("u")).distinct(), "minhash-own")
        links = links.unionByName(own.join(own.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").select("u", "v"))
    parts = materialise(graph.components(links), "minhash-parts")

    index = materialise(necessary(spokes, parts, sets, numerator, denominator), "minhash-prefixes")
    more = materialise(across_parts(index, numerator, denominator), "minhash-more")
    more = materialise(beside_hubs(more, sets, "shingles").filter(_ratio(F.size(F.array_intersect("shingles_v", "shingles_u")), numerator, denominator)).select("u", "v"), "minhash-links")
    if not more.isEmpty():
        parts = materialise(joined(parts, more), "minhash-parts")

    reached = classes.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component_id", F.coalesce("component", "class_id"))
    if tied:  # then classes are not all named by their smallest document
        least = reached.groupBy("component_id").agg(F.min("first_id").alias("least_id"))
        reached = reached.join(least, "component_id").withColumn("component_id", F.col("least_id"))
    reached = materialise(reached.select(*prints, F.col("first_id").alias("class_id"), "component_id"), "minhash-reached")
    grouped = known.select("doc_id", *prints).join(reached, prints)
    alone = signed.filter("n = 0 or doc_id is null").select("doc_id", *prints, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, words: int = 5, numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Rows of ``docs`` without those whose group has a smaller doc_id; one row of each doc_id in a group."""
    found = near_duplicates(docs, words, numerator, denominator)
    gone = materialise(found.filter("not kept").select("doc_id").distinct(), "minhash-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
