"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from aeroband.llm import decontaminate, langid, lines, minhash, mixing, packing, phrases, search, tokenfiles, topk, toxicity, urls, warc
from aeroband.session import table


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file, on driver and executors alike."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, numerator=85, denominator=100)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.repeated(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", "spans", "text")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.categories())
    return toxicity.score(docs, chain).select("row.doc_id", "p_junk", "p_toxic", F.col("is_toxic").alias("toxic"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 1, F.lit(False))
    net = langid.train(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, shards = tokenfiles.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end=2)
    return tokenfiles.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=1))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), first=2000, least=100, longest=5, kept=100)


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    found = mixing.allocated(docs, F.col("size"), weights=(5, 2, 1), share=1.5, most=2)
    return found.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_warc, op3_exact_top_k, op4_toxicity, op5_language_id, op6_token_id_output, op7_url_filters,
    op8_benchmark_decontamination, op9_line_dedup, op10_packing, op11_phrase_collocations, op12_source_mixing, op13_ranked_search)}
#: A-Z lower-cased, and nothing else.
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL: dict[str, str] = {
    "op3_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
              FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_warc": """
        WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS d, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        f AS (SELECT d, min(page_id) AS response FROM p WHERE n >= 100 GROUP BY d)
        SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
               CASE WHEN page_id > response THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > response THEN response END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND n >= 100""",
    "op11_phrase_collocations": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        i AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
        s AS (SELECT lang, ws, i, unnest(range(1, least(5, len(ws) - i + 1) + 1)) AS k FROM i),
        g AS MATERIALIZED (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
        c AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM g WHERE k > 1),
        e AS (SELECT *, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
        u AS (SELECT e.*, l.a AS l, r.a AS r, CAST((CAST(1000 AS HUGEINT) * e.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score, n.n
              FROM e JOIN n ON n.lang = e.lang JOIN g AS l ON l.lang = e.lang AND l.phrase = e.head JOIN g AS r ON r.lang = e.lang AND r.phrase = e.tail),
        b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
        x AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.k > b.k AND 100 * c.a >= 100 * b.a
                                                AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))),
        o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM x)
        SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""",
    "op12_source_mixing": r"""
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight, CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM s) AS budget FROM s),
        f AS (SELECT *, coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
                     sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER o AS turn
              FROM w WINDOW o AS (ORDER BY CAST(2 * source_size AS DOUBLE) / weight, place)),
        v AS (SELECT arg_min((budget - CAST(filled AS DOUBLE)) / rest, turn) AS level FROM f WHERE (budget - CAST(filled AS DOUBLE)) / rest * weight < 2 * source_size),
        t AS (SELECT source, source_size, least(CAST(2 * source_size AS DOUBLE), coalesce(level, 0) * weight) AS target,
                     CAST('0x' || substr(md5(CASE WHEN source IS NULL THEN 'mix:null' ELSE 'mix:=' || source END), 1, 8) AS HUGEINT) * 256 AS u FROM w, v),
        k AS (SELECT d.doc_id, size, source_size, target, u,
                     CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * CAST(1099511627776 AS DOUBLE)) AS HUGEINT) ELSE 0 END AS rate,
                     row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) - 1 AS rank
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(size * ((u + (rank + 1) * rate) // 1099511627776 - (u + rank * rate) // 1099511627776) AS BIGINT) AS taken FROM k""",
    "op13_ranked_search": rf"""
        WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        d AS (SELECT doc_id, ws, len(ws) AS n FROM t WHERE len(ws) > 0),
        c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(ws) AS term FROM d) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, c GROUP BY term, docs),
        s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
              FROM q JOIN p USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
}
