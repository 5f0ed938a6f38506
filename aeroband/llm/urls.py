"""Verdicts on URLs: suffix rules first, mined association rules for the rest.

Host and path follow the text alone.  A written rule (host, path) fits its host and all
subdomains if the path starts with the rule's; the longest wins.  Every other URL is judged
by token combinations that FP-growth finds in labelled URLs: baskets hold a URL's tokens and
its label, and of the itemsets those ending in a block label make rules, pruned by support,
confidence, lift and by shorter rules that are as sure.  Tokens that the same examples hold
are one item, and a set takes one host suffix at most, so deep hosts don't multiply sets.
Rules are looked up through an inverted index from their rarest token; one whose tokens are
all met blocks.  Everything runs in DataFrame operations.

A page's label is that of the document its URL numbers (the first all-digit path segment):
bad if toxic or of quality 0.

Edge cases.  A null URL, or one without ``://``, has empty host and path and no tokens, so
it is allowed.  Repeated rows are judged each; rows without page_id too.  Without labels
there are no mined rules.  Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from aeroband.session import materialise

#: Written rules (verdict, host, path).  Fixed values.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

SUPPORT = 0.002
CONFIDENCE = 0.6
LIFT = 1.5
BAD = "label:bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host, its suffixes, path segments with numbers as #, query keys, ending."""
    h, p = host(url), path(url)
    labels = F.split(h, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -k, k), ".")))
    segments = F.transform(F.filter(F.split(p, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path:"), F.regexp_replace(s, "[0-9]+", "#")))
    query = F.regexp_extract(url, r"(?s)://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("key:"), F.regexp_extract(s, "(?s)^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "(?s)^(.*?)://", 1)))
    every = F.array_distinct(F.concat(scheme, suffixes, segments, keys))
    return F.when(h != "", every).otherwise(F.array().cast("array<string>"))


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path)."""
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` (host, path, ...) with rule and rule_verdict of the longest rule that fits.

    The rules stand in the expression, grouped by host: of a page's host suffixes those
    named by a rule are looked up in a map, so no row is multiplied or moved.
    """
    by_host: dict[str, list[tuple[str, str]]] = {}
    for verdict, h, p in rules:
        by_host.setdefault(h, []).append((p, verdict))
    entries = [x for h, own in by_host.items() for x in (F.lit(h), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")) for p, v in own]))]
    index = F.create_map(*entries)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    met = F.flatten(F.transform(suffixes, lambda s: F.coalesce(index[s], F.array().cast("array<struct<path:string,verdict:string,rule:string>>"))))
    fits = F.filter(met, lambda r: F.startswith(F.col("path"), r["path"]))
    longest = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return pages.withColumn("__r", F.when(F.col("host") != "", longest)).select(*pages.columns, F.col("__r.rule").alias("rule"), F.col("__r.verdict").alias("rule_verdict"))


def labelled(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of pages whose URL numbers a labelled document."""
    number = F.regexp_extract("path", "/([0-9]{1,18})(?![^/.])", 1)
    numbered = pages.select(F.when(number != "", number.cast("long")).alias("doc_id"), tokens(F.col("url")).alias("tokens")).filter("doc_id is not null")
    bad = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False))).alias("bad"))
    return numbered.join(bad, "doc_id").select("tokens", "bad")


def groups(examples: DataFrame, support: float) -> DataFrame:
    """(token, rep, n) of the tokens that ``support`` of all examples hold.

    Tokens held by the same examples, like the parts of one deep host, are one item for mining:
    ``rep`` names them all, the shortest host suffix first.  There are no more than some tokens
    of a URL divided by the support."""
    least = F.ceil(examples.agg(F.count("*")).scalar() * F.lit(support))
    held = examples.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b")).filter(F.col("n") >= least)
    held = materialise(held, "url-tokens")
    first = F.struct((~F.startswith(F.col("token"), F.lit("host:"))).alias("other"), F.length("token").alias("length"), "token")
    reps = held.groupBy("n", "a", "b").agg(F.min(first).alias("first")).select("n", "a", "b", F.col("first.token").alias("rep"))
    return materialise(held.join(reps, ["n", "a", "b"]).select("token", "rep", "n"), "url-groups")


def mined_rules(examples: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, found: DataFrame | None = None) -> DataFrame:
    """(rule_id, tokens, confidence, support) of token sets whose pages are mostly bad; of tokens held
    by the same examples, the first stands for all.

    A host suffix holds all shorter ones, so sets need one host token at most.  Baskets are
    mined with none, and once for each length of suffix with those of that length; tokens
    carry the length, so one run mines all."""
    examples = examples if "row" in examples.columns else numbered(examples)
    found = groups(examples, support) if found is None else found
    total, share = examples.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    items = examples.select("row", "bad", F.explode("tokens").alias("token")).join(found, "token").groupBy("row", "bad").agg(F.collect_set("rep").alias("reps"))
    is_host = lambda t: F.startswith(t, F.lit("host:"))
    length = lambda t: F.size(F.split(t, r"\."))
    levels = F.concat(F.array(F.lit(0)), F.array_distinct(F.transform(F.filter("reps", is_host), length)))
    copies = items.select("bad", "reps", F.explode(levels).alias("level"))
    kept = F.filter("reps", lambda t: ~is_host(t) | (length(t) == F.col("level")))
    kept = F.when(F.col("bad"), F.concat(kept, F.array(F.lit(BAD)))).otherwise(kept)
    baskets = materialise(copies.select(F.transform(kept, lambda t: F.concat(F.col("level").cast("string"), F.lit("|"), t)).alias("items")), "url-baskets")
    rows = baskets.count()
    if not rows or not share:
        return examples.limit(0).select(F.lit(0).cast("long").alias("rule_id"), "tokens", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    model = FPGrowth(itemsCol="items", minSupport=(math.ceil(support * total) - 0.5) / rows, minConfidence=confidence).fit(baskets)
    level = F.split(F.element_at("consequent", 1), r"\|", 2)
    plain = F.array_sort(F.transform("antecedent", lambda t: F.element_at(F.split(t, r"\|", 2), 2)))
    rules = model.associationRules.filter((F.element_at(level, 2) == BAD) & (F.col("confidence") / share >= lift))
    rules = rules.select(plain.alias("tokens"), "confidence", (F.col("support") * rows / total).alias("support"), F.element_at(level, 1).alias("level"))
    rules = rules.filter((F.col("level") == "0") | F.exists("tokens", is_host)).drop("level")
    rules = materialise(rules, "url-rules").withColumn("rule_id", F.xxhash64("tokens"))
    shorter = rules.select(F.col("tokens").alias("inner"), F.col("confidence").alias("sure"), F.explode("tokens").alias("token"))
    longer = rules.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("token")).join(shorter, "token")
    needless = longer.filter((F.size("inner") < F.size("tokens")) & (F.size(F.array_except("inner", "tokens")) == 0) & (F.col("sure") >= F.col("confidence"))).select("rule_id").distinct()
    return rules.join(needless, "rule_id", "left_anti")


def numbered(examples: DataFrame) -> DataFrame:
    """Written examples with the number of their row."""
    return materialise(examples, "url-examples").withColumn("row", F.monotonically_increasing_id())


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence): confidence of the mined rule that blocked, if one did.

    A rule is found under its rarest token and then compared with all tokens of the URL."""
    base = ruled(parsed(pages), rules)
    examples = numbered(labelled(parsed(pages), labels))
    found = groups(examples, SUPPORT)
    mined = materialise(mined_rules(examples, found=found), "url-mined")
    counts = found.groupBy("rep").agg(F.max("n").alias("n"))
    index = mined.select("rule_id", "tokens", "confidence", F.explode("tokens").alias("rep")).join(counts, "rep")
    index = index.groupBy("rule_id").agg(F.min(F.struct("n", "rep")).alias("key"), F.first("tokens").alias("tokens"), F.first("confidence").alias("confidence"))
    index = materialise(index.select(F.col("key.rep").alias("rep"), F.col("tokens").alias("needed"), "confidence"), "url-index")
    open_urls = base.filter("rule is null and host <> ''").select("url").distinct()
    held = open_urls.withColumn("token", F.explode(tokens(F.col("url")))).join(found, "token").groupBy("url").agg(F.collect_set("rep").alias("reps"))
    met = held.withColumn("rep", F.explode("reps")).join(index, "rep").filter(F.size(F.array_except("needed", "reps")) == 0)
    blocked = met.groupBy("url").agg(F.max("confidence").alias("confidence"))
    open_rows = base.filter("rule is null and host <> ''").join(blocked, "url", "left")
    rest = base.filter("rule is not null or host = ''").withColumn("confidence", F.lit(None).cast("double"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return open_rows.select(*rest.columns).unionByName(rest).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
