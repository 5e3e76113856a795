"""Operator 9, quality rules: per-text rules, and verdicts on hosts from shrunken failure rates, all in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.plans.staging import stage

# Fixed values.
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"


def _count(text: Column, characters: str) -> Column:
    """How many of the given ASCII characters a text holds."""
    left = text
    for c in characters:
        left = F.replace(left, F.lit(c), F.lit(""))
    return (F.octet_length(text) - F.octet_length(left)).cast("long")


def text_rules(docs: DataFrame, host: str = "source", min_words: int = 50, max_repeats: int = 50) -> DataFrame:
    """documents -> doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    Every count covers the whole text; a null text has no words. Repeats are found by hashing each window of three
    words and sorting a text's hashes with their places: neighbours that agree are repeats. Texts without a repeated
    hash skip the sort.
    """
    has = lambda line: line.rlike(r"[^\x20\x09-\x0D]")
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    x = x.withColumn("w", F.filter(F.split("text", _SPACE), lambda w: w != ""))
    x = x.withColumn("lines", F.filter(F.split("text", "\n"), has))
    x = x.withColumn("n", F.size("w"))
    steps = F.when(F.col("n") >= 3, F.sequence(F.lit(1), F.col("n") - 2)).otherwise(F.array().cast("array<int>"))
    x = x.withColumn("h", F.transform(steps, lambda i: F.xxhash64(F.element_at("w", i), F.element_at("w", i + 1), F.element_at("w", i + 2))))
    pairs = F.array_sort(F.arrays_zip(F.col("h"), steps.alias("i")))
    x = x.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs))
    same = lambda a, b: F.get(F.col("s"), a)["h"] == F.get(F.col("s"), b)["h"]
    twice = F.filter(F.col("s"), lambda e, k: F.coalesce(same(k, k - 1), F.lit(False)) | F.coalesce(same(k, k + 1), F.lit(False)))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
    out = x.select(
        "doc_id", "host", F.col("n").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"), _count(F.col("text"), _SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.when(F.col("s").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeats * F.col("n_words")))


def host_verdicts(checked: DataFrame, most: float = 0.5) -> DataFrame:
    """doc_id, host, base_failed -> host, docs, failed, rate, host_kept.

    A host's failure rate is shrunk towards the rate of all, by a beta prior whose strength is fitted to the hosts by
    moments: with mean m and variance v of the hosts' rates, alpha + beta = m(1-m)/v - 1, within 1 and 10,000. A host
    is kept while (failed + alpha) / (docs + alpha + beta) is at most `most`; a single bad page cannot condemn one.
    A null host is a host of its own.
    """
    hosts = checked.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("docs")
    prior = hosts.agg((F.sum("failed") / F.sum("docs")).alias("m"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias("v"))
    strength = F.greatest(F.lit(1.0), F.least(F.lit(10_000.0), F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(10_000.0)))
    # the prior is one row, an aggregate without keys, so this broadcast has a fixed size
    shrunk = hosts.join(F.broadcast(prior.select("m", strength.alias("k")))).select("host", "docs", "failed", ((F.col("failed") + F.col("m") * F.col("k")) / (F.col("docs") + F.col("k"))).alias("rate"))
    return shrunk.withColumn("host_kept", F.col("rate") <= most)


def quality_rules(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """documents -> doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate.

    A document is kept if it passes the base rules and its host's verdict is good. Counts of a document are staged
    once, without texts; hosts are aggregated before any shuffle, and verdicts join back on the host with a salt, so a
    host with a third of all rows is spread over tasks. Repeated rows stay; an empty table gives no rows.
    """
    checked = stage(text_rules(docs, host), "rules")
    salts = 16
    verdicts = host_verdicts(checked, most).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"), "host_kept", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = checked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(salts)).cast("int"))
    joined = salted.join(verdicts, salted.host.eqNullSafe(verdicts.h) & (salted.salt == verdicts.salt))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_rate")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), x AS (
  SELECT r, doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d
), g AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM x WHERE len(w) >= 3)
), g2 AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM g) WHERE n > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g2) GROUP BY r
), c AS (
  SELECT x.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda q: length(q))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM x LEFT JOIN rep ON rep.r = x.r
), f AS (
  SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM c
), h AS (
  SELECT source, count(*) AS docs, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM f GROUP BY source
), p AS (
  SELECT m, greatest(1.0, least(10000.0, CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 10000.0 END)) AS k
  FROM (SELECT CAST(sum(failed) AS DOUBLE) / sum(docs) AS m, coalesce(var_pop(CAST(failed AS DOUBLE) / docs), 0.0) AS v FROM h)
), v AS (
  SELECT source, (failed + m * k) / (docs + k) AS host_rate FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_rate <= 0.5) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
