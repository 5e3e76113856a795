"""Variants of terms, and the thesaurus that merges them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import canonical_term


def term_counts(inc: DataFrame) -> DataFrame:
    """key, label, n: distinct documents of each term."""
    return inc.groupBy("key").agg(F.min_by("label", F.struct("doc", "pos")).alias("label"), F.count_distinct("doc").alias("n"))


def variant_groups(counts: DataFrame) -> DataFrame:
    """(key, label, n) -> canon, target, members, n: terms that differ by hyphens, spelling or plural; the most frequent leads, then the shorter."""
    x = counts.withColumn("canon", canonical_term(F.col("key")))
    lead = F.max_by("key", F.struct("n", -F.length("key"), "key"))
    groups = x.groupBy("canon").agg(lead.alias("target"), F.array_sort(F.collect_set("key")).alias("members"), F.sum("n").alias("n"))
    return groups.where(F.size("members") > 1)


def acronym_pairs(counts: DataFrame) -> DataFrame:
    """long, short: terms written `long form (ABBR)` and the term ABBR."""
    paren = counts.select(F.col("key").alias("long"), F.lower(F.regexp_extract("label", r"\(([A-Za-z0-9]{2,8})\)\s*$", 1)).alias("short")).where("short <> ''")
    return paren.join(counts.select(F.col("key").alias("short")), "short").select("long", "short")


def typo_pairs(counts: DataFrame, shortest: int = 8) -> DataFrame:
    """a, b: terms one edit apart, of eight letters or more, that begin alike and do not differ in a digit.

    Each term is filed under itself with every letter left out in turn; terms one edit apart meet under at least one of
    these, so the join is an equi-join whose size grows with the terms and not with their pairs.
    """
    long = counts.where(F.length("key") >= shortest).select("key")
    cuts = F.transform(F.sequence(F.lit(0), F.length("key")), lambda i: F.when(i == 0, F.col("key")).otherwise(F.concat(F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.length("key")))))
    filed = long.select("key", F.explode(F.array_distinct(cuts)).alias("cut"))
    both = filed.select(F.col("key").alias("a"), "cut").join(filed.select(F.col("key").alias("b"), "cut"), "cut").where("a < b").select("a", "b").distinct()
    both = both.where((F.levenshtein("a", "b") == 1) & (F.substring("a", 1, 1) == F.substring("b", 1, 1)))
    return both.where(F.regexp_replace("a", "[^0-9]", "") == F.regexp_replace("b", "[^0-9]", ""))


def merge_terms(thesaurus: DataFrame, groups: DataFrame) -> DataFrame:
    """The thesaurus with each group's other members renamed to its target; new entries win."""
    new = groups.select(F.explode("members").alias("key"), F.col("target").alias("replace_by")).where("key <> replace_by")
    return thesaurus.join(new, "key", "left_anti").select("key", "replace_by").unionByName(new)


def existing_only(proposals: DataFrame, counts: DataFrame) -> DataFrame:
    """Proposed merges (key, replace_by) of terms that the corpus holds."""
    return proposals.join(counts.select("key"), "key", "left_semi")
