"""Operator 2, document fingerprints: a canonical exact digest, all in DataFrame functions.

A text's canonical form is NFKC, full case folding, NFKC again, white space folded to single spaces and trimmed. Its
fingerprint is two independent XXH64, 32 hexadecimal digits. Digests only choose buckets: inside a bucket canonical
texts are compared byte by byte, so texts that differ never fall together.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.plans.staging import stage

_SPACES = r"[\s\p{Z}\x{85}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty. Normalisation and case folding are ICU's, called in the JVM."""

    def icu(kind: str, method: str, x: Column, flag: bool) -> Column:
        return F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), x, F.lit(flag))

    x = icu("text.Normalizer", "compose", F.coalesce(text, F.lit("")), True)
    x = icu("text.Normalizer", "compose", icu("lang.UCharacter", "foldCase", x, True), True)
    return F.trim(F.regexp_replace(x, _SPACES, " "))


def digest(canon: Column) -> Column:
    """128 bits of a canonical text as 32 hexadecimal digits: XXH64 with two seeds."""
    word = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(word(F.xxhash64(canon)), word(F.xxhash64(F.lit("second"), canon)))


def likeness(a: Column, b: Column, canon_a: Column, canon_b: Column) -> Column:
    """1.0 if two fingerprints are equal and so are the canonical texts, byte by byte; else 0.0. Texts are only read when fingerprints agree."""
    return F.when(a == b, F.when(canon_a == canon_b, 1.0).otherwise(0.0)).otherwise(0.0)


def exact_groups(docs: DataFrame, small: int = 200_000) -> DataFrame:
    """documents -> doc_id, fp, group_id: the smallest doc_id whose text has the same canonical form.

    Digests of all rows are aggregated first; only rows in buckets of two or more are looked at again, where a second
    aggregation by digest and text compares bytes and, being partial before its shuffle, sends each copy's text once a
    task. Buckets go to the readers by broadcast if they are at most `small`, else by a shuffled join. A null doc_id is
    kept and names no group; repeated rows stay.
    """
    each = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(canonical(F.col("text").cast("string"))).alias("fp")), "digests")
    return _grouped(docs, each, small)


def _grouped(docs: DataFrame, each: DataFrame, small: int) -> DataFrame:
    buckets = each.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("group_id"))
    shared = stage(buckets.where("n > 1").select("fp"), "buckets")
    few = shared.count() <= small
    canon = canonical(F.col("text").cast("string"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canon.alias("canon")).withColumn("fp", digest(F.col("canon")))
    texts = texts.join(F.broadcast(shared) if few else shared, "fp", "left_semi")
    classes = stage(texts.groupBy("fp", "canon").agg(F.min("doc_id").alias("first")).groupBy("fp").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("fp"), "collisions")
    named = each.join(buckets.select("fp", "group_id"), "fp")
    if not classes.take(1):
        return named.select("doc_id", "fp", "group_id")
    # digests that different texts share: their rows alone are grouped by the text itself
    split = texts.join(classes, "fp", "left_semi")
    firsts = split.groupBy("fp", "canon").agg(F.min("doc_id").alias("first"))
    own = split.join(firsts, ["fp", "canon"]).select("fp", "doc_id", F.col("first").alias("own")).distinct()
    return named.join(own, ["fp", "doc_id"], "left").select("doc_id", "fp", F.coalesce("own", "group_id").alias("group_id"))


def _search(values: list[int], x: Column) -> Column:
    """How many of the sorted values are less than x: binary search over a literal array."""
    steps = max(1, math.ceil(math.log2(len(values) + 1)))
    bounds = F.array(*[F.lit(v).cast("long") for v in values])
    lo_hi = F.struct(F.lit(0).alias("lo"), F.lit(len(values)).alias("hi"))

    def halve(s: Column, _: Column) -> Column:
        mid = ((s["lo"] + s["hi"]) / 2).cast("int")
        less = F.element_at(bounds, F.least(mid, F.lit(len(values) - 1)) + 1) < x
        go = s["lo"] < s["hi"]
        return F.struct(F.when(go & less, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(go & ~less, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), lo_hi, halve, lambda s: s["lo"])


def with_next(docs: DataFrame, columns: list[str], group_rows: int = 2000, most_groups: int = 4096) -> DataFrame:
    """Each row with the `columns` of the next document in descending doc_id, as next_*; after the last comes the first.

    One shuffle: doc_ids are cut into at most most_groups ranges of equal counts, whose upper ends are ids of the
    table. Each range is one window, and the row at its upper end goes along into the range above, behind all others,
    so that every row finds its next row inside its own range. Rows of one doc_id follow each other in the order of
    `columns`; null ids come last.
    """
    n = docs.count()
    groups = int(min(most_groups, max(1, math.ceil(n / group_rows))))
    row = docs.agg(F.percentile_approx("doc_id", [k / groups for k in range(1, groups)] or [0.5], 20 * groups).alias("p"), F.max("doc_id").alias("m")).first()
    ends = sorted({*(row["p"] or [] if groups > 1 else []), row["m"]} - {None}) or [0]
    top = len(ends) - 1
    home = F.coalesce(F.least(_search(ends, F.col("doc_id")), F.lit(top)), F.lit(0))
    above = F.when(F.col("g") == top, 0).otherwise(F.col("g") + 1)
    end = F.col("doc_id").isin(ends) if len(ends) <= 10 else F.col("doc_id") == F.element_at(F.array(*[F.lit(v).cast("long") for v in ends]), F.col("g") + 1)
    if row["m"] is None:  # no ids at all: any row leads the one range
        end = F.lit(True)
    both = docs.withColumn("g", home).withColumn("e", F.explode(F.when(end, F.array(F.struct(F.col("g").alias("g"), F.lit(0).alias("ghost")), F.struct(above.alias("g"), F.lit(1).alias("ghost")))).otherwise(F.array(F.struct(F.col("g").alias("g"), F.lit(0).alias("ghost"))))))
    both = both.drop("g").select("*", "e.g", "e.ghost").drop("e")
    from pyspark.sql import Window

    w = Window.partitionBy("g").orderBy(F.col("ghost"), F.col("doc_id").desc_nulls_last(), *columns)
    return both.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("ghost = 0").drop("g", "ghost")


def edited_fingerprints(docs: DataFrame, small: int = 200_000) -> DataFrame:
    """Every text's fingerprint beside that of an edited text and of the next document.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document in descending doc_id; after the last document comes the first, and a lone document is its own next.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id. Null
    texts count as empty; rows of one doc_id follow each other by fingerprint and text.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("fp", digest(canonical(F.col("text"))))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    paired = with_next(base, ["fp", "text"])
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    told = paired.withColumn("edited", edited).withColumn("edited_fp", digest(canonical(F.col("edited"))))
    canon = lambda c: canonical(F.col(c))
    out = told.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", F.col("edited_fp").alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp"), canon("text"), canon("edited")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), canon("text"), canon("next_text")).alias("near_next"),
    )
    out = stage(out, "fingerprints")
    groups = _grouped(docs, out.select("doc_id", "fp"), small)
    named = groups.groupBy("doc_id", "fp").agg(F.min("group_id").alias("group_id"))
    joined = out.alias("o").join(named.alias("n"), F.col("o.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("o.fp") == F.col("n.fp")))
    return joined.select("o.doc_id", "n_chars", "edited_sha256", F.col("o.fp").alias("fingerprint"), "edited_fingerprint", "near_edited", "near_next", "group_id")
