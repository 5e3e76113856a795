"""From records to incidence: which document holds which unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions import refs as R
from inkmesh.functions.terms import extract_terms
from inkmesh.functions.text import bib_key, pick_org, source_key, split_any


def _empty() -> Column:
    return F.array().cast("array<string>")


def in_years(year: Column, first: int | None = None, last: int | None = None) -> Column:
    """True unless the year is known and outside; a bound of None or 0 is open."""
    ok = F.lit(True)
    if first:
        ok = ok & (year >= first)
    if last:
        ok = ok & (year <= last)
    return year.isNull() | (year == 0) | ok


def _labels(unit: str) -> Column:
    c = lambda n: F.coalesce(F.col(n), _empty())
    if unit == "all_keywords":
        return F.concat(c("keywords"), c("index_terms"))
    if unit in ("keywords", "index_terms", "authors", "countries"):
        return c(unit)
    if unit == "sources":
        return F.array(F.col("source"))
    if unit == "terms":
        return extract_terms(F.col("title"), F.col("abstract"))
    if unit == "orgs":
        return F.transform(c("affiliations"), lambda a: pick_org(split_any(a, ",")))
    if unit == "documents":
        return F.array(F.coalesce(F.col("title"), F.lit("")))
    if unit in ("refs", "cited_sources", "cited_authors"):
        return c("refs")
    raise ValueError(f"unknown unit {unit!r}")


def columns_of(unit: str) -> tuple[str, ...]:
    """The columns of records that a unit is made of."""
    return {"all_keywords": ("keywords", "index_terms"), "sources": ("source",), "terms": ("title", "abstract"), "orgs": ("affiliations",), "documents": ("title",)}.get(unit, ("refs",) if unit in ("cited_sources", "cited_authors") else (unit,))


def incidence(records: DataFrame, unit: str, thesaurus: DataFrame | None = None, exclusions: DataFrame | None = None) -> DataFrame:
    """records -> doc, key, label, pos: each unit of each document once, at its first place.

    Keys are normalised; a thesaurus (key, replace_by) renames them, an empty replacement drops the unit; keys in
    exclusions (key) go. Keys of under two bytes are no units. Cited units come from parsed references and ignore the
    thesaurus. Nulls are no units.
    """
    found = records.select(F.col("rec_id").alias("doc"), F.posexplode(_labels(unit)).alias("pos", "label")).where("label is not null")
    cited = unit in ("refs", "cited_sources", "cited_authors")
    if unit == "documents":
        out = found.select("doc", F.col("doc").cast("string").alias("key"), "label", "pos")
    elif cited:
        p = R.parsed(found, "label")
        if unit == "refs":
            out = p.select("doc", R.ref_key(F.col("p")).alias("key"), R.ref_label(F.col("p"), F.col("label")).alias("label"), "pos")
        elif unit == "cited_sources":
            out = p.select("doc", source_key(F.col("p.source")).alias("key"), F.col("p.source").alias("label"), "pos")
        else:
            out = p.select("doc", F.concat_ws(" ", F.col("p.surname"), F.when(F.col("p.initial") != "", F.col("p.initial"))).alias("key"), F.concat_ws(" ", F.col("p.surname"), F.col("p.initial")).alias("label"), "pos")
        out = out.where(F.octet_length("key") >= 2)
    else:
        key = source_key if unit == "sources" else bib_key
        out = found.withColumn("key", key(F.col("label")))
        if thesaurus is not None:
            t = thesaurus.select(F.col("key").alias("k"), "replace_by").dropDuplicates(["k"])
            out = out.join(t, out.key == t.k, "left").where("replace_by is null or replace_by <> ''")
            out = out.select("doc", F.coalesce(key(F.col("replace_by")), "key").alias("key"), F.coalesce("replace_by", "label").alias("label"), "pos")
        out = out.where(F.octet_length("key") >= 2)
    if exclusions is not None:
        out = out.join(exclusions.select("key").distinct(), "key", "left_anti")
    return out.groupBy("doc", "key").agg(F.min_by("label", "pos").alias("label"), F.min("pos").cast("int").alias("pos"))


def first_labels(inc: DataFrame) -> DataFrame:
    """key, label: the label of a key's first occurrence in document order."""
    return inc.groupBy("key").agg(F.min_by("label", F.struct("doc", "pos")).alias("label"))
