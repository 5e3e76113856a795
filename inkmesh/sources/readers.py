"""Readers of scholarly exports: every format becomes a DataFrame of the records schema.

Files are decoded and cut into records by many tasks each, however large they are (see raw and split); fields are taken
out by built-in expressions. rec_id grows in the order of a file and is unique over files. UTF-8, with or without byte
order mark, and UTF-16 of either order are told apart file by file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh import schema
from inkmesh.functions.text import bib_clean, bib_key, collapse, first_number, latex_clean, lower, norm_doi, pick_org, split_any, to_int, trim
from inkmesh.operators.geo import normalise_countries
from inkmesh.sources import raw
from inkmesh.sources.bibtex import read_entries
from inkmesh.sources.split import csv_table, json_objects

def _no() -> Column:
    return F.array().cast("array<string>")


def _records(df: DataFrame, **columns: Column) -> DataFrame:
    """The records schema, missing columns null, empty texts null, year 0 null."""
    out = []
    for f in schema.RECORDS.fields:
        c = columns.get(f.name)
        if f.name == "rec_id":
            c = F.monotonically_increasing_id() if c is None else c
        elif c is None:
            c = _no() if f.dataType.typeName() == "array" else F.lit(None)
        elif f.dataType.typeName() == "string":
            c = F.nullif(trim(c), F.lit(""))
        elif f.dataType.typeName() == "array":
            c = F.filter(F.coalesce(c, _no()), lambda x: F.coalesce(trim(x), F.lit("")) != "")
        elif f.name == "year":
            c = F.nullif(c.cast("int"), F.lit(0))
        elif f.name == "cites":
            c = F.coalesce(c.cast("int"), F.lit(0))
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def _with_countries(records: DataFrame) -> DataFrame:
    """countries: distinct normalised names of the raw ones, in their order."""
    raw = records.select("rec_id", F.posexplode("countries").alias("pos", "c"))
    named = normalise_countries(raw, "c", keep_unknown=True).where("c <> ''").groupBy("rec_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"])).alias("named"))
    return records.join(named, "rec_id", "left").withColumn("countries", F.coalesce("named", _no())).drop("named").select(*schema.RECORDS.fieldNames())


def _blocks(spark: SparkSession, path: str, end: str) -> DataFrame:
    """value: the lines of one record, without carriage returns. Records end in a line that begins with `end`."""
    return raw.pieces(spark, path, "\n" + end).select(F.replace("value", F.lit("\r"), F.lit("")).alias("value"))


def _wos(tag: str, lines: Column) -> Column:
    """Values of a tag, a line each; the lines carry their tag in front of continuation lines already."""
    return F.transform(F.filter(lines, lambda x: x.startswith(tag + " ")), lambda x: trim(F.substring(x, 4, 1 << 30)))


def read_wos(spark: SparkSession, path: str) -> DataFrame:
    """Tagged text: two-letter tags, continuation lines of three spaces, records that end in ER."""
    rows = _blocks(spark, path, "ER")
    # a continuation line gets the tag of the line it continues
    lines = F.filter(F.split("value", "\n"), lambda x: F.length(x) > 3)
    told = F.aggregate(lines, F.array().cast("array<string>"), lambda acc, x: F.concat(acc, F.array(F.when(x.startswith("   "), F.concat(F.substring(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("   ")), 1, 3), F.substring(x, 4, 1 << 30))).otherwise(x))))
    rows = rows.withColumn("l", told)
    one = lambda t: F.nullif(F.array_join(_wos(t, F.col("l")), " "), F.lit(""))
    semi = lambda t: split_any(F.coalesce(one(t), F.lit("")), ";")
    place = F.transform(_wos("C1", F.col("l")), lambda x: F.regexp_replace(x, r"^\[[^\]]*\]\s*", ""))
    orgs = F.array_distinct(F.transform(place, lambda x: pick_org(split_any(x, ","))))
    lands = F.transform(place, lambda x: F.regexp_replace(trim(F.element_at(F.split(x, ","), -1)), r"[.;]$", ""))
    cites = F.when(to_int(F.coalesce(one("TC"), F.lit(""))) > 0, to_int(F.coalesce(one("TC"), F.lit("")))).otherwise(to_int(F.coalesce(one("Z9"), F.lit(""))))
    rows = rows.where(one("TI").isNotNull() | (F.size(_wos("AU", F.col("l"))) > 0))
    return _with_countries(_records(rows, title=one("TI"), abstract=one("AB"), source=one("SO"), doi=norm_doi(F.coalesce(one("DI"), F.lit(""))), volume=one("VL"), pages=one("BP"), doc_type=one("DT"), publisher=one("PU"), language=one("LA"), key=one("UT"), year=to_int(F.coalesce(one("PY"), F.lit(""))), cites=cites, authors=_wos("AU", F.col("l")), keywords=semi("DE"), index_terms=semi("ID"), affiliations=orgs, countries=lands, refs=_wos("CR", F.col("l"))))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS: lines `XX  - value`, records that end in ER."""
    rows = _blocks(spark, path, "ER  -").withColumn("l", F.split("value", "\n"))

    def many(*tags: str) -> Column:
        pick = lambda t: F.transform(F.filter(F.col("l"), lambda x: x.startswith(t + "  - ")), lambda x: trim(F.substring(x, 7, 1 << 30)))
        out = pick(tags[-1])
        for t in reversed(tags[:-1]):
            out = F.when(F.size(pick(t)) > 0, pick(t)).otherwise(out)
        return out

    one = lambda *t: F.coalesce(F.get(many(*t), F.lit(0)), F.lit(""))
    note = F.array_join(many("N1"), " ")
    cites = first_number(F.regexp_extract(note, r"(?i)(times cited:?|cited by)\s*:?\s*(\d+)", 2))
    rows = rows.where(one("TI", "T1") != "")
    authors = F.concat(many("AU"), many("A1"))
    return _records(rows, title=one("TI", "T1"), abstract=one("AB", "N2"), source=one("JO", "JF", "T2", "JA"), doi=norm_doi(one("DO")), volume=one("VL"), pages=one("SP"), doc_type=one("TY"), publisher=one("PB"), language=one("LA"), year=F.coalesce(first_number(one("PY", "Y1", "DA")), F.lit(0)), cites=cites, authors=F.when(F.size(authors) > 0, authors).otherwise(many("A2")), keywords=F.flatten(F.transform(many("KW"), lambda k: split_any(k, ";"))), affiliations=many("AD"), refs=many("CR"))


def _named(df: DataFrame, *names: str) -> Column:
    """The first of the columns that is there, whatever its case; else an empty text."""
    found = {c.strip().lstrip("﻿").lower(): c for c in df.columns}
    for n in names:
        if n in found:
            return F.coalesce(F.col(f"`{found[n]}`").cast("string"), F.lit(""))
    return F.lit("")


def read_scopus(spark: SparkSession, path: str) -> DataFrame:
    """A CSV export with author keywords, affiliations and references; records without a title go."""
    df = csv_table(spark, path)
    c = lambda *n: _named(df, *n)
    who = F.regexp_replace(c("authors"), r"\[No author name available\]", "")
    place = split_any(c("affiliations"), ";")
    return _with_countries(_records(df.where(trim(c("title")) != ""), rec_id=F.col("rec_id"), title=c("title"), abstract=F.when(c("abstract").contains("[No abstract available]"), "").otherwise(c("abstract")), source=c("source title"), doi=norm_doi(c("doi")), volume=c("volume"), pages=c("page start"), doc_type=c("document type"), publisher=c("publisher"), language=c("language of original document"), key=c("eid"), year=to_int(c("year")), cites=to_int(c("cited by")), authors=F.when(who.contains(";"), split_any(who, ";")).otherwise(split_any(who, ",")), keywords=split_any(c("author keywords"), ";"), index_terms=split_any(c("index keywords"), ";"), affiliations=F.array_distinct(F.transform(place, lambda x: pick_org(split_any(x, ",")))), countries=F.transform(place, lambda x: trim(F.element_at(F.split(x, ","), -1))), refs=split_any(c("references"), ";")))


def read_wos_tab(spark: SparkSession, path: str) -> DataFrame:
    """A tab-delimited export whose columns are named by tags."""
    df = csv_table(spark, path, "\t")
    c = lambda *n: _named(df, *n)
    place = F.filter(F.transform(F.split(F.regexp_replace(c("c1"), r"\[[^\]]*\]", ""), ";"), trim), lambda x: x != "")
    return _with_countries(_records(df.where(trim(c("ti")) != ""), rec_id=F.col("rec_id"), title=c("ti"), abstract=c("ab"), source=c("so"), doi=norm_doi(c("di")), volume=c("vl"), pages=c("bp"), doc_type=c("dt"), language=c("la"), year=to_int(c("py")), cites=to_int(c("tc")), authors=split_any(c("au"), ";"), keywords=split_any(c("de"), ";"), index_terms=split_any(c("id"), ";"), affiliations=F.array_distinct(F.transform(place, lambda x: pick_org(split_any(x, ",")))), countries=F.transform(place, lambda x: trim(F.element_at(F.split(x, ","), -1))), refs=split_any(c("cr"), ";")))


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """BibTeX: fields by their names, macros put in; entries without a title go."""
    rows = read_entries(spark, path)

    def c(*names: str) -> Column:
        return latex_clean(F.coalesce(*[F.nullif(F.try_element_at("fields", F.lit(n)), F.lit("")) for n in names], F.lit("")))

    listed = lambda x: F.when(x.contains(";"), split_any(x, ";")).otherwise(split_any(x, ","))
    cites = F.coalesce(first_number(c("times-cited")), first_number(F.regexp_extract(c("note"), r"(?i)cited by:?\s*(\d+)", 1)))
    place = split_any(c("affiliations", "affiliation"), ";")
    rows = rows.where(c("title") != "")
    authors = F.filter(F.transform(F.split(c("author"), r"\s+and\s+"), trim), lambda x: x != "")
    return _with_countries(_records(rows, rec_id=F.col("rec_id"), title=c("title"), abstract=c("abstract"), source=c("journal", "booktitle"), doi=norm_doi(c("doi")), volume=c("volume"), pages=F.regexp_extract(c("pages"), r"^\s*([A-Za-z]?\d+)", 1), doc_type=F.col("kind"), publisher=c("publisher"), language=c("language"), key=F.col("key"), year=F.coalesce(first_number(c("year")), F.lit(0)), cites=cites, authors=authors, keywords=listed(c("author_keywords", "keywords")), index_terms=split_any(c("keywords-plus"), ";"), affiliations=F.array_distinct(F.transform(place, lambda x: pick_org(split_any(x, ",")))), countries=F.transform(place, lambda x: trim(F.element_at(F.split(x, ","), -1))), refs=split_any(c("references", "cited-references"), ";")))


OPENALEX = """id string, title string, display_name string, publication_year int, doi string, cited_by_count int, type string, language string,
primary_location struct<source: struct<display_name: string>>, biblio struct<volume: string, first_page: string>,
authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string, country_code: string>>>>,
keywords array<struct<display_name: string, keyword: string>>, concepts array<struct<display_name: string, level: int, score: double>>,
referenced_works array<string>, abstract_inverted_index map<string, array<int>>"""


def rebuild_abstract(inverted: Column) -> Column:
    """The text of a map from words to their places."""
    pairs = F.flatten(F.transform(F.map_entries(inverted), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """JSON pages of works, in `results` or as the root array."""
    return works_to_records(json_objects(spark, path))


def works_to_records(texts: DataFrame) -> DataFrame:
    """rec_id, text (the JSON of a work) -> records; what has no id or no title is no work."""
    w = texts.select("rec_id", F.from_json("text", f"struct<{_fields()}>").alias("w")).select("rec_id", "w.*").where("id is not null and coalesce(title, display_name) is not null")
    inst = F.flatten(F.transform("authorships", lambda a: F.coalesce(a["institutions"], F.array().cast("array<struct<display_name:string,country_code:string>>"))))
    concepts = F.transform(F.filter("concepts", lambda c: (c["level"] >= 1) & (c["score"] > 0.3)), lambda c: lower(c["display_name"]))
    return _with_countries(_records(w, rec_id=F.col("rec_id"), title=F.coalesce("title", "display_name"), abstract=rebuild_abstract(F.col("abstract_inverted_index")), source=F.col("primary_location.source.display_name"), doi=norm_doi(F.coalesce("doi", F.lit(""))), volume=F.col("biblio.volume"), pages=F.col("biblio.first_page"), doc_type=F.col("type"), language=F.col("language"), key=F.regexp_extract("id", r"([^/]+)$", 1), year=F.coalesce("publication_year", F.lit(0)), cites=F.col("cited_by_count"), authors=F.transform("authorships", lambda a: a["author"]["display_name"]), keywords=F.transform("keywords", lambda k: lower(F.coalesce(k["display_name"], k["keyword"]))), index_terms=concepts, affiliations=F.array_distinct(F.transform(inst, lambda i: i["display_name"])), countries=F.array_distinct(F.transform(inst, lambda i: i["country_code"])), refs=F.transform("referenced_works", lambda r: F.concat(F.lit("DOI openalex:"), F.regexp_extract(r, r"([^/]+)$", 1)))))


def _fields() -> str:
    flat = re.sub(r"\s+", " ", OPENALEX)
    out, depth = "", 0
    for k, part in enumerate(re.split(r"(,)", flat)):
        if part == "," and depth == 0:
            out += ","
            continue
        if depth == 0:
            part = re.sub(r"^\s*(\w+) ", r"\1: ", part)
        depth += part.count("<") - part.count(">")
        out += part
    return out


def read_vosviewer(spark: SparkSession, map_path: str | None, network_path: str | None) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of map and network files: y is negated, clusters count from 0, a repeated pair keeps its largest weight, loops go.

    Columns weight<...> and score<...> are kept under their names; ids that only the network has become nodes.
    """
    links = None
    if network_path:
        rows = raw.pieces(spark, network_path).select(F.split(trim(F.col("value")), r"[\t, ]+").alias("p")).where(F.size("p") >= 2)
        a, b = F.get("p", F.lit(0)), F.get("p", F.lit(1))
        w = F.coalesce(F.get("p", F.lit(2)).try_cast("double"), F.lit(1.0))
        links = rows.where(a != b).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(w).alias("w"))
    if map_path:
        m = csv_table(spark, map_path, "\t").drop("rec_id")
        extra = [F.col(f"`{c}`").try_cast("double").alias(c) for c in m.columns if c.startswith(("weight<", "score<"))]
        nodes = m.select(_named(m, "id").alias("key"), _named(m, "label").alias("label"), _named(m, "x").try_cast("double").alias("x"), (-_named(m, "y").try_cast("double")).alias("y"), (_named(m, "cluster").try_cast("int") - 1).alias("cluster"), *extra)
        if links is not None:
            others = links.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes, "key", "left_anti")
            nodes = nodes.unionByName(others.withColumn("label", F.col("key")), allowMissingColumns=True)
    else:
        nodes = links.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("label", F.col("key"))
    return nodes, links if links is not None else spark.createDataFrame([], "a string, b string, w double")


def read_thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """key, replace_by of a tab-separated list `label, replace by`; an empty replacement means: ignore the term."""
    df = spark.read.csv(path, sep="\t", header=True, schema="label string, replace_by string", enforceSchema=True)
    return df.where("label is not null").select(bib_key(F.col("label")).alias("key"), F.coalesce(bib_clean(F.col("replace_by")), F.lit("")).alias("replace_by")).dropDuplicates(["key"])


def sniff(head: str, name: str = "") -> str:
    """The format of a file by its first characters, then by its name; an empty text if unknown."""
    t = head.lstrip("﻿ \r\n\t")[:4000]
    first = t.split("\n", 1)[0].lower()
    if t.startswith("{") and '"manifest"' in t and '"sha256"' in t:
        return "bundle"
    if t[:1] in "{[" and ('"results"' in t or "openalex" in t):
        return "openalex"
    if t.startswith("FN ") or (t.startswith("PT ") and re.search(r"^ER\s*$", t, re.M)):
        return "wos"
    if t.startswith("PT\t"):
        return "wos_tab"
    if re.match(r"TY  - ", t):
        return "ris"
    if "authors" in first and "title" in first and ("source title" in first or "eid" in first or "cited by" in first):
        return "scopus"
    if re.match(r"@\w+\s*\{", t):
        return "bibtex"
    if first.startswith("id\tlabel"):
        return "vosviewer_map"
    rows = [x for x in t.split("\n")[:8] if x.strip()]
    if rows and all(re.fullmatch(r"\s*[\d.]+([\t, ]+[\d.]+){1,2}\s*", x) for x in rows):
        return "vosviewer_network"
    ends = {"ris": "ris", "bib": "bibtex", "csv": "scopus", "json": "openalex", "ciw": "wos"}
    return ends.get(name.rsplit(".", 1)[-1].lower(), "")


_READERS = {"wos": read_wos, "wos_tab": read_wos_tab, "scopus": read_scopus, "ris": read_ris, "bibtex": read_bibtex, "openalex": read_openalex}


def read_records(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Records of a file in any format that sniff knows; only the first characters of its first file are looked at on the driver."""
    if kind is None:
        found = raw.sources(spark, path)
        kind = sniff(found[0].head, path) if found else ""
    if kind not in _READERS:
        raise ValueError(f"unknown format of {path}: {kind or 'nothing fits'}; one of {', '.join(_READERS)}")
    return _READERS[kind](spark, path)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Records of several files, in their order, without duplicates."""
    from inkmesh.operators.match import deduplicate

    out = None
    for k, p in enumerate(paths):
        part = read_records(spark, p).withColumn("rec_id", F.col("rec_id") + F.lit(k * (1 << 52)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return deduplicate(out)


def matched_terms(found: DataFrame) -> DataFrame:
    """(id, term, ...) of several searches -> id, terms: each work once, with the terms that found it."""
    return found.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


