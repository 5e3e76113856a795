"""Writers of the formats that the readers read, and of a project as Parquet tables with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.functions.text import wos_author

def _no() -> Column:
    return F.array().cast("array<string>")


def _line(tag: str, value: Column) -> Column:
    return F.when(F.coalesce(value.cast("string"), F.lit("")) != "", F.concat(F.lit(tag), value.cast("string")))


def _lines(tag: str, values: Column) -> Column:
    v = F.coalesce(values, _no())
    return F.when(F.size(v) > 0, F.array_join(F.transform(v, lambda x: F.concat(F.lit(tag), x)), "\n"))


def wos_text(records: DataFrame) -> DataFrame:
    """value: each record as tagged text that ends in ER."""
    more = lambda tag, v: F.when(F.size(F.coalesce(v, _no())) > 0, F.concat(F.lit(tag + " "), F.array_join(v, "\n   ")))
    place = F.transform(F.coalesce("affiliations", _no()), lambda a: a)
    lands = F.coalesce("countries", _no())
    n = F.greatest(F.size(place), F.size(lands))
    c1 = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.coalesce(F.get(place, i), F.lit("")), F.lit(", "), F.coalesce(F.get(lands, i), F.coalesce(F.try_element_at(lands, F.lit(-1)), F.lit(""))), F.lit("."))))
    parts = [F.lit("PT J"), more("AU", F.transform("authors", wos_author)), _line("TI ", F.col("title")), _line("SO ", F.col("source")), _line("LA ", F.col("language")), _line("DT ", F.col("doc_type")), _line("DE ", F.array_join("keywords", "; ")), _line("ID ", F.array_join("index_terms", "; ")), _line("AB ", F.col("abstract")), more("C1", c1), more("CR", F.col("refs")), F.concat(F.lit("NR "), F.size(F.coalesce("refs", _no()))), F.concat(F.lit("TC "), F.coalesce("cites", F.lit(0))), F.concat(F.lit("Z9 "), F.coalesce("cites", F.lit(0))), _line("PU ", F.col("publisher")), _line("PY ", F.col("year")), _line("VL ", F.col("volume")), _line("BP ", F.col("pages")), _line("DI ", F.col("doi")), _line("UT ", F.col("key")), F.lit("ER"), F.lit("")]
    return records.select(F.concat_ws("\n", *parts).alias("value"))


def ris_text(records: DataFrame) -> DataFrame:
    """value: each record as RIS that ends in ER."""
    kind = F.lower(F.coalesce("doc_type", F.lit("")))
    ty = F.when(kind.contains("book"), "BOOK").when(kind.contains("proceed") | kind.contains("conference"), "CONF").otherwise("JOUR")
    tag = lambda t: f"{t}  - "
    parts = [F.concat(F.lit(tag("TY")), ty), _lines(tag("AU"), F.col("authors")), _line(tag("TI"), F.col("title")), _line(tag("PY"), F.col("year")), _line(tag("JO"), F.col("source")), _line(tag("VL"), F.col("volume")), _line(tag("SP"), F.col("pages")), _line(tag("DO"), F.col("doi")), _line(tag("AB"), F.col("abstract")), _lines(tag("KW"), F.col("keywords")), _lines(tag("AD"), F.col("affiliations")), _line(tag("PB"), F.col("publisher")), _line(tag("LA"), F.col("language")), F.concat(F.lit(tag("N1") + "Times cited: "), F.coalesce("cites", F.lit(0))), F.lit("ER  - "), F.lit("")]
    return records.select(F.concat_ws("\n", *parts).alias("value"))


def scopus_table(records: DataFrame) -> DataFrame:
    """The 18 columns of a CSV export: authors by surname and initials, and in full."""
    join = lambda c: F.array_join(F.coalesce(c, _no()), "; ")
    place = F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.coalesce("affiliations", _no())), F.size(F.coalesce("countries", _no())), F.lit(1)) - 1), lambda i: F.concat_ws(", ", F.get(F.coalesce("affiliations", _no()), i), F.get(F.coalesce("countries", _no()), i)))
    short = F.transform(F.coalesce("authors", _no()), wos_author)
    return records.select(join(short).alias("Authors"), join("authors").alias("Author full names"), F.col("title").alias("Title"), F.col("year").alias("Year"), F.col("source").alias("Source title"), F.col("volume").alias("Volume"), F.col("pages").alias("Page start"), F.col("cites").alias("Cited by"), F.col("doi").alias("DOI"), join(place).alias("Affiliations"), F.col("abstract").alias("Abstract"), join("keywords").alias("Author Keywords"), join("index_terms").alias("Index Keywords"), join("refs").alias("References"), F.col("doc_type").alias("Document Type"), F.col("language").alias("Language of Original Document"), F.col("publisher").alias("Publisher"), F.col("key").alias("EID"))


def write_records(records: DataFrame, path: str, kind: str) -> None:
    """Records as wos, ris or csv: a folder of part files, in the order of rec_id inside each."""
    if kind == "wos":
        wos_text(records).write.text(path)
    elif kind == "ris":
        ris_text(records).write.text(path)
    elif kind == "csv":
        scopus_table(records).write.csv(path, header=True, quote='"', escape='"')
    else:
        raise ValueError("kind is wos, ris or csv")


def vosviewer_tables(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(map, network) with ids from 1 in order of key; y is negated and clusters count from 1."""
    from pyspark.sql import Window

    ids = nodes.select("key").withColumn("id", F.row_number().over(Window.orderBy("key")))  # a map's bounded nodes
    other = [c for c in nodes.columns if c not in ("key", "label", "x", "y", "cluster")]
    have = lambda c: F.col(c) if c in nodes.columns else F.lit(None)
    m = nodes.join(ids, "key").select("id", have("label").alias("label"), have("x").alias("x"), (-have("y").cast("double")).alias("y"), (have("cluster") + 1).alias("cluster"), *[F.col(f"`{c}`").alias(c if "<" in c else f"weight<{c}>") for c in other])
    n = links.join(ids.select(F.col("key").alias("a"), F.col("id").alias("i")), "a").join(ids.select(F.col("key").alias("b"), F.col("id").alias("j")), "b")
    return m, n.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "w")


def write_vosviewer(nodes: DataFrame, links: DataFrame, map_path: str, network_path: str) -> None:
    m, n = vosviewer_tables(nodes, links)
    m.write.csv(map_path, sep="\t", header=True)
    n.write.csv(network_path, sep="\t")


def write_thesaurus(thesaurus: DataFrame, path: str) -> None:
    thesaurus.select(F.col("key").alias("label"), F.col("replace_by").alias("replace by")).write.csv(path, sep="\t", header=True, emptyValue="")


def _checksum(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: hashes are combined inside Spark."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("x"), F.sum(F.xxhash64(F.lit(1), *df.columns).cast("decimal(38,0)")).alias("s")).first()
    return f"{row['n']}:{row['x']}:{row['s']}"


def save_project(tables: dict[str, DataFrame], path: str, settings: dict | None = None) -> None:
    """Every table as Parquet below path, and a manifest with settings and each table's checksum."""
    spark = next(iter(tables.values())).sparkSession
    sums = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}.parquet")
        sums[name] = _checksum(spark.read.parquet(f"{path}/{name}.parquet"))
    spark.createDataFrame([(json.dumps({"manifest": 1, "settings": settings or {}, "tables": sums}),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def open_project(spark: SparkSession, path: str, verify: bool = True) -> tuple[dict[str, DataFrame], dict]:
    """(tables, settings); raises ValueError where a table is not what was saved."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    tables = {n: spark.read.parquet(f"{path}/{n}.parquet") for n in manifest["tables"]}
    for n, df in tables.items() if verify else ():
        if _checksum(df) != manifest["tables"][n]:
            raise ValueError(f"table {n} differs from what was saved")
    return tables, manifest["settings"]
