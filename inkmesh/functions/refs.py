"""Cited-reference strings taken apart with regular expressions, as Column -> Column, and over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import ascii_fold, initial, lower, norm_doi, source_key, surname, trim
from inkmesh.plans.joins import computed
from inkmesh.plans.names import fresh


def _first(*columns: Column) -> Column:
    """The first that is not empty, else empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def ref_year(ref: Column) -> Column:
    """Year of a reference, 1500 to 2100: the second comma field, `(yyyy)`, or four digits that stand alone; 0 if none."""
    second = F.regexp_extract(ref, r"^[^,]*,\s*(\d{4})\s*(,|$)", 1)
    paren = F.regexp_extract(ref, r"\((\d{4})[a-z]?\)", 1)
    alone = F.regexp_extract(ref, r"(?<![\w.])(1[5-9]\d\d|20\d\d|2100)(?![\w])", 1)
    ok = lambda y: F.when(y.try_cast("int").between(1500, 2100), y.try_cast("int"))
    return F.coalesce(ok(second), ok(paren), ok(alone), F.lit(0))


def ref_doi(ref: Column) -> Column:
    """The DOI in a reference, or an empty text."""
    return _doi(_found_doi(ref))


def _found_doi(ref: Column) -> Column:
    return F.regexp_extract(lower(ref), r"(10\.\d+/[^\s,;\]]+)", 1)


def _doi(found: Column) -> Column:
    return F.when(found == "", "").otherwise(norm_doi(found))


def _pieces(r: Column) -> dict[str, Column]:
    """What most references are read from, a match a piece."""
    patterns = {
        "head": r"^([^,]*)", "comma_style": r"^([^,]*,\s*[A-Z][A-Z.\- ]{0,6})(,|\s*\()", "paren": r"\(((?:18|19|20)\d\d)[a-z]?\)", "token": r"(?:^|,)\s*((?:18|19|20)\d\d)\s*(?:,|$)",
        "volume": r",\s*[Vv](?:ol\.?\s*)?(\d+)", "page": r",\s*P([A-Za-z]?\d+)", "source": r"(?:^|,)\s*(?:18|19|20)\d\d\s*,\s*([^,]+)",
    }
    return {n: F.regexp_extract(r, p, 1) for n, p in patterns.items()} | {"dated": r.rlike(r"^[^,]*,\s*(18|19|20)\d\d\s*(,|$)"), "doi": _found_doi(r)}


def _chosen(r: Column, x: dict[str, Column]) -> dict[str, Column]:
    """Of several readings the one that counts."""
    return {
        "author": F.when(x["dated"], x["head"]).otherwise(_first(x["comma_style"], x["head"])), "year": _first(x["paren"], x["token"], F.regexp_extract(r, r"(?<!\d)((?:18|19|20)\d\d)(?!\d)", 1)),
        "volume": _first(x["volume"], F.regexp_extract(r, r",\s*(\d{1,4})\s*(?:\(\d+\))?\s*,\s*(?:pp?\.)", 1)), "page": _first(x["page"], F.regexp_extract(r, r"pp?\.\s*([A-Za-z]?\d+)", 1)),
        "source": _first(x["source"], F.regexp_extract(r, r"\((?:18|19|20)\d\d[a-z]?\)\s*,?\s*([^,]+)", 1)), "doi": x["doi"],
    }


def _assembled(x: dict[str, Column]) -> Column:
    source = F.when(x["source"].rlike(r"^(?i)(v\d+|p\d+|doi.*)$"), "").otherwise(trim(x["source"]))
    year = F.coalesce(x["year"].try_cast("int"), F.lit(0))
    return F.struct(_doi(x["doi"]).alias("doi"), F.trim(surname(x["author"])).alias("surname"), initial(x["author"]).alias("initial"), year.alias("year"), x["volume"].alias("volume"), x["page"].alias("page"), source.alias("source"))


def ref_parse(ref: Column) -> Column:
    """A struct of doi, surname, initial, year (1800 to 2099, else 0), volume, page and source."""
    r = trim(ref)
    return _assembled(_chosen(r, _pieces(r)))


def parsed(df: DataFrame, ref: str, name: str = "p") -> DataFrame:
    """df with ref_parse of the column `ref`, every match made once: the expression alone repeats them wherever a value is tested and used."""
    r, one, two = fresh([*df.columns, name], "trimmed", "pieces", "chosen")
    held = lambda x: F.struct(*[c.alias(n) for n, c in x.items()])
    of = lambda col, x: {n: F.col(col)[n] for n in x}
    pieces = _pieces(F.col(r))
    chosen = _chosen(F.col(r), of(one, pieces))
    x = computed(computed(computed(df, r, trim(F.col(ref))), one, held(pieces)), two, held(chosen))
    return computed(x.drop(r, one), name, _assembled(of(two, chosen))).drop(two)


def ref_key(p: Column) -> Column:
    """The key of a parsed reference: its DOI, else author, year, source, volume and page; empty without surname or year."""
    parts = F.concat_ws("|", p["surname"], p["initial"], p["year"].cast("string"), source_key(p["source"]), p["volume"], p["page"])
    return F.when(p["doi"] != "", F.concat(F.lit("doi:"), p["doi"])).when((p["surname"] == "") | (p["year"] == 0), "").otherwise(parts)


def ref_label(p: Column, ref: Column) -> Column:
    """`surname i (year) source`, or the reference itself where it names no author."""
    return F.when(p["surname"] == "", ref).otherwise(F.concat_ws(" ", p["surname"], F.when(p["initial"] != "", p["initial"]), F.concat(F.lit("("), p["year"].cast("string"), F.lit(")")), F.when(p["source"] != "", p["source"])))


def first_page(pages: Column) -> Column:
    return F.regexp_extract(pages, r"^\s*([A-Za-z]?\d+)", 1)


def alnum_lower(s: Column, n: int) -> Column:
    """The first n letters and digits, folded and lower case."""
    return F.substring(F.regexp_replace(lower(ascii_fold(s)), "[^a-z0-9]", ""), 1, n)
