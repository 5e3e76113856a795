"""Noun-phrase-like terms and similarity tokens of English text, by built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.functions.text import ascii_fold, lower

# Words that break terms.
STOP_WORDS = tuple("""
a about above across after again against all almost also although among an and another any are as at
based be because been before being between both but by can could did do does during each either et
etc even ever every few for from further had has have having he her here hers him his how however
i if in into is it its itself just least less may more most much must my neither no nor not
of often on once one only or other our out over own per rather same several she should since so
some such than that the their them then there these they this those though through thus to too two
under until up upon us use used using very via was we well were what when where whether which
while who whom whose why will with within without would yet you your study paper results result show
shows findings research article investigates examine examines discuss implications approach method methods new
different various associated measurable changes indicate evidence growing attention limitations purpose aim aims
present proposed propose provide provides significant significantly large high low first second three four
""".split())
# Words that similarity ignores.
SIMILARITY_STOP_WORDS = tuple("""
a about above across after again against all almost also although among an and another
any are around as at based be because been before being below between both but by
can could did do does doing done due during each either et etc even ever every
few for found from further had has have having he her here hers high him his how
however i if in into is it its itself just less low made make many may more
most much must my new no nor not novel now of off often on once one only or
other our ours out over own paper per present proposed rather result results same
several she should show shown shows since so some study studies such than that the
their theirs them then there these they this those through thus to too two under
until up upon use used uses using various very via was we well were what when
where whether which while who whom whose why will with within without would yet you
your article research approach method methods analysis data three first second
elsevier rights reserved copyright ltd inc springer wiley published author authors
""".split())


def let(value: Column, body) -> Column:
    """body(value), the value computed once: an expression that is written several times would also run several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract_terms(title: Column, abstract: Column, longest: int = 3) -> Column:
    """Distinct 1- to 3-grams of the runs between stop words, numbers, short words and punctuation.

    A run is a stretch of words of three letters or more, none a stop word or a number; single words count from five
    letters on.
    """
    text = lower(ascii_fold(F.concat_ws(". ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")))))
    tokens = F.filter(F.split(F.regexp_replace(text, r"[.,;:()?!]", " | "), r"[^a-z0-9\-|]+"), lambda t: t != "")
    tokens = F.transform(tokens, lambda t: F.regexp_replace(t, r"^-+|-+$", ""))
    marked = F.transform(tokens, lambda t: F.when((F.length(t) < 3) | t.rlike(r"^[0-9\-]*$") | t.contains("|") | t.isin(*STOP_WORDS), "|").otherwise(t))
    runs = F.transform(F.filter(F.split(F.array_join(marked, " "), r"(?:^| )\|(?: \|)*(?: |$)"), lambda r: r != ""), lambda r: F.split(r, " "))

    def gram(run: Column, n: int):
        return lambda i: F.array_join(F.slice(run, i, n), " ")

    def grams(run: Column) -> Column:
        parts = []
        for n in range(1, longest + 1):
            starts = F.when(F.size(run) >= n, F.sequence(F.lit(1), F.greatest(F.size(run) - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
            found = F.transform(starts, gram(run, n))
            parts.append(F.filter(found, lambda t: F.length(t) >= 5) if n == 1 else found)
        return F.concat(*parts)

    return F.array_distinct(F.flatten(F.transform(runs, grams)))


def stem(w: Column) -> Column:
    """A very light stem: plurals, -ing, -ed and -ation."""
    cut = lambda x, k, add="": F.concat(F.substring(x, F.lit(1), F.length(x) - k), F.lit(add))
    n = F.length(w)
    a = F.when(w.endswith("ies") & (n >= 6), cut(w, 3, "y")).when(w.endswith("sses") & (n >= 7), cut(w, 2)).when(w.endswith("ss") & (n >= 5), w).when(w.endswith("s") & (n >= 4) & ~(w.endswith("us") & (n >= 5)) & ~(w.endswith("is") & (n >= 5)), cut(w, 1)).otherwise(w)

    def suffix(a: Column) -> Column:
        m = F.length(a)
        return F.when(a.endswith("ing") & (m > 6), cut(a, 3)).when(a.endswith("ed") & (m > 5), cut(a, 2)).otherwise(a)

    return let(let(a, suffix), lambda b: F.when(b.endswith("ation") & (F.length(b) > 8), cut(b, 3)).otherwise(b))


def similarity_tokens(text: Column) -> Column:
    """Stems and pairs of neighbouring stems (`a_b`); stop words, short words and numbers break pairs. Hyphens inside words vanish."""
    t = F.regexp_replace(lower(F.coalesce(text, F.lit(""))), r"(?<=[a-z0-9\x80-\x{10FFFF}])-+", "")
    words = F.filter(F.split(t, r"[^a-z0-9\x80-\x{10FFFF}]+"), lambda w: w != "")
    kept = F.transform(words, lambda w: F.when((F.octet_length(w) < 3) | w.rlike("^[0-9]+$") | w.isin(*SIMILARITY_STOP_WORDS), "").otherwise(stem(w)))

    def with_pairs(k: Column) -> Column:
        pairs = F.zip_with(F.slice(k, F.lit(1), F.greatest(F.size(k) - 1, F.lit(0))), F.slice(k, 2, 1 << 30), lambda a, b: F.when((a != "") & (b != ""), F.concat_ws("_", a, b)).otherwise(""))
        return F.filter(F.concat(k, pairs), lambda x: F.coalesce(x, F.lit("")) != "")

    return let(kept, with_pairs)


def similarity_token_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc, text) -> doc, token: the elements of similarity_tokens a row each.

    Words are made rows before anything is done to them, so that stems are compiled code and not folds over arrays; a
    word's neighbour travels in its row.
    """
    t = F.regexp_replace(lower(F.coalesce(F.col(text), F.lit(""))), r"(?<=[a-z0-9\x80-\x{10FFFF}])-+", "")
    words = F.filter(F.split(t, r"[^a-z0-9\x80-\x{10FFFF}]+"), lambda w: w != "")
    rows = df.select("doc", words.alias("w")).select("doc", F.explode(F.arrays_zip("w", F.slice("w", 2, 1 << 30).alias("next"))).alias("x")).select("doc", F.col("x.w").alias("a"), F.col("x.next").alias("b"))
    term = lambda w: (F.octet_length(w) >= 3) & ~w.rlike("^[0-9]+$") & ~w.isin(*SIMILARITY_STOP_WORDS)
    kept = rows.where(term(F.col("a"))).select("doc", stem(F.col("a")).alias("a"), F.when(term(F.col("b")), stem(F.col("b"))).alias("b"))
    return kept.select("doc", F.explode(F.array_compact(F.array("a", F.when(F.col("b").isNotNull(), F.concat_ws("_", "a", "b"))))).alias("token"))


def record_text(title: Column, abstract: Column, keywords: Column) -> Column:
    """What a record is compared by: its title twice, abstract and keywords."""
    return F.concat_ws(" ", title, title, abstract, F.array_join(keywords, " "))
