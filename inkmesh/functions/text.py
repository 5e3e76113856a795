"""Scalar text functions as Column -> Column expressions; nulls stay null, nothing here is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters that fold to one ASCII letter, and what they fold to.
_FOLD_FROM = "áàâäãåéèêëíìîïóòôöõøúùûüçñýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕØÚÙÛÜÇÑłŁşŞğıčČšŠžŽćřěőű"
_FOLD_TO = "aaaaaaeeeeiiiioooooouuuucnyAAAAAAEEEEIIIIOOOOOOUUUUCNlLsSgicCsSzZcreou"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Prefixes that DOIs come with.
_DOI_PREFIX = r"^(https?://(dx\.)?doi\.org/|doi\.org/|doi:\s*|doi\s+)"
# Endings and beginnings that British spelling has and American has not, in order of trial.
_ENDINGS = (("isation", "ization"), ("isations", "izations"), ("ised", "ized"), ("ising", "izing"), ("ise", "ize"), ("ises", "izes"), ("yse", "yze"), ("ysed", "yzed"), ("ysing", "yzing"), ("elling", "eling"), ("elled", "eled"), ("centre", "center"), ("centres", "centers"))
_BEGINNINGS = (("behaviour", "behavior"), ("colour", "color"), ("favour", "favor"), ("labour", "labor"), ("honour", "honor"), ("neighbour", "neighbor"), ("humour", "humor"), ("programme", "program"), ("analogue", "analog"), ("catalogue", "catalog"))
# What the name of an institution holds.
ORG_WORDS = ("univ", "inst", "coll", "school", "acad", "ctr", "center", "centre", "hosp", "lab", "corp", "inc", "ltd", "fdn", "polytech", "minist", "council", "agcy", "agency", "res ")


def trim(s: Column) -> Column:
    """Strip control characters, spaces and no-break spaces at both ends."""
    return F.regexp_replace(s, r"^[\x00-\x20\xA0]+|[\x00-\x20\xA0]+$", "")


def lower(s: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(s, _UPPER, _LOWER)


def upper(s: Column) -> Column:
    """Upper-case a-z only."""
    return F.translate(s, _LOWER, _UPPER)


def split_any(s: Column, separators: str) -> Column:
    """Parts between any of the separators, trimmed, empty ones dropped."""
    pattern = "[" + "".join("\\" + c for c in separators) + "]"
    return F.filter(F.transform(F.split(s, pattern), trim), lambda x: x != "")


def collapse(s: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return F.trim(F.regexp_replace(s, r"[\x00-\x20]+", " "))


def title_case(s: Column) -> Column:
    """Upper-case an ASCII letter that begins the text or follows a space, a hyphen or a parenthesis; leave the rest."""
    cut = F.split(s, r"(?<=[ \-(])")
    return F.array_join(F.transform(cut, lambda w: F.concat(upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def ascii_fold(s: Column) -> Column:
    """Fold a fixed set of Latin letters to ASCII; others stay."""
    return F.replace(F.translate(s, _FOLD_FROM, _FOLD_TO), F.lit("ß"), F.lit("ss"))


def to_int(s: Column, default: int = 0) -> Column:
    """The integer that a text begins with, or the default."""
    return F.coalesce(F.regexp_extract(trim(s), r"^[+-]?\d+", 0).try_cast("int"), F.lit(default))


def to_double(s: Column, default: float = 0.0) -> Column:
    """The number that a text begins with, or the default."""
    return F.coalesce(F.regexp_extract(trim(s), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double"), F.lit(default))


def is_digits(s: Column) -> Column:
    return s.rlike(r"^[0-9]+$")


def truncate(s: Column, n: int) -> Column:
    """At most n code points; a cut text ends in an ellipsis."""
    return F.when(F.length(s) > n, F.concat(F.rtrim(F.substring(s, 1, n - 1)), F.lit("…"))).otherwise(s)


def format_int(x: Column) -> Column:
    return F.format_number(x.cast("long"), 0)


def format_num(x: Column, decimals: int = 1) -> Column:
    """Whole numbers without decimals, others with a fixed number of them."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(F.format_string(f"%.{decimals}f", x))


def bib_clean(s: Column) -> Column:
    """White space collapsed, no trailing .;, and no quotes at the ends."""
    s = F.regexp_replace(collapse(s), r"[.;,]+$", "")
    return F.trim(F.regexp_replace(s, "^[\"']+|[\"']+$", ""))


def bib_key(s: Column) -> Column:
    """The key under which spellings of a term meet: folded, lower case, hyphens as spaces, without quotes, dots and commas."""
    s = lower(ascii_fold(bib_clean(s)))
    return collapse(F.regexp_replace(F.translate(s, "-_/", "   "), "[\"'.,]", ""))


def source_key(s: Column) -> Column:
    """The key of a source title: folded, lower case, letters and digits only."""
    return F.regexp_replace(lower(ascii_fold(s)), "[^a-z0-9]", "")


def norm_doi(s: Column) -> Column:
    """A bare lower-case DOI, or an empty text if it is none."""
    s = lower(trim(s))
    s = F.regexp_replace(F.regexp_replace(s, _DOI_PREFIX, ""), _DOI_PREFIX, "")
    s = F.regexp_replace(trim(s), r"[.,;]+$", "")
    return F.when(s.startswith("10."), s).otherwise(F.lit(""))


def title_key(title: Column, year: Column) -> Column:
    """The key under which copies of a publication meet; null if it is too short to tell."""
    key = F.concat(source_key(F.coalesce(title, F.lit(""))), F.lit("|"), F.coalesce(year, F.lit(0)).cast("string"))
    return F.when(F.length(key) > 12, key)


def surname(author: Column) -> Column:
    """The folded surname: before a comma, else without trailing initials, else the first word."""
    a = collapse(author)
    before = F.regexp_extract(a, r"^([^,]*),", 1)
    bare = F.regexp_replace(a, r"\s+[A-Z]{1,3}\.?$", "")
    name = F.when(a.contains(","), before).when(bare != a, bare).otherwise(F.element_at(F.split(a, " "), 1))
    return F.regexp_replace(lower(ascii_fold(name)), r"[^a-z '\-]", "")


def initial(author: Column) -> Column:
    """The folded first initial behind the surname, or an empty text."""
    a = collapse(author)
    rest = F.when(a.contains(","), F.regexp_extract(a, r",\s*([A-Za-zÀ-ž])", 1)).otherwise(F.regexp_extract(a, r"\s([A-Z])[A-Z]{0,2}\.?$", 1))
    return lower(ascii_fold(rest))


def wos_author(name: Column) -> Column:
    """`Surname, INITIALS`: of `Surname, Given Names`, `Surname AB` and `Given Names Surname`."""
    a = collapse(name)
    initials = lambda x: F.regexp_replace(upper(F.regexp_replace(F.regexp_replace(x, r"(?<=\p{L})[\p{L}']+", ""), r"[^\p{L}]", "")), " ", "")
    tail, head = F.regexp_extract(a, r"\s(\S+)$", 1), F.regexp_extract(a, r"^(.*)\s\S+$", 1)
    short = F.regexp_extract(a, r"^(.*)\s([A-Z]{1,3})$", 2)
    comma = F.concat(F.regexp_extract(a, r"^([^,]*),", 1), F.lit(", "), F.when(F.regexp_extract(a, r",\s*(.*)$", 1).rlike(r"^[A-Z]{1,4}$"), F.regexp_extract(a, r",\s*(.*)$", 1)).otherwise(initials(F.regexp_extract(a, r",\s*(.*)$", 1))))
    return F.when(a.contains(","), comma).when(short != "", F.concat(F.regexp_extract(a, r"^(.*)\s[A-Z]{1,3}$", 1), F.lit(", "), short)).when(tail != "", F.concat(tail, F.lit(", "), initials(head))).otherwise(a)


def apa_author(name: Column) -> Column:
    """`Petrov, B. A.` of any of the spellings that wos_author reads."""
    w = wos_author(name)
    letters = F.filter(F.split(F.regexp_extract(w, r", (.*)$", 1), ""), lambda c: c != "")
    dotted = F.array_join(F.transform(letters, lambda c: F.concat(c, F.lit("."))), " ")
    return F.when(w.contains(", "), F.concat(F.regexp_extract(w, "^([^,]*),", 1), F.lit(", "), dotted)).otherwise(w)


def apa_authors(names: Column) -> Column:
    """Authors of an APA citation: up to twenty, the last behind an ampersand; of more, the first nineteen, an ellipsis and the last."""
    a = F.transform(names, apa_author)
    n = F.size(a)
    few = F.when(n == 0, F.lit("")).when(n == 1, F.get(a, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(a, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(", & "), F.element_at(a, -1)))
    return F.when(n > 20, F.concat(F.array_join(F.slice(a, 1, 19), ", "), F.lit(", … "), F.try_element_at(a, F.lit(-1)))).otherwise(few)


def pick_org(parts: Column) -> Column:
    """Of an affiliation's parts the first that names an institution, else the first."""
    named = F.filter(parts, lambda p: lower(p).rlike("|".join(ORG_WORDS)))
    return bib_clean(F.coalesce(F.get(named, F.lit(0)), F.get(parts, F.lit(0)), F.lit("")))


def singular(w: Column) -> Column:
    """A light singular of an English word."""
    n = F.length(w)
    cut = lambda k, add="": F.concat(F.substring(w, F.lit(1), n - k), F.lit(add))
    return F.when((n > 4) & w.endswith("ies"), cut(3, "y")).when((n > 4) & w.rlike("(sses|xes|ches|shes)$"), cut(2)).when((n > 3) & w.endswith("s") & ~w.rlike("(ss|us|is|ics)$"), cut(1)).otherwise(w)


def us_spelling(w: Column) -> Column:
    """British endings and beginnings to American ones, the first that fits of each."""
    out = w
    for british, american in reversed(_ENDINGS):
        fits = w.endswith(british) & (F.length(w) > len(british) + 2)
        out = F.when(fits, F.concat(F.substring(w, F.lit(1), F.length(w) - len(british)), F.lit(american))).otherwise(out)
    whole = out
    for british, american in reversed(_BEGINNINGS):
        out = F.when(whole.startswith(british), F.concat(F.lit(american), F.substring(whole, len(british) + 1, 1 << 30))).otherwise(out)
    return out


def canonical_term(key: Column) -> Column:
    """The form in which variants of a term meet: American spelling word by word, last word singular, no spaces."""
    words = F.transform(F.split(F.translate(key, "-", " "), " "), us_spelling)
    last = singular(F.element_at(words, -1))
    return F.concat(F.array_join(F.slice(words, F.lit(1), F.size(words) - 1), ""), last)


def latex_clean(s: Column) -> Column:
    """TeX accents and macros dropped, braces removed."""
    s = F.regexp_replace(s, r"\\[`'^\"~=.uvHckbdrt]\{?\\?([A-Za-z])\}?", "$1")
    s = F.regexp_replace(s, r"\\(ss)\b", "ss")
    s = F.regexp_replace(s, r"\\([&%$#_])", "$1")
    s = F.regexp_replace(s, r"\\[A-Za-z]+\s?", "")
    return collapse(F.translate(s, "{}", ""))


def xml_escape(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def first_number(s: Column) -> Column:
    return F.regexp_extract(s, r"\d+", 0).try_cast("int")


def json_in_prose(s: Column) -> Column:
    """From the first { or [ to the last } or ] of a text, or null."""
    found = F.regexp_extract(s, r"(?s)[{\[].*[}\]]", 0)
    return F.when(found != "", found)


def sha256_hex(s: Column) -> Column:
    return F.sha2(s.cast("binary"), 256)


def mulberry32(seed: int):
    """A small deterministic generator of floats in [0, 1), for fixtures and seeds."""
    a = seed & 0xFFFFFFFF
    mask = 0xFFFFFFFF

    def draw() -> float:
        nonlocal a
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (a | 1)) & mask
        t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & mask)) & mask
        return ((t ^ (t >> 14)) & mask) / 4294967296.0

    return draw
