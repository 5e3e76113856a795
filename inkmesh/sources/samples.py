"""Sample corpora of any size. Every draw has a number, so each record is made alone, in whatever task it falls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh import schema

#: Numbers of draws set apart for a record. Draws repeat after 2**32, so records do after 2**26.
DRAWS = 64
_LOW = 0xFFFFFFFF

# The step and the multipliers' bits of the mulberry32 generator.
STEP, FIRST_BITS, SECOND_BITS = 0x6D2B79F5, 1, 61

SURNAMES = "Abara Brandt Castell Dumont Eriksen Farkas Gallo Hoang Ibsen Jansky Kamau Lindqvist Mbeki Novotny Oyelaran Pereira Quist Rahimi Sandoval Tanaka".split()
INITIALS = "A B C D E F G H J K L M N P R".split()
COUNTRIES = ("USA", "Germany", "Japan", "Brazil", "France", "Kenya", "Italy", "India", "Norway", "Chile", "Poland", "Canada")
THEMES = {
    "soil": "Soil Letters; carbon; humus; erosion; tillage; compost; nitrogen; drainage; clay; microbes; yield; salinity; mulch",
    "tides": "Coastal Notes; tide; estuary; sediment; storm surge; dune; salt marsh; wave energy; harbour; current; beach; delta; reef",
    "grids": "Power Review; battery; inverter; load; frequency; storage; microgrid; forecast; tariff; outage; solar; wind; voltage",
    "speech": "Voice Studies; phoneme; pitch; accent; hearing; stutter; vowel; prosody; dialect; recognition; synthesis; silence; rhythm",
}


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of 32-bit numbers, which itself may not fit a long."""
    high = F.shiftleft(a.bitwiseAND(F.lit(0xFFFF)) * F.shiftright(b, 16), 16)
    return (a * b.bitwiseAND(F.lit(0xFFFF)) + high).bitwiseAND(F.lit(_LOW))


def draw(seed: int, number: Column) -> Column:
    """Draw `number` (from 0) of a mulberry32 generator, a double from 0 to below 1: its state only adds a step a draw."""
    low = lambda c: c.bitwiseAND(F.lit(_LOW).cast("long"))
    a = low(F.lit(seed).cast("long") + low((low(number.cast("long")) + 1) * F.lit(STEP)))
    mix = lambda x: F.transform(F.array(a), x)[0]  # noqa: E731 - a lambda's variable is evaluated once

    def finish(t: Column) -> Column:
        return F.transform(F.array(low(t.bitwiseXOR(low(t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(SECOND_BITS))))))), lambda u: u.bitwiseXOR(F.shiftright(u, 14)).cast("double") / 4294967296.0)[0]

    return mix(lambda t: F.transform(F.array(_times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(FIRST_BITS)))), finish)[0])


def sample_records(spark: SparkSession, n: int, seed: int = 4242, parts: int | None = None, first_year: int = 2016, last_year: int = 2024) -> DataFrame:
    """n records like those of an export: a theme each with its source and most of its keywords (one in five is of any theme), 1 to 3 authors and countries, 4 to 8
    references to old works of the theme, the first of them most often, and up to three to earlier records, by strings
    that the matchers read; seven in ten have a DOI. The same n and seed give the same records, however many tasks make
    them, and a larger n adds records behind the earlier ones.
    """
    at = lambda i, k: draw(seed, i * DRAWS + k)
    below = lambda i, k, m: F.floor(at(i, k) * m).cast("int")
    listed = lambda values: F.array(*map(F.lit, values))
    each = lambda first, count, f: F.transform(F.sequence(F.lit(0), count - 1), lambda j: f(j + first))
    themes = [t.split("; ") for t in THEMES.values()]

    i = F.col("id")
    theme = lambda i: below(i, 0, len(themes))
    source = lambda i: F.get(listed([t[0] for t in themes]), theme(i))
    year = lambda i: below(i, 1, last_year - first_year + 1) + first_year
    volume = lambda i: (below(i, 2, 60) + 1).cast("string")
    page = lambda i: (i + 1).cast("string")  # noqa: E731 - tells records of one author, year and volume apart
    doi = lambda i: F.when(at(i, 3) < 0.7, F.concat(F.lit("10.5555/ink."), i.cast("string")))
    author = lambda i, k: F.concat(F.get(listed(SURNAMES), below(i, k, len(SURNAMES))), F.lit(", "), F.get(listed(INITIALS), below(i, k + 3, len(INITIALS))))

    def cited(i: Column) -> Column:
        return F.concat(F.replace(author(i, F.lit(10)), F.lit(","), F.lit("")), F.lit(", "), year(i).cast("string"), F.lit(", "), F.upper(source(i)), F.lit(", V"), volume(i), F.lit(", P"), page(i), F.coalesce(F.concat(F.lit(", DOI "), doi(i)), F.lit("")))

    def classic(t: Column, k: Column) -> Column:
        """Work k (0 to 17) of a theme."""
        name = F.get(listed(SURNAMES), F.pmod(t * 7 + k * 3, F.lit(len(SURNAMES))))
        return F.concat(name, F.lit(" "), F.get(listed(INITIALS), F.pmod(t + k, F.lit(len(INITIALS)))), F.lit(", "), (1990 + F.pmod(t * 5 + k * 3, F.lit(20))).cast("string"), F.lit(", CLASSICS, V"), (k + 1).cast("string"), F.lit(", P"), (t * 100 + k + 1).cast("string"))

    words = F.array(*[listed(t[1:]) for t in themes])
    strays = lambda k: F.when(at(i, k + 5) < 0.8, theme(i)).otherwise(F.floor(at(i, k + 5) * 1000 % len(themes)).cast("int"))
    keywords = F.array_distinct(each(20, below(i, 4, 3) + 3, lambda k: F.get(F.get(words, strays(k)), below(i, k, 12))))
    old = F.array_distinct(each(30, below(i, 5, 5) + 4, lambda k: classic(theme(i), F.floor(F.pow(F.lit(19.0), at(i, k))).cast("int") - 1)))  # density 1 / k
    known = F.filter(each(40, F.lit(3), lambda k: F.floor(at(i, k) * 2 * i).cast("long")), lambda j: j < i)
    rows = spark.range(0, n, 1, parts) if parts else spark.range(n)
    values = dict(
        rec_id=i, title=F.concat(F.initcap(F.get(keywords, F.lit(0))), F.lit(" and "), F.element_at(keywords, -1), F.lit(", study "), page(i)), source=source(i), doi=doi(i), volume=volume(i), pages=page(i), doc_type=F.lit("Article"), language=F.lit("English"), key=F.concat(F.lit("INK:"), i.cast("string")), year=year(i),
        cites=F.floor(F.pow(at(i, 6), F.lit(2.3)) * 220), authors=F.array_distinct(each(10, below(i, 7, 3) + 1, lambda k: author(i, k))), keywords=keywords, countries=F.array_distinct(each(50, below(i, 8, 3) + 1, lambda k: F.get(listed(COUNTRIES), below(i, k, 12)))), refs=F.concat(old, F.transform(F.array_distinct(known), cited)),
    )
    none = lambda f: F.array().cast(f.dataType) if f.dataType == schema.RECORDS["authors"].dataType else F.lit(None).cast(f.dataType)
    return rows.select(*[(values[f.name].cast(f.dataType) if f.name in values else none(f)).alias(f.name) for f in schema.RECORDS])
