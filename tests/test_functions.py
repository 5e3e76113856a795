from pyspark.sql import functions as F

from inkmesh.functions import refs as R
from inkmesh.functions import terms as T
from inkmesh.functions import text as X
from inkmesh.operators.geo import COUNTRIES, normalise_countries


def _apply(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_scalars(spark):
    assert _apply(spark, ["\t a  ", None], X.trim) == ["a", None]
    assert _apply(spark, ["ÉCOLE"], X.lower) == ["École".replace("É", "É")[0] + "cole"]
    assert _apply(spark, ["école-of (art) of Life"], X.title_case) == ["école-Of (Art) Of Life"]
    assert _apply(spark, ["Straße Łódž"], X.ascii_fold) == ["Strasse Lodz"]
    assert _apply(spark, [" 12abc", "-3", "x"], X.to_int) == [12, -3, 0]
    assert _apply(spark, ["1.5e2 kg", "."], X.to_double) == [150.0, 0.0]
    assert _apply(spark, ["Machine-Learning's  (ML).", "'Quoted'"], X.bib_key) == ["machine learnings (ml)", "quoted"]
    assert _apply(spark, ["J. Inf. Sci. 2"], X.source_key) == ["jinfsci2"]
    assert _apply(spark, ["https://doi.org/10.1/AbC.", "doi: 10.2/x", "nothing"], X.norm_doi) == ["10.1/abc", "10.2/x", ""]
    assert _apply(spark, ["abcdef"], lambda c: X.truncate(c, 4)) == ["abc…"]
    assert _apply(spark, ["a; b;;c"], lambda c: X.split_any(c, ";")) == [["a", "b", "c"]]


def test_authors(spark):
    assert _apply(spark, ["Maria T. Okonkwo", "Okonkwo M", "Ana-Lucia Ferrari", "Ito, K"], X.wos_author) == ["Okonkwo, MT", "Okonkwo, M", "Ferrari, AL", "Ito, K"]
    df = spark.createDataFrame([(["Maria T. Okonkwo", "Ito, K", "Varga LE"],)], "a array<string>")
    assert df.select(X.apa_authors(F.col("a"))).first()[0] == "Okonkwo, M. T., Ito, K., & Varga, L. E."
    assert _apply(spark, ["van Eck, N. J.", "Smith AB", "Jean Doe"], X.surname) == ["van eck", "smith", "jean"]


def test_spelling(spark):
    assert _apply(spark, ["studies", "classes", "networks", "analysis", "gas"], X.singular) == ["study", "class", "network", "analysis", "gas"]
    assert _apply(spark, ["organisation", "behavioural", "modelling", "epicentre"], X.us_spelling) == ["organization", "behavioral", "modeling", "epicenter"]
    assert len(set(_apply(spark, ["co-word networks", "coword network"], X.canonical_term))) == 1
    assert _apply(spark, [r"{\'E}tude {\"o}f \emph{x}"], X.latex_clean) == ["Etude of x"]


def test_references(spark):
    assert _apply(spark, ["Johnson T, 2010, PATTE RECOG, V54, P118", "Lee J., A title of a paper (2005)", "no year"], R.ref_year) == [2010, 2005, 0]
    p = _apply(spark, ["Johnson T, 2010, PATTE RECOG, V54, P118, DOI 10.1000/AB"], R.ref_parse)[0]
    assert (p.surname, p.year, p.volume, p.page, p.source, p.doi) == ("johnson", 2010, "54", "118", "PATTE RECOG", "10.1000/ab")
    assert _apply(spark, ["Johnson T, 2010, PATTE RECOG, V54, P118", "???"], lambda c: R.ref_key(R.ref_parse(c))) == ["johnson|t|2010|patterecog|54|118", ""]


def test_terms(spark):
    df = spark.createDataFrame([("Deep graph networks", "We use large graph networks, and 2020 trees.")], "t string, a string")
    terms = set(df.select(T.extract_terms(F.col("t"), F.col("a"))).first()[0])
    assert {"deep graph networks", "graph networks", "graph", "trees"} <= terms and "use" not in terms and "networks trees" not in terms
    tokens = _apply(spark, ["Graph Neural Networks of large-scale data"], T.similarity_tokens)[0]
    assert "graph_neural" in tokens and "largescale" in tokens and "data" not in tokens


def test_countries(spark):
    given = ["CA 94305 USA", "Peoples R China", "BD", "Korea", "Unknownland", "Univ Leeds, Leeds, England", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, c string")
    got = [r["c"] for r in normalise_countries(df, "c").orderBy("i").collect()]
    assert got == ["United States", "China", "Bangladesh", "South Korea", "", "United Kingdom", None]


def test_countries_by_code_and_spelling(spark):
    given = ["NZ", "nzl", "New Zealand", "Zagreb, Croatia", "HR", "Doha QAT", "Atlanta, GA", "Cote d'Ivoire", "Tunis, Tunisia.", "Burma", "Hong Kong SAR"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, c string")
    got = [r["c"] for r in normalise_countries(df, "c").orderBy("i").collect()]
    assert got == ["New Zealand", "New Zealand", "New Zealand", "Croatia", "Croatia", "Qatar", "", "Ivory Coast", "Tunisia", "Myanmar", "Hong Kong"]
    names = [line.partition("=")[0].split(" ", 2) for line in COUNTRIES.strip().splitlines()]
    assert all(len(set(column)) == len(names) for column in zip(*names))


def test_generator():
    draw = X.mulberry32(42)
    values = [draw() for _ in range(1000)]
    assert all(0 <= v < 1 for v in values) and 0.45 < sum(values) / 1000 < 0.55 and X.mulberry32(42)() == values[0]
