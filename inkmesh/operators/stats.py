"""Descriptive statistics of a corpus: documents (doc, year, cites, ...) and incidence (doc, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.functions import refs as R
from inkmesh.functions.text import bib_clean
from inkmesh.plans.joins import join_uneven
from inkmesh.plans.scan import running


def _known(year: str = "year") -> Column:
    return F.col(year).isNotNull() & (F.col(year) != 0)


def h_index(rows: DataFrame, by: list[str], cites: str = "cites") -> DataFrame:
    """by, h: the largest h with h documents of h citations or more.

    Ranks need no row of a group together: per group the citation counts are aggregated first, and the window runs over
    distinct counts, so a group with a third of all documents stays small.
    """
    counts = rows.groupBy(*by, F.col(cites).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("c"))
    run = counts.withColumn("rank", F.sum("n").over(w))
    return run.groupBy(*by).agg(F.max(F.greatest(F.lit(0), F.least("c", "rank"))).cast("long").alias("h"))


def g_index(rows: DataFrame, cites: str = "cites") -> DataFrame:
    """One row, g: the largest g whose g most cited documents have g^2 citations together, over distinct counts."""
    counts = rows.groupBy(F.col(cites).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("c"))  # one row a distinct citation count: bounded by the counts, not the documents
    run = counts.withColumn("before", F.sum("n").over(w) - F.col("n")).withColumn("cites_before", F.sum(F.col("n") * F.col("c")).over(w) - F.col("n") * F.col("c"))
    # inside a run of n equal counts c: the largest i <= n with cites_before + i c >= (before + i)^2
    b, s, c = F.col("before"), F.col("cites_before"), F.col("c")
    root = F.floor((c - 2 * b + F.sqrt(F.greatest(F.lit(0.0), (c - 2 * b) * (c - 2 * b) - 4.0 * (b * b - s)))) / 2)
    i = F.least(F.col("n"), F.greatest(F.lit(0), root))
    ok = s + i * c >= (b + i) * (b + i)
    return run.agg(F.coalesce(F.max(F.when(ok, b + i)), F.lit(0)).cast("long").alias("g"))


def actor_table(inc: DataFrame, docs: DataFrame) -> DataFrame:
    """key, docs, cites, h, first_year, last_year, cites_per_doc."""
    each = inc.select("doc", "key").distinct().join(docs, "doc")
    y = F.when(_known(), F.col("year"))
    base = each.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.sum("cites").cast("long").alias("cites"), F.min(y).alias("first_year"), F.max(y).alias("last_year"))
    return base.join(h_index(each, ["key"]), "key").select("key", "docs", "cites", "h", "first_year", "last_year", (F.col("cites") / F.col("docs")).alias("cites_per_doc"))


def top_actors(inc: DataFrame, docs: DataFrame, n: int = 20) -> DataFrame:
    return actor_table(inc, docs).orderBy(F.desc("docs"), F.desc("cites"), "key").limit(n)


def citation_summary(docs: DataFrame) -> DataFrame:
    """One row: docs, uncited, total, mean, median (interpolated), h, g."""
    base = docs.agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("cites") == 0).alias("uncited"), F.sum("cites").cast("long").alias("total"), F.avg("cites").alias("mean"), F.percentile("cites", 0.5).alias("median"))
    return base.join(h_index(docs.withColumn("one", F.lit(1)), ["one"]).select("h")).join(g_index(docs))


# Lower ends of the citation classes.
CITATION_CLASSES = (0, 1, 5, 10, 25, 50, 100, 250)


def citation_classes(docs: DataFrame) -> DataFrame:
    """low, docs of each class; empty classes behind the last full one are left out, inner ones stay."""
    low = F.lit(CITATION_CLASSES[0])
    for x in CITATION_CLASSES[1:]:
        low = F.when(F.col("cites") >= x, x).otherwise(low)
    found = docs.groupBy(low.alias("low")).agg(F.count(F.lit(1)).alias("docs"))
    every = docs.sparkSession.createDataFrame([(x,) for x in CITATION_CLASSES], "low int")
    both = every.join(found, "low", "left").select("low", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"))
    return both.join(F.broadcast(found.agg(F.max("low").alias("top")))).where("low <= top").select("low", "docs")


def growth(docs: DataFrame) -> DataFrame:
    """year, docs, mean_cites, cagr: every year from the first to the last known one; cagr, the same in all rows, from those two."""
    by = docs.where(_known()).groupBy("year").agg(F.count(F.lit(1)).alias("docs"), F.avg("cites").alias("mean_cites"))
    ends = by.agg(F.min("year").alias("y0"), F.max("year").alias("y1"), F.min_by("docs", "year").alias("d0"), F.max_by("docs", "year").alias("d1"))
    years = ends.select(F.explode(F.sequence("y0", "y1")).alias("year"), F.when(F.col("y1") > F.col("y0"), F.pow(F.col("d1") / F.col("d0"), F.lit(1.0) / F.nullif(F.col("y1") - F.col("y0"), F.lit(0))) - 1).alias("cagr"))
    return years.join(by, "year", "left").select("year", F.coalesce("docs", F.lit(0).cast("long")).alias("docs"), F.coalesce("mean_cites", F.lit(0.0)).alias("mean_cites"), "cagr")


def lotka(inc: DataFrame) -> DataFrame:
    """One row: exponent, c and r2 of authors by number of documents, by least squares on logarithms."""
    n = inc.groupBy("key").agg(F.count_distinct("doc").alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("authors"))
    x, y = F.log("n"), F.log("authors")
    return n.agg((-F.regr_slope(y, x)).alias("exponent"), F.exp(F.regr_intercept(y, x)).alias("c"), F.regr_r2(y, x).alias("r2"))


def bradford(inc: DataFrame) -> DataFrame:
    """key, docs, rank, zone (1 to 3): sources by documents, cut where their running sum reaches thirds of all.

    Ranks and running sums come from a scan by ranges, so sources may be as many as they like.
    """
    n = inc.groupBy("key").agg(F.count_distinct("doc").alias("docs"))
    run = running(n, [F.desc("docs"), F.col("key")], ("docs",))
    run = run.join(F.broadcast(run.agg(F.sum("docs").alias("total"))))
    before = F.col("run_docs") - F.col("docs")
    zone = F.when(3 * before < F.col("total"), 1).when(3 * before < 2 * F.col("total"), 2).otherwise(3)
    return run.select("key", "docs", "rank", zone.alias("zone"))


def quality_report(docs: DataFrame, sources: DataFrame, authors: DataFrame, columns: list[str]) -> DataFrame:
    """One row: docs, first and last known year, cites, distinct sources and authors, and how many rows have each column."""
    base = docs.agg(F.count(F.lit(1)).alias("docs"), F.min(F.when(_known(), F.col("year"))).alias("first_year"), F.max(F.when(_known(), F.col("year"))).alias("last_year"), F.sum("cites").cast("long").alias("cites"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) != "").alias(f"has_{c}") for c in columns])
    return base.join(sources.agg(F.count_distinct("key").alias("sources"))).join(authors.agg(F.count_distinct("key").alias("authors")))


def single_multiple(inc: DataFrame) -> DataFrame:
    """key, single, multiple: documents of one country only, and of several."""
    each = inc.select("doc", "key").distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc")))
    return each.groupBy("key").agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("multiple"))


def production(inc: DataFrame, docs: DataFrame, top: int = 10) -> DataFrame:
    """key, year, docs, yearly_cites of the top actors; citations of a document are spread over the years since."""
    each = inc.select("doc", "key").distinct()
    best = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top).select("key")
    dated = docs.where(_known())
    last = dated.agg(F.max("year").alias("last"))
    rows = each.join(best, "key", "left_semi").join(dated, "doc").join(F.broadcast(last))
    return rows.groupBy("key", "year").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("cites") / (F.col("last") - F.col("year") + 1)).alias("yearly_cites"))


def suggest_split(docs: DataFrame) -> DataFrame:
    """One row, split: the first year whose running count reaches half of all dated documents."""
    by = docs.where(_known()).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    run = by.withColumn("run", F.sum("n").over(Window.orderBy("year"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return run.where(2 * F.col("run") >= F.col("total")).agg(F.min("year").alias("split"))


def nearest_rank(rows: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share, value: the element at floor(share (n - 1)) of the sorted values, by running counts of distinct values."""
    n = rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    run = n.withColumn("run", F.sum("n").over(Window.orderBy("v"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = rows.sparkSession.createDataFrame([(float(p),) for p in shares], "share double")
    both = run.join(F.broadcast(wanted), F.col("run") > F.floor(F.col("share") * (F.col("total") - 1)))
    return both.groupBy("share").agg(F.min("v").alias("value"))


def trend_topics(inc: DataFrame, docs: DataFrame, least: int = 5, per_year: int = 3) -> DataFrame:
    """key, freq, q1, median, q3: of the terms with `least` dated documents, each median year's most frequent `per_year`."""
    dated = inc.select("doc", "key").distinct().join(docs.where(_known()), "doc")
    q = dated.groupBy("key").agg(F.count(F.lit(1)).alias("freq"), F.percentile("year", [0.25, 0.5, 0.75]).alias("q")).where(F.col("freq") >= least)
    w = Window.partitionBy(F.round(F.col("q")[1])).orderBy(F.desc("freq"), "key")
    return q.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_year).select("key", "freq", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def rpys(years: DataFrame) -> DataFrame:
    """(year) of cited references -> year, refs, deviation, peak: against the median of the five years around; gaps are zeros.

    A peak deviates upwards, no less than the year before and more than the year after.
    """
    n = years.where(_known()).groupBy("year").agg(F.count(F.lit(1)).alias("refs"))
    return _deviations(n, n.agg(F.min("year").alias("a"), F.max("year").alias("b")))


def _deviations(n: DataFrame, ends: DataFrame) -> DataFrame:
    """(year, refs) and one row (a, b) -> the years a to b, gaps as zeros, with deviation and peak."""
    full = ends.select(F.explode(F.sequence("a", "b")).alias("year")).join(n, "year", "left").select("year", F.coalesce("refs", F.lit(0).cast("long")).alias("refs"))
    w = Window.orderBy("year")  # a row a year
    dev = full.withColumn("deviation", F.col("refs") - F.percentile("refs", 0.5).over(w.rowsBetween(-2, 2)))
    before, after = F.lag("deviation").over(w), F.lead("deviation").over(w)
    return dev.withColumn("peak", (F.col("deviation") > 0) & (before.isNull() | (before <= F.col("deviation"))) & (after.isNull() | (after < F.col("deviation"))))


def rpys_peaks(records: DataFrame, first: int | None = None, last: int | None = None, top: int = 8) -> DataFrame:
    """year, refs, deviation, top_key, top_ref, top_refs: the `top` peaks of the years that references name, most cited reference each.

    References newer than the newest publication do not count. Without `first` the years begin where 1 % of the dated
    references are passed (nearest rank), without `last` they end at the newest; swapped bounds are turned round. A
    reference is its first 80 letters and digits; equals in citations go to the smaller key, equals in deviation to the
    earlier year. No dated reference: no row.
    """
    cited = records.select("rec_id", "year", F.explode("refs").alias("ref")).select("rec_id", R.ref_year(F.col("ref")).alias("y"), "ref").where("y > 0")
    newest = records.agg(F.max("year").alias("newest"))
    dated = cited.join(F.broadcast(newest)).where(F.coalesce("newest", F.lit(0)).isin(0) | (F.col("y") <= F.col("newest")))
    n = dated.groupBy(F.col("y").alias("year")).agg(F.count(F.lit(1)).alias("refs"))
    run = n.withColumn("up_to", F.sum("refs").over(Window.orderBy("year"))).withColumn("all", F.sum("refs").over(Window.partitionBy()))  # a row a year
    ends = run.where(F.col("up_to") > F.floor((F.col("all") - 1) * 0.01)).agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null")
    a, b = F.lit(first or None).cast("int"), F.lit(last or None).cast("int")
    ends = ends.select(F.coalesce(a, "a").alias("a"), F.coalesce(b, "b").alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    peaks = _deviations(n, ends).where("peak").orderBy(F.desc("deviation"), "year").limit(top).drop("peak")
    own = dated.join(F.broadcast(peaks.select(F.col("year").alias("y"))), "y", "left_semi").select(F.col("y").alias("year"), "rec_id", bib_clean(F.col("ref")).alias("ref"))
    each = own.groupBy("year", R.alnum_lower(F.col("ref"), 80).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min_by("ref", F.struct("rec_id", "ref")).alias("ref"))
    best = each.groupBy("year").agg(F.min_by(F.struct("key", "ref", "n"), F.struct(-F.col("n"), "key")).alias("t"))
    return peaks.join(best, "year", "left").select("year", "refs", "deviation", F.col("t.key").alias("top_key"), F.col("t.ref").alias("top_ref"), F.col("t.n").alias("top_refs"))


def _share_ratio(a: str, b: str, na: Column, nb: Column) -> Column:
    return F.log2(((F.col(b) + 0.5) / nb) / ((F.col(a) + 0.5) / na))


def compare_periods(inc: DataFrame, docs: DataFrame, a: tuple[int, int], b: tuple[int, int], least: int = 5) -> DataFrame:
    """key, a, b, log_ratio, change between two ranges of years; the first range wins where they overlap."""
    side = F.when(F.col("year").between(*a), "a").when(F.col("year").between(*b), "b")
    sided = docs.where(_known()).withColumn("side", side).where("side is not null").select("doc", "side")
    total = sided.agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    n = inc.select("doc", "key").distinct().join(sided, "doc").groupBy("key").agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b")).where(F.col("a") + F.col("b") >= least)
    both = n.join(F.broadcast(total)).withColumn("log_ratio", _share_ratio("a", "b", F.col("na"), F.col("nb")))
    return both.select("key", "a", "b", "log_ratio", F.when(F.col("log_ratio") > 0.58, "emerging").when(F.col("log_ratio") < -0.58, "declining").otherwise("stable").alias("change"))


def rising_fading(inc: DataFrame, docs: DataFrame, recent: int = 3) -> DataFrame:
    """key, recent, earlier, ratio, trend: keywords whose share in the last years rose over 1.6 times, or fell under half."""
    dated = docs.where(_known())
    last = dated.agg(F.max("year").alias("last"))
    marked = dated.join(F.broadcast(last)).withColumn("new", F.col("year") > F.col("last") - recent).select("doc", "new")
    total = marked.agg(F.count_if("new").alias("r_all"), F.count_if(~F.col("new")).alias("b_all"))
    n = inc.select("doc", "key").distinct().join(marked, "doc").groupBy("key").agg(F.count_if("new").alias("recent"), F.count_if(~F.col("new")).alias("earlier")).where(F.col("recent") + F.col("earlier") >= 4)
    both = n.join(F.broadcast(total)).withColumn("ratio", ((F.col("recent") + 0.5) / F.col("r_all")) / ((F.col("earlier") + 0.5) / F.col("b_all")))
    trend = F.when((F.col("ratio") > 1.6) & (F.col("recent") >= 3), "rising").when((F.col("ratio") < 0.5) & (F.col("earlier") >= 4), "fading")
    return both.select("key", "recent", "earlier", "ratio", trend.alias("trend")).where("trend is not null")


def emerging_keys(fresh: DataFrame, known: DataFrame, mapped: DataFrame, top: int = 12) -> DataFrame:
    """key, n: keywords of two or more fresh documents that are neither on the map nor in more than one known document."""
    new = fresh.groupBy("key").agg(F.count_distinct("doc").alias("n")).where("n >= 2 and length(key) >= 3")
    old = known.groupBy("key").agg(F.count_distinct("doc").alias("m")).where("m > 1").select("key")
    return new.join(old, "key", "left_anti").join(mapped.select("key"), "key", "left_anti").orderBy(F.desc("n"), "key").limit(top)


def three_field(left: DataFrame, mid: DataFrame, right: DataFrame, top: int = 10) -> DataFrame:
    """side, a, b, docs: documents that hold a left and a mid unit, and a mid and a right one, among each field's top units."""

    def best(inc: DataFrame) -> DataFrame:
        each = inc.select("doc", "key").distinct()
        keys = each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top).select("key")
        return each.join(keys, "key", "left_semi")

    l, m, r = best(left), best(mid), best(right)
    pair = lambda x, y, side: x.select("doc", F.col("key").alias("a")).join(y.select("doc", F.col("key").alias("b")), "doc").groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs")).select(F.lit(side).alias("side"), "a", "b", "docs")
    return pair(l, m, "left").unionByName(pair(m, r, "right"))


def label_suffixes(labels: DataFrame) -> DataFrame:
    """(doc, label) -> doc, label: repeated labels get a, b, c ... in document order, beginning anew after z.

    A label's place in the order of all labels and documents, less that of its first document, is its number: no task
    holds all documents of a label. Null labels stay null.
    """
    run = running(labels.select("doc", "label").where("label is not null"), [F.col("label"), F.col("doc")])
    facts = run.groupBy("label").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > 1).alias("many"))
    letter = F.char(F.lit(97) + F.pmod(F.col("rank") - F.col("first"), F.lit(26)))
    named = join_uneven(run, facts, "label", "n").select("doc", F.when(F.col("many"), F.concat("label", letter)).otherwise(F.col("label")).alias("label"))
    return named.unionByName(labels.select("doc", "label").where("label is null"))


def partition_agreement(labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row, nmi and ari of two labellings of the same items, from their contingency table."""
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = (cells.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in "ab")
    full = cells.join(rows, "a").join(cols, "b").withColumn("all", F.sum("n").over(Window.partitionBy()))
    two = lambda x: x * (x - 1) / 2
    p = lambda c: F.col(c) / F.col("all")
    mutual = full.agg(F.sum(p("n") * F.log(F.col("n") * F.col("all") / (F.col("na") * F.col("nb")))).alias("i"), F.sum(two(F.col("n"))).alias("same"), F.max("all").alias("all"))
    h = lambda t, c: t.withColumn("all", F.sum(c).over(Window.partitionBy())).agg(F.sum(-p(c) * F.log(p(c))).alias(f"h{c[1]}"), F.sum(two(F.col(c))).alias(f"s{c[1]}"))
    x = mutual.join(h(rows, "na")).join(h(cols, "nb"))
    expected = F.col("sa") * F.col("sb") / two(F.col("all"))
    most = (F.col("sa") + F.col("sb")) / 2
    return x.select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("i") / (F.col("ha") + F.col("hb"))).otherwise(1.0).alias("nmi"), F.when(most == expected, 1.0).otherwise(F.try_divide(F.col("same") - expected, most - expected)).alias("ari"))


def cluster_info(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cluster, size, weight, centrality (links to others), density (inner strength by size) and quadrant, split at the medians.

    nodes: key, cluster, weight; links: a, b, w.
    """
    c = nodes.select("key", "cluster")
    ends = links.join(c.select(F.col("key").alias("a"), F.col("cluster").alias("ca")), "a").join(c.select(F.col("key").alias("b"), F.col("cluster").alias("cb")), "b")
    inner = ends.where("ca = cb").groupBy(F.col("ca").alias("cluster")).agg(F.sum("w").alias("inner"))
    outer = ends.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("cluster"), "w").groupBy("cluster").agg(F.sum("w").alias("centrality"))
    size = nodes.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("weight").alias("weight"))
    x = size.join(inner, "cluster", "left").join(outer, "cluster", "left").select("cluster", "size", "weight", F.coalesce("centrality", F.lit(0.0)).alias("centrality"), (F.coalesce("inner", F.lit(0.0)) / F.col("size")).alias("density"))
    mid = x.agg(F.percentile("centrality", 0.5).alias("mc"), F.percentile("density", 0.5).alias("md"))
    x = x.join(F.broadcast(mid))
    far, thick = F.col("centrality") >= F.col("mc"), F.col("density") >= F.col("md")
    return x.select("cluster", "size", "weight", "centrality", "density", F.when(far & thick, "motor").when(thick, "niche").when(far, "basic").otherwise("emerging or declining").alias("quadrant"))


def bursts(inc: DataFrame, docs: DataFrame, least: int = 5, s: float = 2.0, gamma: float = 1.0) -> DataFrame:
    """key, start, end, strength: the strongest burst of each term, by a two-state automaton over the observed years.

    Per term its yearly counts r of d documents are gathered, a number a year; the cheaper of two costs is carried
    forward by a fold over that array, with back pointers, and a second fold walks back. Terms of under three years,
    or in every document, have none.
    """
    dated = docs.where(_known())
    d = dated.groupBy("year").agg(F.count(F.lit(1)).alias("d"))
    year_n = d.agg(F.sort_array(F.collect_list(F.struct("year", "d"))).alias("years"), F.sum("d").alias("all_docs"), F.count(F.lit(1)).alias("n_years")).where("n_years >= 3")
    r = inc.select("doc", "key").distinct().join(dated, "doc").groupBy("key", "year").agg(F.count(F.lit(1)).alias("r"))
    per = r.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("year", "r"))).alias("counts"), F.sum("r").alias("own_docs")).where(F.col("own_docs") >= least)
    x = per.join(F.broadcast(year_n)).where("own_docs < all_docs")
    p0 = F.col("own_docs") / F.col("all_docs")
    p1 = F.least(F.lit(0.9999), s * p0)
    cost = lambda p, r_, d_: -(r_ * F.log(p) + (d_ - r_) * F.log(1 - p))
    x = x.withColumn("step", gamma * F.log(F.col("n_years"))).withColumn("p0", p0).withColumn("p1", p1)
    x = x.withColumn("seq", F.transform("years", lambda y: F.struct(y["year"].alias("year"), cost(F.col("p0"), F.coalesce(F.try_element_at("counts", y["year"]), F.lit(0)), y["d"]).alias("c0"), cost(F.col("p1"), F.coalesce(F.try_element_at("counts", y["year"]), F.lit(0)), y["d"]).alias("c1"))))
    none = F.array().cast("array<struct<b0:int,b1:int>>")
    start = F.struct(F.lit(0.0).alias("a0"), F.lit(float("inf")).alias("a1"), none.alias("back"))

    def forward(acc: Column, y: Column) -> Column:
        up, stay = acc["a0"] + F.col("step"), acc["a1"]
        return F.struct((F.least(acc["a0"], acc["a1"]) + y["c0"]).alias("a0"), (F.least(up, stay) + y["c1"]).alias("a1"), F.concat(acc["back"], F.array(F.struct(F.when(acc["a0"] <= acc["a1"], 0).otherwise(1).alias("b0"), F.when(up < stay, 0).otherwise(1).alias("b1")))).alias("back"))

    x = x.withColumn("f", F.aggregate("seq", start, forward))
    ended = F.struct(F.when(F.col("f.a1") < F.col("f.a0"), 1).otherwise(0).alias("s"), F.array().cast("array<int>").alias("states"))
    x = x.withColumn("states", F.aggregate(F.reverse("f.back"), ended, lambda acc, b: F.struct(F.when(acc["s"] == 1, b["b1"]).otherwise(b["b0"]).alias("s"), F.concat(F.array(acc["s"]), acc["states"]).alias("states")))["states"])
    run = F.aggregate(
        F.arrays_zip("seq", "states"),
        F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("to"), F.lit(0.0).alias("w"), F.array().cast("array<struct<strength:double,start:int,end:int>>").alias("all")),
        lambda acc, y: F.when(y["states"] == 1, F.struct(F.coalesce(acc["at"], y["seq"]["year"]).alias("at"), y["seq"]["year"].alias("to"), (acc["w"] + y["seq"]["c0"] - y["seq"]["c1"]).alias("w"), acc["all"].alias("all"))).otherwise(
            F.struct(F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("to"), F.lit(0.0).alias("w"), F.when(acc["at"].isNotNull(), F.concat(acc["all"], F.array(F.struct(acc["w"].alias("strength"), acc["at"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["all"]).alias("all"))
        ),
        lambda acc: F.when(acc["at"].isNotNull(), F.concat(acc["all"], F.array(F.struct(acc["w"].alias("strength"), acc["at"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["all"]),
    )
    best = x.withColumn("best", F.array_max(run))
    return best.where("best is not null and best.strength > 0").select("key", F.col("best.start").alias("start"), F.col("best.end").alias("end"), F.col("best.strength").alias("strength"))
