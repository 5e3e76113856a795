"""Registered queries: the operators over a bibliographic reading of the star-schema tables, each beside its DuckDB SQL.

An order is a document: its year is the order's, its citations are the price in ten thousands, its keywords are the
brands of its parts, its authors the suppliers, its countries theirs, its source the customer, and its references the
parts. Documents cite the same customer's order before them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.functions import text as X
from inkmesh.functions.terms import similarity_token_rows
from inkmesh.operators import cleaning, density, graph, match, network, reports, similarity, stats, themes, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ctes = _CTES.rstrip(",\n") + "\n" if sql.startswith("SELECT") else _CTES
            ORACLE_SQL[f.__name__] = f"WITH {sql}" if sql.startswith("RECURSIVE") else f"WITH {ctes}{sql}"
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """doc, year, cites, source."""
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"), F.floor(F.col("o_totalprice") / 10000).cast("int").alias("cites"), F.col("o_custkey").alias("source"))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = _t(spark, d, "lineitem"), _t(spark, d, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("doc"), F.col("p_brand").alias("key")).distinct()


def types(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = _t(spark, d, "lineitem"), _t(spark, d, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(F.col("l_orderkey").alias("doc"), F.col("p_type").alias("key")).distinct()


def authors(spark: SparkSession, d: str) -> DataFrame:
    lines, s = _t(spark, d, "lineitem"), _t(spark, d, "supplier")
    return lines.join(s, lines.l_suppkey == s.s_suppkey).select(F.col("l_orderkey").alias("doc"), F.col("s_name").alias("key")).distinct()


def countries(spark: SparkSession, d: str) -> DataFrame:
    lines, s, n = _t(spark, d, "lineitem"), _t(spark, d, "supplier"), _t(spark, d, "nation")
    home = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name")
    return lines.join(home, lines.l_suppkey == home.s_suppkey).select(F.col("l_orderkey").alias("doc"), F.col("n_name").alias("key")).distinct()


def sources(spark: SparkSession, d: str) -> DataFrame:
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("doc"), F.col("c_name").alias("key"))


def references(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("ref")).distinct()


def citations(spark: SparkSession, d: str) -> DataFrame:
    """citing, cited: a document cites the one before it of the same source."""
    w = Window.partitionBy("source").orderBy("year", "doc")
    return documents(spark, d).select(F.col("doc").alias("citing"), F.lag("doc").over(w).alias("cited")).where("cited is not null")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


_CTES = """docs AS (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INT) AS year, CAST(floor(o_totalprice / 10000) AS INT) AS cites, o_custkey AS source FROM orders),
kw AS (SELECT DISTINCT l_orderkey AS doc, p_brand AS key FROM lineitem JOIN part ON l_partkey = p_partkey),
ty AS (SELECT DISTINCT l_orderkey AS doc, p_type AS key FROM lineitem JOIN part ON l_partkey = p_partkey),
au AS (SELECT DISTINCT l_orderkey AS doc, s_name AS key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
co AS (SELECT DISTINCT l_orderkey AS doc, n_name AS key FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
so AS (SELECT o_orderkey AS doc, c_name AS key FROM orders JOIN customer ON o_custkey = c_custkey),
rf AS (SELECT DISTINCT l_orderkey AS doc, l_partkey AS ref FROM lineitem),
ci AS (SELECT * FROM (SELECT doc AS citing, lag(doc) OVER (PARTITION BY source ORDER BY year, doc) AS cited FROM docs) WHERE cited IS NOT NULL),
"""
_PAIRS = "pairs AS (SELECT a.key AS a, b.key AS b, CAST(count(*) AS DOUBLE) AS w FROM {0} a JOIN {0} b ON a.doc = b.doc AND a.key < b.key GROUP BY 1, 2)"
_KWPAIRS = _PAIRS.format("(SELECT * FROM kw WHERE key IN (SELECT key FROM kw GROUP BY key HAVING count(*) >= 5))")
_TLS = "tls AS (SELECT key, count(*) AS links, sum(w) AS tls FROM (SELECT a AS key, w FROM pairs UNION ALL SELECT b, w FROM pairs) GROUP BY key)"
_FRAC = "n AS (SELECT doc, count(*) AS n FROM kw GROUP BY doc), pairs AS (SELECT a.key AS a, b.key AS b, sum(1.0::DOUBLE / (n - 1)) AS w FROM kw a JOIN kw b ON a.doc = b.doc AND a.key < b.key JOIN n ON n.doc = a.doc GROUP BY 1, 2)"
_DOCPAIRS = "rn AS (SELECT ref FROM rf GROUP BY ref HAVING count(*) BETWEEN 2 AND 2000), rk AS (SELECT rf.* FROM rf JOIN rn USING (ref)), dp AS (SELECT a.doc AS a, b.doc AS b, CAST(count(*) AS DOUBLE) AS w FROM rk a JOIN rk b ON a.ref = b.ref AND a.doc < b.doc GROUP BY 1, 2)"


@_register(f"{_KWPAIRS}, {_TLS} SELECT a, b, w, round((SELECT sum(2 * w) FROM pairs) * w / (ta.tls * tb.tls), 9) AS s FROM pairs JOIN tls ta ON a = ta.key JOIN tls tb ON b = tb.key")
def cooc_brand_assoc(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of five documents or more that occur together, and their association strength."""
    return _round(network.normalise(network.cooccurrence(keywords(spark, d), 5)), "s", digits=9)


@_register(f"{_FRAC} SELECT a, b, round(w, 6) AS w FROM pairs")
def cooc_fractional(spark: SparkSession, d: str) -> DataFrame:
    return _round(network.cooccurrence(keywords(spark, d), fractional=True), "w")


@_register(f"{_KWPAIRS}, {_TLS} SELECT a, b, w, round(w / ta.tls + w / tb.tls, 9) AS s FROM pairs JOIN tls ta ON a = ta.key JOIN tls tb ON b = tb.key")
def norm_fractionalization(spark: SparkSession, d: str) -> DataFrame:
    return _round(network.normalise(network.cooccurrence(keywords(spark, d), 5), "fractionalization"), "s", digits=9)


@_register(f"{_KWPAIRS}, {_TLS} SELECT a, b, w, round(w / sqrt(ta.tls * tb.tls), 9) AS s FROM pairs JOIN tls ta ON a = ta.key JOIN tls tb ON b = tb.key")
def norm_linlog(spark: SparkSession, d: str) -> DataFrame:
    return _round(network.normalise(network.cooccurrence(keywords(spark, d), 5), "linlog"), "s", digits=9)


@_register("few AS (SELECT * FROM au WHERE doc IN (SELECT doc FROM au GROUP BY doc HAVING count(*) <= 5)), kept AS (SELECT * FROM few WHERE key IN (SELECT key FROM few GROUP BY key HAVING count(*) >= 5)), " + _PAIRS.format("kept") + " SELECT * FROM pairs")
def coauthor_suppliers(spark: SparkSession, d: str) -> DataFrame:
    """Co-authorship in documents of at most five authors."""
    return network.cooccurrence(authors(spark, d), 5, max_units=5)


@_register(_PAIRS.format("co") + " SELECT * FROM pairs")
def country_coauth(spark: SparkSession, d: str) -> DataFrame:
    return network.cooccurrence(countries(spark, d))


@_register(_PAIRS.format("ty") + " SELECT * FROM pairs")
def cocitation_brands(spark: SparkSession, d: str) -> DataFrame:
    """Co-citation, part types as the cited units."""
    return network.cooccurrence(types(spark, d))


@_register(f"{_DOCPAIRS} SELECT * FROM dp")
def coupling_documents(spark: SparkSession, d: str) -> DataFrame:
    return network.coupling(references(spark, d))


@_register(f"{_DOCPAIRS}, x AS (SELECT least(u.key, v.key) AS a, greatest(u.key, v.key) AS b, w FROM dp JOIN co u ON u.doc = dp.a JOIN co v ON v.doc = dp.b WHERE u.key <> v.key) SELECT a, b, sum(w) AS w FROM x GROUP BY 1, 2")
def coupling_countries(spark: SparkSession, d: str) -> DataFrame:
    """Bibliographic coupling of countries through their documents' shared references."""
    return network.coupling_units(references(spark, d), countries(spark, d))


@_register("SELECT least(citing, cited) AS a, greatest(citing, cited) AS b, CAST(count(*) AS DOUBLE) AS w FROM ci GROUP BY 1, 2")
def citation_documents(spark: SparkSession, d: str) -> DataFrame:
    return network.citation_links(citations(spark, d))


@_register("l AS (SELECT least(citing, cited) AS a, greatest(citing, cited) AS b, CAST(count(*) AS DOUBLE) AS w FROM ci GROUP BY 1, 2), n AS (SELECT doc, count(*) AS n FROM kw GROUP BY doc), k AS (SELECT kw.doc, key, n FROM kw JOIN n USING (doc)) SELECT least(u.key, v.key) AS a, greatest(u.key, v.key) AS b, round(sum(w / (u.n * v.n)), 6) AS w FROM l JOIN k u ON u.doc = l.a JOIN k v ON v.doc = l.b WHERE u.key <> v.key GROUP BY 1, 2")
def citation_units_fractional(spark: SparkSession, d: str) -> DataFrame:
    """Direct citation between keywords, fractionally counted."""
    return _round(network.unit_links(network.citation_links(citations(spark, d)), keywords(spark, d), fractional=True), "w")


@_register("SELECT key, count(*) AS occ, CAST(sum(cites) AS BIGINT) AS cites, round(avg(year), 6) AS avg_year FROM kw JOIN docs USING (doc) GROUP BY key")
def item_stats(spark: SparkSession, d: str) -> DataFrame:
    return _round(network.item_stats(keywords(spark, d), documents(spark, d)), "avg_year")


@_register(f"{_KWPAIRS}, {_TLS} SELECT key, links, tls FROM tls")
def total_link_strength(spark: SparkSession, d: str) -> DataFrame:
    return network.total_link_strength(network.cooccurrence(keywords(spark, d), 5))


@_register(f"{_FRAC}, {_TLS} SELECT key, round(tls, 6) AS tls FROM tls")
def strength_without_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Total link strength without making a pair; the SQL makes them."""
    return _round(network.strength_without_pairs(keywords(spark, d), fractional=True).where("tls > 0"), "tls")


@_register("SELECT count(*) AS keys, count(*) FILTER (n < 2) AS hidden_singles FROM (SELECT key, count(*) AS n FROM so GROUP BY key)")
def hidden_singles(spark: SparkSession, d: str) -> DataFrame:
    return network.hidden_singles(sources(spark, d))


@_register(f"{_KWPAIRS}, h AS (SELECT a, b, w FROM pairs UNION ALL SELECT b, a, w FROM pairs), r AS (SELECT a, sum(w) AS s FROM h GROUP BY a) SELECT h.a AS key, round(sum(w / r.s * ln(w / r.s / (o.s / (SELECT sum(s) FROM r)))), 9) AS relevance FROM h JOIN r ON h.a = r.a JOIN r o ON h.b = o.a GROUP BY h.a")
def term_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _round(network.term_relevance(network.cooccurrence(keywords(spark, d), 5)), "relevance", digits=9)


@_register(f"{_KWPAIRS}, {_TLS}, st AS (SELECT key, count(*) AS occ FROM kw GROUP BY key), r AS (SELECT key, occ, tls, CAST(row_number() OVER (ORDER BY tls DESC, occ DESC, key) AS INT) AS rank FROM st JOIN tls USING (key)) SELECT * FROM r WHERE rank <= 10")
def select_top_items(spark: SparkSession, d: str) -> DataFrame:
    """The ten strongest items: the cap is the map's size."""
    inc = keywords(spark, d)
    return network.rank_items(network.item_stats(inc, documents(spark, d)), network.cooccurrence(inc, 5), cap=10)


@_register("m AS (SELECT year, avg(cites) AS m FROM docs GROUP BY year) SELECT key, round(avg(cites / m), 9) AS norm_citations FROM kw JOIN docs USING (doc) JOIN m USING (year) WHERE m > 0 GROUP BY key")
def norm_citations(spark: SparkSession, d: str) -> DataFrame:
    return _round(network.normalised_citations(documents(spark, d), keywords(spark, d)), "norm_citations", digits=9)


@_register("st AS (SELECT key, count(*) AS occ FROM so GROUP BY key) SELECT CAST(m AS INT) AS m, (SELECT count(*) FROM st WHERE occ >= m) AS items FROM range(1, 21) t(m)")
def sensitivity_curve(spark: SparkSession, d: str) -> DataFrame:
    return network.sensitivity(network.item_stats(sources(spark, d), documents(spark, d)))


@_register("st AS (SELECT key, count(*) AS occ FROM so GROUP BY key) SELECT CASE WHEN (SELECT count(*) FROM st) < 50 THEN 1 ELSE greatest(1, min(occ)) END AS threshold FROM (SELECT occ FROM st ORDER BY occ DESC LIMIT 50)")
def suggest_threshold(spark: SparkSession, d: str) -> DataFrame:
    return network.suggest_threshold(network.item_stats(sources(spark, d), documents(spark, d)), 50)


@_register("n AS (SELECT doc, count(*) AS n FROM co GROUP BY doc) SELECT key, count(*) AS docs, CAST(sum(cites) AS BIGINT) AS cites, CAST(sum(n - 1) AS BIGINT) AS partner_pairs, count(*) FILTER (n > 1) AS shared_docs FROM co JOIN n USING (doc) JOIN docs USING (doc) GROUP BY key")
def geo_stats(spark: SparkSession, d: str) -> DataFrame:
    return network.partner_counts(countries(spark, d), documents(spark, d))


_H = "r AS (SELECT key, cites, row_number() OVER (PARTITION BY key ORDER BY cites DESC) AS rn FROM {0} JOIN docs USING (doc)), h AS (SELECT key, CAST(coalesce(max(CASE WHEN cites >= rn THEN rn END), 0) AS BIGINT) AS h FROM r GROUP BY key)"


@_register(_H.format("au") + " SELECT key, count(*) AS docs, CAST(sum(cites) AS BIGINT) AS cites, any_value(h) AS h, min(year) AS first_year, max(year) AS last_year, round(CAST(sum(cites) AS DOUBLE) / count(*), 6) AS cites_per_doc FROM au JOIN docs USING (doc) JOIN h USING (key) GROUP BY key")
def actors_h(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.actor_table(authors(spark, d), documents(spark, d)), "cites_per_doc")


@_register(_H.format("so") + ", t AS (SELECT key, count(*) AS docs, CAST(sum(cites) AS BIGINT) AS cites, any_value(h) AS h, min(year) AS first_year, max(year) AS last_year, round(CAST(sum(cites) AS DOUBLE) / count(*), 6) AS cites_per_doc FROM so JOIN docs USING (doc) JOIN h USING (key) GROUP BY key) SELECT * FROM t ORDER BY docs DESC, cites DESC, key LIMIT 20")
def top_actors_h(spark: SparkSession, d: str) -> DataFrame:
    """A top-20 report."""
    return _round(stats.top_actors(sources(spark, d), documents(spark, d)), "cites_per_doc")


@_register("r AS (SELECT cites, row_number() OVER (ORDER BY cites DESC) AS rn, sum(cites) OVER (ORDER BY cites DESC ROWS UNBOUNDED PRECEDING) AS s FROM docs) SELECT count(*) AS docs, count(*) FILTER (cites = 0) AS uncited, CAST(sum(cites) AS BIGINT) AS total, round(avg(cites), 6) AS mean, quantile_cont(cites, 0.5) AS median, CAST((SELECT max(rn) FROM r WHERE cites >= rn) AS BIGINT) AS h, CAST((SELECT max(rn) FROM r WHERE s >= rn * rn) AS BIGINT) AS g FROM docs")
def citation_summary_hg(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.citation_summary(documents(spark, d)), "mean")


@_register("c AS (SELECT CASE WHEN cites >= 250 THEN 250 WHEN cites >= 100 THEN 100 WHEN cites >= 50 THEN 50 WHEN cites >= 25 THEN 25 WHEN cites >= 10 THEN 10 WHEN cites >= 5 THEN 5 WHEN cites >= 1 THEN 1 ELSE 0 END AS low FROM docs) SELECT CAST(t.low AS INT) AS low, (SELECT count(*) FROM c WHERE c.low = t.low) AS docs FROM (VALUES (0), (1), (5), (10), (25), (50), (100), (250)) t(low) WHERE t.low <= (SELECT max(low) FROM c)")
def citation_classes(spark: SparkSession, d: str) -> DataFrame:
    return stats.citation_classes(documents(spark, d))


@_register("y AS (SELECT year, count(*) AS docs, avg(cites) AS m FROM docs GROUP BY year), e AS (SELECT min(year) AS y0, max(year) AS y1 FROM y) SELECT CAST(s.year AS INT) AS year, coalesce(docs, 0) AS docs, round(coalesce(m, 0), 6) AS mean_cites, round(pow((SELECT docs FROM y, e WHERE year = y1)::DOUBLE / (SELECT docs FROM y, e WHERE year = y0), 1.0 / (SELECT y1 - y0 FROM e)) - 1, 6) AS cagr FROM (SELECT unnest(range(y0, y1 + 1)) AS year FROM e) s LEFT JOIN y ON y.year = s.year")
def growth_by_year(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.growth(documents(spark, d)), "mean_cites", "cagr")


@_register("n AS (SELECT key, count(*) AS docs FROM so GROUP BY key), r AS (SELECT key, docs, row_number() OVER (ORDER BY docs DESC, key) AS rank, sum(docs) OVER (ORDER BY docs DESC, key ROWS UNBOUNDED PRECEDING) AS run, (SELECT sum(docs) FROM n) AS total FROM n) SELECT key, docs, rank, CAST(CASE WHEN 3 * (run - docs) < total THEN 1 WHEN 3 * (run - docs) < 2 * total THEN 2 ELSE 3 END AS INT) AS zone FROM r")
def bradford_zones(spark: SparkSession, d: str) -> DataFrame:
    return stats.bradford(sources(spark, d))


@_register("n AS (SELECT n, count(*) AS k FROM (SELECT key, count(*) AS n FROM so GROUP BY key) GROUP BY n) SELECT round(-regr_slope(ln(k), ln(n)), 6) AS exponent, round(exp(regr_intercept(ln(k), ln(n))), 6) AS c, round(regr_r2(ln(k), ln(n)), 6) AS r2 FROM n")
def lotka_fit(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.lotka(sources(spark, d)), "exponent", "c", "r2")


@_register("q AS (SELECT key, count(*) AS freq, quantile_cont(year, 0.25) AS q1, quantile_cont(year, 0.5) AS median, quantile_cont(year, 0.75) AS q3 FROM so JOIN docs USING (doc) GROUP BY key HAVING count(*) >= 5), r AS (SELECT *, row_number() OVER (PARTITION BY round(median) ORDER BY freq DESC, key) AS rn FROM q) SELECT key, freq, q1, median, q3 FROM r WHERE rn <= 3")
def trend_topics(spark: SparkSession, d: str) -> DataFrame:
    """Each median year's three most frequent topics, the feature's own limit."""
    return stats.trend_topics(sources(spark, d), documents(spark, d))


@_register("n AS (SELECT year, count(*) AS refs FROM docs GROUP BY year), e AS (SELECT unnest(range(min(year), max(year) + 1)) AS year FROM n), f AS (SELECT CAST(e.year AS INT) AS year, coalesce(refs, 0) AS refs FROM e LEFT JOIN n USING (year)), v AS (SELECT year, refs, refs - quantile_cont(refs, 0.5) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS deviation FROM f), p AS (SELECT *, lag(deviation) OVER (ORDER BY year) AS b, lead(deviation) OVER (ORDER BY year) AS a FROM v) SELECT year, refs, deviation, deviation > 0 AND (b IS NULL OR b <= deviation) AND (a IS NULL OR a < deviation) AS peak FROM p")
def rpys_deviation(spark: SparkSession, d: str) -> DataFrame:
    return stats.rpys(documents(spark, d))


_RATIO = "log2(((b + 0.5) / nb) / ((a + 0.5) / na))"


@_register(f"s AS (SELECT doc, CASE WHEN year BETWEEN 1995 AND 1997 THEN 'a' WHEN year BETWEEN 1998 AND 2001 THEN 'b' END AS side FROM docs), t AS (SELECT count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM s), n AS (SELECT key, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM so JOIN s USING (doc) WHERE side IS NOT NULL GROUP BY key HAVING count(*) >= 5) SELECT key, a, b, round({_RATIO}, 6) AS log_ratio, CASE WHEN {_RATIO} > 0.58 THEN 'emerging' WHEN {_RATIO} < -0.58 THEN 'declining' ELSE 'stable' END AS change FROM n, t")
def compare_periods(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.compare_periods(sources(spark, d), documents(spark, d), (1995, 1997), (1998, 2001)), "log_ratio")


@_register("y AS (SELECT year, count(*) AS n FROM docs GROUP BY year), r AS (SELECT year, sum(n) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) AS run FROM y) SELECT min(year) AS split FROM r WHERE 2 * run >= (SELECT sum(n) FROM y)")
def period_split(spark: SparkSession, d: str) -> DataFrame:
    return stats.suggest_split(documents(spark, d))


_TOP = "{1} AS (SELECT * FROM {0} WHERE key IN (SELECT key FROM (SELECT key, count(*) AS n FROM {0} GROUP BY key ORDER BY n DESC, key LIMIT 10)))"


@_register(f"{_TOP.format('au', 'l')}, {_TOP.format('kw', 'm')}, {_TOP.format('co', 'r')} SELECT 'left' AS side, l.key AS a, m.key AS b, count(*) AS docs FROM l JOIN m USING (doc) GROUP BY 2, 3 UNION ALL SELECT 'right', m.key, r.key, count(*) FROM m JOIN r USING (doc) GROUP BY 2, 3")
def three_field(spark: SparkSession, d: str) -> DataFrame:
    """Authors, keywords and countries, ten of each: the plot's own limit."""
    return stats.three_field(authors(spark, d), keywords(spark, d), countries(spark, d))


@_register("n AS (SELECT doc, count(*) AS n FROM co GROUP BY doc) SELECT key, count(*) FILTER (n = 1) AS single, count(*) FILTER (n > 1) AS multiple FROM co JOIN n USING (doc) GROUP BY key")
def scp_mcp(spark: SparkSession, d: str) -> DataFrame:
    return stats.single_multiple(countries(spark, d))


@_register("b AS (SELECT key FROM (SELECT key, count(*) AS n FROM au GROUP BY key ORDER BY n DESC, key LIMIT 10)) SELECT key, year, count(*) AS docs, round(sum(CAST(cites AS DOUBLE) / ((SELECT max(year) FROM docs) - year + 1)), 6) AS yearly_cites FROM au JOIN b USING (key) JOIN docs USING (doc) GROUP BY key, year")
def production_over_time(spark: SparkSession, d: str) -> DataFrame:
    """Yearly output of the ten most productive authors, the report's own limit."""
    return _round(stats.production(authors(spark, d), documents(spark, d)), "yearly_cites")


@_register("SELECT count(*) AS docs, min(year) AS first_year, max(year) AS last_year, CAST(sum(cites) AS BIGINT) AS cites, count(*) FILTER (source IS NOT NULL) AS has_source, (SELECT count(DISTINCT key) FROM so) AS sources, (SELECT count(DISTINCT key) FROM au) AS authors FROM docs")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return stats.quality_report(documents(spark, d), sources(spark, d), authors(spark, d), ["source"])


@_register("x AS (SELECT lang AS a, quality AS b FROM documents JOIN labels USING (doc_id)), c AS (SELECT a, b, count(*)::DOUBLE AS n FROM x GROUP BY a, b), ra AS (SELECT a, sum(n) AS na FROM c GROUP BY a), rb AS (SELECT b, sum(n) AS nb FROM c GROUP BY b), t AS (SELECT sum(n) AS t FROM c), i AS (SELECT sum(n / t * ln(n * t / (na * nb))) AS i, sum(n * (n - 1) / 2) AS same FROM c JOIN ra USING (a) JOIN rb USING (b), t), h AS (SELECT (SELECT sum(-na / t * ln(na / t)) FROM ra, t) AS ha, (SELECT sum(-nb / t * ln(nb / t)) FROM rb, t) AS hb, (SELECT sum(na * (na - 1) / 2) FROM ra) AS sa, (SELECT sum(nb * (nb - 1) / 2) FROM rb) AS sb) SELECT round(2 * i / (ha + hb), 9) AS nmi, round((same - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 9) AS ari FROM i, h, t")
def partition_agreement(spark: SparkSession, d: str) -> DataFrame:
    both = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").select(F.col("lang").alias("a"), F.col("quality").alias("b"))
    return _round(stats.partition_agreement(both), "nmi", "ari", digits=9)


@_register(f"{_KWPAIRS}, n AS (SELECT key, CAST(ascii(right(key, 1)) % 4 AS INT) AS cluster, CAST(count(*) AS DOUBLE) AS weight FROM kw GROUP BY key), e AS (SELECT na.cluster AS ca, nb.cluster AS cb, w FROM pairs JOIN n na ON a = na.key JOIN n nb ON b = nb.key), i AS (SELECT ca AS cluster, sum(w) AS inner_w FROM e WHERE ca = cb GROUP BY 1), o AS (SELECT cluster, sum(w) AS centrality FROM (SELECT ca AS cluster, w FROM e WHERE ca <> cb UNION ALL SELECT cb, w FROM e WHERE ca <> cb) GROUP BY 1), s AS (SELECT cluster, count(*) AS size, sum(weight) AS weight FROM n GROUP BY 1), x AS (SELECT s.cluster, size, weight, coalesce(centrality, 0.0) AS centrality, coalesce(inner_w, 0.0) / size AS density FROM s LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster)), m AS (SELECT median(centrality) AS mc, median(density) AS md FROM x) SELECT cluster, size, weight, centrality, round(density, 6) AS density, CASE WHEN centrality >= mc AND density >= md THEN 'motor' WHEN density >= md THEN 'niche' WHEN centrality >= mc THEN 'basic' ELSE 'emerging or declining' END AS quadrant FROM x, m")
def cluster_density_centrality(spark: SparkSession, d: str) -> DataFrame:
    """The strategic diagram of a fixed clustering, by the last letter of the keyword."""
    inc = keywords(spark, d)
    nodes = inc.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("weight")).withColumn("cluster", (F.ascii(F.right(F.col("key"), F.lit(1))) % 4).cast("int"))
    return _round(stats.cluster_info(nodes, network.cooccurrence(inc, 5)), "density")


@_register("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def dedup_title(spark: SparkSession, d: str) -> DataFrame:
    """Documents without the copies of a text: a group keeps its smallest id, found by a partial aggregation and no window."""
    return _t(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


_FOLDED = f"regexp_replace(translate(replace(translate({{0}}, '{X._FOLD_FROM}', '{X._FOLD_TO}'), 'ß', 'ss'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '', 'g')"


@_register(
    f"""RECURSIVE k AS (SELECT doc_id, {_FOLDED.format("coalesce(text, '')")} || '|2000' AS t FROM documents),
o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id, list_filter(['d' || CAST(floor(doc_id / 10) AS BIGINT), CASE WHEN length(t) > 12 THEN md5(t) END], lambda x: x IS NOT NULL) AS keys FROM k),
r(i, taken, kept) AS (SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(NULL AS BIGINT) UNION ALL SELECT o.i, CASE WHEN list_has_any(taken, keys) THEN taken ELSE list_concat(taken, keys) END, CASE WHEN list_has_any(taken, keys) THEN NULL ELSE doc_id END FROM r JOIN o ON o.i = r.i + 1)
SELECT kept AS rec_id FROM r WHERE kept IS NOT NULL"""
)
def dedup_greedy(spark: SparkSession, d: str) -> DataFrame:
    """rec_id of the records that the greedy duplicate rule keeps, texts as titles and every tenth id as a DOI."""
    docs = _t(spark, d, "documents")
    recs = docs.select(F.col("doc_id").alias("rec_id"), F.col("text").alias("title"), F.lit(2000).alias("year"), F.concat(F.lit("10.1/"), F.floor(F.col("doc_id") / 10).cast("string")).alias("doi"))
    return match.deduplicate(recs).select("rec_id")


@_register()
def tfidf_to_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of every document to the centroid of the benchmark's texts."""
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    seeds = _t(spark, d, "benchmark").select(F.col("item_id").alias("doc"), "text")
    return _round(similarity.similarity_to_seeds(docs, seeds, similarity_token_rows), "score")


@_register("q AS (SELECT vec_id AS query, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query, vec_id, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q JOIN embeddings ON query <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 10")
def embedding_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by twenty, against all vectors."""
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return _round(similarity.embedding_search(v, v.where("vec_id % 20 = 0")), "score")


@_register("q AS (SELECT vec_id AS query, embedding AS q FROM embeddings), s AS (SELECT query, vec_id, list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS score FROM q JOIN embeddings ON query <> vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r WHERE rank <= 3")
def embedding_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest of every vector, each of which is a query."""
    v = _t(spark, d, "embeddings").select("vec_id", "embedding")
    return _round(vectors.nearest(v, v, 3), "score")


@_register("v AS (SELECT DISTINCT lower(p_name) AS key FROM part), z AS (SELECT key FROM v WHERE length(key) >= 8) SELECT a.key AS a, b.key AS b FROM z a JOIN z b ON a.key < b.key AND levenshtein(a.key, b.key) = 1 AND a.key[1] = b.key[1] AND regexp_replace(a.key, '[^0-9]', '', 'g') = regexp_replace(b.key, '[^0-9]', '', 'g')")
def variant_typos(spark: SparkSession, d: str) -> DataFrame:
    names = _t(spark, d, "part").select(F.lower("p_name").alias("key")).distinct()
    return cleaning.typo_pairs(names)


@_register("SELECT doc_id AS doc, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN source || chr(CAST(97 + (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 26 AS INT)) ELSE source END AS label FROM documents")
def doc_label_suffix(spark: SparkSession, d: str) -> DataFrame:
    return stats.label_suffixes(_t(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("label")))


@_register("l AS (SELECT max(year) AS last FROM docs), m AS (SELECT doc, year > last - 3 AS new FROM docs, l), t AS (SELECT count(*) FILTER (new) AS ra, count(*) FILTER (NOT new) AS ba FROM m), n AS (SELECT key, count(*) FILTER (new) AS recent, count(*) FILTER (NOT new) AS earlier FROM so JOIN m USING (doc) GROUP BY key HAVING count(*) >= 4), x AS (SELECT key, recent, earlier, ((recent + 0.5) / ra) / ((earlier + 0.5) / ba) AS ratio FROM n, t), y AS (SELECT *, CASE WHEN ratio > 1.6 AND recent >= 3 THEN 'rising' WHEN ratio < 0.5 AND earlier >= 4 THEN 'fading' END AS trend FROM x) SELECT key, recent, earlier, round(ratio, 6) AS ratio, trend FROM y WHERE trend IS NOT NULL")
def rising_fading(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.rising_fading(sources(spark, d), documents(spark, d)), "ratio")


@_register("f AS (SELECT key, count(*) AS n FROM so JOIN docs USING (doc) WHERE year = 2001 GROUP BY key HAVING count(*) >= 2), o AS (SELECT key FROM so JOIN docs USING (doc) WHERE year < 2001 GROUP BY key HAVING count(*) > 1) SELECT key, n FROM f WHERE key NOT IN (SELECT key FROM o) ORDER BY n DESC, key LIMIT 12")
def emerging_keywords(spark: SparkSession, d: str) -> DataFrame:
    """A top-12 report."""
    dated = sources(spark, d).join(documents(spark, d).select("doc", "year"), "doc")
    return stats.emerging_keys(dated.where("year = 2001"), dated.where("year < 2001"), spark.createDataFrame([], "key string"))


@_register("n AS (SELECT cites AS v FROM docs), s AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS c FROM n) SELECT p AS share, (SELECT v FROM s WHERE rn = CAST(floor(p * (c - 1)) AS BIGINT) + 1) AS value FROM (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) t(p)")
def nearest_rank(spark: SparkSession, d: str) -> DataFrame:
    return stats.nearest_rank(documents(spark, d), "cites", [0.05, 0.5, 0.95])


@_register(f"{_KWPAIRS}, n AS (SELECT key, CAST(ascii(right(key, 1)) % 4 AS INT) AS cluster FROM kw GROUP BY key), h AS (SELECT a AS key, b AS o, w FROM pairs UNION ALL SELECT b, a, w FROM pairs), p AS (SELECT h.key, n.cluster AS oc, sum(w) AS k, count(*) AS c FROM h JOIN n ON h.o = n.key GROUP BY 1, 2), x AS (SELECT p.key, n.cluster, CAST(sum(c) AS BIGINT) AS degree, sum(k) AS strength, sum(k * k) AS sq, sum(CASE WHEN oc = n.cluster THEN k ELSE 0 END) AS inn FROM p JOIN n ON p.key = n.key GROUP BY 1, 2), z AS (SELECT *, avg(inn) OVER (PARTITION BY cluster) AS m, stddev_pop(inn) OVER (PARTITION BY cluster) AS sd FROM x) SELECT key, degree, strength, round(1 - sq / (strength * strength), 6) AS participation, round(CASE WHEN sd > 0 THEN (inn - m) / sd ELSE 0 END, 6) AS within_z FROM z")
def node_roles(spark: SparkSession, d: str) -> DataFrame:
    inc = keywords(spark, d)
    nodes = inc.select("key").distinct().withColumn("cluster", (F.ascii(F.right(F.col("key"), F.lit(1))) % 4).cast("int"))
    return _round(graph.roles(nodes, network.cooccurrence(inc, 5)), "participation", "within_z").drop("role")


@_register("SELECT s_suppkey, regexp_replace(translate(s_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]', '', 'g') AS source_key, trim(regexp_replace(translate(translate(s_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '#-_/', '#   '), ' +', ' ', 'g')) AS bib_key, sha256(s_name) AS digest FROM supplier")
def text_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of names, by built-in expressions."""
    s = F.col("s_name")
    return _t(spark, d, "supplier").select("s_suppkey", X.source_key(s).alias("source_key"), X.bib_key(s).alias("bib_key"), X.sha256_hex(s).alias("digest"))


@_register("e AS (SELECT event_type AS key, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT key, CAST(day AS TIMESTAMP) AS day, n FROM e")
def events_per_day(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming window count."""
    from inkmesh.streaming.windows import daily_counts

    return daily_counts(_t(spark, d, "events"))


@_register(
    f"""RECURSIVE {_CTES}y AS (SELECT year, count(*) AS d, row_number() OVER (ORDER BY year) AS i FROM docs GROUP BY year), t AS (SELECT sum(d) AS total, count(*) AS years FROM y),
k AS (SELECT key, count(*) AS own, count(*)::DOUBLE / total AS p0, least(0.9999, 2.0 * count(*)::DOUBLE / total) AS p1, 0.5 * ln(years) AS step, years FROM so JOIN docs USING (doc), t GROUP BY key, total, years HAVING count(*) >= 5 AND count(*) < total AND years >= 3),
n AS (SELECT key, year, count(*) AS r FROM so JOIN docs USING (doc) GROUP BY key, year),
q AS MATERIALIZED (SELECT k.key, y.i, y.year, step, years, -(coalesce(r, 0) * ln(p0) + (d - coalesce(r, 0)) * ln(1 - p0)) AS c0, -(coalesce(r, 0) * ln(p1) + (d - coalesce(r, 0)) * ln(1 - p1)) AS c1 FROM k CROSS JOIN y LEFT JOIN n ON n.key = k.key AND n.year = y.year),
f(key, i, a0, a1, b0, b1) AS (SELECT key, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST('inf' AS DOUBLE), 0, 0 FROM k UNION ALL SELECT q.key, q.i, least(a0, a1) + c0, least(a0 + step, a1) + c1, CASE WHEN a0 <= a1 THEN 0 ELSE 1 END, CASE WHEN a0 + step < a1 THEN 0 ELSE 1 END FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1),
fm AS MATERIALIZED (SELECT * FROM f),
g(key, i, state) AS (SELECT fm.key, fm.i, CASE WHEN a1 < a0 THEN 1 ELSE 0 END FROM fm JOIN k ON k.key = fm.key AND fm.i = k.years UNION ALL SELECT g.key, g.i - 1, CASE WHEN state = 1 THEN b1 ELSE b0 END FROM g JOIN fm ON fm.key = g.key AND fm.i = g.i WHERE g.i > 1),
o AS (SELECT g.key, g.i, q.year, c0 - c1 AS w, g.i - row_number() OVER (PARTITION BY g.key ORDER BY g.i) AS run FROM g JOIN q ON q.key = g.key AND q.i = g.i WHERE state = 1),
z AS (SELECT key, run, sum(w) AS strength, min(year) AS "start", max(year) AS "end" FROM o GROUP BY key, run), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY strength DESC, "start" DESC) AS rn FROM z)
SELECT key, "start", "end", round(strength, 6) AS strength FROM b WHERE rn = 1 AND strength > 0"""
)
def bursts(spark: SparkSession, d: str) -> DataFrame:
    return _round(stats.bursts(sources(spark, d), documents(spark, d), gamma=0.5), "strength")


def _map_links(spark: SparkSession, d: str) -> DataFrame:
    return network.normalise(network.cooccurrence(authors(spark, d), 5))


@_register(f"RECURSIVE {_CTES}{_PAIRS.format('(SELECT * FROM au WHERE key IN (SELECT key FROM au GROUP BY key HAVING count(*) >= 5))')}, e AS MATERIALIZED (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs), r(x, y) AS (SELECT DISTINCT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y) SELECT x AS key, min(y) AS component FROM r GROUP BY x")
def components_of_map(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_map_links(spark, d))


@_register()
def leiden_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.best_clusters(graph.cluster(_map_links(spark, d), seeds=4))


@_register()
def layout_xy(spark: SparkSession, d: str) -> DataFrame:
    return graph.place(network.normalise(network.cooccurrence(keywords(spark, d), 5)), starts=2)


@_register()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return graph.centralities(_map_links(spark, d))


@_register()
def resolution_sweep(spark: SparkSession, d: str) -> DataFrame:
    return graph.stability(graph.cluster(network.normalise(network.cooccurrence(keywords(spark, d), 5)), (0.5, 1.0, 1.5), seeds=3))


@_register()
def main_path(spark: SparkSession, d: str) -> DataFrame:
    years = documents(spark, d).select("doc", "year")
    return graph.main_path(graph.path_counts(citations(spark, d), years), years)


@_register("best AS (SELECT cited AS doc FROM (SELECT cited, count(*) AS n FROM ci GROUP BY cited ORDER BY n DESC, cited LIMIT 30)) SELECT DISTINCT citing, cited FROM ci WHERE citing IN (SELECT doc FROM best) AND cited IN (SELECT doc FROM best)")
def historiograph(spark: SparkSession, d: str) -> DataFrame:
    """Citations among the thirty most cited documents, the chart's own limit."""
    return themes.historiograph(citations(spark, d))


@_register("s AS (SELECT doc, year BETWEEN 1995 AND 1998 AS ia, year BETWEEN 1998 AND 2001 AS ib FROM docs), t AS (SELECT count(*) FILTER (ia) AS na, count(*) FILTER (ib) AS nb FROM s), n AS (SELECT key, count(*) FILTER (ia) AS a, count(*) FILTER (ib) AS b FROM so JOIN s USING (doc) GROUP BY key), x AS (SELECT key, a, b, log2(((b + 0.5) / nb) / ((a + 0.5) / na)) AS r FROM n, t) SELECT key, a, b, round(r, 6) AS log_ratio, CASE WHEN a + b < 2 THEN 'stable' WHEN a = 0 THEN 'appearing' WHEN r >= log2(1.5) THEN 'growing' WHEN r <= -log2(1.5) THEN 'fading' ELSE 'stable' END AS change FROM x")
def period_difference(spark: SparkSession, d: str) -> DataFrame:
    """Two overlapping periods; documents of 1998 count in both."""
    return _round(themes.period_difference(sources(spark, d), documents(spark, d), (1995, 1998), (1998, 2001)), "log_ratio")


@_register("k AS (SELECT doc, key AS cluster FROM ty) SELECT cluster, year, count(DISTINCT doc) AS docs FROM k JOIN docs USING (doc) GROUP BY cluster, year")
def cluster_years(spark: SparkSession, d: str) -> DataFrame:
    """Yearly documents of a fixed clustering, by part type."""
    return themes.cluster_years(types(spark, d).select("doc", F.col("key").alias("cluster")), documents(spark, d))


@_register("k AS (SELECT doc, key AS cluster FROM ty), s AS (SELECT cluster, count(*) AS size FROM k GROUP BY 1), a AS (SELECT key, count(*) AS al FROM kw GROUP BY 1), n AS (SELECT cluster, key, count(*) AS n FROM kw JOIN k USING (doc) GROUP BY 1, 2), x AS (SELECT cluster, key, n, (n::DOUBLE / size) / (al::DOUBLE / (SELECT count(DISTINCT doc) FROM kw)) AS lift FROM n JOIN s USING (cluster) JOIN a USING (key) WHERE n >= 2 OR size <= 3), y AS (SELECT cluster, key, n, n * ln(1 + lift) * CASE WHEN lift > 1 THEN 1.0 ELSE 0.3 END AS score FROM x), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, key) AS rn FROM y) SELECT cluster, key, n, round(score, 6) AS score FROM r WHERE rn <= 2")
def cluster_names(spark: SparkSession, d: str) -> DataFrame:
    """The two most distinctive keywords of each cluster, which name it."""
    return _round(themes.distinctive_keywords(types(spark, d).select("doc", F.col("key").alias("cluster")), keywords(spark, d)), "score")


@_register()
def thematic_evolution(spark: SparkSession, d: str) -> DataFrame:
    """Themes of three periods."""
    return themes.thematic_evolution(keywords(spark, d), documents(spark, d), [1998, 2000])[0]


_NODES = "nodes AS (SELECT key, count(*) AS weight, CAST(sum(cites) AS BIGINT) AS cites, CAST(substr(key, 7, 1) AS INT) AS cluster FROM kw JOIN docs USING (doc) GROUP BY key)"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Brands as items of a map, in clusters by their first digit."""
    each = keywords(spark, d).join(documents(spark, d), "doc").groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.sum("cites").cast("long").alias("cites"))
    return each.withColumn("cluster", F.substring("key", 7, 1).cast("int"))


@_register(f"{_NODES} SELECT * FROM nodes WHERE cluster = 2 ORDER BY cites DESC, key LIMIT 4")
def top_items_of_cluster(spark: SparkSession, d: str) -> DataFrame:
    """A top-4 report."""
    return reports.top_items(_nodes(spark, d), "cites", 4, cluster=2)


@_register(f"{_NODES} SELECT * FROM nodes WHERE weight >= 10 ORDER BY weight DESC, key LIMIT 20")
def item_table(spark: SparkSession, d: str) -> DataFrame:
    """A top-20 report."""
    return reports.top_items(_nodes(spark, d), "weight", 20, least=10)


@_register(_PAIRS.format("co") + " SELECT * FROM pairs ORDER BY w DESC, a, b LIMIT 150")
def country_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The 150 strongest pairs of countries."""
    return reports.top_pairs(network.cooccurrence(countries(spark, d)))


@_register(_PAIRS.format("kw") + " SELECT * FROM pairs WHERE w >= 2 ORDER BY w DESC, a, b LIMIT 100")
def links_to_draw(spark: SparkSession, d: str) -> DataFrame:
    """The 100 heaviest links of strength 2 or more."""
    return reports.links_to_draw(network.cooccurrence(keywords(spark, d)), 2.0, 100)


@_register("SELECT ref, count(*) AS citing FROM rf GROUP BY ref HAVING count(*) >= 2 ORDER BY citing DESC, ref LIMIT 400")
def cited_references(spark: SparkSession, d: str) -> DataFrame:
    """The 400 most cited references of those cited twice or more."""
    return reports.cited_references(references(spark, d))


@_register(_PAIRS.format("kw") + f", {_NODES}, best AS (SELECT *, row_number() OVER (ORDER BY cluster, weight DESC, key) - 1 AS place FROM (SELECT * FROM nodes ORDER BY weight DESC, key LIMIT 12)) SELECT a, b, w, CAST(x.place AS INT) AS place_a, CAST(y.place AS INT) AS place_b FROM pairs JOIN best x ON x.key = a JOIN best y ON y.key = b")
def item_matrix(spark: SparkSession, d: str) -> DataFrame:
    """The matrix of the twelve heaviest items."""
    return reports.matrix(_nodes(spark, d), network.cooccurrence(keywords(spark, d)), 12)


@_register("se AS (SELECT doc FROM docs WHERE cites >= 30) SELECT DISTINCT cited AS doc, 'references' AS by FROM ci WHERE citing IN (SELECT doc FROM se) UNION SELECT DISTINCT citing, 'citing' FROM ci WHERE cited IN (SELECT doc FROM se)")
def seed_expansion(spark: SparkSession, d: str) -> DataFrame:
    """What the most cited documents cite, and what cites them."""
    return reports.expand_seeds(citations(spark, d), documents(spark, d).where("cites >= 30").select("doc"))


@_register("y AS (SELECT 'year' AS what, CAST(year AS VARCHAR) AS key, count(*) AS docs FROM docs GROUP BY year), k AS (SELECT 'keywords' AS what, key, count(*) AS docs FROM kw GROUP BY key ORDER BY docs DESC, key LIMIT 15), c AS (SELECT 'countries' AS what, key, count(*) AS docs FROM co GROUP BY key ORDER BY docs DESC, key LIMIT 15), s AS (SELECT 'sources' AS what, key, count(*) AS docs FROM so GROUP BY key ORDER BY docs DESC, key LIMIT 15) SELECT * FROM y UNION ALL SELECT * FROM k UNION ALL SELECT * FROM c UNION ALL SELECT * FROM s")
def corpus_digest(spark: SparkSession, d: str) -> DataFrame:
    """Records a year, and the top 15 keywords, countries and sources."""
    return reports.digest({"keywords": keywords(spark, d), "countries": countries(spark, d), "sources": sources(spark, d)}, documents(spark, d))


_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@_register(
    rf"""t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, t, trim(regexp_replace(t, '[\x00-\x20]+', ' ', 'g')) AS c FROM t)
SELECT doc_id, sha256(translate(t, '{_AZ}', '{_az}')) AS low, sha256(translate(t, '{_az}', '{_AZ}')) AS high, sha256(c) AS collapsed, sha256(regexp_replace(t, '^[\x00-\x20\xA0]+|[\x00-\x20\xA0]+$', '', 'g')) AS trimmed,
sha256(replace(translate(t, '{X._FOLD_FROM}', '{X._FOLD_TO}'), 'ß', 'ss')) AS folded, CASE WHEN length(c) > 40 THEN rtrim(substring(c, 1, 39)) || '…' ELSE c END AS short,
CAST(len(list_filter(list_transform(regexp_split_to_array(t, '[;,]'), lambda x: regexp_replace(x, '^[\x00-\x20\xA0]+|[\x00-\x20\xA0]+$', '', 'g')), lambda x: x <> '')) AS INT) AS parts,
sha256(replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&apos;')) AS escaped FROM c"""
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    """The plain text functions over every whole text, long results as their SHA-256."""
    t = F.coalesce(F.col("text"), F.lit(""))
    digests = {"low": X.lower(t), "high": X.upper(t), "collapsed": X.collapse(t), "trimmed": X.trim(t), "folded": X.ascii_fold(t), "escaped": X.xml_escape(t)}
    return _t(spark, d, "documents").select("doc_id", *[X.sha256_hex(c).alias(k) for k, c in digests.items()], X.truncate(X.collapse(t), 40).alias("short"), F.size(X.split_any(t, ";,")).alias("parts"))


@_register(
    r"""x AS (SELECT o_orderkey AS doc, '10.1000/' || o_orderkey || '.' || o_orderstatus AS doi, o_totalprice AS v, o_orderpriority AS p FROM orders)
SELECT doc, translate(doi, 'FOP', 'fop') AS doi, CAST(doc AS INT) AS number, format('{:,}', CAST(floor(v) AS BIGINT)) AS pretty, CAST(regexp_extract(p, '\d+') AS INT) AS first_number, doc % 2 = 0 AS digits FROM x"""
)
def text_values(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers and numbers written as texts, and read back."""
    o = _t(spark, d, "orders")
    key = F.col("o_orderkey").cast("string")
    written = F.concat(F.lit("  https://DOI.org/10.1000/"), key, F.lit("."), F.col("o_orderstatus"), F.lit(".; "))
    return o.select(
        F.col("o_orderkey").alias("doc"), X.norm_doi(written).alias("doi"), X.to_int(F.concat(F.lit(" "), key, F.lit(" pp."))).alias("number"), X.format_int(F.floor("o_totalprice")).alias("pretty"),
        X.first_number(F.col("o_orderpriority")).alias("first_number"), X.is_digits(F.concat(key, F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("a"))).alias("digits"),
    )


def _box_sql(source: str, name: str, by: str, along: str, r: int) -> str:
    return f"{name} AS (SELECT layer, x, y, sum(value) OVER (PARTITION BY layer, {by} ORDER BY {along} ROWS BETWEEN {r} PRECEDING AND {r} FOLLOWING) / {2 * r + 1} AS value FROM {source})"


_PASSES = (("y", "x"), ("y", "x"), ("y", "x"), ("x", "y"), ("x", "y"), ("x", "y"))


@_register(
    """pt AS (SELECT l_returnflag AS layer, l_quantity AS x, l_extendedprice / 1000 AS y, CAST(l_linenumber AS DOUBLE) AS w FROM lineitem), bx AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pt),
sc AS (SELECT *, least(159 * (1 - 2 * 0.05::DOUBLE) / (x1 - x0), 89 * (1 - 2 * 0.05::DOUBLE) / (y1 - y0)) AS s FROM bx), px AS (SELECT layer, CAST(round((x - (x0 + x1) / 2) * s + 159 / 2) AS INT) AS x, CAST(round((y - (y0 + y1) / 2) * s + 89 / 2) AS INT) AS y, w FROM pt, sc),
gr AS (SELECT layer, CAST(unnest(range(160)) AS INT) AS x, y FROM (SELECT layer, CAST(unnest(range(90)) AS INT) AS y FROM (SELECT DISTINCT layer FROM px))),
b0 AS (SELECT layer, x, y, sum(coalesce(w, 0.0)) AS value FROM gr LEFT JOIN px USING (layer, x, y) GROUP BY 1, 2, 3), """
    + ", ".join(_box_sql(f"b{k}", f"b{k + 1}", by, along, 4) for k, (by, along) in enumerate(_PASSES))
    + " SELECT layer, x, y, round(value, 4) AS value FROM b6"
)
def density_raster(spark: SparkSession, d: str) -> DataFrame:
    """Lines of orders by quantity and price on a raster of 160 by 90 cells, a layer a return flag; a line weighs its number."""
    points = _t(spark, d, "lineitem").select(F.col("l_returnflag").alias("layer"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_linenumber").cast("double").alias("w"))
    return _round(density.density(density.fitted(points, 160, 90), 160, 90, 4.0, "w", ("layer",)), "value", digits=4)
