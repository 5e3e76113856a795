"""What clusters and periods are about: names, evolution, difference on a map, historiograph, and the methods paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.operators import graph, network
from inkmesh.plans.spec import MapSpec


def name_clusters(nodes: DataFrame, top: int = 2) -> DataFrame:
    """(key, label, cluster, weight) -> cluster, name: its heaviest labels."""
    w = Window.partitionBy("cluster").orderBy(F.desc("weight"), "key")
    best = nodes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)
    return best.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "label"))), lambda x: x["label"]), ", ").alias("name"))


def distinctive_keywords(clusters: DataFrame, inc: DataFrame, top: int = 2) -> DataFrame:
    """(doc, cluster) and (doc, key) -> cluster, key, n, score: keywords over-represented in a cluster's documents.

    The score is n ln(1 + lift), times 0.3 where the lift is not above 1; keywords of one document count only in
    clusters of up to three.
    """
    each, docs = inc.select("doc", "key").distinct(), clusters.select("doc", "cluster").distinct()
    size = docs.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    all_ = each.groupBy("key").agg(F.count(F.lit(1)).alias("all"))
    total = each.agg(F.count_distinct("doc").alias("total"))
    n = each.join(docs, "doc").groupBy("cluster", "key").agg(F.count(F.lit(1)).alias("n"))
    x = n.join(size, "cluster").join(all_, "key").join(F.broadcast(total)).where("n >= 2 or size <= 3")
    lift = (F.col("n") / F.col("size")) / (F.col("all") / F.col("total"))
    x = x.withColumn("score", F.col("n") * F.log(1 + lift) * F.when(lift > 1, 1.0).otherwise(0.3))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "key")
    return x.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).select("cluster", "key", "n", "score")


def with_periods(docs: DataFrame, cuts: list[int] | None = None) -> DataFrame:
    """docs (doc, year, ...) -> with period 0, 1, ...: a cut is the first year of the next period; without cuts, thirds of the span."""
    dated = docs.where("year is not null and year <> 0")
    if cuts is None:
        ends = dated.agg(F.min("year").alias("a"), F.max("year").alias("b")).first()
        if ends["a"] is None:
            return dated.withColumn("period", F.lit(0))
        span = ends["b"] - ends["a"]
        cuts = [ends["a"] + span // 3 + 1, ends["a"] + 2 * span // 3 + 1]
    return dated.withColumn("period", sum([(F.col("year") >= c).cast("int") for c in cuts], F.lit(0)))


def thematic_evolution(inc: DataFrame, docs: DataFrame, cuts: list[int] | None = None, least: int = 2, max_items: int = 250, seeds: int = 3, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(themes, flows): clusters of each period's keyword map, and the keywords that consecutive periods' clusters share.

    themes: period, cluster, key, occ; flows: period, cluster, next_cluster, shared, kept where shared keys are at least
    `share` of the smaller theme. Each period's map is a map query of its own, bounded by max_items.
    """
    dated = with_periods(docs, cuts).select("doc", "year", "cites", "period")
    periods = sorted(r["period"] for r in dated.select("period").distinct().collect())
    themes = None
    for p in periods:
        own = dated.where(F.col("period") == p)
        part = inc.join(own.select("doc"), "doc", "left_semi")
        pairs = network.cooccurrence(part, least)
        stats = network.item_stats(part, own).where(F.col("occ") >= least)
        links = network.normalise(network.links_among(pairs, network.rank_items(stats, pairs, cap=max_items)))
        if not links.take(1):
            continue
        found = graph.best_clusters(graph.cluster(links, seeds=seeds, least=2)).join(stats.select("key", "occ"), "key").select(F.lit(p).alias("period"), "cluster", "key", "occ")
        themes = found if themes is None else themes.unionByName(found)
    if themes is None:
        themes = inc.sparkSession.createDataFrame([], "period int, cluster int, key string, occ long")
    size = themes.groupBy("period", "cluster").agg(F.count(F.lit(1)).alias("size"))
    a = themes.join(size, ["period", "cluster"]).select("period", "cluster", "key", "size")
    b = a.select((F.col("period") - 1).alias("period"), F.col("cluster").alias("next_cluster"), "key", F.col("size").alias("next_size"))
    flows = a.join(b, ["period", "key"]).groupBy("period", "cluster", "next_cluster", F.least("size", "next_size").alias("m")).agg(F.count(F.lit(1)).alias("shared"))
    return themes, flows.where(F.col("shared") >= share * F.col("m")).select("period", "cluster", "next_cluster", "shared")


def period_difference(inc: DataFrame, docs: DataFrame, a: tuple[int, int], b: tuple[int, int]) -> DataFrame:
    """key, a, b, log_ratio, change of map items between two periods; a document in both counts in both."""
    dated = docs.where("year is not null and year <> 0").select("doc", F.col("year").between(*a).alias("in_a"), F.col("year").between(*b).alias("in_b"))
    total = dated.agg(F.count_if("in_a").alias("na"), F.count_if("in_b").alias("nb"))
    n = inc.select("doc", "key").distinct().join(dated, "doc").groupBy("key").agg(F.count_if("in_a").alias("a"), F.count_if("in_b").alias("b"))
    r = F.log2(((F.col("b") + 0.5) / F.col("nb")) / ((F.col("a") + 0.5) / F.col("na")))
    x = n.join(F.broadcast(total)).where("na > 0 and nb > 0").withColumn("log_ratio", r)
    edge = F.log2(F.lit(1.5))
    change = F.when(F.col("a") + F.col("b") < 2, "stable").when(F.col("a") == 0, "appearing").when(F.col("log_ratio") >= edge, "growing").when(F.col("log_ratio") <= -edge, "fading").otherwise("stable")
    return x.select("key", "a", "b", "log_ratio", change.alias("change"))


def historiograph(edges: DataFrame, top: int = 30) -> DataFrame:
    """citing, cited among the `top` documents most cited inside the corpus, ties to the smaller id."""
    best = edges.groupBy(F.col("cited").alias("doc")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "doc").limit(top).select("doc")
    return edges.join(best.select(F.col("doc").alias("citing")), "citing", "left_semi").join(best.select(F.col("doc").alias("cited")), "cited", "left_semi").select("citing", "cited").distinct()


def cluster_years(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    """cluster, year, docs: distinct documents of each cluster (doc, cluster) in each known year."""
    return clusters.select("doc", "cluster").distinct().join(docs.where("year is not null and year <> 0"), "doc").groupBy("cluster", "year").agg(F.count_distinct("doc").alias("docs"))


def methods_text(spec: MapSpec, documents: int, items: int, links: int, clusters: int | None = None) -> str:
    """A paragraph that says how a map was made."""
    counting = "fractional" if spec.fractional else "full"
    text = f"From {documents:,} documents a {spec.analysis} network of {spec.unit.replace('_', ' ')} was built with {counting} counting. Items needed a minimum of {spec.minimum}; {items:,} items with {links:,} links were kept (at most {spec.max_items:,})."
    text += f" Links were normalised by {spec.normalisation}." if spec.normalisation != "none" else " Links were not normalised."
    return text + (f" Clustering found {clusters} clusters." if clusters is not None else "")
