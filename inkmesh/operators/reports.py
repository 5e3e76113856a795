"""Short ranked views of a map and its corpus, as users read them. Each limit is the feature; ties end at the key, so results are fixed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_items(nodes: DataFrame, by: str = "weight", top: int = 20, cluster: int | None = None, least: float = 0.0) -> DataFrame:
    """The `top` nodes with the largest `by`, of one cluster if given, of those that have `least` or more; nulls last, equals by key."""
    found = nodes if cluster is None else nodes.where(F.col("cluster") == cluster)
    return found.where(F.coalesce(F.col(by), F.lit(0)) >= least).orderBy(F.col(by).desc_nulls_last(), "key").limit(top)


def links_to_draw(links: DataFrame, min_strength: float = 0.0, most: int = 1000) -> DataFrame:
    """The heaviest `most` links (a, b, w) of min_strength or more."""
    return links.where(F.col("w") >= min_strength).orderBy(F.desc("w"), "a", "b").limit(most)


def top_pairs(links: DataFrame, top: int = 150) -> DataFrame:
    """The `top` strongest pairs, such as pairs of countries on a world map."""
    return links_to_draw(links, 0.0, top)


def cited_references(refs: DataFrame, least: int = 2, top: int = 400) -> DataFrame:
    """(doc, ref) -> ref, citing: references that `least` documents or more cite, the `top` most cited."""
    n = refs.groupBy("ref").agg(F.count_distinct("doc").alias("citing"))
    return n.where(F.col("citing") >= least).orderBy(F.desc("citing"), "ref").limit(top)


def matrix(nodes: DataFrame, links: DataFrame, most: int = 40) -> DataFrame:
    """a, b, w of the links among the `most` heaviest items; place_a and place_b are their rows in a matrix ordered by cluster, then weight."""
    from pyspark.sql import Window

    best = nodes.orderBy(F.desc("weight"), "key").limit(most)  # at most `most` rows, so one window over them is small
    place = best.select("key", (F.row_number().over(Window.orderBy("cluster", F.desc("weight"), "key")) - 1).alias("place"))
    side = lambda c: place.select(F.col("key").alias(c), F.col("place").alias(f"place_{c}"))
    return links.join(F.broadcast(side("a")), "a").join(F.broadcast(side("b")), "b").select("a", "b", "w", "place_a", "place_b")


def expand_seeds(citations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(citing, cited) and seeds (doc) -> doc, by: the works that seeds cite (by references) and that cite seeds (by citing), each once a way."""
    own = seeds.select("doc").distinct()
    cited = citations.join(own.withColumnRenamed("doc", "citing"), "citing", "left_semi").select(F.col("cited").alias("doc"), F.lit("references").alias("by"))
    citing = citations.join(own.withColumnRenamed("doc", "cited"), "cited", "left_semi").select(F.col("citing").alias("doc"), F.lit("citing").alias("by"))
    return cited.unionByName(citing).where("doc is not null").distinct()


def digest(units: dict[str, DataFrame], docs: DataFrame, top: int = 15) -> DataFrame:
    """what, key, docs: the `top` units of every kind, such as sources or keywords, and all years with their records."""
    parts = [docs.where("year is not null and year <> 0").groupBy(F.col("year").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("docs")).select(F.lit("year").alias("what"), "key", "docs")]
    for what, inc in units.items():
        n = inc.groupBy("key").agg(F.count_distinct("doc").alias("docs")).orderBy(F.desc("docs"), "key").limit(top)
        parts.append(n.select(F.lit(what).alias("what"), F.col("key").cast("string").alias("key"), "docs"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
