"""Text similarity to a set of seeds, search and ranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.operators.vectors import nearest
from inkmesh.plans.staging import stage


def similarity_to_seeds(docs: DataFrame, seeds: DataFrame, tokens: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, ...) and seeds (doc, ...) -> doc, score of docs against the seeds' centroid.

    A token weighs (1 + ln tf) (ln((N + 1) / (df + 1)) + 1), documents have length one. tokens is an array expression
    over either table, or a function from a table to its rows doc, token. N and document frequencies are over seeds and
    candidates together; a seed among the candidates counts twice.

    Texts are shuffled by document before they become tokens, counts of tokens go through one shuffle, by token, and a
    document's length and product come back from there as two sums.
    """
    rows = tokens if callable(tokens) and not isinstance(tokens, Column) else lambda t: t.select("doc", F.explode(tokens).alias("token"))
    counted = lambda t: stage(rows(t.repartition("doc")).groupBy("doc", "token").agg(F.count(F.lit(1)).alias("tf")), "tf")
    own, seed = counted(docs), counted(seeds)
    n = docs.select(F.lit(1)).unionAll(seeds.select(F.lit(1))).agg(F.count(F.lit(1)).alias("n"))
    df = own.select("token").unionAll(seed.select("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = stage(df.join(F.broadcast(n)).select("token", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf")), "idf")
    x = (1 + F.log("tf")) * F.col("idf")
    s = stage(seed.join(idf, "token").select("doc", "token", x.alias("x")), "seeds")
    length = s.groupBy("doc").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    centroid = s.join(length, "doc").groupBy("token").agg(F.sum(F.col("x") / F.col("size")).alias("c"))
    size = centroid.agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("size"))
    unit = centroid.join(F.broadcast(size)).select("token", (F.col("c") / F.col("size")).alias("c"))
    known = idf.join(unit, "token", "left")
    sums = own.join(known, "token").groupBy("doc").agg(F.sum(x * x).alias("q"), F.sum(x * F.col("c")).alias("p"))
    return docs.select("doc").join(sums, "doc", "left").select("doc", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide("p", F.sqrt("q")), F.lit(0.0)))).alias("score"))


def rerank(scores: DataFrame, seeds: DataFrame, most: int = 500, least: float = 0.1) -> DataFrame:
    """doc, score, seed, rank: seeds first, then the `most` best others of at least `least`, ties in document order."""
    marked = scores.join(seeds.select("doc").distinct().withColumn("seed", F.lit(True)), "doc", "left").withColumn("seed", F.coalesce("seed", F.lit(False)))
    others = marked.where(~F.col("seed") & (F.col("score") >= least)).orderBy(F.desc("score"), "doc").limit(most)
    kept = marked.where("seed").unionByName(others)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("seed"), F.when(F.col("seed"), 0.0).otherwise(-F.col("score")), "doc")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers, in built-in functions; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def embedding_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(vec_id, embedding) and queries of the same columns -> query, vec_id, score, rank of each query's k nearest others, exactly (see vectors.nearest)."""
    return nearest(vectors, queries, k)


def find_papers(records: DataFrame, query: str, sort: str = "cited", skip: int = 0, n: int = 20) -> DataFrame:
    """Records whose title, abstract and keywords hold every word of the query, sorted and paged."""
    hay = F.lower(F.concat_ws(" ", "title", "abstract", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("index_terms", F.array().cast("array<string>")), " ")))
    hit = F.lit(True)
    words = [w for w in query.lower().split() if len(w) > 1]
    for w in words:
        hit = hit & F.contains(hay, F.lit(w))
    hits = F.lit(0)
    for w in words:
        hits = hits + F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(w)).cast("int")
    order = {"cited": [F.desc("cites"), "rec_id"], "recent": [F.desc("year"), "rec_id"], "relevance": [hits.desc(), F.desc("cites"), "rec_id"]}[sort]
    return records.where(hit).orderBy(*order).offset(skip).limit(n)


def search_items(nodes: DataFrame, text: str, weight: str = "occurrences", n: int = 20) -> DataFrame:
    """Items whose label is, begins with or holds the text, in this order, then by weight."""
    label, t = F.lower("label"), F.lit(text.lower())
    rank = F.when(label == t, 0).when(label.startswith(t), 1).when(F.contains(label, t), 2)
    return nodes.withColumn("match", rank).where("match is not null").orderBy("match", F.desc(weight), "key").limit(n)


def neighbours(links: DataFrame, key: str, n: int = 20) -> DataFrame:
    """key, w: the strongest partners of one item."""
    return links.where((F.col("a") == key) | (F.col("b") == key)).select(F.when(F.col("a") == key, F.col("b")).otherwise(F.col("a")).alias("key"), "w").orderBy(F.desc("w"), "key").limit(n)


def rank_documents(docs: DataFrame, how: str = "global", edges: DataFrame | None = None, now: int = 2026, n: int = 15) -> DataFrame:
    """doc, score: most cited documents, by all citations, by year since, or by citations inside the corpus (edges)."""
    if how == "local":
        x = edges.groupBy(F.col("cited").alias("doc")).agg(F.count(F.lit(1)).cast("double").alias("score"))
    else:
        x = docs.select("doc", (F.col("cites").cast("double") if how == "global" else F.col("cites") / F.greatest(F.lit(1), F.lit(now) - F.col("year"))).alias("score"))
    return x.orderBy(F.desc("score"), "doc").limit(n)
