"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.plans.staging import stage


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, max_rounds: int = 60, stop_after: int | None = None) -> DataFrame:
    """(a, b) -> (node, root): root is the smallest node id reachable from node.

    Only nodes with at least one edge to another node appear. Nulls and self loops are ignored, repeated and reversed
    edges count once. Each round is two aggregations and two joins, whose skew
    by hubs is left to adaptive execution, which splits a hub's rows; every round is staged, so the plan stays short and
    no edge ever reaches the driver. Rounds grow with the logarithm of the longest path.

    stop_after: so many rounds and no more. Nodes of one root are then of one component, but one component may still
    have several roots: enough to spare comparisons of what is known to be linked.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    e = stage(edges.where("a <> b").select(high.alias("a"), low.alias("b")).distinct(), "edges")
    last = None
    for k in range(max_rounds):
        # large star: what is larger than u moves to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        grown = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and what is smaller than u move to the smallest neighbour
        least = grown.groupBy("a").agg(F.min("b").alias("m"))
        moved = grown.join(least, "a")
        e = stage(moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct(), "edges")
        if k + 1 == stop_after:
            break
        now = _mark(e)
        if now == last or now[0] == 0:
            break
        last = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).groupBy("node").agg(F.min("root").alias("root"))
