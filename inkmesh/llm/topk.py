"""Operator 11, exact top-k search: tiles of query blocks and candidate shards, partial selection in each, lists merged in a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.text import give_back
from inkmesh.plans.staging import stage

#: Components of one query block at most, so many doubles: 16 MB.
BLOCK = 2_000_000
#: Rows of one candidate shard, about; they stream through a tile and are never held.
SHARD = 262_144
#: Shards at least, so that small tables use every core.
LEAST_SHARDS = 96
#: Lists that one step of the merge takes together.
FAN_IN = 32
#: Scores of one partial matrix product.
_TILE = 4_000_000
_EXACT = float(1 << 53)

#: A hit: ~score, so that ascending order is best first; whether vec_id is null, as nulls come last among ties; vec_id.
HIT = "struct<low: long, none: boolean, vec_id: long>"


def scaled(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> vec_id, dim, vec: floor(scale * x) of every component x as little-endian doubles.

    Rows whose vector is null or holds a null or non-finite component (also: one that scale makes infinite) are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.diff(lists.offsets.to_numpy())
            flat = lists.values.slice(lists.offsets[0].as_py(), int(ends.sum()))
            x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(x * scale) + 0.0  # no negative zero: equal vectors have equal bytes
            bad = np.r_[0, np.cumsum(~np.isfinite(x))]
            cut = np.r_[0, np.cumsum(ends)]
            good = pa.array(bad[cut[1:]] == bad[cut[:-1]]) if len(ends) else pa.array([], pa.bool_())
            good = pc.and_(good, lists.is_valid())
            vec = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer((cut * 8).astype(np.int64)), pa.py_buffer(x.tobytes())]).cast(pa.binary()) if len(ends) else pa.array([], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends.astype(np.int32)), vec], ["vec_id", "dim", "vec"]).filter(good)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, dim int, vec binary")


def inner_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact q @ c.T of whole numbers given as doubles: by doubles where no sum can leave their exact range, else by whole numbers.

    Sums beyond a long are held at its ends.
    """
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if most < _EXACT:
        return q @ c.T
    if most < float(1 << 62):
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q) @ whole(c).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest scores, ties to the smaller column, best first; all columns if they are fewer."""
    m = scores.shape[1]
    k = min(k, m)
    if scores.dtype == np.float64 and np.abs(scores).max(initial=0) * m < _EXACT / 2:
        scores *= m
        scores += np.arange(m - 1, -1, -1.0)  # keys without ties
        at = np.argpartition(scores, m - k, 1)[:, m - k :] if k < m else np.tile(np.arange(m), (len(scores), 1))
        return np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), 1), 1)
    return np.argsort(~scores.astype(np.int64), 1, kind="stable")[:, :k]


class Best:
    """The best k hits of each query of a block, so far."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries, k
        n = len(queries)
        self.low, self.none, self.id = np.zeros((n, 0), np.int64), np.zeros((n, 0), bool), np.zeros((n, 0), np.int64)

    def meet(self, c: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """Take in candidates c (rows of doubles) with these ids."""
        order = np.lexsort((ids, none))
        c, none, ids = c[order], none[order], ids[order]
        step = max(1, _TILE // max(1, len(self.q)))
        for lo in range(0, len(c), step):
            self._part(c[lo : lo + step], none[lo : lo + step], ids[lo : lo + step])

    def _part(self, c: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        low, flags, found = [], [], []
        step = max(1, _TILE // max(1, len(c)))
        for lo in range(0, len(self.q), step):
            scores = inner_products(self.q[lo : lo + step], c)
            at = select(scores.copy(), self.k)
            low.append(~np.take_along_axis(scores, at, 1).astype(np.int64))
            flags.append(none[at])
            found.append(ids[at])
        low, flags, found = (np.concatenate([a, np.concatenate(b)], 1) for a, b in ((self.low, low), (self.none, flags), (self.id, found)))
        order = np.lexsort((found, flags, low), 1)[:, : self.k]
        self.low, self.none, self.id = (np.take_along_axis(x, order, 1) for x in (low, flags, found))

    def hits(self) -> pa.Array:
        n, k = self.low.shape
        ids = pa.array(self.id.ravel(), mask=self.none.ravel())
        flat = pa.StructArray.from_arrays([pa.array(self.low.ravel()), pa.array(self.none.ravel()), ids], ["low", "none", "vec_id"])
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)


def _tile_lists(k: int):
    """Rows (tile, side, query, vec_id, dim, vec) in order of tile and side -> query, hits: queries are held, candidates stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, waiting, numbers, best = None, [], [], None

        def matrix(vec: pa.Array, dim: int) -> np.ndarray:
            return np.frombuffer(b"".join(vec.to_pylist()), np.float64).reshape(len(vec), dim)

        def done() -> Iterator[pa.RecordBatch]:
            if best is not None and best.low.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(numbers)), best.hits()], ["query", "hits"])

        for batch in batches:
            key, side, query, vec_id, dim, vec = batch.columns
            t = key.to_numpy(zero_copy_only=False)
            s = side.to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero((t[1:] != t[:-1]) | (s[1:] != s[:-1])) + 1, len(t)] if len(t) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if t[lo] != tile:
                    yield from done()
                    tile, waiting, numbers, best = t[lo], [], [], None
                part = vec.slice(lo, hi - lo)
                d = dim[int(lo)].as_py()
                if s[lo] == 0:
                    waiting.append(matrix(part, d))
                    numbers.append(query.slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                elif waiting:
                    best = best or Best(np.concatenate(waiting), k)
                    ids = vec_id.slice(lo, hi - lo)
                    best.meet(matrix(part, d), ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False))
        yield from done()
        give_back()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(vec_id, embedding) -> query_id, rank, vec_id, score: the k best candidates of each query by the inner product of scaled vectors.

    Queries are the rows where is_query, a condition on vec_id, holds; candidates are all rows but the query's own.
    score is the inner product of floor(scale * x), exactly (held at the ends of a long); ties go to the smaller vec_id,
    null ids last. Fewer candidates than k give them all. Vectors that are null or hold a null or non-finite component
    take no part; vectors meet only vectors of their own length. Each of repeated rows is a query and a candidate of its
    own, so a repeated query has its list repeated. Other columns are not read. An empty table gives no rows.

    A tile is a block of queries of one length, at most BLOCK components, and a shard of candidates; every query block
    meets every shard, so the work is that of the exact search, and a task holds one block and its lists. Queries that
    agree in id and vector are searched once. Lists of k + 1 hits are merged FAN_IN at a time; at the end a query's own
    row, which is a hit of its id and of its product with itself, is taken out once.
    """
    rows = scaled(vectors, scale)
    asked = rows.where(F.coalesce(is_query, F.lit(False))).groupBy("vec_id", "dim", "vec").agg(F.count(F.lit(1)).alias("n"))
    queries = stage(asked.withColumn("query", F.monotonically_increasing_id()), "queries")  # numbers must not change
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(queries.count()) * F.col("dim") / BLOCK)).cast("int")  # of a length, so a block is within its bound
    shards = max(LEAST_SHARDS, math.ceil(vectors.count() / SHARD))

    upto = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    key = F.xxhash64("dim", "block", "shard")
    ask = queries.select("query", F.lit(None).cast("long").alias("vec_id"), "dim", "vec", F.pmod(F.xxhash64("vec_id", "vec"), blocks).cast("int").alias("block"), upto(F.lit(shards)).alias("shard"), F.lit(0).alias("side"))
    mine = F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")  # a row meets each block in one shard, whichever
    offer = rows.select(F.lit(None).cast("long").alias("query"), "vec_id", "dim", "vec", upto(blocks).alias("block"), mine.alias("shard"), F.lit(1).alias("side"))
    tiles = ask.unionByName(offer).select(key.alias("tile"), "shard", "side", "query", "vec_id", "dim", "vec")
    dealt = tiles.repartition("tile").sortWithinPartitions("tile", "side").select("tile", "side", "query", "vec_id", "dim", "vec")
    lists = dealt.mapInArrow(_tile_lists(k + 1), f"query long, hits array<{HIT}>")

    left = shards
    while left > FAN_IN:  # a query has a list of each shard; which ones meet does not matter
        left = math.ceil(left / FAN_IN)
        lists = _merged(lists.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(left))), ["query", "part"], k + 1).drop("part")
    best = _merged(lists, ["query"], k + 1)
    return _named(best.join(queries, "query"), k)


def _merged(lists: DataFrame, by: list[str], most: int) -> DataFrame:
    return lists.groupBy(*by).agg(F.slice(F.array_sort(F.flatten(F.collect_list("hits"))), 1, most).alias("hits"))


def _named(best: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the hits without the query's own row."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = []
            for v in batch.column(0).to_pylist():
                x = np.frombuffer(v, np.float64)[None]
                low.append(~int(inner_products(x, x)[0, 0]))
            yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), *batch.columns[1:]], ["low", *batch.schema.names[1:]])

    told = best.select("vec", F.col("vec_id").alias("query_id"), "n", "hits").mapInArrow(own, f"low long, query_id long, n long, hits array<{HIT}>")
    place = F.array_position("hits", F.struct(F.col("low"), F.lit(False).alias("none"), F.col("query_id").alias("vec_id"))).cast("int")
    others = F.when(F.col("place") > 0, F.concat(F.slice("hits", F.lit(1), F.col("place") - 1), F.slice("hits", F.col("place") + 1, F.lit(k + 1)))).otherwise(F.col("hits"))
    told = told.withColumn("place", place).select("query_id", F.slice(others, 1, k).alias("hits"), F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return told.select("query_id", F.posexplode("hits").alias("pos", "hit")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.bitwise_not("hit.low").alias("score"))


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10"""
