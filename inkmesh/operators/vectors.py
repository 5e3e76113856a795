"""Nearest vectors by cosine: exactly, by blocked matrix products, or through the cells of an inverted file with measured recall."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.plans.staging import stage

#: Vectors of one query block, so that a block and its lists stay within some 100 MB for 1000 components.
BLOCK = 8192
#: Vectors that stream through one tile, about; and tiles at least, so that small tables use every core.
SHARD, TILES = 200_000, 64
_STEP = 2048


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> vec_id, dim, vec: doubles of length one. Null vectors, those that hold nulls or numbers that are not finite, and zero vectors have no direction and are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.array(v.values.cast(pa.float64()).to_numpy(zero_copy_only=False)) if v.is_valid else np.zeros(0)
                size = math.sqrt(float(x @ x)) if len(x) and np.isfinite(x).all() else 0.0
                if size > 0 and math.isfinite(size):
                    ids.append(i)
                    dims.append(len(x))
                    out.append((x / size).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["vec_id", "dim", "vec"])

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, dim int, vec binary")


class _Top:
    """The k best of each query, so far; ties to the smaller id."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int):
        self.q, self.own, self.k = q, own, k
        self.score, self.id = np.zeros((len(q), 0)), np.zeros((len(q), 0), own.dtype)

    def meet(self, c: np.ndarray, ids: np.ndarray) -> None:
        for lo in range(0, len(self.q), _STEP):
            hi = lo + _STEP
            s = self.q[lo:hi] @ c.T
            s[self.own[lo:hi, None] == ids[None, :]] = -np.inf
            k = min(self.k, len(ids))
            least = np.partition(s, len(ids) - k, 1)[:, len(ids) - k]
            for r in np.flatnonzero(s.max(1) > -np.inf).tolist():
                at = np.flatnonzero((s[r] >= least[r]) & (s[r] > -np.inf))  # ties with the last one come along
                self._add(lo + r, s[r, at], ids[at])

    def _add(self, r: int, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.r_[self.score[r] if self.score.size else [], score], np.r_[self.id[r] if self.id.size else np.zeros(0, ids.dtype), ids]
        best = np.lexsort((ids, -score))[: self.k]
        if self.score.shape[1] < self.k:
            grown = np.full((len(self.q), self.k), -np.inf)
            grown[:, : self.score.shape[1]] = self.score
            numbers = np.zeros((len(self.q), self.k), self.own.dtype)
            numbers[:, : self.id.shape[1]] = self.id
            self.score, self.id = grown, numbers
        self.score[r, : len(best)], self.id[r, : len(best)] = score[best], ids[best]
        self.score[r, len(best) :] = -np.inf


def _met(k: int):
    """Rows (tile, side, vec_id, dim, vec), queries (side 0) of a tile first -> query, vec_id, score of each query's k best in the tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, asked, numbers, top = None, [], [], None

        def done() -> Iterator[pa.RecordBatch]:
            if top is not None:
                r, c = np.nonzero(top.score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(top.own[r]), pa.array(top.id[r, c]), pa.array(top.score[r, c])], ["query", "vec_id", "score"])

        for batch in batches:
            t, side, ids, dim = (batch.column(n).to_numpy(zero_copy_only=False) for n in range(4))
            cuts = np.r_[0, np.flatnonzero((t[1:] != t[:-1]) | (side[1:] != side[:-1])) + 1, len(t)] if len(t) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                if t[lo] != tile:
                    yield from done()
                    tile, asked, numbers, top = t[lo], [], [], None
                x = np.frombuffer(b"".join(batch.column(4).slice(lo, hi - lo).to_pylist()), np.float64).reshape(hi - lo, dim[lo])
                if side[lo] == 0:
                    asked.append(x)
                    numbers.append(ids[lo:hi])
                elif asked:
                    top = top or _Top(np.concatenate(asked), np.concatenate(numbers), k)
                    for at in range(0, hi - lo, _STEP):
                        top.meet(x[at : at + _STEP], ids[lo:hi][at : at + _STEP])
        yield from done()

    return run


def _searched(asked: DataFrame, offered: DataFrame, k: int) -> DataFrame:
    """asked and offered, with their tile -> query, vec_id, score, rank."""
    rows = asked.select("tile", F.lit(0).alias("side"), "vec_id", "dim", "vec").unionByName(offered.select("tile", F.lit(1).alias("side"), "vec_id", "dim", "vec"))
    found = rows.repartition("tile").sortWithinPartitions("tile", "side").mapInArrow(_met(k), "query long, vec_id long, score double")
    hits = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id")))
    best = found.groupBy("query").agg(F.slice(hits, 1, k).alias("hits")).select("query", F.posexplode("hits").alias("pos", "h"))
    return best.select("query", F.col("h.vec_id").alias("vec_id"), (-F.col("h.low")).alias("score"), (F.col("pos") + 1).alias("rank"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(vec_id, embedding) twice -> query, vec_id, score, rank: the k vectors of the largest cosine with each query, but for the row of its own id.

    Exact. Vectors meet only those of their own length; ties go to the smaller id. Ids are long and tell rows apart.
    Queries may be all vectors: they are cut into blocks, vectors into shards, and a task holds one block while a shard
    streams by. What has no direction (see unit_vectors) neither asks nor is found.
    """
    q, v = unit_vectors(queries), unit_vectors(vectors)
    blocks, shards = max(1, math.ceil(queries.count() / BLOCK)), max(1, math.ceil(vectors.count() / SHARD))
    shards = max(shards, math.ceil(TILES / blocks))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", upto(shards))
    offered = v.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")).withColumn("block", upto(blocks))
    tile = F.xxhash64("dim", "block", "shard")
    return _searched(asked.withColumn("tile", tile), offered.withColumn("tile", tile), k)


def centroids(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8) -> np.ndarray:
    """Directions of `cells` k-means cells, fitted on at most `sample` vectors with the smallest hashes of their ids, all of the most frequent length."""
    units = unit_vectors(vectors)
    dim = units.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dim is None:
        return np.zeros((0, 0))
    rows = units.where(F.col("dim") == dim["dim"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec").collect()
    x = np.array([np.frombuffer(r["vec"], np.float64) for r in rows])
    centre = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(1)
        sums = np.zeros_like(centre)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 0, sums / np.where(size > 0, size, 1), centre)
    return centre


def _celled(units: DataFrame, centre: np.ndarray, probes: int) -> DataFrame:
    """Each vector once for each of its `probes` nearest cells; vectors of other lengths have cell -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cells = [], []
            for r, (dim, v) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                near = np.argsort(-(centre @ np.frombuffer(v, np.float64)), kind="stable")[:probes].tolist() if dim == centre.shape[1] else [-1]
                at += [r] * len(near)
                cells += near
            part = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells, pa.int32())], [*batch.schema.names, "cell"])

    return units.mapInArrow(run, "vec_id long, dim int, vec binary, cell int")


def nearest_in_cells(vectors: DataFrame, queries: DataFrame, k: int = 10, cells: int = 64, probes: int = 8, sample: int = 20_000) -> DataFrame:
    """As nearest, but each query looks into its `probes` nearest cells of `cells` alone: every vector is indexed, some neighbours may be missed (see recall).

    A cell of many vectors or queries is cut into tiles like any other, so no task grows with a cell.
    """
    centre = centroids(vectors, cells, sample)
    index = stage(_celled(unit_vectors(vectors), centre, 1), "cells")
    asked = stage(_celled(unit_vectors(queries), centre, probes), "asked")
    size = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards"))
    many = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    cut = F.broadcast(size.join(many, "cell"))  # a row a cell
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = lambda c: F.pmod(F.xxhash64("vec_id"), F.col(c)).cast("int")
    tile = F.xxhash64("cell", "dim", "block", "shard")
    a = asked.join(cut, "cell").withColumn("block", mine("blocks")).withColumn("shard", upto("shards"))
    b = index.join(cut, "cell").withColumn("shard", mine("shards")).withColumn("block", upto("blocks"))
    return _searched(a.withColumn("tile", tile), b.withColumn("tile", tile), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, recall: the share of exact hits (query, vec_id) that were found."""
    hits = exact.join(found.select("query", "vec_id").withColumn("hit", F.lit(1)), ["query", "vec_id"], "left")
    return hits.agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))
