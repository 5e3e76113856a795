"""Near copies by exact Jaccard similarity of word shingles: SimHash links first, then a prefix join that misses no pair."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.simhash import ROW_KEY, keep_rows, link_fingerprints, majority, row_key, text_key
from inkmesh.llm.text import give_back, in_slices
from inkmesh.plans.components import connected_components
from inkmesh.plans.joins import join_uneven
from inkmesh.plans.staging import stage

#: Buckets up to so many members are compared in full at once; in larger ones the first member meets all, the rest later.
_FULL = 16
#: Larger buckets are never held by one task: they are cut into tiles.
_CROWDED = 4096
#: Members lo to hi of a bucket meet all behind them in one round; what they link needs no comparison in the next.
_ROUNDS = ((1, 8), (8, _CROWDED))
_TILE = 1024


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """64-bit hashes of the text's word shingles in order, repeats included; one of all words if they are fewer, none without words.

    Words are those of op5: A-Z lowered, split at ASCII white space. Each word is hashed once, and a shingle's hash is
    mixed from those of its words, so a text costs one hash a word and a few array operations.
    """
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    own = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)
    k = min(shingle, len(words))
    n = len(words) - k + 1 if k else 0
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = (h ^ own[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles, sorted."""
    return np.unique(shingle_hashes(text, shingle))


def _node(found: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63)


def bitmap(found: np.ndarray) -> bytes:
    """A bit for each value modulo a power of two that is four times the set's size or more."""
    bits = np.zeros(1 << max(5, int(4 * len(found) - 1).bit_length()) if len(found) else 32, bool)
    bits[(found >> np.uint64(7)).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """By their bitmaps, the least number of elements that only one of two sets holds: every bit of one alone has such an element."""
    a, b = (np.frombuffer(v, np.uint8) for v in (x, y))
    size = min(len(a), len(b))
    a, b = (np.bitwise_or.reduce(v.reshape(-1, size), 0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def alike(n: int, x: bytes, m: int, y: bytes, threshold: float) -> bool:
    """Whether sets of n and m elements with these bitmaps can reach the similarity: they then differ in at most (n + m)(1 - t)/(1 + t) elements."""
    return least_difference(x, y) <= (n + m) * (1 - threshold) / (1 + threshold) + 1e-6


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(docs).alias("text_key"), F.col("text").cast("string").alias("text"))


def common_shingles(docs: DataFrame, shingle: int, one_in: int = 16, least: int = 4, most: int = 100_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that many distinct texts share, their ranks by frequency, and estimates of their texts, from one text in `one_in`.

    They only set the order in which prefixes are taken, and which shingles are dealt as crowded from the beginning: any
    order finds the same pairs, this one with fewer candidates.
    """

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([shingle_set(t, shingle) for t in texts]).view(np.int64))], ["h"])

    some = _keyed(docs).where(F.pmod("text_key", F.lit(one_in)) == 0).select("text_key", "text").dropDuplicates(["text_key"])
    counted = some.mapInArrow(in_slices(run), "h long").groupBy("h").count().where(F.col("count") >= least)
    found = counted.orderBy(F.desc("count"), "h").limit(most).toPandas()
    h = found["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], len(h) - order, found["count"].to_numpy(np.int64)[order] * one_in


def prefix(found: np.ndarray, threshold: float, common: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(threshold n) + 1 of n hashes, rare ones first, in two parts: two sets of that similarity share one of these.

    The second part, the most frequent ones, holds those that over _CROWDED texts seem to hold.
    """
    n = len(found)
    size = n - math.ceil(threshold * n - 1e-9) + 1 if n else 0
    known, ranks, texts = common
    if n and len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        held = known[at] == found
        if held.any():
            rank = np.where(held, ranks[at], 0)
            order = np.lexsort((found, rank))[:size]
            crowded = int((held[order] & (texts[at[order]] > _CROWDED)).sum())
            first = found[order]
            return first[: size - crowded], first[size - crowded :]
    return found[:size], found[:0]


def may_be_alike(n: np.ndarray, m: np.ndarray, left_n: np.ndarray, left_m: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of n and m hashes, of which left_n and left_m stand from their first shared one on, can reach the similarity."""
    return (np.minimum(left_n, left_m) * (1 + threshold) >= threshold * (n + m) - 1e-6) & (np.minimum(n, m) >= threshold * np.maximum(n, m) - 1e-6)


def bucket_pairs(key: np.ndarray, node: np.ndarray, n: np.ndarray, pos: np.ndarray, root: np.ndarray, lo: int, hi: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b) of candidates within the buckets of a sorted key column, and the rows of buckets to be compared further.

    Members lo to hi of a bucket meet all behind them; in the first round, lo = 0, only the first member of a bucket of
    over hi does. Members of one root are linked already. What sizes and the first shared place rule out is no candidate.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    alone = np.repeat(size > 1, size)
    rest = np.zeros(len(key), bool)
    if not alone.any():
        return key[:0], key[:0], rest
    at = np.flatnonzero(alone)
    node, n, pos, root, size = node[at], n[at], pos[at], root[at], size[size > 1]
    starts = np.cumsum(size) - size
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(lo, min(hi, int(size.max()) - 1)):
        live = size > d + 1
        if lo == 0 and d > 0:
            live &= size <= hi
        count = size[live] - d - 1
        i = np.repeat(starts[live] + d, count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        ok = (root[i] != root[j]) & may_be_alike(n[i], n[j], n[i] - pos[i], n[j] - pos[j], threshold)
        out_a.append(node[i[ok]])
        out_b.append(node[j[ok]])
    mixed = np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts)
    rest[at] = np.repeat((size > (hi if lo else _FULL)) & mixed, size)
    a, b = np.concatenate(out_a), np.concatenate(out_b)
    return np.minimum(a, b), np.maximum(a, b), rest


CANDIDATES = "token long, a long, b long, n int, pos int"


def _candidates(a: np.ndarray, b: np.ndarray, rest: tuple[np.ndarray, ...] = (), sets: tuple[np.ndarray, ...] = (), threshold: float = 0.8) -> pa.RecordBatch:
    """Distinct pairs, and behind them rows (token, node, n, pos) to be compared further, whose b is null.

    With sets (node, n, bits) only pairs that their bitmaps do not rule out.
    """
    both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    if sets and len(both):
        known = {x: (n, bits) for x, n, bits in zip(*(c.tolist() for c in sets))}
        both = both[[alike(*known[x], *known[y], threshold) for x, y in both.tolist()]]
    token, node, n, pos = rest or (np.zeros(0, np.int64),) * 4
    none = lambda x, kind: pa.concat_arrays([pa.nulls(len(both), kind), pa.array(x, kind)])
    return pa.RecordBatch.from_arrays([none(token, pa.int64()), pa.array(np.r_[both[:, 0], node]), pa.concat_arrays([pa.array(both[:, 1]), pa.nulls(len(node), pa.int64())]), none(n, pa.int32()), none(pos, pa.int32())], ["token", "a", "b", "n", "pos"])


def _compare(rows: DataFrame, lo: int, hi: int, threshold: float) -> DataFrame:
    """token, node, n, pos, root, bits or not -> a, b of candidates; and token, a, n, pos, with b null, of rows to be compared further.

    With bits, pairs are held against their bitmaps here, so that large buckets give no pairs but promising ones.
    """

    def emit(key, node, n, pos, root, *bits) -> pa.RecordBatch:
        a, b, rest = bucket_pairs(key, node, n, pos, root, lo, hi, threshold)
        return _candidates(a, b, (key[rest], node[rest], n[rest], pos[rest]), (node, n, *bits) if bits else (), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the last bucket may go on in the next batch
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            key = columns[0]
            if not len(key):
                continue
            if held and held[0][0][0] == key[0] == key[-1]:
                held.append(columns)
                if lo == 0 and sum(len(c[0]) for c in held) > _CROWDED:  # its first member meets them, then all but it can go
                    columns = [np.concatenate(c) for c in zip(*held)]
                    yield emit(*columns)
                    held = [[c[:1] for c in columns]]
                continue
            columns = [np.concatenate(c) for c in zip(*held, columns)]
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [[c[last:] for c in columns]]
            if last:
                yield emit(*(c[:last] for c in columns))
        if held:
            yield emit(*(np.concatenate(c) for c in zip(*held)))
        give_back()

    dealt = rows.select("token", "node", "n", "pos", "root", *[c for c in rows.columns if c == "bits"]).repartition("token").sortWithinPartitions("token", "node")
    return stage(dealt.mapInArrow(run, CANDIDATES), "candidates")


def _tiles(rows: DataFrame, threshold: float) -> DataFrame:
    """Crowded buckets, token, node, n, pos, root, bits -> a, b of candidates between different roots.

    A pair of different roots has a member outside the bucket's most frequent root. Those members, cut into parts of
    about _TILE, meet all members, cut likewise: a task holds one part of each, however large the bucket.
    """
    counts = rows.groupBy("token", "root").agg(F.count(F.lit(1)).alias("c"))
    facts = counts.groupBy("token").agg(F.sum("c").alias("all"), F.max_by("root", F.struct("c", "root")).alias("top"), F.max("c").alias("most"))
    parts = lambda c: F.ceil(c / F.lit(_TILE)).cast("int")
    facts = facts.where(F.col("all") > F.col("most")).select("token", "top", parts(F.col("all")).alias("of_all"), parts(F.col("all") - F.col("most")).alias("of_few"))
    told = rows.join(facts, "token")
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = told.where("root <> top").select("token", "node", "n", "pos", "root", "bits", mine("of_few").alias("i"), upto("of_all").alias("j"), F.lit(0).alias("side"))
    every = told.select("token", "node", "n", "pos", "root", "bits", upto("of_few").alias("i"), mine("of_all").alias("j"), F.lit(1).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.concatenate(c) for c in zip(held, columns)] if held else columns
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            held = [c[last:] for c in columns]
            if last:
                yield from meet(*(c[:last] for c in columns))
        if held:
            yield from meet(*held)

    def meet(key, side, node, n, pos, root, bits) -> Iterator[pa.RecordBatch]:
        cuts = np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)].tolist()
        for lo, hi in zip(cuts, cuts[1:]):
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            for k in range(lo, mid, 256):
                i, j = np.arange(k, min(k + 256, mid))[:, None], np.arange(mid, hi)[None, :]
                ok = (root[i] != root[j]) & may_be_alike(n[i], n[j], n[i] - pos[i], n[j] - pos[j], threshold)
                x, y = np.nonzero(ok)
                a, b = node[i[x, 0]], node[j[0, y]]
                if len(a):
                    yield _candidates(np.minimum(a, b), np.maximum(a, b), sets=(node[lo:hi], n[lo:hi], bits[lo:hi]), threshold=threshold)

    dealt = few.unionByName(every).select(F.xxhash64("token", "i", "j").alias("key"), "side", "node", "n", "pos", "root", "bits").repartition("key").sortWithinPartitions("key", "side")
    return stage(dealt.mapInArrow(run, CANDIDATES).select("a", "b").distinct(), "candidates")


def _promising(pairs: DataFrame, each: DataFrame, threshold: float) -> DataFrame:
    """The pairs that their bitmaps do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(*row, threshold) for row in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    nodes = each.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    left, right = (nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "bits_a", "n_b", "bits_b")
    return stage(joined.mapInArrow(run, "a long, b long"), "promising")


def _linked(pairs: DataFrame, docs: DataFrame, each: DataFrame, shingle: int, threshold: float, small: int = 200_000) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the similarity. Only texts that bitmaps leave in question are read again."""
    pairs = _promising(pairs, each, threshold)

    def whole(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([shingle_set(t, shingle).tobytes() for t in texts], pa.binary())], ["node", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= threshold * (len(x) + len(y) - both) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        give_back()

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    key = row_key(F.col("doc_id"), F.col("text_key"))
    one = each.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(*key)).alias("x")).select("node", "x.*")
    one = stage(one, "wanted")
    texts = _keyed(docs).select(*key, "text").join(F.broadcast(one) if one.count() <= small else one, list(ROW_KEY)).select("node", "text")
    sets = stage(texts.mapInArrow(in_slices(whole), "node long, found binary").groupBy("node").agg(F.first("found").alias("found")), "sets")
    left, right = sets.select(F.col("node").alias("a"), F.col("found").alias("x")), sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    return stage(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _simhash_pairs(each: DataFrame) -> DataFrame:
    """Pairs of nodes whose SimHash fingerprints differ in at most three bits, by op5's anchors: a star on each fingerprint, and the links of stars."""
    nodes = each.groupBy("node").agg(F.first("fp").alias("fp"))
    stars = stage(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    links = link_fingerprints(stars)
    ends = lambda side: stars.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_node"))
    between = links.join(ends("a"), "a").join(ends("b"), "b").select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b"))
    own = nodes.join(stars.where("n > 1"), "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return between.unionByName(own)


def near_copies(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """documents -> doc_id, text_key, group of each row: groups are joined by links of a Jaccard similarity of threshold or more.

    The similarity is that of the sets of distinct shingles of `shingle` words (A-Z lowered, split at ASCII white space);
    a text of fewer words is one shingle, and texts without words, or null, are alike. SimHash fingerprints of the
    shingles find most near copies through op5's anchors. The rest comes by prefixes: every pair that reaches the
    threshold shares a shingle of its prefixes, so none is missed, and pairs already in one group need no comparison.
    Bitmaps rule most candidates out without error, whole sets decide. Equal sets are compared once, by a 64-bit digest,
    as shingles are by theirs. Repeated rows stay; an empty table gives no rows.
    """
    common = common_shingles(docs, shingle)

    def begin(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        rows: list[tuple] = []
        for t in texts:
            h = shingle_hashes(t, shingle)
            s = np.unique(h)
            rows.append((_node(s), len(s), majority(h), bitmap(s), *prefix(s, threshold, common)))
        lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, c)]), pa.int32()), pa.array(np.concatenate(c).view(np.int64))) for c in list(zip(*rows))[4:]]
        node, n, bits = (pa.array([r[k] for r in rows], kind) for k, kind in ((0, pa.int64()), (1, pa.int32()), (3, pa.binary())))
        fp = pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), node, n, fp, bits, *lists], ["doc_id", "text_key", "node", "n", "fp", "bits", "prefix", "crowded"])

    each = stage(_keyed(docs).mapInArrow(in_slices(begin), "doc_id long, text_key long, node long, n int, fp long, bits binary, prefix array<long>, crowded array<long>"), "prefixes")
    links = _linked(_simhash_pairs(each), docs, each, shingle, threshold)
    roots = stage(connected_components(links, stop_after=3), "roots")

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    nodes = marked(each.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    out = _compare(nodes.select("node", "n", "root", F.posexplode("prefix").alias("pos", "token")), 0, _FULL, threshold)
    more, rest = out.where("b is not null").select("a", "b").distinct(), out.where("b is null").drop("b").withColumnRenamed("a", "node")
    if not more.isEmpty():
        links = links.unionByName(_linked(more, docs, each, shingle, threshold))
        roots = stage(connected_components(links, stop_after=3), "roots")
    bits_of = each.groupBy("node").agg(F.first("bits").alias("bits"))
    sizes = stage(rest.groupBy("token").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > _CROWDED).select("token"), "sizes")
    large, rest = rest.join(sizes, "token", "left_semi"), rest.join(sizes, "token", "left_anti")
    for lo, hi in _ROUNDS:
        out = _compare(marked(rest).join(bits_of, "node"), lo, hi, threshold)
        more, rest = out.where("b is not null").select("a", "b").distinct(), out.where("b is null").drop("b").withColumnRenamed("a", "node")
        if not more.isEmpty():
            links = links.unionByName(_linked(more, docs, each, shingle, threshold))
            roots = stage(connected_components(links, stop_after=3), "roots")
        if rest.isEmpty():
            break
    crowded = each.where(F.size("crowded") > 0).groupBy("node").agg(F.first("n").alias("n"), F.first(F.size("prefix")).alias("k"), F.first("crowded").alias("crowded"))
    crowded = crowded.select("node", "n", "k", F.posexplode("crowded").alias("p", "token")).select("token", "node", "n", (F.col("p") + F.col("k")).alias("pos"))
    crowded = stage(marked(crowded.unionByName(large.select("token", "node", "n", "pos").distinct())).join(bits_of, "node"), "crowded")
    if not crowded.isEmpty():
        links = links.unionByName(_linked(_tiles(crowded, threshold), docs, each, shingle, threshold))
    roots = stage(connected_components(links), "roots")
    sizes = each.groupBy("node").agg(F.count(F.lit(1)).alias("rows"))
    named = sizes.join(roots, "node", "left").select("node", "rows", F.coalesce("root", "node").alias("group"))
    return join_uneven(each.select("doc_id", "text_key", "node"), named, "node", "rows").select("doc_id", "text_key", "group")


def keep_one(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """documents without near copies: of each group one row stays, that with the smallest doc_id, null ids last, with all its columns.

    Of rows that agree in doc_id and text one stays; rows of one doc_id but of other groups are rows of their own. Texts
    without words, null ones too, are one group. An empty table gives an empty table.
    """
    return keep_rows(docs, near_copies(docs, shingle, threshold))
