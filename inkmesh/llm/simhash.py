"""Operator 5, SimHash near-duplicates: fingerprints, anchor-point covering, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.text import id_and_text, in_slices
from inkmesh.plans.components import connected_components
from inkmesh.plans.joins import join_uneven
from inkmesh.plans.names import fresh
from inkmesh.plans.staging import stage

_POSITIONS = np.arange(1, 32)
#: For each syndrome s, the fifteen masks of two bits that lead from a word to the codewords at distance two.
_PAIRS = np.array([[0] * 15] + [[(1 << (p - 1)) | (1 << ((p ^ s) - 1)) for p in range(1, 32) if p < p ^ s] for s in range(1, 32)], np.int64)


def shingle_hashes(text: bytes, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's word shingles in order, repeats included; one of all words if they are fewer, none without words."""
    import xxhash

    words = text.lower().split()  # bytes: lowers A-Z only and splits at space and \t to \r only
    line, digest = b" ".join(words), xxhash.xxh64_digest
    begins = [0, *accumulate([len(w) + 1 for w in words])]
    spans = zip(begins, begins[shingle:] if len(words) > shingle else begins[-1:] if words else ())
    return np.frombuffer(b"".join([digest(line[a : b - 1], seed) for a, b in spans]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit k is set if it is set in over half of the hashes; 0 without any."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        h = hashes[k : k + 65536].astype("<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64 bits: bit k is set if it is set in over half the XXH64 of the text's word shingles, repeats included."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 3, keyed: bool = False) -> DataFrame:
    """documents -> doc_id, fp (the fingerprint's 64 bits as a signed long), text_key if keyed. A text without words, or null, has fp 0."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        fp = np.array([simhash(t.encode("utf-8", "surrogatepass"), shingle) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(fp), *part.columns[2:]], ["doc_id", "fp", *part.schema.names[2:]])

    rows = id_and_text(docs)
    return rows.withColumn("text_key", text_key(rows)).mapInArrow(in_slices(run), "doc_id long, fp long, text_key long") if keyed else rows.mapInArrow(in_slices(run), "doc_id long, fp long")


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor keys of fingerprints: (index into fp, key, home).

    Two words that differ in at most three of 64 bits differ in at most one bit in their lower or in their upper half.
    The anchors of a half are the codewords of the (31, 26) Hamming code on 31 of its bits, covering radius 1. A half
    has one home, the codeword within 1, and is copied to every codeword within radius plus threshold, 1 + 1 = 2: so
    of two halves within 1, each reaches the other's home. At most 16 keys a half.
    """
    word = fp.view(np.uint64)
    out_i, out_k, out_h = [], [], []
    for half, shift in ((0, 0), (1, 32)):
        x = ((word >> np.uint64(shift)) & np.uint64(0x7FFFFFFF)).astype(np.int64)
        bits = (x[:, None] >> (_POSITIONS - 1)) & 1
        syndrome = np.bitwise_xor.reduce(bits * _POSITIONS, axis=1)
        home = np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x)
        i = np.arange(len(x))
        far = np.flatnonzero(syndrome > 0)
        out_i += [i, np.repeat(far, 15)]
        out_k += [home | (half << 31), (x[far, None] ^ _PAIRS[syndrome[far]]).ravel() | (half << 31)]
        out_h += [np.ones(len(i), bool), np.zeros(15 * len(far), bool)]
    return np.concatenate(out_i), np.concatenate(out_k), np.concatenate(out_h)


def forest(fp: np.ndarray, most: int = 3) -> list[tuple[int, int]]:
    """Edges (a, b) of a spanning forest of the links among distinct fingerprints: stars grown outward from a seed.

    Each fingerprint is compared with those not yet reached, a row of numpy at a time, so time is at worst quadratic
    and memory linear; links never exceed the fingerprints.
    """
    left, edges = np.sort(fp), []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            seed = queue.pop()
            near = np.bitwise_count((left ^ seed).view(np.uint64)) <= most
            if near.any():
                found = left[near]
                edges += [(int(seed), int(x)) for x in found]
                queue += list(found)
                left = left[~near]
    return edges


def _bucket_links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Spanning links within the buckets of a sorted key column."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    size = ends - starts
    homes = np.add.reduceat(home.astype(np.int64), starts)
    edges: list[tuple[int, int]] = []
    small = (size > 1) & (homes > 0) & (size <= 64)
    for n in np.unique(size[small]).tolist():  # buckets of one size side by side: all their comparisons in one array
        at = starts[small & (size == n)]
        for k in range(0, len(at), max(1, 1_000_000 // (n * n))):
            rows = at[k : k + max(1, 1_000_000 // (n * n))]
            block = fp[rows[:, None] + np.arange(n)]
            near = np.bitwise_count((block[:, :, None] ^ block[:, None, :]).view(np.uint64)) <= most
            linked = near.sum((1, 2)) > n
            for b in block[linked]:
                edges += forest(np.unique(b), most)
    for b in np.flatnonzero((size > 64) & (homes > 0)).tolist():
        edges += forest(np.unique(fp[starts[b] : ends[b]]), most)
    return edges


def _parts(mask: int, n: int = 4) -> list[int]:
    """The bits of a mask dealt to n masks of about equal size."""
    bits = [k for k in range(32) if mask >> k & 1]
    return [sum(1 << k for k in bits[j::n]) for j in range(n)]


def split(key: np.ndarray, fp: np.ndarray, home: np.ndarray, free: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of crowded buckets, four times each, in buckets of their own: (key, fp, home, free, half).

    Members of a bucket that link differ in at most three bits of the half that is not the anchor's, so of any four
    parts of its free bits they agree in one: each row goes to the bucket of its value in each part, whose bits are
    free no longer. 32 free bits give parts of eight, the next split parts of six, and so on.
    """
    out: list[tuple[np.ndarray, ...]] = []
    other = np.where(half == 0, fp.view(np.uint64) >> np.uint64(32), fp.view(np.uint64) & np.uint64(0xFFFFFFFF))
    for mask in np.unique(free).tolist():
        at = free == mask
        for j, part in enumerate(_parts(mask)):
            word = (other[at] & np.uint64(part)) | (np.uint64(part) << np.uint64(32))
            mixed = (key[at].view(np.uint64) ^ (word * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(29)) ^ np.uint64(j)) * np.uint64(0x9E3779B97F4A7C15)
            out.append((mixed.view(np.int64), fp[at], home[at], np.full(int(at.sum()), mask & ~part), half[at]))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (key, fp, home, free, half)


BUCKETS = "key long, fp long, home boolean, free long, half int"


def buckets(fps: DataFrame) -> DataFrame:
    """Distinct fingerprints (column fp) at all their anchors."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            i, key, home = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[i]), pa.array(home), pa.array(np.full(len(i), 0xFFFFFFFF)), pa.array((key >> 31).astype(np.int32))], ["key", "fp", "home", "free", "half"])

    return fps.select("fp").mapInArrow(spread, BUCKETS)


def split_crowded(rows: DataFrame, crowded: DataFrame, salts: int = 32) -> tuple[DataFrame, DataFrame]:
    """(rows of other buckets, rows of crowded ones dealt out anew). A salted join: a bucket of any size is read by many tasks."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = split(*(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, batch.schema)], batch.schema.names)

    salted = rows.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int"))
    keys = crowded.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    few, many = (salted.join(keys, ["key", "salt"], how).select(*rows.columns) for how in ("left_anti", "left_semi"))
    return few, many.mapInArrow(again, BUCKETS)


def link_fingerprints(fps: DataFrame, most: int = 3, hot: int = 1024, splits: int = 2) -> DataFrame:
    """Distinct fingerprints (column fp) -> (a, b): links within `most` (3) bits, enough to connect all that are linked.

    Every pair within three bits meets at an anchor. Buckets of over `hot` fingerprints are split by eight of the other
    half's bits (see split), and those that stay crowded by six more, four copies each time. What is crowded still
    agrees in fourteen bits of one half and lies within two bits of the anchor in the other: such a dense bucket is
    searched whole, by stars that take in all of a seed's neighbours at once.
    """
    if most != 3:
        raise ValueError("the anchors cover distances of three bits")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for batch in batches:
            key, fp, home = (np.concatenate([r, batch.column(k).to_numpy(zero_copy_only=False)]) for k, r in enumerate(rest))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on in the next batch
            rest = (key[last:], fp[last:], home[last:])
            if last:
                yield _edges(_bucket_links(key[:last], fp[:last], home[:last], most))
        if len(rest[0]):
            yield _edges(_bucket_links(*rest, most))

    def linked(rows: DataFrame) -> DataFrame:
        return rows.select("key", "fp", "home").repartition("key").sortWithinPartitions("key").mapInArrow(link, "a long, b long")

    rows, found = buckets(fps), []
    for _ in range(splits):
        crowded = stage(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("key"), "crowded")
        if crowded.isEmpty():
            break
        few, many = split_crowded(rows, crowded)
        found.append(linked(few))
        rows = stage(many, "split")
    found.append(linked(rows))
    return reduce(DataFrame.unionByName, found).distinct()


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["a", "b"])


def _groups(each: DataFrame) -> DataFrame:
    """Rows with doc_id and fp -> fp, n (its rows), first (its smallest doc_id), root (the group's smallest fp) of each distinct fp."""
    distinct = stage(each.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    roots = connected_components(link_fingerprints(distinct))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """documents -> doc_id, fp, component_id: the smallest doc_id reachable over links of at most three differing bits.

    Equal texts share a fingerprint and are compared once. Null and empty texts have fingerprint zero and link like any
    other. A row with a null doc_id keeps its fingerprint and its group's id (null if no member has one); repeated rows
    stay. An empty table gives no rows. Fingerprints of very many rows, and groups of very many fingerprints, are
    joined by broadcast of at most 10,000 of them (see join_uneven).
    """
    each = stage(fingerprints(docs, shingle), "simhash")
    rooted = stage(_groups(each), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = join_uneven(rooted, least, "root", "rows").select("fp", "n", "component_id")
    return join_uneven(each, named, "fp", "n").select("doc_id", "fp", "component_id")


#: Columns that tell rows apart by doc_id, nulls last, and text.
ROW_KEY = ("no_id", "id", "text_key")


def text_key(docs: DataFrame) -> Column:
    """A 64-bit key of the whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def row_key(doc_id: Column, key: Column, names: Sequence[str] = ROW_KEY) -> list[Column]:
    """The columns of ROW_KEY of a row's doc_id and text_key, under the given names."""
    own = doc_id.cast("long")
    return [c.alias(n) for c, n in zip((own.isNull(), F.coalesce(own, F.lit(0).cast("long")), key), names, strict=True)]


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """documents, and doc_id, text_key, group of their rows -> one row a group, with all its columns.

    The row with the smallest doc_id stays, null ids last, of equal ids the smallest text key; rows of one doc_id but of
    other groups are rows of their own. Of rows that agree in doc_id and text, one stays. The caller's columns may have
    any names: the keys beside them take names that are free.
    """
    own = fresh(docs.columns, *ROW_KEY)
    best = rows.groupBy("group").agg(F.min(F.struct(*row_key(rows["doc_id"], rows["text_key"]))).alias("x")).select("x.*").toDF(*own)
    marked = docs.select("*", *row_key(docs["doc_id"], text_key(docs), own))
    return marked.join(best, own, "left_semi").dropDuplicates(own).drop(*own)


def keep_one(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """documents without near-duplicates: of each group one row stays, that with the smallest doc_id, null ids last, with all its columns."""
    each = stage(fingerprints(docs, shingle, keyed=True), "simhash")
    return keep_rows(docs, join_uneven(each, _groups(each), "fp", "n").select("doc_id", "text_key", F.col("root").alias("group")))
