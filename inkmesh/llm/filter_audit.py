"""Operator 12, filter interaction audit: what each filter removes under every order of five, by a first-failure lookup."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmesh.llm.text import in_slices
from inkmesh.plans.joins import join_uneven
from inkmesh.plans.staging import stage

FILTERS = "ABCDE"
#: The 120 orders, in alphabetical order.
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_PLACES = np.array([[o.index(f) for f in FILTERS] for o in ORDERS])
#: FIRST[mask, order]: the step (0 to 4) at which a document that fails the filters of the mask (A is bit 0) goes; 5: it stays.
FIRST = np.array([[min((int(p[k]) for k in range(5) if mask >> k & 1), default=5) for p in _PLACES] for mask in range(32)], np.int64)
#: Counts of a part: by order and step (0 to 5), documents, good ones and toxic ones; and by mask, documents.
_LABELS = 3
_STEPS = 6
#: Parts whose counts one task holds at a time.
_MOST_PARTS = 256

_UPPER, _MARK, _FOLLOWS = (np.zeros(256, bool) for _ in range(3))
_UPPER[ord("A") : ord("Z") + 1] = True
_MARK[list(b"#$%&*|")] = True
_FOLLOWS[0x80:0xC0] = True  # bytes that continue a code point


def failures(text: bytes) -> int:
    """The mask of filters A to D that a text (UTF-8) fails."""
    words = text.split()  # splits at 0x20 and 0x09 to 0x0D
    x = np.frombuffer(text, np.uint8)
    points = len(x) - int(_FOLLOWS[x].sum())
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * int(_UPPER[x].sum()) > 2 * points) << 2 | bool(_MARK[x].any()) << 3


def judged(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, part, digest (SHA-256 of the text), mask (A to D) of every row."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        digest = pa.array([hashlib.sha256(t).digest() for t in raw], pa.binary())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), digest, pa.array([failures(t) for t in raw], pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    return rows.mapInArrow(in_slices(run), "doc_id long, part string, digest binary, mask int")


def with_copies(rows: DataFrame) -> DataFrame:
    """judged rows with E in their mask: a smaller doc_id anywhere in the table has the same digest. The digest goes."""
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    both = join_uneven(rows, first, "digest", "n")
    return both.select("doc_id", "part", F.when(F.col("first") < F.col("doc_id"), F.col("mask") + 16).otherwise(F.col("mask")).alias("mask"))


def _removals(most: int):
    """Rows part, mask, good, toxic -> part, counts: partial arrays of removals by order, step and label, and of masks; of `most` parts at a time."""
    size, at = len(ORDERS) * _STEPS * _LABELS, np.arange(len(ORDERS)) * _STEPS

    def let_go(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.int64()))], ["part", "counts"])
            held.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code, mask, good, toxic = names.indices.to_numpy(), *(batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3))
            order = np.argsort(code, kind="stable")
            ends = np.searchsorted(code[order], np.arange(len(names.dictionary) + 1))
            for k, name in enumerate(names.dictionary.to_pylist()):
                own = order[ends[k] : ends[k + 1]]
                _count(held.setdefault(name, np.zeros(size + 32, np.int64)), mask[own], good[own], toxic[own], at)
                if len(held) >= most:
                    yield from let_go(held)
        yield from let_go(held)

    return run


def _count(total: np.ndarray, mask: np.ndarray, good: np.ndarray, toxic: np.ndarray, at: np.ndarray) -> None:
    by_label = total[:-32].reshape(_LABELS, -1)
    for label, rows in enumerate((mask, mask[good == 1], mask[toxic == 1])):
        for lo in range(0, len(rows), 8192):
            steps = FIRST[rows[lo : lo + 8192]]  # documents by orders
            by_label[label] += np.bincount((steps + at).ravel(), minlength=len(ORDERS) * _STEPS)
    total[-32:] += np.bincount(mask, minlength=32)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, counts (summed) -> the report's 600 rows of each part."""
    size = len(ORDERS) * _STEPS * _LABELS
    letter = np.array([[FILTERS.index(c) for c in o] for o in ORDERS])
    fails = np.array([[mask >> k & 1 for k in range(5)] for mask in range(32)])
    for batch in batches:
        for name, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.array(counts.values.to_numpy(), np.int64)
            gone, good, toxic = x[:size].reshape(_LABELS, len(ORDERS), _STEPS)[:, :, :5]
            masks = x[size:]
            kept = masks.sum() - np.cumsum(gone, 1)
            failing = masks @ fails
            alone = masks[1 << np.arange(5)]
            shapley = np.bincount(letter.ravel(), gone.ravel(), 5).astype(np.int64)
            columns = [kept, gone, failing[letter] - gone, alone[letter], good, toxic, shapley[letter]]
            rows = len(ORDERS) * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * rows, pa.string()), pa.array(np.repeat(ORDERS, 5).tolist()), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))), *(pa.array(c.ravel().astype(np.int64)) for c in columns)],
                ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
            )


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents, labels -> part, filter_order, step and counts of every part under all 120 orders of the filters A to E.

    part: the value of source, null as an empty text. Filters fail a document of under 200 words (A), whose distinct
    words are under half of its words (B), of over 2 % capitals A-Z (C), with one of #$%&*| (D), and whose text a
    smaller doc_id has, in any part (E). Null texts count as empty; they fail A and, but for the first, E. A null doc_id
    is smaller than none and has none smaller; repeated rows of the smallest doc_id of a text pass E. A document is good
    or toxic if a label of its doc_id says so. Every row of documents counts. An empty table gives no rows.

    Masks of failures are looked up in a table of 32 by 120 first failing steps, and np.bincount adds up removals in
    each task; the partial arrays of a part, 2192 numbers each, are summed place by place.
    """
    rows = stage(judged(docs), "judged")
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("g"), (F.col("toxic") == 1).alias("t")).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.coalesce(F.max("g"), F.lit(False)).cast("int").alias("good"), F.coalesce(F.max("t"), F.lit(False)).cast("int").alias("toxic"))
    told = with_copies(rows).join(marks, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    partial = told.mapInArrow(_removals(_MOST_PARTS), "part string, counts array<long>")
    places = partial.select("part", F.posexplode("counts").alias("place", "n")).groupBy("part", "place").agg(F.sum("n").alias("n"))
    whole = places.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda x: x["n"]).alias("counts"))
    return whole.mapInArrow(_report, REPORT)


_MASK = " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(("w < 200", "100 * u < 50 * w", "100 * up > 2 * cp", "sym", "coalesce(first < doc_id, false)")))
ORACLE = rf"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
f AS (SELECT t AS x, min(doc_id) AS first FROM t GROUP BY t),
s AS (SELECT t.*, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, first FROM t JOIN f ON t.t = f.x),
k AS (SELECT doc_id, part, first, len(ws) AS w, len(list_distinct(ws)) AS u, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS up, length(t) AS cp, regexp_matches(t, '[#$%&*|]') AS sym FROM s),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, {_MASK} AS mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM k LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
o(o) AS (SELECT '' UNION ALL SELECT o || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE length(o) < 5 AND NOT contains(o, c)),
p AS (SELECT o, CAST(i AS INT) AS step, 1 << CAST(ascii(substr(o, CAST(i AS INT), 1)) - 65 AS INT) AS bit, list_sum(list_transform(range(1, i), lambda j: 1 << CAST(ascii(substr(o, CAST(j AS INT), 1)) - 65 AS INT))) AS prev FROM o, range(1, 6) r(i) WHERE length(o) = 5),
q AS (SELECT part, o AS filter_order, step, bit, CAST(sum(CASE WHEN mask & coalesce(CAST(prev AS INT), 0) = 0 AND mask & bit = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
CAST(sum(CASE WHEN mask & coalesce(CAST(prev AS INT), 0) = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN mask & coalesce(CAST(prev AS INT), 0) > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
CAST(sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN mask & coalesce(CAST(prev AS INT), 0) = 0 AND mask & bit > 0 THEN g ELSE 0 END) AS BIGINT) AS good_lost,
CAST(sum(CASE WHEN mask & coalesce(CAST(prev AS INT), 0) = 0 AND mask & bit > 0 THEN x ELSE 0 END) AS BIGINT) AS toxic_lost FROM m, p GROUP BY part, o, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM q"""
