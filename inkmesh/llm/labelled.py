"""Bounded samples of labelled rows, for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True where crc32 of doc_id as text leaves the remainder `fold`; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, most: int) -> DataFrame:
    """doc_id, text, label of at most `most` labelled documents outside the held-out fold, by smallest hash of doc_id.

    Labels of one doc_id that disagree, and null ones, count as none. Only the chosen ids, `most` at the utmost, are
    broadcast; documents are read once. Of rows of one doc_id the smallest text is taken, so rows are bounded too, and
    only chosen texts are shuffled.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("top")).where("label = top")
    chosen = known.select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


SKETCH = 64
_FACTORS = np.random.default_rng(0).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under each of SKETCH odd factors, 32 bits each; zeros without hashes."""
    if not len(hashes):
        return np.zeros(SKETCH, np.uint32)
    return np.array([((hashes * f) >> np.uint64(32)).min() for f in _FACTORS], np.uint32)


def copies(sketches: np.ndarray, label: np.ndarray, agree: int = 48, band: int = 4) -> np.ndarray:
    """How many rows of a sample each row stands for: those of its label linked with it by sketches that agree in `agree` (48) of 64 places.

    Rows meet that agree in a band of `band` places and in their label; each meets the first of its band, so that links
    grow with the rows. A sketch that wide takes unlike texts for copies next to never.
    """
    root = np.arange(len(label))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for k in range(0, SKETCH, band):
        keys = np.c_[sketches[:, k : k + band], label.astype(np.uint32)]
        _, first, of = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        first = first[of.ravel()]
        for i in np.flatnonzero((first != np.arange(len(label))) & ((sketches == sketches[first]).sum(1) >= agree)).tolist():
            root[find(i)] = find(int(first[i]))
    top = np.array([find(i) for i in range(len(label))], np.int64)
    return np.bincount(top, minlength=len(label))[top] if len(label) else top
