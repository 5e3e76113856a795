"""Helpers shared by the operators whose core runs in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id as long and text as string; every other column is left behind, so clashing names cannot occur."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 2_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch into runs of about `most` bytes of text, whole texts always; a null text counts as empty."""
    column = batch.column(batch.schema.get_field_index(text))
    size, begin = 0, 0
    lengths = pc.binary_length(column).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= most or i + 1 == len(lengths):
            part = batch.slice(begin, i + 1 - begin)
            yield part, [x or "" for x in column.slice(begin, i + 1 - begin).to_pylist()]
            size, begin = 0, i + 1


@contextmanager
def no_cycles() -> Iterator[None]:
    """Hold the cycle collector while many small objects without cycles are made: it would walk all caches again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


class Generations:
    """A cache bounded in entries and in letters of its keys: two generations; what is used again moves to the young one, the rest is forgotten."""

    def __init__(self, most: int = 100_000, letters: int = 4_000_000):
        self.most, self.letters, self.size, self.young, self.old = most, letters, 0, {}, {}

    def missing(self, keys: set) -> list:
        """Make room, carry what is known over, and return the keys that still need a value."""
        young = self.young
        need = keys.difference(young)
        size = sum(map(len, need))
        if len(young) + len(need) > self.most or self.size + size > self.letters:
            self.old, self.young, need = young, {}, keys
            self.size, size = 0, sum(map(len, need))
        self.size += size
        young, old = self.young, self.old
        new = []
        for k in need:
            if k in old:
                young[k] = old[k]
            else:
                new.append(k)
        return new


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what one stage freed another cannot use."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass


def in_slices(make: Callable[[pa.RecordBatch, list[str]], pa.RecordBatch], text: str = "text", most: int = 2_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow: `make` takes each slice of each batch with its texts; freed memory goes back at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, text, most):
                yield make(part, texts)
        give_back()

    return run


def keep_where(docs: DataFrame, good: Callable[[list[str]], np.ndarray], text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, for whose texts `good` holds; it sees a slice of texts at a time, null as empty."""

    @F.arrow_udf("boolean")
    def holds(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in arrays:
            yield pa.concat_arrays([pa.array([], pa.bool_()), *(pa.array(good(texts), pa.bool_()) for _, texts in slices(pa.record_batch([array], ["text"])))])
        give_back()

    return docs.where(holds(F.col(text).cast("string")))
