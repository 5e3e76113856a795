"""Ranks and running sums over a whole table, by two passes: no task holds more than one range of the order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.plans.names import fresh
from inkmesh.plans.staging import stage


def running(df: DataFrame, by: list[Column], sums: tuple[str, ...] = (), rank: str = "rank", parts: int | None = None) -> DataFrame:
    """df with `rank` (long, from 1) in the order `by`, and run_<c> (the sum of c up to the row, itself included) for each c of sums.

    Rows are dealt to ranges of the order and sorted there; each range numbers and sums its own rows as they stream by.
    The ranges' totals, a row a range, are summed in order and joined back. A key that many rows share is cut into
    ranges by the later columns of `by`, so these should tell rows apart; rows equal in all of them share a range.
    Null summands count as zero. sums: long or double columns. The ranges are staged, as a second sampling would cut
    elsewhere. An empty table gives no rows.
    """
    part, *_ = names = fresh([*df.columns, rank, *(f"run_{c}" for c in sums)], "part")
    kinds = {c: df.schema[c].dataType.simpleString() for c in sums}
    if bad := [c for c, k in kinds.items() if k not in ("bigint", "double")]:
        raise ValueError(f"sums are long or double; {', '.join(bad)} is not")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        k, n = TaskContext.get().partitionId(), 0
        before = {c: (0 if kinds[c] == "bigint" else 0.0) for c in sums}
        for batch in batches:
            if not batch.num_rows:
                continue
            more = []
            for c in sums:
                x = np.cumsum(batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False)) + before[c]
                before[c] = x[-1]
                more.append(pa.array(x))
            numbers = pa.array(np.arange(n + 1, n + 1 + batch.num_rows, dtype=np.int64))
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, k, np.int32)), numbers, *more], [*batch.schema.names, names[0], rank, *(f"run_{c}" for c in sums)])

    dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{part}` int", f"`{rank}` long", *(f"`run_{c}` {kinds[c]}" for c in sums)])
    rows = stage(dealt.sortWithinPartitions(*by).mapInArrow(local, schema), "ranges")
    ends = rows.groupBy(part).agg(F.max(rank).alias("n"), *[F.sum(c).alias(f"sum_{k}") for k, c in enumerate(sums)])
    w = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = ends.select(part, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{i}") for i, c in enumerate(["n", *(f"sum_{k}" for k in range(len(sums)))])])
    inner = fresh(rows.columns, *[f"before_{i}" for i in range(len(sums) + 1)])
    ends = ends.toDF(part, *inner)
    moved = [(F.col(f"`{rank}`") + F.col(inner[0])).cast("long").alias(rank)] + [(F.col(f"`run_{c}`") + F.col(inner[k + 1])).cast(kinds[c]).alias(f"run_{c}") for k, c in enumerate(sums)]
    return rows.join(F.broadcast(ends), part).select(*[F.col(f"`{c}`") for c in df.columns], *moved)
