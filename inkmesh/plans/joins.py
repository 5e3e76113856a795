"""Joins whose keys hold very unequal numbers of rows; columns that are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that hold over 1 / FEW of the rows are broadcast: there are fewer than FEW of them, whatever the data.
FEW = 10_000


def join_uneven(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int | None = None) -> DataFrame:
    """rows inner-joined with facts, one row a key, by the column `key`; n, a column of facts, is how many rows hold the key.

    Keys that hold over one in FEW of all rows never reach a shuffle: their facts are broadcast, and by that definition
    they are fewer than FEW. All other keys are joined by shuffle, where none can fill a task. `total` is the number of
    rows, if known. Null keys join nothing. The column n is dropped.
    """
    total = rows.count() if total is None else total
    heavy = F.col(n) * FEW > total
    often = facts.where(heavy).drop(n)
    a = rows.join(F.broadcast(often), key)
    b = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(facts.where(~heavy).drop(n), key)
    return a.unionByName(b)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with one more column, computed once a row: the optimizer cannot copy its expression to each place that uses it."""
    return df.withColumn(name, value).select(*df.columns, F.explode(F.array(name)).alias(name))
