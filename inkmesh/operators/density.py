"""Density of points on a raster: points become cells, three box sums along rows and along columns stand for a Gaussian."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmesh.plans.names import fresh

#: A Gaussian's width as a share of the mean distance of two points.
WIDTH_SHARE = 0.125


def fitted(points: DataFrame, width: int, height: int, margin: float = 0.05) -> DataFrame:
    """points with x and y moved and scaled alike, so that all lie inside the raster but for a margin on each side.

    Rows without a finite x and y are left out. Points of one place come to the middle.
    """
    known = points.where(_finite("x") & _finite("y"))
    x0, x1, y0, y1, s = names = fresh(points.columns, "x0", "x1", "y0", "y1", "scale")
    ends = F.min("x").alias(x0), F.max("x").alias(x1), F.min("y").alias(y0), F.max("y").alias(y1)
    room = [F.lit((n - 1) * (1 - 2 * margin)) for n in (width, height)]
    scale = F.least(F.try_divide(room[0], F.col(x1) - F.col(x0)), F.try_divide(room[1], F.col(y1) - F.col(y0)))
    box = known.agg(*ends).withColumn(s, F.coalesce(scale, F.lit(1.0)))
    moved = {c: (F.col(c) - (F.col(a) + F.col(b)) / 2) * F.col(s) + (n - 1) / 2 for c, a, b, n in (("x", x0, x1, width), ("y", y0, y1, height))}
    return known.join(F.broadcast(box)).withColumns(moved).drop(*names)  # the box is one row


def mean_distance(points: DataFrame, exact: int = 2000, pairs: int = 400_000, seed: int = 0) -> DataFrame:
    """One row: pairs, mean_distance of two points (x, y), standard_error.

    Up to `exact` points all pairs count and the error is zero. Beyond, about `pairs` random ones are drawn: every point
    gets the same number of tickets (or a ticket by chance, where there are more points than tickets), tickets are dealt
    and ordered at random, and each slice of a task pairs its own. Rows without a finite x and y are left out; fewer
    than two points are no pairs and a distance of 0.
    """
    spark = points.sparkSession
    known = points.where(_finite("x") & _finite("y")).select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    n = known.count()
    schema = "pairs long, mean_distance double, standard_error double"
    if n <= exact:
        z = np.array([complex(*r) for r in known.collect()])  # `exact` rows at most
        total = sum(float(np.abs(z[i + 1 :] - z[i]).sum()) for i in range(len(z)))
        count = n * (n - 1) // 2
        return spark.createDataFrame([(count, total / count if count else 0.0, 0.0)], schema)
    each = 2 * pairs / n
    tickets = known.withColumn("i", F.monotonically_increasing_id())
    if each < 1:
        tickets = tickets.where(F.rand(seed) < each)
    elif each > 1:
        tickets = tickets.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(math.ceil(each))))).drop("t")
    dealt = tickets.withColumns({"deal": F.rand(seed + 1), "order": F.rand(seed + 2)}).repartition(max(1, 2 * pairs // 50_000), "deal").sortWithinPartitions("order")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, i = (batch.column(k).to_numpy() for k in range(3))
            h = len(x) // 2
            d = np.hypot(x[:h] - x[h : 2 * h], y[:h] - y[h : 2 * h])[i[:h] != i[h : 2 * h]]
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(d)], pa.int64()), "s": [float(d.sum())], "q": [float((d * d).sum())]})

    sums = dealt.select("x", "y", "i").mapInArrow(measure, "n long, s double, q double").agg(*[F.sum(c).alias(c) for c in "nsq"])
    mean = F.col("s") / F.col("n")
    return sums.select(F.col("n").alias("pairs"), mean.alias("mean_distance"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)) / F.col("n")).alias("standard_error"))


def kernel_width(distance: float, scale: float = 1.0, kernel: float = 1.0) -> float:
    """A Gaussian's width in cells for points of this mean distance, a unit of which is `scale` cells; at least one cell."""
    return max(1.0, WIDTH_SHARE * distance / math.sqrt(2) * kernel * scale)


def box_radius(sigma: float) -> int:
    """The radius of a box that, passed three times, is as wide as the Gaussian; at least 1."""
    return max(1, math.floor(math.sqrt(4 * sigma * sigma + 1) / 2 + 0.5))


def density(points: DataFrame, width: int, height: int, sigma: float, weight: str | None = None, layers: tuple[str, ...] = ()) -> DataFrame:
    """*layers, x int, y int, value: the blurred weight of each cell of a width by height raster, zeros included.

    points: x and y in cells, weight (1 each where none is named), and layers, whose values (null too) get a raster each.
    A point counts in the cell whose middle is nearest; those outside the raster, without a finite x or y, or with a null
    weight are left out. What a pass blurs over the edge is lost. A raster without layers is there even if no point is.

    Points are summed to cells before anything else is shuffled. Rows of the raster are dealt to tasks once for all
    three passes along x, its columns once for those along y; a group of the windows is one row or column of the raster.
    """
    r = box_radius(sigma)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    inside = points.where(_finite("x") & _finite("y")).select(*layers, F.round("x").alias("x"), F.round("y").alias("y"), w.alias("value"))
    inside = inside.where(F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1) & F.col("value").isNotNull())
    cells = inside.groupBy(*layers, F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).agg(F.sum("value").alias("value"))
    which = cells.select(*layers).distinct() if layers else points.sparkSession.range(1).select()
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    empty = which.withColumn("y", each(height)).withColumn("x", each(width)).select(*layers, "x", "y", F.lit(0.0).alias("value"))
    grid = cells.unionByName(empty).repartition(*layers, "y").groupBy(*layers, "y", "x").agg(F.sum("value").alias("value"))
    for along, across in (("x", "y"), ("y", "x")):
        for _ in range(3):
            grid = _box(grid, [*layers, across], along, r)
    return grid.select(*layers, "x", "y", F.greatest("value", F.lit(0.0)).alias("value"))  # differences may fall a bit below zero


def _finite(c: str) -> Column:
    return F.abs(F.col(c).cast("double")) < float("inf")  # NaN is above infinity


def _box(grid: DataFrame, by: list[str], along: str, r: int) -> DataFrame:
    """The mean of 2r + 1 cells around each, as a difference of two running sums."""
    w = Window.partitionBy(*by).orderBy(along)
    run = F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("value").over(Window.partitionBy(*by))
    sums = grid.withColumns({"run": run, "total": total})
    return sums.withColumn("value", (F.coalesce(F.lead("run", r).over(w), "total") - F.coalesce(F.lag("run", r + 1).over(w), F.lit(0.0))) / (2 * r + 1)).drop("run", "total")
