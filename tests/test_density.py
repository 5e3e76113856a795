import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkmesh.operators import density as D


def plain(x, y, v, width, height, r):
    g = np.zeros((height, width))
    for a, b, c in zip(np.floor(x + 0.5).astype(int), np.floor(y + 0.5).astype(int), v):
        if 0 <= a < width and 0 <= b < height:
            g[b, a] += c
    for _ in range(3):
        for axis in (0, 1):
            n = g.shape[axis]
            out = np.zeros_like(g)
            for i in range(n):
                out.swapaxes(0, axis)[i] = g.swapaxes(0, axis)[max(0, i - r) : i + r + 1].sum(axis=0) / (2 * r + 1)
            g = out
    return g


@pytest.mark.parametrize("sigma", [1.0, 4.0, 60.0])  # the last box is wider than the raster is high
def test_raster_of_2000_points(spark, sigma):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"x": rng.normal(30, 25, 2000), "y": rng.normal(20, 15, 2000), "v": rng.random(2000), "part": rng.integers(0, 2, 2000)})
    want = {k: plain(p["x"].to_numpy(), p["y"].to_numpy(), p["v"], 64, 40, D.box_radius(sigma)) for k, p in pdf.groupby("part")}
    df = spark.createDataFrame(pdf)
    got = D.density(df, 64, 40, sigma, "v", ("part",)).toPandas()
    assert len(got) == 2 * 64 * 40 and got["value"].min() >= 0
    for k, p in got.groupby("part"):
        g = np.zeros((40, 64))
        g[p["y"], p["x"]] = p["value"]
        assert np.abs(g - want[k]).max() < 1e-9
    one = D.density(df, 64, 40, sigma, "v").toPandas()
    g = np.zeros((40, 64))
    g[one["y"], one["x"]] = one["value"]
    assert np.abs(g - want[0] - want[1]).max() < 1e-9


def test_raster_of_a_million_points_in_one_spot(spark):
    """A hot cell is summed before it is shuffled; what stays inside the raster is kept whole."""
    hot = spark.range(0, 1_000_000, 1, 8).select(F.lit(50.0).alias("x"), F.lit(30.0).alias("y"))
    got = D.density(hot, 101, 61, 2.0)
    assert abs(got.agg(F.sum("value")).first()[0] - 1_000_000) < 1e-6
    top = got.orderBy(F.desc("value")).first()
    assert (top["x"], top["y"]) == (50, 30)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3  # cells, rows, columns


def test_points_that_do_not_count(spark):
    rows = [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (float("inf"), 1.0, 1.0), (1.0, 1.0, None), (-0.6, 0.0, 1.0), (9.5, 0.0, 1.0), (1.0, 2.0, 3.0), (1.2, 1.8, 4.0)]
    df = spark.createDataFrame(rows, "x double, y double, w double")
    got = D.density(df, 10, 10, 1.0, "w").toPandas()
    assert len(got) == 100 and got.loc[got["value"] > 1e-12, ["x", "y"]].max().tolist() == [4, 5]
    assert abs(got["value"].sum() - D.density(df.where("w >= 3"), 10, 10, 1.0, "w").agg(F.sum("value")).first()[0]) < 1e-12
    assert D.density(df.limit(0), 10, 10, 1.0).where("value <> 0").count() == 0 and D.density(df.limit(0), 10, 10, 1.0).count() == 100
    assert D.density(df.limit(0), 10, 10, 1.0, "w", ("w",)).count() == 0


def test_fitting_and_distances(spark):
    rng = np.random.default_rng(3)
    xy = rng.normal(0, 1, (1500, 2)) * [3.0, 1.0]
    df = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1]}))
    d = np.sqrt(((xy[:, None] - xy[None]) ** 2).sum(-1))
    true = d.sum() / (1500 * 1499)
    exact = D.mean_distance(df).first()
    assert exact["pairs"] == 1500 * 1499 // 2 and abs(exact["mean_distance"] - true) < 1e-9 and exact["standard_error"] == 0
    for k, pairs in enumerate((300_000, 500)):  # several tickets a point, and fewer tickets than points
        s = D.mean_distance(df, exact=100, pairs=pairs, seed=k).first()
        assert 0.8 * pairs < s["pairs"] < 1.2 * pairs and 0 < s["standard_error"] < 0.2
        assert abs(s["mean_distance"] - true) < 4 * s["standard_error"]
    fit = D.fitted(df, 200, 100).agg(*[f(c) for c in ("x", "y") for f in (F.min, F.max)]).first()
    assert fit[0] > 9 and fit[1] < 190 and fit[2] > 4 and fit[3] < 95 and (abs(fit[0] - 9.95) < 1e-9 or abs(fit[2] - 4.95) < 1e-9)
    assert D.mean_distance(df.limit(1)).first()["mean_distance"] == 0 and D.mean_distance(df.limit(0)).first()["pairs"] == 0
    assert D.fitted(df.limit(1), 11, 21).first()[:] == (5.0, 10.0) and D.fitted(df.limit(0), 5, 5).count() == 0
    assert D.kernel_width(80.0, 2.0) == pytest.approx(14.142135623) and D.kernel_width(0.0) == 1.0 and D.box_radius(0.1) == 1
