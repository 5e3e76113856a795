import numpy as np

from inkmesh.operators import vectors


def plain(ids, x, queries, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = set()
    for q in queries:
        s = [(-round(float(u[q] @ u[j]), 9), ids[j]) for j in range(len(ids)) if j != q]
        out |= {(ids[q], i, r) for r, (_, i) in enumerate(sorted(s)[:k], 1)}
    return out


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)


def test_blocks_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 6))
    x[200:220] = x[7]
    monkeypatch.setattr(vectors, "BLOCK", 70)
    v = table(spark, range(300), x)
    v = v.union(spark.createDataFrame([(900, None), (901, [0.0] * 6), (902, [1.0, float("nan")]), (903, [1.0, 2.0]), (904, [2.0, 4.0]), (905, [])], "vec_id long, embedding array<double>"))
    found = vectors.nearest(v, v, 5)
    got = {(r.query, r.vec_id, r.rank): r.score for r in found.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(300):
        mine = sorted((rank, i, s) for (a, i, rank), s in got.items() if a == q)
        want = np.sort(np.delete(u @ u[q], q))[::-1][:5]
        assert np.allclose([s for *_, s in mine], want) and all(np.isclose(u[q] @ u[i], s) for _, i, s in mine)
    assert {k for k in got if k[0] > 299} == {(903, 904, 1), (904, 903, 1)}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()


def test_cells_miss_little(spark):
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(20, 8))[rng.integers(0, 20, 2000)] + 0.4 * rng.normal(size=(2000, 8)))
    v = table(spark, range(2000), x)
    q = v.where("vec_id % 20 = 0")
    found = vectors.nearest_in_cells(v, q, 10, cells=32, probes=6)
    assert vectors.recall(found, vectors.nearest(v, q, 10)).first()["recall"] >= 0.9
    assert vectors.nearest_in_cells(v, q, 10, cells=8, probes=8).groupBy("query").count().where("count = 10").count() == 100
