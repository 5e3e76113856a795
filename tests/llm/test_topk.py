import math
import random

import numpy as np
from pyspark.sql import functions as F

from inkmesh.llm import topk

SCHEMA = "vec_id long, embedding array<double>, query long, dim int, vec string"


def plain(rows, k=10):
    """Brute force with whole numbers; rows are (vec_id, list)."""
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(1024 * x) for x in v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i is None or i % 100:
            continue
        hits = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, c)))), j is None, j or 0) for n, (j, c) in enumerate(ok) if n != at and len(c) == len(q)]
        out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out, key=lambda x: tuple(-1 if y is None else y for y in x))


def search(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in rows], SCHEMA).repartition(parts)
    got = topk.top_k(df, F.col("vec_id") % 100 == 0).collect()
    return sorted(map(tuple, got), key=lambda x: tuple(-1 if y is None else y for y in x))


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(350)]
    rows += [(400 + i, rows[0][1]) for i in range(30)]  # copies: ties to the smaller id
    rows += [(300, rows[0][1]), (300, rows[0][1]), (200, rows[1][1]), (None, rows[0][1]), (None, rows[2][1])]
    rows += [(500, None), (600, [0.1] * 7 + [None]), (700, [0.1] * 7 + [math.nan]), (800, [math.inf] * 8), (900, [0.5, 0.5, 0.5]), (901, [0.25] * 3), (1000, []), (1001, [])]
    assert search(spark, rows) == plain(rows)


def test_huge_components_stay_exact(spark):
    rows = [(i * 100, [x, 1e-3, -7.3]) for i, x in enumerate([3e7, 3e7 + 0.001, 2.0**40, -(2.0**41), 2.0**43 + 1, 1e300, 0.0, 1e308])]
    assert search(spark, rows) == plain(rows)


def test_empty_tables_and_few_rows(spark):
    assert search(spark, [], 1) == [] and search(spark, [(0, [1.0])], 1) == [] and search(spark, [(1, [1.0]), (2, [1.0])], 1) == []


def test_many_blocks_and_a_tree_of_lists(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "FAN_IN", 4)
    rng = random.Random(6)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(0, 4000, 20)]
    assert search(spark, rows) == plain(rows)


def test_selection_breaks_ties_by_place():
    rng = np.random.default_rng(0)
    for big in (1, 1 << 50):
        s = rng.integers(0, 4, (20, 37)) * big
        for kind in (np.float64, np.int64):
            got = topk.select(s.astype(kind), 6)
            want = np.array([sorted(range(37), key=lambda j: (-row[j], j))[:6] for row in s])
            assert (got == want).all()


def test_hits_do_not_depend_on_the_size_of_products(monkeypatch):
    rng = np.random.default_rng(1)
    q, c, ids = rng.integers(-2, 3, (9, 3)).astype(float), rng.integers(-2, 3, (200, 3)).astype(float), rng.permutation(200)
    want = topk.Best(q, 5)
    want.meet(c, ids < 3, ids)
    monkeypatch.setattr(topk, "_TILE", 50)
    got = topk.Best(q, 5)
    for lo in range(0, 200, 70):
        got.meet(c[lo : lo + 70], ids[lo : lo + 70] < 3, ids[lo : lo + 70])
    assert got.hits().equals(want.hits())
