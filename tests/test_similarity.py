"""Similarity to seeds against a plain version, and the shuffles it takes."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from inkmesh.operators import similarity


def plain(docs, seeds):
    tf = lambda rows: [Counter(t.split()) for t in rows]
    merged = {}
    for k, t in docs:
        merged[k] = merged.get(k, "") + " " + t
    own, sd = tf(merged.values()), tf([t for _, t in seeds])
    df = Counter(w for c in own + sd for w in c)
    n = len(docs) + len(seeds)
    words = sorted(df)

    def vector(c):
        v = np.array([(1 + math.log(c[w])) * (math.log((n + 1) / (df[w] + 1)) + 1) if w in c else 0.0 for w in words])
        return v / (np.linalg.norm(v) or 1)

    c = sum(vector(x) for x in sd)
    c = c / np.linalg.norm(c)
    return {k: float(vector(x) @ c) for k, x in zip(merged, own)}


def test_scores_and_shuffles(spark):
    rng = np.random.default_rng(4)
    text = lambda: " ".join(f"w{int(k)}" for k in rng.zipf(1.6, 30) % 50)
    docs = [(i, text()) for i in range(60)] + [(7, "w1 w2 w2"), (100, "")]
    seeds = [(i, text()) for i in range(5)]
    d, s = spark.createDataFrame(docs, "doc long, text string"), spark.createDataFrame(seeds, "doc long, text string")
    df = similarity.similarity_to_seeds(d, s, F.filter(F.split("text", " "), lambda x: x != ""))
    got, want = {r["doc"]: r["score"] for r in df.collect()}, plain(docs, seeds)
    assert df.count() == 62 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    # the counts of all tokens are read once, and never sorted by (side, document) again
    assert df._jdf.queryExecution().optimizedPlan().toString().count("inkmesh-tf-") <= 2 and "named_struct" not in df._jdf.queryExecution().optimizedPlan().toString()
