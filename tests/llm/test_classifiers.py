import zlib

import numpy as np
import pytest

from inkmesh.llm import language, quality, toxicity
from inkmesh.llm.labelled import held_out

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", None), (3, "w " * 50_000, "z"), (3, "w " * 50_000, "z")], "doc_id long, text string, score string")


def test_folds(spark):
    from pyspark.sql import functions as F

    got = {r["id"]: r["h"] for r in spark.range(50).select("id", held_out(F.col("id"), 3, 1).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(50)}


def test_quality_on_held_out_labels(tables):
    docs, labels = tables
    x = quality.quality(docs, labels).toPandas().merge(labels.toPandas())
    own = x[x.held_out]
    assert (own.predicted == own.quality).mean() > 0.9 and x.score.between(0, 1).all()


def test_trees_are_flat_and_exact():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] > 0.5).astype(float)
    t = quality.fit_trees(x, y, trees=10, depth=3)
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.98

    def walk(row):
        z = t.bias
        for r in t.roots:
            while t.left[r] != r:
                r = t.left[r] if row[t.feature[r]] <= t.cut[r] else t.right[r]
            z += t.value[r]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(t.score(x[:50]), [walk(r) for r in x[:50]])
    assert np.allclose(quality.fit_trees(x, np.ones(600)).score(x[:2]), 0.999)


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    x = toxicity.toxicity(docs, labels).toPandas().merge(labels.toPandas())
    own = x[x.held_out]
    assert own[own.toxic == 1].predicted.mean() >= 0.9 and own[own.toxic == 0].predicted.mean() < 0.01


def test_identity_swaps_pull_weights_together():
    # word 0 is an insult, word 1 a group's name that co-occurs with it in the biased sample, word 2 another group's name
    rows = [np.array(r) for r in [[0, 1]] * 40 + [[1]] * 6 + [[2]] * 40 + [[]] * 40]
    label = np.array([1] * 40 + [1] * 3 + [0] * 3 + [0] * 80, float)
    weight = np.ones(len(rows))
    free, _ = toxicity.fit_weights(rows, label, weight, 3, [[1, 2]], swap=0.0)
    fair, bias = toxicity.fit_weights(rows, label, weight, 3, [[1, 2]], swap=10.0)
    assert abs(fair[1] - fair[2]) < 0.3 * abs(free[1] - free[2]) and fair[0] > 2
    assert 1 / (1 + np.exp(-(bias + fair[1]))) < 0.5


def test_fit_reaches_the_least_of_a_plain_objective():
    rng = np.random.default_rng(8)
    dense = (rng.random((160, 12)) < 0.3).astype(float)
    label = (rng.random(160) < 1 / (1 + np.exp(-(dense @ rng.normal(0, 2, 12) - 1)))).astype(float)
    weight, pairs, l1, swap = rng.random(160) + 0.1, [((1, -2), 3.0), ((3, -4, 5), 1.0)], 2e-3, 0.7
    v = weight / weight.sum()

    def objective(x):
        w, z = x[:-1], dense @ x[:-1] + x[-1]
        fair = sum(p / 4.0 * sum(np.sign(k) * w[abs(k) - 1] for k in ks) ** 2 for ks, p in pairs)
        return (v * (np.logaddexp(0, z) - label * z)).sum() + l1 * np.abs(w).sum() + swap * fair

    w, b = toxicity.fit_weights([np.flatnonzero(r) for r in dense], label, weight, 12, [], l1=l1, swap=swap, rounds=2000, swaps=pairs)
    best = np.append(w, b)
    at = objective(best)
    for k in range(13):  # convex: a least point has no better neighbour along any axis, nor in any drawn direction
        for d in (1e-2, -1e-2, 1e-3, -1e-3):
            assert objective(best + d * np.eye(13)[k]) > at - 1e-9
    assert all(objective(best + rng.normal(0, s, 13)) > at - 1e-9 for s in (1e-3, 1e-2, 0.1, 1.0) for _ in range(200))


def test_balanced_classes_weigh_the_same():
    label, weight = np.array([1.0, 0, 0, 0, 0]), np.array([0.5, 1, 1, 1, 1])
    assert toxicity.balanced(label, weight).tolist() == [4, 1, 1, 1, 1] and toxicity.balanced(label, weight, 0).tolist() == weight.tolist()
    assert toxicity.balanced(np.ones(5), weight).tolist() == weight.tolist()


def test_clean_rows_stay_whatever_their_ids(spark):
    # wide filler makes the model sure of its word only
    good, bad = [f"calm words number {i} of a quiet text" for i in range(60)], [f"zorgy words number {i} of a loud text" for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(120)], "doc_id long, toxic int")
    x = spark.createDataFrame([(None, good[0]), (None, bad[0]), (1, good[1]), (1, good[1]), (61, bad[1]), (5, None), (6, "")], "doc_id long, text string")
    for d in (x, docs):  # labels of other rows, and of these
        assert toxicity.keep_clean(d.limit(0), labels).count() == 0
    model = toxicity.fit(docs, labels)
    kept = toxicity.keep_where(x, lambda texts: model.score(texts) < 0.7).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == [("1", good[1]), ("1", good[1]), ("5", ""), ("6", ""), ("None", good[0])]


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    x = language.languages(docs, most=100).toPandas().merge(docs.select("doc_id", "lang").toPandas())
    assert (x[x.held_out].lang_pred == x[x.held_out].lang).mean() > 0.99


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "aba"]
    p = rng.random((len(pieces) + 2, 2))
    p[-1] = 0
    m = language.PieceModel(["x", "y"], pieces, p)

    def brute(w):
        if not w:
            return np.ones(2)
        return sum(brute(w[k:]) * p[pieces.index(w[:k]) if w[:k] in pieces else len(pieces)] for k in range(1, len(w) + 1) if w[:k] in pieces or k == 1)

    words = ["▁ab", "▁aba", "▁aaa", "▁bab", "▁", "▁qb", "abaab"]
    assert np.allclose(m.word_scores(words), [np.log(brute(w)) for w in words])


def test_odd_rows(spark, tables):
    docs, labels = tables
    x = odd(spark)
    none = x.limit(0)
    for f in (lambda d: quality.quality(d, labels), lambda d: toxicity.toxicity(d, labels)):
        got = f(x).collect()
        assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got) and f(none).count() == 0
    got = language.languages(x.withColumn("lang", x.score)).collect()
    assert sorted(r["lang_pred"] for r in got if r["doc_id"] in (1, 2)) == ["und", "und"] and len(got) == 5
    assert language.languages(none.withColumn("lang", none.score)).count() == 0
    assert toxicity.keep_clean(x, labels).columns == x.columns and quality.keep_good(x, labels).columns == x.columns
