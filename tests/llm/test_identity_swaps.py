import random

from inkmesh.llm import toxicity

GROUPS = (("muslims", "christians"), ("immigrants", "citizens"))


def test_a_swap_changes_words_and_stems():
    for words in ({"muslims", "walked"}, {"muslims", "muslimah", "christ"}, {"immigrants", "immigrant", "citizen"}, {"muslims", "christians"}):
        got = {(frozenset(c), frozenset(g)) for c, g in toxicity.swapped_features(words, GROUPS)}
        want = set()
        for g in GROUPS:
            for a in words & set(g):
                for b in set(g) - words:
                    old, new = set(toxicity.features_of(words)), set(toxicity.features_of(words - {a} | {b}))
                    want.add((frozenset(new - old), frozenset(old - new)))
        assert got == want


def test_no_weight_hides_in_the_stems_of_a_group(spark):
    rng = random.Random(4)
    filler = lambda: " ".join(f"q{rng.randrange(400)}" for _ in range(12))
    rows = [(f"{filler()} muslims {'zorgy' if rng.random() < 0.6 else ''}", 1) for _ in range(150)]
    rows += [(f"{filler()} christians", 0) for _ in range(150)] + [(filler(), 0) for _ in range(150)]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, identity=GROUPS, swap=10.0)
    assert abs(model.logit("the muslims walked") - model.logit("the christians walked")) < 0.5


def test_copies_share_a_weight_only_with_equal_labels_and_like_texts(spark, monkeypatch):
    base = " ".join(f"k{i}" for i in range(200))
    rows = [(1, base, 1), (2, base + " end", 1), (3, base + " stop", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit_weights", lambda rows, label, weight, n, *a, **k: seen.update(w=weight.tolist()) or ([0.0] * n, 0.0))
    toxicity.fit(docs, labels, folds=10**9, fold=-1)
    assert seen["w"] == [0.5, 0.5, 1.0]
