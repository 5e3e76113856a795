import random

import pyarrow.parquet as pq

import corpus_pipeline
from inkmesh.llm import near_copies

DATA = "/root/testdata/sf0.001"


def groups_by_hand(texts, shingle=5, threshold=0.8):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 10 * len(x & sets[j]) >= 10 * threshold * len(x | sets[j]):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def edited_texts(seed, n=12):
    """Texts, and copies with words replaced, from under to over the similarity of 0.8, and a line that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    shared = [word() for _ in range(12)]
    out = []
    for _ in range(n):
        base = [word() for _ in range(rng.choice((4, 30, 60, 200, 400)))] + shared * rng.randrange(2)
        out.append(base)
        for rate in (0.005, 0.01, 0.02, 0.025, 0.03, 0.05):
            out.append([word() if rng.random() < rate else w for w in base])
    base = [word() for _ in range(300)]  # a group larger than what is compared at once
    out += [[*base[:k], word(), *base[k + 1 :]] for k in range(0, 300, 9)]
    return [" ".join(x) for x in out] + ["", "  ", "one two", "ONE two"]


def test_the_stage_keeps_one_row_of_each_group(spark):
    texts = edited_texts(1) + pq.read_table(f"{DATA}/documents.parquet", columns=["text"])["text"].to_pylist()[:120]
    root = groups_by_hand(texts)
    want = sorted({root[i]: i for i in reversed(range(len(texts)))}.values())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()) == want


def test_order_of_prefixes_changes_no_group(spark, monkeypatch):
    texts = edited_texts(2)
    root = groups_by_hand(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    once = near_copies.common_shingles
    monkeypatch.setattr(near_copies, "common_shingles", lambda d, k: once(d, k, one_in=1, least=3))
    got = {r.doc_id: r.group for r in near_copies.near_copies(docs).collect()}
    assert len({(root[i], got[i]) for i in got}) == len(set(root)) == len(set(got.values()))


def test_crowded_buckets_are_cut_into_tiles_and_lose_no_link(spark, monkeypatch):
    texts = edited_texts(3)
    root = groups_by_hand(texts)
    for name, value in (("_CROWDED", 10), ("_ROUNDS", ((1, 3), (3, 10))), ("_FULL", 4), ("_TILE", 4)):
        monkeypatch.setattr(near_copies, name, value)
    once = near_copies.common_shingles
    monkeypatch.setattr(near_copies, "common_shingles", lambda d, k: once(d, k, one_in=1, least=3))
    got = {r.doc_id: r.group for r in near_copies.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len({(root[i], got[i]) for i in got}) == len(set(root)) == len(set(got.values()))
