import random
import re
import zlib
from collections import Counter

import pytest

from inkmesh.llm import queries, spelling
from inkmesh.llm.spelling import Trie

DATA = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or len(a) == len(b) and a[i + 1 :] == b[i + 1 :]


def plain(docs):
    """Brute force: word -> (form, root, n, n_near, form_n); every word is edited in all ways."""
    n = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = {c for w in n for c in w}
    out = {}
    for w in n:
        ways = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + x :] for k in range(len(w) + 1) for c in letters for x in (0, 1)}
        near = [v for v in ways if v in n and v != w]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w, x in out.items():
        while out[x[1]][0]:
            x[1] = out[x[1]][0]
    return {w: tuple(x) for w, x in out.items()}


def run(spark, docs, **more):
    df = spark.createDataFrame([(*x, 0, "w", "s", 1) for x in docs], "doc_id long, text string, n long, word string, shard string, size long").repartition(3)
    got = spelling.variants(df, **more).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: tuple(r)[1:] for r in got}


def test_automata_find_all_words_one_edit_away():
    rng = random.Random(3)
    for letters in ("ab", "abcd\xe9"):
        words = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(300)} | {"a" * k for k in range(70, 74)} | {"ab" * 40, "b" + "ab" * 40})
        trie = Trie.of([w.encode("latin-1") for w in words])
        for w in words + ["", "a" * 69, "ba" * 40]:
            assert trie.near(w.encode("latin-1")) == [k for k, v in enumerate(words) if one_edit(w, v)]


def texts(rng):
    base = ["".join(rng.choices("abcdefg\xe9\xd7", k=rng.randrange(4, 9))) for _ in range(60)]

    def broken(w):
        k = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:k] + w[k + 1 :], w[:k] + rng.choice("abz") + w[k:], w[:k].upper() + w[k:]])

    return [(i, " ".join(broken(rng.choice(base)) for _ in range(120)) + " 12,naiveāx") for i in range(60)]


def test_against_brute_force(spark):
    docs = texts(random.Random(4)) + [(None, "letters lettres letters"), (7, None), (8, ""), (5, "wordy words wordy"), (5, "wordy words wordy"), (9, "\xc9COLE \xe9cole \xc9cole")]
    got = run(spark, docs)
    assert got == plain(docs) and sum(x[0] is not None for x in got.values()) > 20 and any(x[1] != (x[0] or w) for w, x in got.items())


def test_shuffled_shards_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BROADCAST", 0)
    monkeypatch.setattr(spelling, "SHARD", 90)
    docs = texts(random.Random(5))[:25] + [(k, "a" * 200_000 + " " + "a" * 199_999 + " " + "ab" * 100_000) for k in range(100, 106)]
    assert run(spark, docs[:25]) == plain(docs[:25])
    got = run(spark, docs, damage=0)
    assert got["a" * 200_000][3] == 1 and got["ab" * 100_000][3] == 0


def test_empty_tables_and_short_words(spark):
    assert run(spark, []) == {} and run(spark, [(1, "a bb ccc dddd")] * 4) == {}
    with pytest.raises(ValueError):
        run(spark, [(1, "a")], ratio=1)


def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["word"]: tuple(r)[1:] for r in queries.op13_spelling_variants(spark, DATA).collect()}
    assert got == plain(docs)
