import random
import re
from collections import Counter
from itertools import permutations

import pytest

from inkmesh.llm import filter_audit

DOCS = "doc_id long, text string, source string, mask int, part string, good string, n long, digest string"


def plain(docs, labels):
    """Brute force: (part, order, step) -> the seven counts."""
    texts = [(i, t or "", s or "") for i, t, s in docs]
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    failed = []
    for i, t, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = set()
        if len(words) < 200:
            f.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            f.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            f.add("C")
        if re.search(r"[#$%&*|]", t):
            f.add("D")
        if any(t == u and j is not None and i is not None and j < i for j, u, _ in texts):
            f.add("E")
        failed.append((i, part, f))
    out = {}
    for part in {p for _, p, _ in failed}:
        own = [(i, f) for i, p, f in failed if p == part]
        sums = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                sums[c] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == {c} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), x in out.items():
            if p == part:
                x.append(sums[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels):
    df = spark.createDataFrame([(*x, 0, "p", "g", 1, "d") for x in docs], DOCS).repartition(3)
    got = filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int, part string")).collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got}
    assert len(found) == len(got)
    return found


def test_against_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "Beta", "g#mma", "delta", "É x", "z z", "and", "of", *(f"w{k}" for k in range(300))]
    pool = [" ".join(rng.choices(words, weights=[1] * 5 + [rng.choice([1, 40])] * 3 + [rng.choice([1, 3])] * 300, k=rng.choice([0, 3, 150, 199, 200, 201, 400]))) for _ in range(60)]
    pool += [" ".join(["same"] * 200), " ".join(f"v{k}" for k in range(250)), "A" * 3 + "a" * 147, "", " \n\t\x0b\x0c\r", "x " * 40_000]
    docs = [(i, rng.choice(pool), rng.choice(["web", "code", None, "", "üñ"])) for i in range(200)]
    docs += [(3, docs[0][1], "web"), docs[5], docs[5], (None, docs[0][1], "web"), (None, None, None), (1000, None, "code"), (1001, "", "web")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "x") for i in range(0, 220, 2)] + [(4, 1, 0, "x"), (4, 0, 1, "x"), (None, 1, 1, "x")]
    assert run(spark, docs, labels) == plain(docs, [(i, q, t) for i, q, t, _ in labels])


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    got = run(spark, [(1, "a", "s")], [])
    assert len(got) == 600 and got["s", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


@pytest.mark.parametrize("most", [1, 3])
def test_many_parts(spark, most, monkeypatch):
    monkeypatch.setattr(filter_audit, "_MOST_PARTS", most)
    docs = [(i, f"T{i % 5}", f"part {i % 40}") for i in range(120)]
    assert run(spark, docs, []) == plain(docs, [])


def test_the_table_of_first_failures():
    assert filter_audit.FIRST.shape == (32, 120) and filter_audit.ORDERS[0] == "ABCDE"
    assert filter_audit.FIRST[0].tolist() == [5] * 120 and filter_audit.FIRST[0b10010, filter_audit.ORDERS.index("CEADB")] == 1
