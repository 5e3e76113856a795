"""Texts without a space: runs of one letter, padding, encoded data. Every operator takes them whole, in little time and memory."""

import random
import time

import numpy as np
import pytest

from inkmesh.llm import fingerprint, language, licenses, near_copies, packing, pieces, quality, rules, simhash, token_counts, toxicity

RUNS = ["a" * 100_000, "-" * 100_000, "=" * 100_000, "_" * 100_000, "中" * 30_000, "".join(random.Random(0).choices("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/", k=100_000))]
SPACES = [" " * 1_200_000, "\n" * 200_000, "\t \u3000" * 100_000]


@pytest.fixture(scope="module")
def unbroken(spark):
    rows = [(i, t, ("en", "de")[i % 2], "s") for i, t in enumerate(RUNS + SPACES)] + [(10 + i, f"some words of text number {i}", ("en", "de")[i % 2], "s") for i in range(30)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").cache()


def test_n_best_of_runs_takes_little_time_and_keeps_the_text():
    coder = pieces.PieceCoder(pieces.tokenizer_path(pieces.VOCABULARY), 3)
    for t in RUNS:
        began = time.time()
        best = coder.encode([t])[0]
        assert time.time() - began < 10 and all(coder.decode(i) == t for _, i in best) and len({i for _, i in best}) == len(best)


def test_every_operator_takes_unbroken_texts(spark, unbroken):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10, 40)], "doc_id long, quality int, toxic int")
    n = len(RUNS) + len(SPACES) + 30
    lengths = {i: len(t) for i, t in enumerate(RUNS + SPACES)}
    found = token_counts.section_tokens(unbroken).toPandas()
    assert {i: g.end.max() for i, g in found.groupby("doc_id") if i in lengths} == lengths
    assert fingerprint.edited_fingerprints(unbroken).count() == n
    packed = packing.pack_documents(unbroken).toPandas()
    assert packed.doc_id.nunique() == n and packed.length.max() <= 2048
    assert {r.doc_id: r.n_words for r in licenses.license_scan(unbroken).collect()}[0] == 1
    assert simhash.near_duplicates(unbroken).count() == near_copies.near_copies(unbroken).count() == n
    for x in (quality.quality(unbroken, labels), toxicity.toxicity(unbroken, labels)):
        assert np.isfinite(x.toPandas().score).all() and x.count() == n
    x = {r.doc_id: (r.lang_pred, r.score) for r in language.languages(unbroken).collect()}
    assert x[1][0] == "und" and x[0][0] in ("en", "de") and all(np.isfinite(s) for _, s in x.values())
    assert {r.doc_id: r.word_chars for r in rules.quality_rules(unbroken).collect()}[4] == 30_000
    assert pieces.encode(unbroken).where("rank = 1").count() == n
