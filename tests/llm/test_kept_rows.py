import random

import pytest

from inkmesh.llm import near_copies, quality, simhash

rng = random.Random(5)
A, B, C, D = (" ".join(f"w{rng.randrange(9000)}" for _ in range(80)) for _ in range(4))


@pytest.mark.parametrize("keep", [simhash.keep_one, near_copies.keep_one])
def test_one_row_of_each_group_stays_whatever_its_id(spark, keep):
    rows = [(None, A, 0), (7, B, 1), (7, C, 2), (3, C, 3), (None, D, 4), (None, D, 5), (None, B, 6), (7, B, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source int")
    kept = keep(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted((r[0] or 0, r[1]) for r in got) == sorted([(0, A), (7, B), (3, C), (0, D)])
    assert set(got) <= set(rows)
    assert keep(docs.limit(0)).count() == 0


def test_all_rows_stay_where_no_label_was_learned(spark):
    docs = spark.createDataFrame([(1, A), (2, B), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(docs, labels).count() == 3
