"""Documents whose own columns are named like those that operators use inside: none is lost, mixed up or refused."""

import pytest
from pyspark.sql import functions as F

from inkmesh.llm import filter_audit, fingerprint, language, licenses, near_copies, packing, pieces, quality, rules, simhash, spelling, token_counts, topk, toxicity

CLASHES = ["text_key", "_id", "_text", "_no_id", "no_id", "id", "fp", "node", "root", "group", "g", "e", "ghost", "salt", "host", "label", "v", "token", "n", "pos", "word", "part", "digest", "mask", "rank", "score", "held_out", "a", "b", "Text_Key", "holds"]
TEXTS = {1: "the quick brown fox jumps over the lazy dog", 2: "the quick brown fox jumps over the lazy dog", 3: "an entirely different text about licences and words", 4: "noch ein ganz anderer Text über Sprachen und Wörter", None: "a row without an id"}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de")[i == 4], "s") for i, t in TEXTS.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = [c for k, c in enumerate(CLASHES) if c.lower() not in {x.lower() for x in CLASHES[:k]}]
    return df.select("*", *[F.lit(k).cast(("long", "string", "boolean")[k % 3]).alias(c) for k, c in enumerate(names)])


def test_stages_keep_rows_and_columns(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0, 5), (3, 1, 0, 6), (4, 0, 1, 7)], "doc_id long, quality int, toxic int, text_key int")
    for kept in (simhash.keep_one(docs), near_copies.keep_one(docs)):
        assert kept.columns == docs.columns and sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4]
    empty = labels.limit(0)
    assert toxicity.keep_clean(docs, empty).count() == quality.keep_good(docs, empty).count() == 5
    assert toxicity.keep_clean(docs, labels).columns == quality.keep_good(docs, labels).columns == docs.columns


@pytest.mark.parametrize("kind", ["long", "string", "boolean", "array<string>"])
def test_a_text_key_of_any_type(spark, kind):
    df = spark.createDataFrame([(i, t) for i, t in TEXTS.items()], "doc_id long, text string").withColumn("text_key", F.lit(None).cast(kind)).withColumn("_id", F.lit(None).cast(kind))
    assert simhash.keep_one(df).count() == 4


def test_operators_take_them(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0, 5), (3, 1, 0, 6), (4, 0, 1, 7)], "doc_id long, quality int, toxic int, text_key int")
    for found in (fingerprint.edited_fingerprints(docs), licenses.license_scan(docs), simhash.near_duplicates(docs), quality.quality(docs, labels), language.languages(docs), toxicity.toxicity(docs, labels), rules.quality_rules(docs)):
        assert found.count() == 5
    assert token_counts.section_tokens(docs).count() == packing.pack_documents(docs).count() == pieces.encode(docs, n=1).count() == 5
    assert filter_audit.audit(docs, labels).count() == 600 and spelling.variants(docs).count() == 0
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.array(F.lit(1.0)).alias("embedding"), *[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
    assert topk.top_k(vectors, F.col("vec_id") == 1).count() == 4
