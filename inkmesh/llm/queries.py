"""The registered queries of this subpackage: each reads whole tables below sf_dir and applies one operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmesh.llm import filter_audit, fingerprint, language, licenses, packing, pieces, quality, rules, simhash, spelling, token_counts, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, section, start, end, n_tokens, n_across: tokens of every line of every document."""
    return token_counts.section_tokens(_table(spark, sf_dir, "documents"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, group_id of every document."""
    return fingerprint.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document."""
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    return language.languages(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of every document."""
    return rules.quality_rules(_table(spark, sf_dir, "documents")).drop("host_rate")


def op10_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_crc32, text_crc32: the three best segmentations of every document, and what they decode to."""
    decoded = pieces.encode(_table(spark, sf_dir, "documents"), n=3, decoded=True)
    return decoded.select("doc_id", "rank", "score", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the ten best candidates of every vector whose id is divisible by 100."""
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, filter_order, step and counts: what five filters remove from each source under all 120 orders."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents."""
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_document_fingerprints, op3_best_fit_packing, op4_license_scans, op5_simhash_near_dedup, op6_quality_classifier, op7_language_id, op8_toxicity, op9_quality_rules, op10_sentencepiece_nbest, op11_exact_topk, op12_filter_audit, op13_spelling_variants)}

#: Fitted models, XXH64 fingerprints, tokenizers and packings are beyond SQL; tests/llm hold those against plain Python.
ORACLE_SQL: dict[str, str] = {"op9_quality_rules": rules.ORACLE, "op11_exact_topk": topk.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
