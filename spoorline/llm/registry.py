"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, html_extract, importance, langid, line_rules, maxscore, mixing, packing, periodic_runs, ppm, simhash, token_counts, url_filter
from .common import doc_bucket, read_table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_rules.clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p", 9).alias("p"), "kept")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "term_weight")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, read_table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ppm.score_documents(docs, ppm.held_out_fold("doc_id"))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(doc_bucket("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the crc32 of its id repeats itself from some word on; without an id nothing changes."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.detect_runs(docs, _planted, with_text=False, with_runs=False)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_html_extraction, op2_quality_rules, op3_source_mixing, op4_url_filter, op5_packing,
        op6_quality_classifier, op7_simhash, op8_ppm_scores, op9_maxscore, op10_language_id,
        op11_token_counts, op12_periodic_runs, op13_hard_negatives,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": line_rules.oracle_sql(),
        "op3_source_mixing": mixing.oracle_sql(),
        "op4_url_filter": url_filter.oracle_sql(),
        "op9_maxscore": maxscore.oracle_sql(),
        "op13_hard_negatives": hard_negatives.oracle_sql(),
    }
