"""Lexical operators: document frequencies, smoothed idf, lexical overlap and BM25."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import within
from .task_rows import flat, task_rows


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def ranking_text(items: DataFrame) -> DataFrame:
    """Add the text that is ranked: the title, then the sentence."""
    return items.withColumn("ranking_text", F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.col("text")))


def document_frequency(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, token, df, idf); the question counts as a document."""
    docs = items.select("task_id", F.concat_ws(". ", "source_ref", "text").alias("t")).unionByName(tasks.select("task_id", F.col("question").alias("t")))
    total = docs.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))
    tokens = docs.select("task_id", F.explode(F.array_distinct(T.content_tokens("t"))).alias("token"))
    df = tokens.groupBy("task_id", "token").agg(F.count(F.lit(1)).alias("df"))
    return df.join(total, "task_id").select("task_id", "token", "df", T.smoothed_idf(F.col("n"), F.col("df")).alias("idf"))


def lexical_overlap(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, item_id, score): shared tokens by idf, aliases in both texts, shared entities; tasks without a question have no rows."""
    return overlap_scores(task_rows(items, tasks))


def overlap_scores(rows: DataFrame) -> DataFrame:
    """The same from task rows."""
    part = lambda name: F.transform("items", lambda i: i[name])
    rows = rows.where("asked is not null").select("task_id", "asked", part("item_id").alias("ids"), part("source_ref").alias("sources"), part("text").alias("texts"))
    rows = within.by_row(rows, ("asked", "sources", "texts"), {"scores": "array<double>"}, lambda asked, sources, texts: (within.Features(sources, texts).overlap(asked),), ("sources", "texts"))
    return flat(rows, scored_items("ids", "scores"), "item_id", "task_id")


def scored_items(ids: str, scores: str) -> Column:
    """An array of (item_id, score), scores rounded."""
    return F.zip_with(ids, scores, lambda i, s: F.struct(i.alias("item_id"), F.round(s, 6).alias("score")))


def bm25_scores(items: DataFrame, tasks: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """(task_id, item_id, score) for every candidate of every task; 0 where no question token occurs.

    Each task is scored within its row, in Arrow batches. The mean idf of all tokens is needed, and made, only
    where a question token stands in more than half of the candidates.
    """
    return flat(bm25_within(task_rows(items, tasks), config), "scored", "item_id", "task_id")


def bm25_within(rows: DataFrame, config: Bm25Config = Bm25Config()) -> DataFrame:
    """Task rows with scored, an array of (item_id, score) in the order of the candidates, in the place of asked and items; other columns stay."""
    kept = [c for c in rows.columns if c not in ("asked", "items")]
    part = lambda name: F.transform("items", lambda i: i[name])
    rows = rows.select(*kept, "asked", part("item_id").alias("__own"), part("title").alias("__titles"), part("text").alias("__texts"))
    score = lambda asked, titles, texts: (within.bm25(asked, titles, texts, config.k1, config.b, config.epsilon),)
    rows = within.by_row(rows, ("asked", "__titles", "__texts"), {"__scores": "array<double>"}, score, ("asked", "__titles", "__texts"))
    return rows.select(*kept, scored_items("__own", "__scores").alias("scored"))


def hashed_within(rows: DataFrame) -> DataFrame:
    """Task rows with scored, as in ``bm25_within``: inner products of hashed token counts (``functions.text.hashed_vector``); other columns stay, asked and items too."""
    kept = rows.columns
    part = lambda name: F.transform("items", lambda i: i[name])
    rows = rows.select(*kept, part("item_id").alias("__own"), part("title").alias("__titles"), part("text").alias("__texts"))
    rows = within.by_row(rows, ("asked", "__titles", "__texts"), {"__scores": "array<double>"}, lambda *row: (within.hashed_products(*row),), ("__titles", "__texts"))
    return rows.select(*kept, scored_items("__own", "__scores").alias("scored"))
