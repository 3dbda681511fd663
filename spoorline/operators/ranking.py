"""Rankings, seed signals, dense inner products and retrieved subgraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK_ORDER = (F.desc, F.asc)


def ranked(scores: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """Add rank: score descending, then item id."""
    w = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc("item_id"))
    return scores.withColumn("rank", F.row_number().over(w).cast("int"))


def ranked_within(rows: DataFrame, column: str = "scored") -> DataFrame:
    """(task_id, item_id, score, rank) of rows of (task_id, array of (item_id, score)): the same order without an exchange."""
    order = F.sort_array(F.transform(column, lambda i: F.struct((-i["score"]).alias("s"), i["item_id"].alias("i"))))
    placed = rows.select("task_id", F.posexplode_outer(order).alias("at", "x")).where("at is not null")  # outer for the reason in task_rows.flat
    return placed.select("task_id", F.col("x.i").alias("item_id"), (-F.col("x.s")).alias("score"), (F.col("at") + 1).alias("rank"))


def top_k(scores: DataFrame, k: int, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    return ranked(scores, keys).where(F.col("rank") <= k)


def seed_signals(scores: DataFrame) -> DataFrame:
    """Add rank and rank percentile (0 for the first, 1 for the last, 0 if alone)."""
    w = W.partitionBy("task_id").orderBy(F.desc("score"), F.asc("item_id"))
    return scores.withColumns({"rank": F.row_number().over(w).cast("int"), "percentile": F.round(F.percent_rank().over(w), 6)})


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dense_scores(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(task_id, item_id, score) by inner product, from queries(task_id, q_vec) and passages(task_id, item_id, vec)."""
    return passages.join(queries, "task_id").select("task_id", "item_id", F.round(inner_product(F.col("vec"), F.col("q_vec")), 6).alias("score"))


def retrieved_subgraph(edges: DataFrame, rankings: DataFrame, k: int) -> DataFrame:
    """Edges with both ends among the first k of their task (the question never is)."""
    top = rankings.where(F.col("rank") <= k).select("task_id", "item_id")
    left = top.withColumnRenamed("item_id", "source")
    right = top.withColumnRenamed("item_id", "target")
    return edges.join(left, ["task_id", "source"], "left_semi").join(right, ["task_id", "target"], "left_semi").select(edges.columns)
