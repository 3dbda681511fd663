"""Supervised pairs: positives, sampled negatives, and contrastive triples."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .graph import EDGE_TYPES, QUERY_NODE
from .ranking import ranked

SAMPLE_ORDER = ("positive", "easy_random", "hard_bm25", "hard_dense", "hard_graph_neighbor")
#: Negatives for triples are taken by this order of kinds.
PRIORITY = ("hard_dense", "hard_bm25", "hard_graph_neighbor", "easy_random")


def _wanted(gold: DataFrame, per_positive: int) -> DataFrame:
    return gold.groupBy("task_id").agg((F.count(F.lit(1)) * per_positive).alias("wanted"))


def _first(candidates: DataFrame, gold: DataFrame, per_positive: int, *order) -> DataFrame:
    """Of (task_id, item_id, ...) the first that are wanted for each task."""
    w = W.partitionBy("task_id").orderBy(*order)
    rows = candidates.withColumn("ord", F.row_number().over(w)).join(_wanted(gold, per_positive), "task_id")
    return rows.where(F.col("ord") <= F.col("wanted")).select("task_id", "item_id", "ord")


def easy_random(items: DataFrame, gold: DataFrame, per_positive: int, seed: str = "13") -> DataFrame:
    """Non-gold candidates in the order of a hash: a sample that does not depend on other tasks."""
    rest = items.select("task_id", "item_id").join(gold, ["task_id", "item_id"], "left_anti")
    return _first(rest, gold, per_positive, F.md5(F.concat_ws("|", F.lit(seed), "task_id", "item_id").cast("binary")), "item_id")


def hard_by_rank(scores: DataFrame, gold: DataFrame, per_positive: int, pool: int = 20) -> DataFrame:
    """Best ranked non-gold candidates from a pool of the first ``pool`` of them."""
    w = W.partitionBy("task_id").orderBy("rank")
    rest = ranked(scores).join(gold, ["task_id", "item_id"], "left_anti").withColumn("p", F.row_number().over(w)).where(F.col("p") <= pool)
    return _first(rest, gold, per_positive, "p")


def _edge_place(edges: DataFrame, items: DataFrame) -> DataFrame:
    """Add place, the order in which a graph's edges are made: by rule; sequential ones by group and sequence, others strongest first."""
    group = F.coalesce("group_key", "source_ref")
    first = F.min("position").over(W.partitionBy("task_id", group))
    where = items.select("task_id", F.col("item_id").alias("source"), F.struct(first.alias("g"), F.coalesce("sequence_index", F.lit(0)).alias("s"), "position").alias("at"))
    rule = F.array_position(F.array(*[F.lit(t) for t in EDGE_TYPES]), F.col("edge_type"))
    at = F.when(F.col("edge_type") == "sequential", F.col("at"))
    return edges.join(where, ["task_id", "source"]).withColumn("place", F.struct(rule.alias("rule"), at.alias("at"), (-F.col("weight")).alias("w"), "source", "target"))


def graph_neighbours(edges: DataFrame, items: DataFrame, gold: DataFrame, per_positive: int) -> DataFrame:
    """Non-gold neighbours of gold items in the order of the graph's edges, never the question."""
    placed = _edge_place(edges.where(F.col("source") != QUERY_NODE).where(F.col("target") != QUERY_NODE), items)
    ends = [placed.select("task_id", F.col(a).alias("near"), F.col(b).alias("item_id"), "place") for a, b in (("source", "target"), ("target", "source"))]
    near = ends[0].unionByName(ends[1]).join(gold.select("task_id", F.col("item_id").alias("near")), ["task_id", "near"], "left_semi")
    rest = near.join(gold, ["task_id", "item_id"], "left_anti").groupBy("task_id", "item_id").agg(F.min("place").alias("place"))
    return _first(rest, gold, per_positive, "place", "item_id")


def training_pairs(gold: DataFrame, negatives: Mapping[str, DataFrame]) -> DataFrame:
    """(task_id, item_id, label, sample_type, ord). The same item may come back under another kind."""
    out = gold.select("task_id", "item_id", F.lit(1).alias("label"), F.lit("positive").alias("sample_type"), (F.col("ord") + 1).alias("ord"))
    for kind, rows in negatives.items():
        out = out.unionByName(rows.select("task_id", "item_id", F.lit(0).alias("label"), F.lit(kind).alias("sample_type"), "ord"))
    return out.dropDuplicates(["task_id", "item_id", "sample_type"])


def pair_summary(pairs: DataFrame, tasks: DataFrame) -> DataFrame:
    """One row: positives, negatives by kind, and both per task."""
    n = tasks.agg(F.count(F.lit(1)).alias("n_tasks"))
    counts = pairs.agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("positives"), F.count(F.when(F.col("label") == 0, 1)).alias("negatives"),
        *[F.count(F.when(F.col("sample_type") == k, 1)).alias(f"n_{k}") for k in SAMPLE_ORDER[1:]],
    )
    rows = counts.join(n)  # one row each
    return rows.withColumns({f"{c}_per_task": F.round(F.try_divide(c, "n_tasks"), 6) for c in ("positives", "negatives")})


def contrastive_triples(pairs: DataFrame, negatives_per_task: int) -> DataFrame:
    """(task_id, positive, negative): a task's first negatives with each of its positives; null where it has none."""
    kind = F.lit(len(PRIORITY))
    for k, name in reversed(list(enumerate(PRIORITY))):
        kind = F.when(F.col("sample_type") == name, k).otherwise(kind)
    rest = pairs.where("label = 0").groupBy("task_id", "item_id").agg(F.min(F.struct(kind.alias("k"), F.col("ord").alias("o"))).alias("x"))
    w = W.partitionBy("task_id").orderBy("x.k", "x.o", "item_id")
    chosen = rest.withColumn("r", F.row_number().over(w)).where(F.col("r") <= negatives_per_task).select("task_id", F.col("item_id").alias("negative"))
    return pairs.where("label = 1").select("task_id", F.col("item_id").alias("positive")).join(chosen, "task_id", "left")
