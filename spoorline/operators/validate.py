"""Rules as violation queries: each gives (rule, task_id, item_id) rows, none for valid data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import EDGE_TYPES, QUERY_NODE

# Fixed names that must not occur in what a retrieval method reads.
LABEL_FIELDS = ("answer", "gold_answer", "gold_evidence_nodes", "gold_evidence_sentence_ids", "gold_dependency_edges", "label", "labels", "is_gold", "supporting_facts", "evidences")


def leaked_fields(schema: T.DataType, path: str = "") -> list[str]:
    """Paths of label fields anywhere in a schema."""
    if isinstance(schema, T.StructType):
        own = [f"{path}{f.name}" for f in schema.fields if f.name in LABEL_FIELDS]
        return own + [p for f in schema.fields for p in leaked_fields(f.dataType, f"{path}{f.name}.")]
    if isinstance(schema, T.ArrayType):
        return leaked_fields(schema.elementType, path)
    if isinstance(schema, T.MapType):
        return leaked_fields(schema.valueType, path)
    return []


def _rule(df: DataFrame, name: str) -> DataFrame:
    item = F.col("item_id") if "item_id" in df.columns else F.lit(None)
    return df.select(F.lit(name).alias("rule"), "task_id", item.cast("string").alias("item_id"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tasks on one side only."""
    a, b = left.select("task_id").distinct(), right.select("task_id").distinct()
    return _all([_rule(a.join(b, "task_id", "left_anti"), "missing"), _rule(b.join(a, "task_id", "left_anti"), "extra")])


def item_rules(items: DataFrame, tasks: DataFrame) -> DataFrame:
    counts = items.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("position").alias("d"), F.min("position").alias("lo"), F.max("position").alias("hi"))
    return _all(
        [
            _rule(items.where(F.col("item_id") != F.concat(F.lit("m"), F.col("position"))), "id_of_position"),
            _rule(items.where(F.col("text").isNull() | (F.trim("text") == "")), "empty_text"),
            _rule(counts.where("n <> d or lo <> 0 or hi <> n - 1"), "positions_contiguous"),
            _rule(items.join(tasks, "task_id", "left_anti"), "unknown_task"),
            _rule(tasks.where(F.col("question").isNull() | (F.trim("question") == "")), "empty_question"),
        ]
    )


def gold_rules(gold: DataFrame, items: DataFrame) -> DataFrame:
    twice = gold.groupBy("task_id", "item_id").count().where("count > 1")
    return _all([_rule(gold.join(items, ["task_id", "item_id"], "left_anti"), "gold_unknown"), _rule(twice, "gold_repeated")])


def graph_rules(edges: DataFrame, items: DataFrame) -> DataFrame:
    nodes = items.select("task_id", "item_id").unionByName(items.select("task_id").distinct().withColumn("item_id", F.lit(QUERY_NODE)))
    ends = edges.select("task_id", F.col("source").alias("item_id")).unionByName(edges.select("task_id", F.col("target").alias("item_id"))).distinct()
    by = edges.withColumn("item_id", F.col("source"))
    return _all(
        [
            _rule(ends.join(nodes, ["task_id", "item_id"], "left_anti"), "end_unknown"),
            _rule(by.where(~F.col("edge_type").isin(*EDGE_TYPES)), "edge_type"),
            _rule(by.where(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") < 0) | (F.col("weight") == float("inf"))), "weight"),
            _rule(by.where("source = target"), "self_loop"),
        ]
    )


def ranking_rules(rankings: DataFrame, items: DataFrame) -> DataFrame:
    w = W.partitionBy("task_id").orderBy("rank")
    falls = rankings.withColumn("before", F.lag("score").over(w)).where("before < score")
    twice = rankings.groupBy("task_id", "item_id").count().where("count > 1")
    keys = ["task_id", "item_id"]
    return _all(
        [
            _rule(items.join(rankings, keys, "left_anti"), "not_ranked"),
            _rule(rankings.join(items, keys, "left_anti"), "unknown_item"),
            _rule(twice, "ranked_twice"),
            _rule(falls, "order"),
            _rule(rankings.where(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))), "finite"),
        ]
    )


def importance_rules(importance: DataFrame, items: DataFrame) -> DataFrame:
    keys = ["task_id", "item_id"]
    return _all(
        [
            _rule(items.join(importance, keys, "left_anti"), "not_scored"),
            _rule(importance.join(items, keys, "left_anti"), "unknown_item"),
            _rule(importance.where("score is null or score < 1 or score > 10"), "range"),
        ]
    )


def pair_rules(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    keys = ["task_id", "item_id"]
    twice = pairs.groupBy(*keys, "sample_type").count().where("count > 1")
    return _all(
        [
            _rule(pairs.where(F.col("item_id") == QUERY_NODE), "question"),
            _rule(pairs.where("label = 1").join(gold, keys, "left_anti"), "false_positive"),
            _rule(pairs.where("label = 0").join(gold, keys, "left_semi"), "false_negative"),
            _rule(gold.join(pairs.where("label = 1"), keys, "left_anti"), "gold_missing"),
            _rule(twice, "repeated"),
        ]
    )


def metric_rules(metrics: DataFrame) -> DataFrame:
    names = [c for c in metrics.columns if c.startswith(("recall", "f1", "full", "mrr", "connected", "query_connected", "edge_recall", "path_recall"))]
    bad = reduce(lambda a, b: a | b, [(F.col(c) < 0) | (F.col(c) > 1) for c in names])
    return _rule(metrics.where(bad), "range")


def violation_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(check, n): one row per check, 0 where nothing is wrong."""
    return _all([df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n") for name, df in parts.items()])
