"""Canonical records: older field names, labels joined to inputs, projections, and preparation by importance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_digest, node_number
from .splits import with_place

# Fixed field names of the two generations of ranking and label records.
SENTENCE = "struct<sentence_id:string,title:string,sentence_index:int,position:int,text:string>"
MEMORY_ITEM = "struct<id:string,source:string,sentence_id:int,position:int,text:string,node_type:string>"
RANKING_SCHEMA = f"task_id string, question string, candidate_sentences array<{SENTENCE}>, query string, memory_items array<{MEMORY_ITEM}>"
LABEL_SCHEMA = "task_id string, gold_answer string, gold_evidence_sentence_ids array<string>, gold_dependency_edges array<array<string>>, gold_evidence_nodes array<string>"


def coerced_rankings(records: DataFrame) -> DataFrame:
    """(task_id, question, candidate_sentences, error): records of either generation; newer fields win where both stand."""
    old = F.col("candidate_sentences").isNull() & F.col("query").isNotNull() & F.col("memory_items").isNotNull()
    moved = F.transform(
        "memory_items",
        lambda m: F.struct(m["id"].alias("sentence_id"), m["source"].alias("title"), m["sentence_id"].alias("sentence_index"), m["position"].alias("position"), m["text"].alias("text")),
    )
    blank = lambda c: c.isNull() | (c == "")
    part = lambda s: blank(s["sentence_id"]) | blank(s["title"]) | s["sentence_index"].isNull() | s["position"].isNull() | blank(s["text"])
    out = records.select(
        "task_id", F.when(old, F.col("query")).otherwise(F.col("question")).alias("question"), F.when(old, moved).otherwise(F.col("candidate_sentences")).alias("candidate_sentences"),
        F.when(old & F.exists("memory_items", lambda m: ~m["node_type"].eqNullSafe(F.lit("document_sentence"))), "node_type").alias("error"),
    )
    fault = F.when(blank(F.col("task_id")), "task_id").when(blank(F.col("question")), "question").when(F.col("candidate_sentences").isNull(), "candidate_sentences").when(F.exists("candidate_sentences", part), "sentence")
    return out.withColumn("error", F.coalesce("error", fault))


def coerced_labels(records: DataFrame) -> DataFrame:
    """(task_id, gold_answer, gold_evidence_sentence_ids, gold_dependency_edges, error) of either generation."""
    edges = F.coalesce("gold_dependency_edges", F.array().cast("array<array<string>>"))
    out = records.select("task_id", "gold_answer", F.coalesce("gold_evidence_sentence_ids", "gold_evidence_nodes").alias("gold_evidence_sentence_ids"), edges.alias("gold_dependency_edges"))
    fault = (
        F.when(F.col("task_id").isNull() | (F.col("task_id") == ""), "task_id")
        .when(F.col("gold_answer").isNull() | (F.col("gold_answer") == ""), "gold_answer")
        .when(F.col("gold_evidence_sentence_ids").isNull(), "gold_evidence_sentence_ids")
        .when(F.exists("gold_dependency_edges", lambda e: F.size(e) != 2), "gold_dependency_edges")
    )
    return out.withColumn("error", fault)


def combined(rankings: DataFrame, labels: DataFrame) -> DataFrame:
    """Inputs with their labels for inspection; an input without labels raises."""
    own = labels.drop("error")
    if missing := rankings.join(own, "task_id", "left_anti").select("task_id").orderBy("task_id").take(3):
        raise ValueError(f"labels are missing for {[r.task_id for r in missing]}")
    return rankings.drop("error").join(own, "task_id")


def items_of(rankings: DataFrame) -> DataFrame:
    """The items table of good ranking records."""
    flat = rankings.where("error is null").select("task_id", F.inline("candidate_sentences"))
    return flat.select(
        "task_id", F.col("sentence_id").alias("item_id"), "position", "title", F.col("title").alias("source_ref"), F.concat(F.lit("document:"), "title").alias("group_key"),
        F.col("sentence_index").alias("sequence_index"), "text",
    )


def temporal_requests(items: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """(task_id, item_id, position, memory_text, importance): texts without titles; importance is null where none is known."""
    rows = items.select("task_id", "item_id", "position", F.col("text").alias("memory_text"))
    if importance is None:
        return rows.withColumn("importance", F.lit(None).cast("double"))
    return rows.join(importance.select("task_id", "item_id", F.col("score").cast("double").alias("importance")), ["task_id", "item_id"], "left")


def graph_requests(items: DataFrame, edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(task_id, candidates, edges): a task's scored candidates with its graph, one row each; every candidate must have a score."""
    told = items.join(scores.select("task_id", "item_id", "score"), ["task_id", "item_id"], "left")
    rows = told.groupBy("task_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "item_id", F.concat_ws(". ", "title", "text").alias("ranking_text"), "score"))).alias("candidates"),
        F.count(F.when(F.col("score").isNull(), 1)).alias("unscored"),
    )
    drawn = edges.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("source", "target", "edge_type", "weight", "directed"))).alias("edges"))
    error = F.when(F.col("unscored") > 0, "score").when(F.col("edges").isNull(), "graph")
    return rows.join(drawn, "task_id", "left").withColumn("error", error).drop("unscored")


def evaluation_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gold(task_id, item_id, ord) and gold_edges(task_id, source, target) of good labels."""
    good = labels.where("error is null")
    gold = good.select("task_id", F.posexplode(F.array_distinct("gold_evidence_sentence_ids")).alias("ord", "item_id")).select("task_id", "item_id", "ord")
    pairs = good.select("task_id", F.explode("gold_dependency_edges").alias("e")).select("task_id", F.get("e", 0).alias("source"), F.get("e", 1).alias("target"))
    return gold, pairs.distinct()


def item_digests(items: DataFrame) -> DataFrame:
    """(task_id, digest) of items in their order."""
    entry = F.struct(F.col("item_id").alias("id"), "position", F.col("source_ref").alias("source"), "text")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", entry.alias("e")))), lambda x: x["e"])
    return items.groupBy("task_id").agg(content_digest(ordered).alias("digest"))


def importance_faults(importance: DataFrame, tasks: DataFrame, items: DataFrame, gold: DataFrame) -> DataFrame:
    """(task_id, error) of tasks of importance(task_id, task_ord, digest, scores array<struct<item_id,score>>) that can't be prepared.

    missing input, missing labels, another digest, items that aren't exactly
    covered in order, and scores that are no whole numbers from 1 to 10.
    """
    own = items.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "item_id"))), lambda x: x["item_id"]).alias("ids"))
    rows = importance.join(tasks.select("task_id", F.lit(True).alias("asked")), "task_id", "left").join(gold.select("task_id").distinct().withColumn("labelled", F.lit(True)), "task_id", "left")
    rows = rows.join(own, "task_id", "left").join(item_digests(items).withColumnRenamed("digest", "own_digest"), "task_id", "left")
    error = (
        F.when(F.col("asked").isNull(), "input")
        .when(F.col("labelled").isNull(), "labels")
        .when(~F.col("digest").eqNullSafe(F.col("own_digest")), "digest")
        .when(~F.transform("scores", lambda s: s["item_id"]).eqNullSafe(F.col("ids")), "coverage")
        .when(F.exists("scores", lambda s: s["score"].isNull() | (s["score"] < 1) | (s["score"] > 10) | (s["score"] != F.floor(s["score"]))), "score")
    )
    return rows.select("task_id", error.alias("error")).where("error is not null")


def prepared_by_importance(importance: DataFrame, tasks: DataFrame, items: DataFrame, gold: DataFrame, offset: int = 0, count: int | None = None) -> DataFrame:
    """(task_id, task_ord) of the tasks at places [offset, offset + count) of the importance order; a fault among them raises."""
    if offset < 0 or (count is not None and count < 0) or (count is None and offset):
        raise ValueError("offset and count must not be negative, and an offset needs a count")
    n = importance.count()
    if count is not None and offset + count > n:
        raise ValueError(f"asked for tasks {offset} to {offset + count} of {n}")
    chosen = importance if count is None else importance.where((F.col("task_ord") >= offset) & (F.col("task_ord") < offset + count))
    if bad := importance_faults(chosen, tasks, items, gold).orderBy("task_id").take(3):
        raise ValueError(f"tasks that can't be prepared: {[(r.task_id, r.error) for r in bad]}")
    return chosen.select("task_id", "task_ord")


def importance_tasks(scored: DataFrame, items: DataFrame) -> DataFrame:
    """importance(task_id, task_ord, digest, scores) from (task_id, item_id, score), in order of task id."""
    rows = scored.groupBy("task_id").agg(F.transform(F.sort_array(F.collect_list(F.struct(node_number("item_id").alias("n"), "item_id", "score"))), lambda s: F.struct(s["item_id"].alias("item_id"), s["score"].alias("score"))).alias("scores"))
    return with_place(rows, ["task_id"], "task_ord").join(item_digests(items), "task_id")
