"""Raw multi-hop QA records to tasks, items, gold items and gold edges.

Records hold a question, documents of sentences, supporting (title, index)
facts and, in the second shape, a type and evidence triples. A record with an
error has a reason and is dropped, counted, or raised by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import folded, support_score

#: Heterogeneous pairs are read as strings and parsed by position.
RAW_SCHEMA = "_id string, question string, answer string, context array<string>, supporting_facts array<string>"
RAW_TRIPLES_SCHEMA = RAW_SCHEMA + ", type string, evidences array<array<string>>, evidences_id array<array<string>>, answer_id string"
KNOWN_FIELDS = ("_id", "question", "answer", "context", "supporting_facts", "type", "evidences", "evidences_id", "answer_id")


def parsed(raw: DataFrame, prefix: str, triples: bool = False) -> DataFrame:
    """task_id, question, answer, documents, facts (and type, evidences), error (null if the record is good)."""
    documents = F.transform("context", lambda c: F.struct(F.get_json_object(c, "$[0]").alias("title"), F.from_json(F.get_json_object(c, "$[1]"), "array<string>").alias("sentences")))
    facts = F.transform("supporting_facts", lambda s: F.struct(F.get_json_object(s, "$[0]").alias("title"), F.get_json_object(s, "$[1]").cast("int").alias("index")))
    cols = [F.concat(F.lit(f"{prefix}_"), "_id").alias("task_id"), "question", "answer", documents.alias("documents"), facts.alias("facts")]
    if triples:
        chosen = F.when(F.size(F.coalesce("evidences_id", F.array())) > 0, F.col("evidences_id")).otherwise(F.col("evidences"))
        cols += [F.col("type").alias("question_type"), chosen.alias("evidences")]
    out = raw.select(*cols)
    empty: Column = F.exists("documents", lambda d: F.size(F.coalesce(d["sentences"], F.array())) == 0)
    error = (
        F.when(F.col("task_id").isNull(), "id")
        .when(F.col("question").isNull() | (F.trim("question") == ""), "question")
        .when(F.col("answer").isNull(), "answer")
        .when(F.col("documents").isNull() | (F.size("documents") == 0), "context")
        .when(F.exists("documents", lambda d: d["title"].isNull() | d["sentences"].isNull()), "document")
        .when(F.col("facts").isNull() | (F.size("facts") == 0), "supporting_facts")
        .when(F.exists("facts", lambda f: f["title"].isNull() | f["index"].isNull()), "fact")
    )
    if triples:
        error = F.coalesce(error, F.when(empty, "empty_document").when(F.exists(F.coalesce("evidences", F.array()), lambda e: F.size(e) != 3), "triple"))
    return out.withColumn("error", error)


def unknown_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """Add the names of fields that records may not have, from raw JSON text."""
    keys = F.map_keys(F.from_json(column, "map<string,string>"))
    return lines.withColumn("unknown", F.array_except(keys, F.array(*map(F.lit, KNOWN_FIELDS))))


def converted(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, items, gold) of good records; records whose facts name no sentence are left to ``unmapped``.

    Items are numbered through the documents in order. A (title, index) that
    occurs twice means its last sentence. Gold keeps the order of the facts,
    each sentence once.
    """
    good = records.where("error is null")
    flat = good.select("task_id", F.posexplode("documents").alias("doc_no", "d")).select("task_id", "doc_no", F.col("d.title").alias("title"), F.posexplode("d.sentences").alias("sentence_index", "text"))
    items = flat.withColumn("position", F.row_number().over(W.partitionBy("task_id").orderBy("doc_no", "sentence_index")) - 1)
    items = items.select(
        "task_id", F.concat(F.lit("m"), "position").alias("item_id"), "position", "title", F.col("title").alias("source_ref"),
        F.concat(F.lit("document:"), "title").alias("group_key"), F.col("sentence_index").alias("sequence_index"), "text",
    )
    place = items.groupBy("task_id", "title", F.col("sequence_index").alias("index")).agg(F.max("position").alias("position"))
    facts = good.select("task_id", F.posexplode("facts").alias("ord", "f")).select("task_id", "ord", "f.title", "f.index")
    named = facts.join(place, ["task_id", "title", "index"]).groupBy("task_id", "position").agg(F.min("ord").alias("first"))
    gold = named.select(
        "task_id", F.concat(F.lit("m"), "position").alias("item_id"), (F.row_number().over(W.partitionBy("task_id").orderBy("first")) - 1).cast("int").alias("ord")
    )
    tasks = good.select("task_id", "question", *(["question_type"] if "question_type" in good.columns else []))
    return tasks, items, gold


def unmapped(records: DataFrame, items: DataFrame) -> DataFrame:
    """(task_id, title, index) of facts that name no sentence."""
    facts = records.where("error is null").select("task_id", F.explode("facts").alias("f")).select("task_id", "f.title", F.col("f.index").alias("sequence_index"))
    return facts.join(items, ["task_id", "title", "sequence_index"], "left_anti")


def _triples(records: DataFrame) -> DataFrame:
    """(task_id, no, subject, relation, object) of good records."""
    triples = records.where("error is null").select("task_id", F.posexplode(F.coalesce("evidences", F.array())).alias("no", "e"))
    return triples.select("task_id", "no", F.get("e", 0).alias("subject"), F.get("e", 1).alias("relation"), F.get("e", 2).alias("object"))


def _supports(records: DataFrame, items: DataFrame, gold: DataFrame) -> DataFrame:
    """Triples with each gold sentence that supports them, and how well."""
    support = gold.join(items, ["task_id", "item_id"]).select("task_id", "item_id", "ord", "title", "text")
    score = support_score(F.col("title"), F.col("text"), F.col("subject"), F.col("relation"), F.col("object"))
    return _triples(records).join(support, "task_id").withColumn("score", score).where("score > 0")


def dependency_edges(records: DataFrame, items: DataFrame, gold: DataFrame) -> DataFrame:
    """(task_id, source, target): supports of consecutive triples where one's object is the next one's subject.

    A triple's support is its best scoring gold sentence, the earliest of equals.
    """
    triples = _triples(records)
    best = _supports(records, items, gold)
    w = W.partitionBy("task_id", "no").orderBy(F.desc("score"), "ord")
    best = best.withColumn("r", F.row_number().over(w)).where("r = 1").select("task_id", "no", "item_id")
    chain = triples.join(best, ["task_id", "no"], "left")
    step = W.partitionBy("task_id").orderBy("no")
    pairs = chain.select(
        "task_id", F.col("item_id").alias("source"), F.lead("item_id").over(step).alias("target"), (folded("object") == folded(F.lead("subject").over(step))).alias("linked"), "no"
    )
    return pairs.where("linked and source is not null and target is not null and source <> target").groupBy("task_id", "source", "target").agg(F.min("no").alias("no")).select("task_id", "source", "target")


def mapping_ambiguity(records: DataFrame, items: DataFrame, gold: DataFrame) -> DataFrame:
    """(task_id, ambiguity): over a task's triples, how many gold sentences support one as well as the chosen one does."""
    scored = _supports(records, items, gold)
    best = F.max("score").over(W.partitionBy("task_id", "no"))
    ties = scored.withColumn("best", best).where("score = best").groupBy("task_id", "no").agg((F.count(F.lit(1)) - 1).alias("more"))
    return ties.groupBy("task_id").agg(F.sum("more").alias("ambiguity"))


def invalid_reasons(records: DataFrame) -> DataFrame:
    return records.where("error is not null").groupBy("error").agg(F.count(F.lit(1)).alias("n"))
