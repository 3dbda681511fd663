"""Strict reading of records, both generations of fields, preparation by importance, and order without one task."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spoorline.functions import text as T
from spoorline.sources import canonical, records, splits, strict_records
from spoorline.sources.strict_records import accepted, fields_of, read_records, reasons, row_of_line, rows_of_array

GOOD = {
    "_id": "a", "question": "Who?", "answer": "She", "type": "bridge", "context": [["T", ["One. ", "Two"]], ["U", ["Three"]]],
    "supporting_facts": [["T", 1], ["U", 0]], "evidences": [["T", "leads to", "U"], ["U", "is", "V"]], "evidences_id": None, "answer_id": None,
}


def told(record, triples=True):
    return row_of_line("f", 0, record if isinstance(record, str) else json.dumps(record), triples)["error"]


@pytest.mark.parametrize(
    "change,reason",
    [
        ({}, None), ({"_id": ""}, "id"), ({"_id": 3}, "id"), ({"question": None}, "question"), ({"answer": ""}, "answer"), ({"type": ""}, "type"), ({"more": 1}, "unknown_field"),
        ({"context": {}}, "context"), ({"context": [["T"]]}, "document"), ({"context": [["", ["x"]]]}, "document"), ({"context": [["T", []]]}, "sentences"), ({"context": [["T", [1]]]}, "sentences"),
        ({"supporting_facts": None}, "supporting_facts"), ({"supporting_facts": [["T", True]]}, "fact"), ({"supporting_facts": [["T", "0"]]}, "fact"), ({"evidences": None}, "evidences"),
        ({"evidences": [["a", "b"]]}, "triple"), ({"evidences_id": [["a", "b", ""]]}, "triple"), ({"answer_id": ""}, "answer_id"),
    ],
)
def test_reasons_of_bad_fields(change, reason):
    assert told(GOOD | change) == reason


def test_json_itself():
    assert told("{") == "json" and told('{"a":1} x') == "json" and told("[1]") == "record" and told("nul") == "json"
    text = json.dumps(GOOD)
    assert told(text[:-1] + ',"_id":"b"}') == "repeated_key"
    assert told('{"_id":"a","x":{"y":1,"y":2}}') == "repeated_key"
    assert fields_of(GOOD | {"evidences_id": [["1", "2", "3"]]}, True)["evidences"] == [["1", "2", "3"]]
    plain = {k: GOOD[k] for k in strict_records.HOTPOT_FIELDS}
    assert told(plain | {"answer": "", "other": 1}, triples=False) is None


def test_arrays_go_on_after_bad_records_until_the_text_breaks():
    bad = '{"_id":"a","_id":"b"}'
    text = f" [ {json.dumps(GOOD)} , {bad},{json.dumps(GOOD)}, nonsense ]"
    rows = list(rows_of_array("f", text, True))
    assert [(r["place"], r["error"]) for r in rows] == [(0, None), (1, "repeated_key"), (2, None), (3, "json")]
    assert rows[1]["raw"] == bad and rows[3]["raw"].startswith("nonsense")
    assert list(rows_of_array("f", "[]", True)) == [] and [r["error"] for r in rows_of_array("f", '{"a":1}', True)] == ["record"]


def test_source_reads_ranges_of_lines_and_arrays(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    lines = [json.dumps(GOOD | {"_id": f"r{k}", "question": "é" * rng.randrange(1, 60)}, ensure_ascii=False) for k in range(300)]
    lines[7], lines[9] = lines[7][:-2], lines[9][:-1] + ',"_id":"x"}'
    (tmp_path / "part-0.jsonl").write_text("\n".join(lines[:200]) + "\n\n", encoding="utf-8")
    (tmp_path / "part-1.json").write_text("[" + ",\n".join(lines[200:]) + "]", encoding="utf-8")
    (tmp_path / "_SUCCESS").write_text("")
    rows = read_records(spark, str(tmp_path), "twowiki")
    assert rows.count() == 300 and {r.error: r.n for r in reasons(rows).collect()} == {"json": 1, "repeated_key": 1}
    monkeypatch.setattr(strict_records, "RANGE", 1000)
    reader = strict_records.StrictReader(str(tmp_path), "twowiki")
    parts = reader.partitions()
    again = [r for p in parts for r in reader.rows(p)]
    assert len(parts) > 50 and sorted(r["raw_id"] or "" for r in again) == sorted(r.raw_id or "" for r in rows.collect())
    assert accepted(rows).count() == 298
    with pytest.raises(ValueError, match="part-0"):
        accepted(rows, strict=True)
    assert accepted(rows.where("error is null"), strict=True).count() == 298
    with pytest.raises(Exception, match="unknown data set"):
        read_records(spark, str(tmp_path), "other").count()


def test_second_gate_and_conversion(spark, tmp_path):
    changes = [{}, {"supporting_facts": [["T", 9]]}, {"supporting_facts": []}, {"question": "  "}, {"context": [["T", ["a", " "]], ["U", ["b"]]]}]
    (tmp_path / "x.jsonl").write_text("\n".join(json.dumps(GOOD | c | {"_id": f"k{n}"}) for n, c in enumerate(changes)))
    rows = read_records(spark, str(tmp_path), "twowiki")
    assert {r.raw_id: r.error for r in rows.collect()} == {"k0": None, "k1": "unmapped_fact", "k2": "no_facts", "k3": "blank_question", "k4": "blank_sentence"}
    _, items, gold = records.converted(rows)
    assert [(r.item_id, r.ord) for r in gold.orderBy("ord").collect()] == [("m1", 0), ("m2", 1)]
    assert [tuple(r) for r in records.dependency_edges(rows, items, gold).collect()] == [("2wiki_k0", "m1", "m2")]
    assert [tuple(r) for r in records.mapping_ambiguity(rows, items, gold).collect()] == [("2wiki_k0", 0)]


def test_support_reads_parts_of_titles(spark):
    score = lambda *x: spark.range(1).select(T.support_score(*map(F.lit, x)).alias("s")).first().s
    assert score("The Old Bridge (film)", "A text", "old bridge", "by", "film") == 8 + 2
    assert score("X", "Old Bridge was made by Ann", "old  bridge", "made by", "ANN") == 4 + 2 + 1


def test_both_generations_of_records(spark):
    new = {"task_id": "a", "question": "Q", "candidate_sentences": [{"sentence_id": "m0", "title": "T", "sentence_index": 0, "position": 0, "text": "x"}]}
    old = {"task_id": "b", "query": "R", "memory_items": [{"id": "m0", "source": "U", "sentence_id": 4, "position": 0, "text": "y", "node_type": "document_sentence"}]}
    other = {"task_id": "c", "query": "R", "memory_items": [{"id": "m0", "source": "U", "sentence_id": 4, "position": 0, "text": "y", "node_type": "thought"}]}
    rows = [new, old, other, {"task_id": "d", "question": "Q"}, {"task_id": "e", "question": "Q", "candidate_sentences": [{"sentence_id": "m0", "title": "", "sentence_index": 0, "position": 0, "text": "x"}]}]
    raw = spark.read.schema(canonical.RANKING_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))
    got = canonical.coerced_rankings(raw)
    assert {r.task_id: r.error for r in got.collect()} == {"a": None, "b": None, "c": "node_type", "d": "candidate_sentences", "e": "sentence"}
    items = {r.task_id: r for r in canonical.items_of(got).collect()}
    assert items["b"].title == "U" and items["b"].sequence_index == 4 and items["b"].group_key == "document:U" and set(items) == {"a", "b"}
    labels = [{"task_id": "a", "gold_answer": "A", "gold_evidence_sentence_ids": ["m0", "m0"], "gold_dependency_edges": [["m0", "m1"]]}, {"task_id": "b", "gold_answer": "B", "gold_evidence_nodes": ["m0"]}, {"task_id": "c", "gold_answer": "C", "gold_evidence_nodes": [], "gold_dependency_edges": [["m0"]]}]
    told = canonical.coerced_labels(spark.read.schema(canonical.LABEL_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(r) for r in labels])))
    assert {r.task_id: r.error for r in told.collect()} == {"a": None, "b": None, "c": "gold_dependency_edges"}
    gold, edges = canonical.evaluation_labels(told)
    assert sorted(map(tuple, gold.collect())) == [("a", "m0", 0), ("b", "m0", 0)] and [tuple(r) for r in edges.collect()] == [("a", "m0", "m1")]
    both = canonical.combined(got.where("task_id in ('a', 'b')"), told)
    assert both.count() == 2 and "gold_answer" in both.columns
    with pytest.raises(ValueError, match="'d'"):
        canonical.combined(got, told)


@pytest.fixture(scope="module")
def prepared(spark):
    items = spark.createDataFrame([(f"t{t}", f"m{k}", k, "T", "T", f"text {t} {k}") for t in range(12) for k in range(3)], "task_id string, item_id string, position int, title string, source_ref string, text string")
    tasks = items.select("task_id").distinct()
    order = canonical.importance_tasks(items.select("task_id", "item_id", F.lit(5).alias("score")), items)
    return items, tasks, order, items.where("position = 0").select("task_id", "item_id")


def test_preparation_by_importance(prepared):
    items, tasks, order, gold = prepared
    got = canonical.prepared_by_importance(order, tasks, items, gold, 2, 3).orderBy("task_ord").collect()
    assert [tuple(r) for r in got] == [("t10", 2), ("t11", 3), ("t2", 4)]
    assert canonical.prepared_by_importance(order, tasks, items, gold).count() == 12
    for changed, fault in (
        (order.withColumn("digest", F.lit("x")), "digest"), (order.withColumn("scores", F.slice("scores", 1, 2)), "coverage"), (order.withColumn("scores", F.reverse("scores")), "coverage"),
        (order.withColumn("scores", F.transform("scores", lambda s: F.struct(s["item_id"].alias("item_id"), F.lit(11).alias("score")))), "score"),
    ):
        with pytest.raises(ValueError, match=fault):
            canonical.prepared_by_importance(changed, tasks, items, gold)
    with pytest.raises(ValueError, match="labels"):
        canonical.prepared_by_importance(order, tasks, items, gold.where("task_id <> 't3'"))
    with pytest.raises(ValueError, match="input"):
        canonical.prepared_by_importance(order, tasks.where("task_id <> 't3'"), items, gold)
    for offset, count in ((-1, 2), (11, 2), (3, None)):
        with pytest.raises(ValueError):
            canonical.prepared_by_importance(order, tasks, items, gold, offset, count)


def test_requests_tell_what_is_missing(spark, prepared):
    items = prepared[0].where("task_id < 't2'")
    edges = spark.createDataFrame([("t0", "m0", "m1", "bridge", 1.0, False), ("t1", "m0", "m1", "bridge", 1.0, False)], "task_id string, source string, target string, edge_type string, weight double, directed boolean")
    scores = items.select("task_id", "item_id", F.lit(1.0).alias("score")).where("not (task_id = 't1' and item_id = 'm2')")
    got = {r.task_id: r for r in canonical.graph_requests(items, edges, scores).collect()}
    assert got["t0"].error is None and len(got["t0"].candidates) == 3 and got["t1"].error == "score" and got["t10"].error == "graph"
    temporal = canonical.temporal_requests(items, items.where("item_id = 'm0'").select("task_id", "item_id", F.lit(3).alias("score")))
    assert {(r.item_id, r.importance) for r in temporal.collect()} == {("m0", 3.0), ("m1", None), ("m2", None)}
    assert {r.importance for r in canonical.temporal_requests(items).collect()} == {None}


def test_places_without_one_task(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(5) if rng.random() < 0.9 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "id int, x int").repartition(7)
    got = {r.id: r.place for r in splits.with_place(df, ["x", "id"]).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert [got[k] for k, _ in want] == list(range(500))
    cut = splits.ordered_slice(df, ["x", "id"], 100, 20)
    assert {r.id for r in cut.collect()} == {k for k, _ in want[100:120]}
    plan = splits.with_place(df, ["id"])._jdf.queryExecution().toString()
    assert "Window" not in plan
    with pytest.raises(ValueError):
        splits.ordered_slice(df, ["id"], 490, 20)
    assert splits.with_place(df.limit(0), ["id"]).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutations(spark, n):
    rows = spark.range(n).select("id", splits.permuted(F.col("id"), n, 3).alias("a"), splits.permuted(F.col("id"), n, 4).alias("b")).collect()
    assert sorted(r.a for r in rows) == list(range(n)) == sorted(r.b for r in rows)
    if n > 90:
        assert [r.a for r in rows] != [r.b for r in rows] and sum(r.a == r.id for r in rows) < n / 10


def test_permuted_split_has_exact_counts(spark):
    got = splits.permuted_split(spark.range(50), ["id"], 1, {"train": 30, "dev": 15}).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in got} == {"train": 30, "dev": 15}
    with pytest.raises(ValueError):
        splits.permuted_split(spark.range(5), ["id"], 1, {"train": 6})
