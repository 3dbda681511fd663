"""Wide metric tables, optional means, and runs whose completeness is observed."""

import pytest
from pyspark.sql import functions as F

from spoorline.operators import evaluate, execution, graph, lexical, memory, rerank, tables
from spoorline.operators.task_rows import task_rows


@pytest.fixture(scope="module")
def wide(spark):
    flat = spark.createDataFrame([("bm25", 0.5, 0.4)], "method string, recall_5 double, mrr double")
    graphs = spark.createDataFrame([("bm25_graph_rerank", 0.6, 0.3, 0.25)], "method string, recall_5 double, mrr double, path_recall_10 double")
    return tables.side_by_side({"a": flat, "b": graphs, "named": flat.drop("method").withColumn("avg_edges", F.lit(3.0))})


def test_unequal_tables_keep_nulls(wide):
    rows = {r.method: r for r in wide.collect()}
    assert set(rows) == {"bm25", "bm25_graph_rerank", "named"} and rows["bm25"].path_recall_10 is None and rows["named"].avg_edges == 3.0
    path = {r.method: r.path_recall_10 for r in tables.report(wide, "path").collect()}
    assert path == {"bm25": None, "bm25_graph_rerank": 0.25, "named": None}
    shown = {r.method: (r.path_recall_10, r.recall_5) for r in tables.rendered(wide.select("method", "path_recall_10", "recall_5")).collect()}
    assert shown["bm25"] == ("N/A", "0.5000") and shown["bm25_graph_rerank"] == ("0.2500", "0.6000")
    with pytest.raises(ValueError):
        tables.report(wide, "other")


def test_tables_turned_over_and_compared(wide):
    turned = {r.metric: (r["bm25"], r["bm25_graph_rerank"]) for r in tables.by_metric(wide, ["bm25", "bm25_graph_rerank"]).collect()}
    assert turned["mrr"] == (0.4, 0.3) and turned["path_recall_10"] == (None, 0.25)
    changes = {(r.method, r.metric): r.change for r in tables.differences(wide, "bm25").collect()}
    assert changes[("bm25_graph_rerank", "recall_5")] == 0.1 and ("bm25_graph_rerank", "path_recall_10") not in changes


def test_ablations_are_looked_up_by_name(spark):
    metrics = spark.createDataFrame([("r1", "x", 0.1), ("r2", "x", 0.2)], "run string, method string, mrr double")
    index = spark.createDataFrame([("rgcn", "full", "r2"), ("rgcn", "wo_graph", "r1"), ("rgcn", "lost", "r9")], "method string, ablation string, run string")
    got = tables.chosen(metrics, index, [("rgcn", "full"), ("rgcn", "wo_graph")]).orderBy("place").collect()
    assert [(r.ablation, r.mrr) for r in got] == [("full", 0.2), ("wo_graph", 0.1)]
    with pytest.raises(ValueError, match="not in the index.*other"):
        tables.chosen(metrics, index, [("rgcn", "other")])
    with pytest.raises(ValueError, match="r9"):
        tables.chosen(metrics, index, [("rgcn", "full"), ("rgcn", "lost")])


def test_means_over_nothing(spark):
    rows = spark.createDataFrame([("a", "t", None, None), ("b", "t", 1.0, 0.5)], "method string, task_id string, mrr double, path double")
    got = {r.method: (r.mrr, r.path) for r in evaluate.summary(rows, optional=("path",)).collect()}
    assert got == {"a": (0.0, None), "b": (1.0, 0.5)}


@pytest.fixture(scope="module")
def requests(spark):
    items = spark.createDataFrame([(t, f"m{k}", k, "Title", "Title", "g", k, f"River number {k} of {t}") for t in ("t1", "t2", "t3") for k in range(4)], "task_id string, item_id string, position int, title string, source_ref string, group_key string, sequence_index int, text string")
    tasks = spark.createDataFrame([(t, "Which River is it?") for t in ("t1", "t2", "t3")], "task_id string, question string")
    return task_rows(items, tasks), items, tasks


def test_runs_count_and_rank_everything(requests):
    rows, items, _ = requests
    run = execution.execute("bm25", rows, lexical.bm25_within)
    assert run.counts == {"tasks": 3, "candidates": 12, "ranked": 3, "scored_items": 12, "without_graph": 0, "without_question": 0, "not_covered": 0, "bad_scores": 0}
    assert run.rankings.count() == 3 and run.latency_ms > 0 and run.record().first().ranked == 3


def test_missing_graphs_and_lost_candidates_raise(requests):
    rows, items, _ = requests
    graphs = graph.with_edges(rows, rules=("sequential",)).select("task_id", "edges")
    rank = lambda r: rerank.rerank_rows(lexical.bm25_within(r))
    assert execution.execute("g", execution.joined_requests(rows, graphs), rank, needs_graph=True).counts["without_graph"] == 0
    holed = execution.joined_requests(rows, graphs.where("task_id <> 't2'"))
    with pytest.raises(execution.Incomplete, match="1 tasks without a graph"):
        execution.execute("g", holed, rank, needs_graph=True)
    assert execution.execute("g", holed, rank, needs_graph=True, strict=False).counts["without_graph"] == 1
    with pytest.raises(execution.Incomplete, match="1 tasks without a ranking"):
        execution.execute("few", rows, lambda r: lexical.bm25_within(r.where("task_id <> 't1'")))
    with pytest.raises(execution.Incomplete, match="aren't each ranked once"):
        execution.execute("twice", rows, lambda r: lexical.bm25_within(r).withColumn("scored", F.transform("scored", lambda s: F.struct(F.lit("m0").alias("item_id"), s["score"].alias("score")))))
    with pytest.raises(execution.Incomplete, match="no finite numbers"):
        execution.execute("nan", rows, lambda r: lexical.bm25_within(r).withColumn("scored", F.transform("scored", lambda s: F.struct(s["item_id"].alias("item_id"), F.lit(float("nan")).alias("score")))))


def test_completeness_needs_no_second_scan(requests):
    rows = requests[0]
    plan = lexical.bm25_within(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 2  # items and tasks, once each


def test_alignment_names_the_tasks(spark):
    one = spark.createDataFrame([("a",), ("b",)], "task_id string")
    execution.aligned(one, one, one)
    with pytest.raises(execution.Incomplete, match="b has no graph"):
        execution.aligned(one, one, one.where("task_id = 'a'"))
    with pytest.raises(execution.Incomplete, match="c has no prediction, graph"):
        execution.aligned(one, one.unionByName(spark.createDataFrame([("c",)], "task_id string")), one)


def test_given_edges_come_first(spark, requests):
    _, items, tasks = requests
    given = spark.createDataFrame([("t1", "m1", "m0", "sequential", 7.0, False), ("t1", "m0", "m3", "bridge", 2.0, False)], "task_id string, source string, target string, edge_type string, weight double, directed boolean")
    got = {(r.source, r.target, r.edge_type): r.weight for r in graph.build_graph(items, tasks, rules=("sequential",), given=given).where("task_id = 't1'").collect()}
    assert got == {("m1", "m0", "sequential"): 7.0, ("m0", "m3", "bridge"): 2.0, ("m1", "m2", "sequential"): 1.0, ("m2", "m3", "sequential"): 1.0}


def test_order_violations_are_found(spark):
    rows = spark.createDataFrame([("t", "m0", 1.0, 3), ("t", "m1", 2.0, 2), ("t", "m2", 2.0, 4), ("u", "m0", 1.0, 5)], "task_id string, item_id string, raw double, score int")
    assert memory.order_violations(rows).count() > 0
    assert memory.order_violations(rows.where("task_id = 'u' or item_id = 'm0'")).count() == 0
