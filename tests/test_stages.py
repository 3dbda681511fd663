"""Graphs of stages: order, resuming, staleness, checks of inputs, running at once and cancelling."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from spoorline.stages import Stage, StageFailed, StageGraph


def graph_of(spark, folder, ran, **changes):
    def noted(name, make):
        def run(session, tables):
            ran.append(name)
            return make(session, tables)

        return run

    numbers = noted("numbers", lambda s, t: s.range(changes.get("n", 10)))
    double = noted("double", lambda s, t: t["numbers"].select((F.col("id") * 2).alias("id")))
    square = noted("square", changes.get("square") or (lambda s, t: t["numbers"].select((F.col("id") * F.col("id")).alias("id"))))
    total = noted("total", lambda s, t: t["double"].unionByName(t["square"]).agg(F.sum("id").alias("total")))
    return StageGraph(spark, str(folder), [
        Stage("total", total, {"double": "id bigint", "square": "id bigint"}), Stage("numbers", numbers, config={"n": changes.get("n", 10)}),
        Stage("double", double, {"numbers": ""}), Stage("square", square, {"numbers": changes.get("reads", "id bigint")}, config={"v": changes.get("v", 1)}),
    ])


def test_runs_resumes_and_goes_stale(spark, tmp_path):
    ran = []
    graph = graph_of(spark, tmp_path, ran)
    assert set(graph.status().values()) == {"missing"} and graph.plan(["double"]) == ["numbers", "double"]
    ended = graph.run()
    assert ended[0] == "numbers" and ended[-1] == "total" and set(ended) == {"numbers", "double", "square", "total"}
    assert graph.table("total").first().total == 90 + 285 and graph.run() == [] and graph.summary("numbers")["rows"] == 10
    changed = graph_of(spark, tmp_path, ran, v=2)
    assert changed.status() == {"numbers": "complete", "double": "complete", "square": "stale", "total": "stale"}
    ran.clear()
    assert changed.run() == ["square", "total"] and ran == ["square", "total"]


def test_a_failed_stage_runs_again(spark, tmp_path):
    ran = []

    def broken(session, tables):
        raise ArithmeticError("no squares today")

    with pytest.raises(StageFailed, match="square") as caught:
        graph_of(spark, tmp_path, ran, square=broken).run(at_once=1)
    assert isinstance(caught.value.__cause__, ArithmeticError)
    graph = graph_of(spark, tmp_path, ran)
    status = graph.status()
    assert status["numbers"] == "complete" and status["square"] == "failed" and status["total"] == "missing" and "no squares" in graph.summary("square")["error"]
    ran.clear()
    graph.run()
    assert "numbers" not in ran and graph.table("total").first().total == 375


def test_columns_that_are_not_there_fail_before_the_stage_runs(spark, tmp_path):
    ran = []
    with pytest.raises(StageFailed) as caught:
        graph_of(spark, tmp_path, ran, reads="id string").run()
    assert isinstance(caught.value.__cause__, TypeError) and "square" not in ran


def test_independent_stages_run_at_once_and_are_cancelled(spark, tmp_path):
    meet = threading.Barrier(2, timeout=60)

    def one(session, tables):
        meet.wait()
        return session.range(3)

    graph = StageGraph(spark, str(tmp_path / "a"), [Stage("left", one), Stage("right", one)])
    assert set(graph.run(at_once=2)) == {"left", "right"}

    def slow(session, tables):
        @F.udf("long")
        def nap(x):
            time.sleep(60)
            return x

        meet.wait()
        return session.range(1).select(nap("id").alias("id"))

    def breaks(session, tables):
        meet.wait()
        time.sleep(4)
        raise ValueError("over")

    graph = StageGraph(spark, str(tmp_path / "b"), [Stage("slow", slow), Stage("breaks", breaks)])
    began = time.time()
    with pytest.raises(StageFailed, match="breaks"):
        graph.run(at_once=2)
    assert time.time() - began < 50 and graph.status() == {"slow": "failed", "breaks": "failed"}


def test_bad_graphs(spark, tmp_path):
    make = lambda s, t: s.range(1)
    for stages, fault in (([Stage("a", make), Stage("a", make)], "same name"), ([Stage("a", make, {"b": ""})], "aren't there"), ([Stage("a", make, {"b": ""}), Stage("b", make, {"a": ""})], "wait for each other")):
        with pytest.raises(ValueError, match=fault):
            StageGraph(spark, str(tmp_path), stages)
    with pytest.raises(ValueError, match="unknown stage"):
        StageGraph(spark, str(tmp_path), [Stage("a", make)]).plan(["z"])


def test_experiment_from_the_command_line(spark, tmp_path, capsys):
    from spoorline.plans import experiment

    data = tmp_path / "data"
    rows = [(k, f"Asks about River {k}. First sentence of River {k}. Second one. Gold sentence here. Last one\nOther line. More of it") for k in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{data}/documents.parquet")
    args = ["--data", str(data), "--folder", str(tmp_path / "x"), "--methods", "bm25_graph_rerank"]
    assert experiment.main(["plan", *args], spark) == 0
    plan = capsys.readouterr().out.split()
    assert plan[0] == "tasks" and plan[-1] == "table" and {"bm25", "graphs", "bm25_graph_rerank"} < set(plan)
    experiment.main(["run", *args], spark)
    assert set(capsys.readouterr().out.split()) == set(plan)
    experiment.main(["status", *args], spark)
    assert set(capsys.readouterr().out.split()[1::2]) == {"complete"}
    experiment.main(["table", *args], spark)
    assert "bm25_graph_rerank" in capsys.readouterr().out
    spark.createDataFrame([(9, "One more. Text here. Third")], "doc_id long, text string").write.mode("append").parquet(f"{data}/documents.parquet")
    experiment.main(["plan", *args], spark)
    assert capsys.readouterr().out.split()[0] == "tasks"
    with pytest.raises(ValueError, match="can't run"):
        experiment.main(["plan", "--data", str(data), "--folder", str(tmp_path / "y"), "--methods", "dense_ft"], spark)
