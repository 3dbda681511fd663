"""Evaluation and training at size: what belongs to a task stays in its row."""

import numpy as np
import pytest

from spoorline.operators import dense_finetune, graph, graph_network, graph_training, pairs, ranking, rgcn
from spoorline.operators.encoder import HashedBag
from spoorline.plans import learned, registry, reports
from spoorline.plans.tasks import document_tasks, settled
from test_findings import against_sql, folder  # noqa: F401


def exchanges(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("Exchange") + plan.count("Join") + plan.count("Window")


@pytest.mark.parametrize("name", ["path_metrics", "connected_evidence"])
def test_paths_are_measured_within_the_row(spark, folder, name):  # noqa: F811
    got, want = against_sql(spark, folder, name)
    assert got == want and got
    assert exchanges(registry.queries()[name](spark, folder)) == 1  # the tasks are dealt once, nothing else moves


@pytest.mark.parametrize("name", ["main_table", "method_changes", "efficiency_table"])
def test_tables_equal_sql(spark, folder, name):  # noqa: F811
    got, want = against_sql(spark, folder, name)
    assert got == want and got


def test_a_graph_is_drawn_once_for_all_methods(spark, folder, monkeypatch):  # noqa: F811
    seen = []
    draw = graph.with_edges
    monkeypatch.setattr(graph, "with_edges", lambda *a, **k: seen.append(1) or draw(*a, **k))
    own, placed = reports._judged(spark, folder)
    assert len(seen) == 1 and exchanges(placed) == 0  # what was ranked is judged where it stands
    assert {r.method for r in placed.select("method").distinct().collect()} == set(reports.METHODS)


@pytest.mark.parametrize("name", ["full_rgcn", "wo_bridge", "wo_edge_weight", "wo_seed_score"])
def test_graphs_of_rows_equal_those_of_tables(spark, folder, name):  # noqa: F811
    """Seeds, messages and samples made within a row are those that joins over tables make."""
    config = graph_network.ablated(graph_network.NetworkConfig(), name)
    own, scores, edges = settled(document_tasks(spark, folder), learned.RULES)
    features, messages = rgcn.node_features(own.items, ranking.seed_signals(scores)), rgcn.message_edges(edges)
    drawn = pairs.training_pairs(own.gold, {"easy_random": pairs.easy_random(own.items, own.gold, 2), "hard_bm25": pairs.hard_by_rank(scores, own.gold, 2)})
    rows = learned._seeds(document_tasks(spark, folder))
    assert exchanges(learned._graphs(rows, config, "train")) == 0
    for fold, samples in (("train", drawn), ("dev", graph_training.every_node(features, own.gold)), (None, None)):
        want = list(graph_network.graph_batches(arrow(graph_network.task_graphs(features, messages, config, samples)), 1))
        got = list(graph_network.graph_batches(arrow(learned._graphs(rows, config, fold)), 1))
        assert got and [b.tasks for b in got] == [b.tasks for b in want]
        for a, b in zip(got, want, strict=True):
            assert [a.nodes[k] for k in range(len(a.x))] == [b.nodes[k] for k in range(len(b.x))]
            assert np.array_equal(a.x, b.x) and np.array_equal(a.sample, b.sample) and np.array_equal(a.label, b.label, equal_nan=True)
            links = lambda g: sorted(zip(g.relation.tolist(), g.source.tolist(), g.target.tolist(), g.factor.tolist(), strict=True))
            assert links(a) == links(b)


def arrow(df):
    return df.orderBy("task_id").toArrow().to_batches()


def test_steps_of_fine_tuning_are_shared_out(spark):
    seen = []
    rows = spark.createDataFrame([(f"t{k}", f"asks {k}", f"tells {k}", ["other"]) for k in range(200)], "task_id string, question string, positive string, negatives array<string>").coalesce(1)
    gradient = dense_finetune.step_gradient
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(dense_finetune, "step_gradient", lambda data, *a: seen.append(data.rdd.getNumPartitions()) or gradient(data, *a))
        dense_finetune.finetune(rows, HashedBag(), lambda bag: 0.0, dense_finetune.FinetuneConfig(epochs=1, steps=1))
    assert seen == [n for n in seen if n >= spark.sparkContext.defaultParallelism] and seen


def test_sums_of_table_rows(monkeypatch):
    monkeypatch.setattr(dense_finetune, "STRIDE", 7)
    rng = np.random.default_rng(1)
    rows, owner, gradient = rng.integers(0, 9, 50), rng.integers(0, 6, 50), rng.normal(size=(6, 3))
    want = np.zeros((9, 3))
    np.add.at(want, rows, gradient[owner])
    at, got = dense_finetune._added(rows, gradient, owner)
    assert at.tolist() == sorted(set(rows.tolist())) and np.allclose(got, want[at])
