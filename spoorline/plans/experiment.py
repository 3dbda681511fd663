"""A retrieval experiment over document tasks as a graph of stages, and its command line.

python -m spoorline plan|run|status|table --data DIR --folder DIR [--methods bm25,...] [--at-once N]
"""

from __future__ import annotations

import argparse
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, graph, lexical, ranking, rerank, tables
from ..runtime import shared_folder
from ..sources.manifests import file_digests, tree_digest
from ..stages import Stage, StageGraph
from ..workflow import METHODS
from .reports import RULES
from .tasks import TaskSet, document_tasks

SCORED = "task_id string, scored array<struct<item_id:string,score:double>>"


def _bm25(tables_):
    return lexical.bm25_within(tables_["tasks"])


def _dense(tables_):
    return lexical.hashed_within(tables_["tasks"]).select("task_id", "scored")


def _reranked(seed: str):
    def run(tables_):
        return rerank.rerank_rows(tables_[seed].join(tables_["graphs"], "task_id", "left"))

    return run


#: The methods that an experiment can run, by what ranks with them and the tables that they read.
RANKERS: dict[str, tuple[Callable, tuple[str, ...]]] = {
    "bm25": (_bm25, ("tasks",)), "dense": (_dense, ("tasks",)), "bm25_graph_rerank": (_reranked("bm25"), ("bm25", "graphs")), "dense_graph_rerank": (_reranked("dense"), ("dense", "graphs")),
}


def _metrics(method: str):
    def run(spark, tables_):
        items = tables_["tasks"].select("task_id", F.inline("items"))
        gold = TaskSet(tables_["tasks"], items).gold
        ranked = ranking.ranked_within(tables_[method])
        return evaluate.summary(evaluate.task_metrics(ranked, gold, rounded=False).withColumn("method", F.lit(method)))

    return run


def with_seeds(methods: Sequence[str]) -> list[str]:
    """The methods and what seeds them, seeds first."""
    if unknown := [m for m in methods if m not in RANKERS]:
        raise ValueError(f"methods that an experiment can't run: {unknown}; known: {sorted(RANKERS)}")
    out: list[str] = []
    for m in methods:
        for name in (METHODS[m].seed, m):
            if name and name not in out:
                out.append(name)
    return out


def stages_of(spark: SparkSession, data: str, methods: Sequence[str]) -> list[Stage]:
    """Tasks, graphs where a method needs them, a ranking and a metric row for each method, and their table."""
    runs = with_seeds(methods)
    source = f"{data.rstrip('/')}/documents.parquet"
    stages = [Stage("tasks", lambda s, t: document_tasks(s, data).rows, inputs={"documents": tree_digest(file_digests(spark, source))})]
    if any(METHODS[m].needs_graph for m in runs):
        stages.append(Stage("graphs", lambda s, t: graph.with_edges(t["tasks"], rules=RULES).select("task_id", "edges"), {"tasks": "task_id string, asked string"}, {"rules": RULES}))
    for m in runs:
        rank, reads = RANKERS[m]
        stages.append(Stage(m, lambda s, t, rank=rank: rank(t), dict.fromkeys(reads, "task_id string"), {"method": m}))
        stages.append(Stage(f"{m}_metrics", _metrics(m), {m: SCORED, "tasks": "task_id string"}))
    rows = [f"{m}_metrics" for m in methods]
    stages.append(Stage("table", lambda s, t: tables.side_by_side({n: t[n] for n in rows}), dict.fromkeys(rows, "method string"), {"methods": list(methods)}))
    return stages


def experiment_table(spark, sf_dir) -> DataFrame:
    """Three methods run as stages in the shared folder; their metric table."""
    graph_ = StageGraph(spark, f"{shared_folder(spark)}/experiment-{uuid.uuid4().hex}", stages_of(spark, sf_dir, ("bm25", "bm25_graph_rerank", "dense")))
    graph_.run()
    return graph_.table("table")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spoorline", description="Retrieval experiments over document tasks.")
    parser.add_argument("action", choices=("plan", "run", "status", "table"))
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--folder", required=True, help="folder of the experiment, shared by driver and executors")
    parser.add_argument("--methods", default="bm25,bm25_graph_rerank", help=f"of {', '.join(sorted(RANKERS))}")
    parser.add_argument("--at-once", type=int, default=4, help="stages that run at once")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.scheduler.mode", "FAIR").getOrCreate()
    folder = args.folder if "://" in args.folder else os.path.abspath(args.folder)
    graph_ = StageGraph(spark, folder, stages_of(spark, args.data, args.methods.split(",")))
    if args.action == "plan":
        print("\n".join(graph_.plan()))
    elif args.action == "status":
        print("\n".join(f"{name}\t{state}" for name, state in graph_.status().items()))
    else:
        if args.action == "run":
            print("\n".join(graph_.run(at_once=args.at_once)))
        else:
            tables.rendered(graph_.table("table")).show(truncate=False)
    return 0


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"experiment_table": experiment_table}


def oracle_sql(method_metrics: str, means: str) -> dict[str, str]:
    return {"experiment_table": method_metrics + f"SELECT method, count(*) AS n_tasks, {means} FROM metrics WHERE method <> 'dense_graph_rerank' GROUP BY method"}
