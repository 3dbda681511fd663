"""Running a method over tasks: completeness is observed in the pass that writes the rankings, and faults raise after it."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import kept

EDGES = "array<struct<source:string,target:string,edge_type:string,weight:double,directed:boolean>>"


class Incomplete(ValueError):
    """A run that doesn't cover what was asked."""


@dataclass(frozen=True)
class Execution:
    """Rankings from files, and what was seen while they were written."""

    method: str
    rankings: DataFrame
    counts: dict[str, int]
    seconds: float

    @property
    def latency_ms(self) -> float:
        """Wall time for each task; tasks of a batch share it."""
        return 1000 * self.seconds / max(1, self.counts["tasks"])

    def record(self) -> DataFrame:
        """One row: the method and its counts."""
        names = sorted(self.counts)
        return self.rankings.sparkSession.createDataFrame([(self.method, *[self.counts[c] for c in names])], "method string, " + ", ".join(f"{c} long" for c in names))


def joined_requests(rows: DataFrame, graphs: DataFrame | None) -> DataFrame:
    """Task rows with their edges from graphs(task_id, edges): a task whose graph is missing has null, an empty graph an empty array."""
    if graphs is None:
        return rows
    return rows.drop("edges").join(graphs.select("task_id", "edges"), "task_id", "left")


def execute(method: str, rows: DataFrame, rank: Callable[[DataFrame], DataFrame], needs_graph: bool = False, strict: bool = True, also: Sequence[str] = ()) -> Execution:
    """Apply ``rank`` to task rows (task_id, asked, items, ...), which gives (task_id, scored), one row per task.

    Every task must come back with each of its candidates once and a finite
    score; with ``needs_graph`` each must have edges. The counts are observed in
    the job that writes the rankings to the shared folder, so nothing is read
    twice for them. Columns ``also`` that ``rank`` hands through are written
    beside the rankings, for what is made of them within the row.
    """
    tag = f"{method}-{time.monotonic_ns()}"
    asked, told = Observation(f"asked-{tag}"), Observation(f"told-{tag}")
    ids = F.sort_array(F.transform("items", lambda i: i["item_id"]))
    graph = F.col("edges").isNull() if "edges" in rows.columns else F.lit(needs_graph)
    rows = rows.withColumn("__ids", ids).observe(
        asked, F.count(F.lit(1)).alias("tasks"), F.sum(F.size("items")).alias("candidates"), F.count(F.when(graph, 1)).alias("without_graph"), F.count(F.when(F.col("asked").isNull(), 1)).alias("without_question")
    )
    scored = rank(rows)
    bad = F.exists("scored", lambda s: s["score"].isNull() | F.isnan(s["score"]) | (F.abs(s["score"]) == F.lit(float("inf"))))
    own = F.sort_array(F.transform("scored", lambda s: s["item_id"]))
    # A method that hands the ids through is compared with them; another one by count.
    wrong = ~own.eqNullSafe(F.col("__ids")) if "__ids" in scored.columns else F.size(F.array_distinct(own)) != F.size(own)
    scored = scored.observe(told, F.count(F.lit(1)).alias("ranked"), F.sum(F.size("scored")).alias("scored_items"), F.count(F.when(wrong, 1)).alias("not_covered"), F.count(F.when(bad, 1)).alias("bad_scores"))
    start = time.perf_counter()
    files = kept(scored.select("task_id", "scored", *also))
    seconds = time.perf_counter() - start
    counts = {k: int(v or 0) for k, v in (asked.get | told.get).items()}
    run = Execution(method, files, counts, seconds)
    if strict:
        verify(run, needs_graph)
    return run


def execute_together(rows: DataFrame, rank: Callable[[DataFrame], DataFrame], methods: dict[str, bool], also: Sequence[str] = (), strict: bool = True) -> dict[str, Execution]:
    """``execute`` for methods that share one pass: ``rank`` gives rows of (task_id, own, ...) a column of scored for each method.

    ``methods`` tells which of them need edges; own holds a task's candidates.
    All rankings are written beside each other, in one job.
    """
    asked, told = (Observation(f"{name}-{time.monotonic_ns()}") for name in ("asked", "told"))
    rows = rows.observe(
        asked, F.count(F.lit(1)).alias("tasks"), F.sum(F.size("own")).alias("candidates"), F.count(F.when(F.col("edges").isNull(), 1)).alias("without_graph"), F.count(F.when(F.col("asked").isNull(), 1)).alias("without_question")
    )
    scored, seen = rank(rows), []
    ids = lambda c: F.sort_array(F.transform(c, lambda s: s["item_id"]))
    for name in methods:
        bad = F.exists(name, lambda s: s["score"].isNull() | F.isnan(s["score"]) | (F.abs(s["score"]) == F.lit(float("inf"))))
        counts = {"ranked": F.count(F.col(name)), "scored_items": F.sum(F.size(name)), "not_covered": F.count(F.when(~ids(name).eqNullSafe(ids("own")), 1)), "bad_scores": F.count(F.when(bad, 1))}
        seen += [c.alias(f"{name}:{n}") for n, c in counts.items()]
    start = time.perf_counter()
    files = kept(scored.observe(told, *seen).select("task_id", *methods, *also))
    seconds = time.perf_counter() - start
    runs = {}
    for name, needs_graph in methods.items():
        own = {k.split(":")[1]: n for k, n in told.get.items() if k.split(":")[0] == name}
        runs[name] = Execution(name, files.select("task_id", F.col(name).alias("scored"), *also), {k: int(v or 0) for k, v in (asked.get | own).items()}, seconds)
        if strict:
            verify(runs[name], needs_graph)
    return runs


def verify(run: Execution, needs_graph: bool = False) -> None:
    c = run.counts
    faults = {
        "tasks without a ranking": c["tasks"] - c["ranked"], "candidates without a score": c["candidates"] - c["scored_items"], "tasks whose candidates aren't each ranked once": c["not_covered"],
        "tasks with scores that are no finite numbers": c["bad_scores"], **({"tasks without a graph": c["without_graph"]} if needs_graph else {}),
    }
    if found := {k: n for k, n in faults.items() if n}:
        raise Incomplete(f"{run.method}: " + ", ".join(f"{n} {k}" for k, n in found.items()))


def aligned(predictions: DataFrame, labels: DataFrame, graphs: DataFrame | None = None) -> None:
    """Raise unless the same tasks stand in all of them: one outer join over task ids, which tells the first few that don't."""
    marks = [df.select("task_id").distinct().withColumn(name, F.lit(True)) for name, df in (("prediction", predictions), ("label", labels), ("graph", graphs)) if df is not None]
    rows = marks[0]
    for other in marks[1:]:
        rows = rows.join(other, "task_id", "full_outer")
    names = [m.columns[1] for m in marks]
    lost = rows.where(" or ".join(f"{n} is null" for n in names)).orderBy("task_id").take(3)
    if lost:
        raise Incomplete("; ".join(f"{r.task_id} has no {', '.join(n for n in names if r[n] is None)}" for r in lost))
