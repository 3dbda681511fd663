"""Experiments as graphs of stages: each writes a table, independent ones run at once, finished ones are not run again.

A stage gets the tables that it names and returns a DataFrame, which is written
as Parquet under the experiment's folder; a one-row summary written after it is
what makes a stage complete, so a stage that was killed runs again. Stages that
don't wait for each other run in threads of their own, each in its own job group
and scheduler pool; when one fails, the others' jobs are cancelled. A stage's
fingerprint covers its settings, the digests of its inputs and the fingerprints
of the stages before it, so a change makes everything behind it stale. All files
are written and read by Spark, so the folder can be in any store it knows.
"""

from __future__ import annotations

import graphlib
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DataType, StructType

Tables = Mapping[str, DataFrame]


class StageFailed(RuntimeError):
    """A stage raised; what it raised is the cause."""


@dataclass(frozen=True)
class Stage:
    """``run`` makes a table from the tables of the stages in ``needs``, a mapping to the columns that it reads of each ("" for any)."""

    name: str
    run: Callable[[SparkSession, Tables], DataFrame]
    needs: Mapping[str, str] = field(default_factory=dict)
    config: Mapping[str, object] = field(default_factory=dict)
    inputs: Mapping[str, str] = field(default_factory=dict)


class StageGraph:
    """Stages of one experiment under a folder."""

    def __init__(self, spark: SparkSession, folder: str, stages: list[Stage]) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.stages = {s.name: s for s in stages}
        if len(self.stages) < len(stages):
            raise ValueError("two stages have the same name")
        if unknown := {f"{s.name} needs {n}" for s in stages for n in s.needs if n not in self.stages}:
            raise ValueError(f"stages that aren't there: {sorted(unknown)}")
        try:
            self.order = list(graphlib.TopologicalSorter({s.name: set(s.needs) for s in stages}).static_order())
        except graphlib.CycleError as error:
            raise ValueError(f"stages wait for each other: {error.args[1]}") from None

    def fingerprint(self, name: str) -> str:
        stage = self.stages[name]
        told = [name, sorted(stage.config.items()), sorted(stage.inputs.items()), sorted((n, self.fingerprint(n)) for n in stage.needs)]
        return hashlib.sha256(json.dumps(told, default=str).encode()).hexdigest()[:24]

    def _path(self, name: str, kind: str) -> str:
        return f"{self.folder}/{name}/{kind}"

    def summary(self, name: str) -> dict | None:
        """What the last run of a stage left, if it came to an end."""
        try:
            rows = self.spark.read.schema("name string, fingerprint string, status string, rows long, seconds double, error string").json(self._path(name, "summary")).collect()
        except AnalysisException:
            return None
        return rows[0].asDict() if rows else None

    def status(self) -> dict[str, str]:
        """missing, failed, stale, complete, or blocked (something before it isn't complete), by stage in order."""
        out: dict[str, str] = {}
        for name in self.order:
            found = self.summary(name)
            if found is None:
                out[name] = "missing"
            elif found["status"] != "complete":
                out[name] = "failed"
            elif found["fingerprint"] != self.fingerprint(name):
                out[name] = "stale"
            elif any(out[n] != "complete" for n in self.stages[name].needs):
                out[name] = "blocked"
            else:
                out[name] = "complete"
        return out

    def plan(self, targets: list[str] | None = None) -> list[str]:
        """The stages that a run would run, in an order in which they could."""
        wanted, todo = set(), list(targets or self.order)
        while todo:
            name = todo.pop()
            if name not in self.stages:
                raise ValueError(f"unknown stage {name}; known: {self.order}")
            if name not in wanted:
                wanted.add(name)
                todo += self.stages[name].needs
        status = self.status()
        return [n for n in self.order if n in wanted and status[n] != "complete"]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name, "data"))

    def _given(self, stage: Stage) -> dict[str, DataFrame]:
        tables = {n: self.table(n) for n in stage.needs}
        for n, columns in stage.needs.items():
            wanted = DataType.fromDDL(columns) if columns else StructType()
            has = {f.name: f.dataType for f in tables[n].schema}
            if bad := [f.name for f in wanted if has.get(f.name) != f.dataType]:
                raise TypeError(f"{stage.name} reads {bad} of {n}, which aren't there as {columns}")
        return tables

    def _tell(self, name: str, status: str, rows: int, seconds: float, error: str | None) -> None:
        row = [(name, self.fingerprint(name), status, rows, seconds, error)]
        frame = self.spark.createDataFrame(row, "name string, fingerprint string, status string, rows long, seconds double, error string")
        frame.coalesce(1).write.mode("overwrite").json(self._path(name, "summary"))

    def _one(self, name: str, group: str) -> None:
        context = self.spark.sparkContext
        context.setJobGroup(group, f"stage {name}", interruptOnCancel=True)
        context.setLocalProperty("spark.scheduler.pool", name)
        began = time.perf_counter()
        try:
            stage = self.stages[name]
            stage.run(self.spark, self._given(stage)).write.mode("overwrite").parquet(self._path(name, "data"))
            rows = self.table(name).count()
        except Exception as error:
            context.setJobGroup(f"{group}-told", f"summary of {name}")  # the stage's own group may have been cancelled
            self._tell(name, "failed", 0, time.perf_counter() - began, f"{type(error).__name__}: {str(error)[:300]}")
            raise
        self._tell(name, "complete", rows, time.perf_counter() - began, None)

    def run(self, targets: list[str] | None = None, at_once: int = 4) -> list[str]:
        """Names of the stages that ran, in the order in which they ended. The first failure cancels what runs and raises."""
        todo = self.plan(targets)
        run_id, waiting, ended = uuid.uuid4().hex[:8], set(todo), []
        groups = {n: f"{run_id}-{n}" for n in todo}
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            running: dict = {}
            while waiting or running:
                for name in [n for n in todo if n in waiting and len(running) < at_once and all(d not in waiting and d not in running.values() for d in self.stages[n].needs)]:
                    if len(running) < at_once:
                        waiting.discard(name)
                        running[pool.submit(inheritable_thread_target(self.spark)(self._one), name, groups[name])] = name
                done, _ = wait(running, return_when=FIRST_COMPLETED)
                for future in done:
                    name = running.pop(future)
                    if error := future.exception():
                        for other in running.values():
                            self.spark.sparkContext.cancelJobGroup(groups[other])
                        wait(running)
                        raise StageFailed(f"stage {name} failed") from error
                    ended.append(name)
        return ended
