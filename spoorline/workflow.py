"""Control plane: layered settings, the method registry, and stages with fingerprints.

All of it is small driver-side Python; the stages themselves are DataFrame jobs.
"""

from __future__ import annotations

import graphlib
import hashlib
import json
import os
import platform
import time
from collections.abc import Callable, Mapping
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any

from .sources.io import strict_json, write_document


@dataclass(frozen=True)
class Method:
    """A retrieval method: what it needs and what seeds it."""

    name: str
    trained: bool = False
    tuned: bool = False
    seed: str | None = None
    needs_graph: bool = False
    depends_on: tuple[str, ...] = ()


# Fixed names of the methods.
METHODS = {
    m.name: m
    for m in (
        Method("bm25"),
        Method("dense"),
        Method("memory_stream", tuned=True),
        Method("bm25_graph_rerank", tuned=True, seed="bm25", needs_graph=True),
        Method("dense_graph_rerank", tuned=True, seed="dense", needs_graph=True),
        Method("dense_rgcn_graph_retriever", trained=True, seed="dense", needs_graph=True),
        Method("dense_ft", trained=True),
        Method("dense_ft_rgcn_graph_retriever", trained=True, seed="dense_ft", needs_graph=True, depends_on=("dense_ft",)),
    )
}
STAGES = ("prepare", "graphs", "pairs", "tune", "train", "retrieve", "evaluate", "aggregate")


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Later layers over earlier ones; nested mappings merge."""
    out: dict[str, Any] = {}
    for layer in layers:
        for key, value in layer.items():
            if isinstance(value, Mapping) and isinstance(out.get(key), Mapping):
                out[key] = merged(out[key], value)
            else:
                out[key] = dict(value) if isinstance(value, Mapping) else value
    return out


def structured(kind: type, record: Mapping[str, Any], complete: bool = False):
    """A dataclass from a record; unknown fields raise, and missing ones too if it must be complete."""
    if not is_dataclass(kind):
        raise TypeError(f"{kind} is no dataclass")
    known = {f.name: f for f in fields(kind)}
    if extra := set(record) - set(known):
        raise ValueError(f"unknown fields: {sorted(extra)}")
    needed = known if complete else {n: f for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING}
    if missing := set(needed) - set(record):
        raise ValueError(f"missing fields: {sorted(missing)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in record.items()})


def train_order(methods: list[str]) -> list[str]:
    """Trained methods with what they depend on first; cycles raise."""
    graph: dict[str, tuple[str, ...]] = {}
    todo = list(methods)
    while todo:
        name = todo.pop()
        if name not in METHODS:
            raise KeyError(f"no method {name}")
        if name not in graph:
            graph[name] = METHODS[name].depends_on
            todo += METHODS[name].depends_on
    return [n for n in graphlib.TopologicalSorter(graph).static_order() if METHODS[n].trained]


def stages_of(method: str, first: str | None = None, last: str | None = None) -> list[str]:
    """The stages that a method runs, within a range."""
    m = METHODS[method]
    own = [s for s in STAGES if (s != "graphs" or m.needs_graph) and (s != "tune" or m.tuned) and (s not in ("pairs", "train") or m.trained)]
    lo = own.index(first) if first else 0
    hi = own.index(last) + 1 if last else len(own)
    return own[lo:hi]


@dataclass
class Stage:
    """A named step: it writes ``output`` from ``inputs`` with ``config``.

    ``digest`` gives what an input's path holds, by content; without it sizes
    and times stand for it.
    """

    name: str
    run: Callable[[], Any]
    inputs: tuple[str, ...] = ()
    output: str | None = None
    config: Mapping[str, Any] = field(default_factory=dict)
    digest: Callable[[str], str] | None = None

    def fingerprint(self) -> str:
        seen = {p: (self.digest or _stamp)(p) for p in self.inputs}
        return hashlib.sha256(json.dumps([self.name, seen, dict(self.config)], sort_keys=True, default=str).encode()).hexdigest()


def _stamp(path: str) -> Any:
    if not os.path.exists(path):
        return None
    files = [os.path.join(d, f) for d, _, names in os.walk(path) for f in sorted(names)] if os.path.isdir(path) else [path]
    return [[os.path.basename(f), os.path.getsize(f), int(os.path.getmtime(f))] for f in files]


class Workflow:
    """Runs stages in order, skips the finished prefix, and records each run."""

    def __init__(self, folder: str, stages: list[Stage]) -> None:
        self.folder, self.stages = folder, stages

    def summary_path(self, stage: Stage) -> str:
        return os.path.join(self.folder, f"{stage.name}.summary.json")

    def status(self, stage: Stage) -> str:
        """missing, failed, stale or complete."""
        path = self.summary_path(stage)
        if not os.path.exists(path) or (stage.output and not os.path.exists(stage.output)):
            return "missing"
        with open(path, encoding="utf-8") as f:
            found = strict_json(f.read())
        if found["status"] != "complete":
            return "failed"
        return "complete" if found["fingerprint"] == stage.fingerprint() else "stale"

    def run(self, resume: bool = True) -> list[str]:
        """Names of the stages that ran: all from the first that isn't complete."""
        ran: list[str] = []
        for stage in self.stages:
            if resume and not ran and self.status(stage) == "complete":
                continue
            began = time.time()
            summary = {"stage": stage.name, "config": dict(stage.config), "environment": {"python": platform.python_version()}, "fingerprint": stage.fingerprint()}
            try:
                result = stage.run()
                summary |= {"status": "complete", "counts": result if isinstance(result, dict) else {}}
            except Exception as error:
                summary |= {"status": "failed", "error": f"{type(error).__name__}: {error}"}
                raise
            finally:
                write_document(self.summary_path(stage), summary | {"seconds": round(time.time() - began, 3)})
            ran.append(stage.name)
        return ran


def init_manifest(path: str, config: Mapping[str, Any], force: bool = False) -> dict[str, Any]:
    """Write an experiment's manifest; one with other settings is kept unless forced."""
    if os.path.exists(path) and not force:
        with open(path, encoding="utf-8") as f:
            old = strict_json(f.read())
        if old != json.loads(json.dumps(config)):
            raise ValueError("the manifest exists with other settings")
        return old
    write_document(path, dict(config))
    return dict(config)
