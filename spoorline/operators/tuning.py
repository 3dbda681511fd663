"""Parameter grids evaluated in one job, and the choice among them."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .evaluate import reachable
from .graph import QUERY_NODE
from .memory import memory_signals
from .rerank import RerankConfig, gathered, parts_within
from .task_rows import flat

# Fixed values of the default searches.
RERANK_GRID = {
    "lambda_init": (1.0,),
    "lambda_query": (0.0, 0.05, 0.1, 0.2),
    "lambda_neighbor": (0.0, 0.05, 0.1, 0.2, 0.4),
    "lambda_bridge": (0.0, 0.05, 0.1, 0.2),
    "lambda_path": (0.0,),
    "seed_top_s": (20, 30),
    "max_hops": (1, 2),
}
MEMORY_GRID = {
    "relevance_weight": (1.0,),
    "recency_weight": (0.0,),
    "importance_weight": (0.0, 0.01, 0.05, 0.1, 0.2, 0.5, 1.0),
    "recency_decay": (0.99,),
}


def parameter_grid(values: Mapping[str, Sequence], fixed: Mapping[str, object] | None = None) -> list[dict]:
    """The ordered product of the values, each with the fixed ones."""
    if overlap := set(values) & set(fixed or {}):
        raise ValueError(f"both fixed and varied: {sorted(overlap)}")
    if empty := [k for k, v in values.items() if not v]:
        raise ValueError(f"no values for {empty}")
    return [dict(zip(values, point, strict=True)) | dict(fixed or {}) for point in itertools.product(*values.values())]


def grid_frame(spark: SparkSession, grid: list[dict]) -> DataFrame:
    """One row per configuration, numbered in order."""
    return spark.createDataFrame([{"config_id": k, **point} for k, point in enumerate(grid)])


def evaluated(scored: DataFrame, gold: DataFrame, edges: DataFrame, subgraph: bool = True) -> DataFrame:
    """(config_id, means of the objective's parts) from (config_id, task_id, item_id, score).

    One exchange by configuration and task; a ranking is measured within its
    row, against its task's gold and edges. Tasks without gold take no part.
    ``subgraph``: whether the method returns the edges among its first 10; avg_edges is 0 otherwise.
    """
    golds = gold.groupBy("task_id").agg(F.sort_array(F.collect_set("item_id")).alias("gold"))
    inner = edges.where(F.col("source") != QUERY_NODE).where(F.col("target") != QUERY_NODE).groupBy("task_id").agg(F.collect_list(F.struct("source", "target")).alias("links"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("item_id").alias("i"))))
    rows = scored.groupBy("config_id", "task_id").agg(F.transform(order, lambda x: x["i"]).alias("ids")).join(golds, "task_id").join(inner, "task_id", "left")
    top = lambda k: F.slice("ids", 1, k)
    none = F.array().cast("array<struct<source:string,target:string>>")
    inside = F.filter(F.coalesce("links", none), lambda e: F.array_contains(top(10), e["source"]) & F.array_contains(top(10), e["target"]))
    rows = rows.select("config_id", "ids", "gold", inside.alias("links"))
    back = F.transform("links", lambda e: F.struct(e["target"].alias("source"), e["source"].alias("target")))
    full = lambda k: F.size(F.array_except("gold", top(k))) == 0
    joined = F.size(F.array_except("gold", reachable(F.slice("gold", 1, 1), F.concat("links", back), 10))) == 0
    first = F.array_min(F.filter(F.transform("gold", lambda g: F.array_position(F.col("ids"), g)), lambda at: at > 0))
    parts = {
        "full_5": full(5).cast("double"),
        "recall_5": F.size(F.array_intersect("gold", top(5))) / F.size("gold"),
        "full_10": full(10).cast("double"),
        "mrr": F.coalesce(1.0 / first, F.lit(0.0)),
        "connected_10": (full(10) & joined).cast("double"),
        "avg_edges": F.size("links").cast("double") if subgraph else F.lit(0.0),
    }
    return rows.groupBy("config_id").agg(*[F.round(F.avg(x), 6).alias(c) for c, x in parts.items()])


def rerank_grid_scores(scores: DataFrame, edges: DataFrame, grid: list[dict]) -> DataFrame:
    """(config_id, task_id, item_id, score). Scores and edges are read once; components are made once for each (seed_top_s, max_hops)."""
    configs = grid_frame(scores.sparkSession, grid)
    shapes = sorted({(p["seed_top_s"], p["max_hops"]) for p in grid})
    each = F.inline(F.array(*[F.struct(F.lit(s).alias("seed_top_s"), F.lit(h).alias("max_hops")) for s, h in shapes]))
    rows = gathered(scores, edges).select("*", each)
    keys = ("task_id", "seed_top_s", "max_hops")
    parts = flat(parts_within(rows, F.col("seed_top_s"), F.col("max_hops"), RerankConfig().neighbor_type_weights, keys), "parts", "item_id", *keys)
    total = sum((F.col(f"lambda_{c}") * F.col(c) for c in ("query", "neighbor", "bridge")), F.col("lambda_init") * F.col("init"))
    rows = parts.join(F.broadcast(configs), ["seed_top_s", "max_hops"])  # a grid has a fixed number of rows
    return rows.select("config_id", "task_id", "item_id", F.round(total, 6).alias("score"))


def memory_grid_scores(items: DataFrame, relevance: DataFrame, importance: DataFrame, grid: list[dict]) -> DataFrame:
    """(config_id, task_id, item_id, score); signals are made once for each decay."""
    out = None
    configs = grid_frame(items.sparkSession, grid)
    for decay in sorted({p["recency_decay"] for p in grid}):
        signals = memory_signals(items, relevance, importance, decay)
        own = configs.where(F.col("recency_decay") == decay)
        total = F.col("relevance_weight") * F.col("relevance") + F.col("recency_weight") * F.col("recency") + F.col("importance_weight") * F.col("importance")
        rows = signals.join(F.broadcast(own)).select("config_id", "task_id", "item_id", F.round(total, 6).alias("score"))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_objective(metrics: DataFrame) -> DataFrame:
    """Half full support at 5, 0.3 recall at 5, 0.2 connected evidence at 10."""
    return metrics.withColumn("objective", F.round(0.5 * F.col("full_5") + 0.3 * F.col("recall_5") + 0.2 * F.col("connected_10"), 6))


def selected(metrics: DataFrame) -> DataFrame:
    """The best row; ties go to full support at 10, then fewer edges, then the earlier configuration. Latency takes no part."""
    return metrics.orderBy(F.desc("objective"), F.desc("full_10"), F.asc("avg_edges"), F.asc("config_id")).limit(1)
