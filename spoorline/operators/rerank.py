"""Graph rerank: seed scores combined with query, neighbour and bridge evidence."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import within
from .graph import QUERY_NODE
from .task_rows import flat


# Fixed names and default values of the settings.
@dataclass(frozen=True)
class RerankConfig:
    lambda_init: float = 1.0
    lambda_query: float = 0.1
    lambda_neighbor: float = 0.2
    lambda_bridge: float = 0.1
    lambda_path: float = 0.0
    seed_top_s: int = 30
    max_hops: int = 2
    neighbor_type_weights: dict[str, float] = field(default_factory=lambda: {"sequential": 0.3, "entity_overlap": 0.7, "bridge": 1.0})

    def __post_init__(self) -> None:
        numbers = (self.lambda_init, self.lambda_query, self.lambda_neighbor, self.lambda_bridge, *self.neighbor_type_weights.values())
        if not all(isinstance(x, int | float) and math.isfinite(x) and x >= 0 for x in numbers):
            raise ValueError("weights must be finite and not negative")
        if self.lambda_path != 0.0:
            raise ValueError("lambda_path must be 0")
        if self.seed_top_s < 1 or self.max_hops < 0:
            raise ValueError("seed_top_s must be positive and max_hops not negative")


def gathered(scores: DataFrame, edges: DataFrame) -> DataFrame:
    """(task_id, ids, norm, asks, links): a task's candidates and edges in one row.

    Scores and edges are read once each; what follows stays within the row, so
    that settings can vary without another pass. norm is the score scaled to
    0..1; links are the edges between candidates in both directions, in order,
    so that sums are the same in any run.
    """
    items = scores.groupBy("task_id").agg(F.collect_list(F.struct("item_id", F.col("score").cast("double").alias("score"))).alias("items"))
    drawn = edges.groupBy("task_id").agg(F.sort_array(F.collect_list(F.struct("source", "target", "edge_type", "weight", "directed"))).alias("edges"))
    return linked(items.join(drawn, "task_id", "left").select("task_id", F.col("items").alias("scored"), "edges"))


def linked(rows: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """The same from rows of (task_id, scored, edges), both in order; columns ``also`` stay."""
    rows = rows.select("task_id", *also, F.transform("scored", lambda i: i["item_id"]).alias("ids"), scaled(F.transform("scored", lambda i: i["score"])).alias("norm"), F.col("edges").alias("__edges"))
    inner = F.filter("__edges", lambda e: (e["source"] != QUERY_NODE) & (e["target"] != QUERY_NODE))
    link = lambda a, b: lambda e: F.struct(e[a].alias("source"), e[b].alias("target"), e["edge_type"].alias("edge_type"), e["weight"].alias("weight"))
    links = F.concat(F.transform(inner, link("source", "target")), F.transform(F.filter(inner, lambda e: ~e["directed"]), link("target", "source")))
    asks = F.transform(F.filter("__edges", lambda e: (e["source"] == QUERY_NODE) & (e["edge_type"] == "query_overlap")), lambda e: F.struct(e["target"].alias("target"), e["weight"].alias("weight")))
    return rows.select(
        "task_id", *also, "ids", "norm",
        F.coalesce(asks, F.array().cast("array<struct<target:string,weight:double>>")).alias("asks"),
        F.coalesce(links, F.array().cast("array<struct<source:string,target:string,edge_type:string,weight:double>>")).alias("links"),
    )


def scaled(values: Column) -> Column:
    """An array scaled to 0..1; constant values give 0."""
    ends = lambda v: F.struct(v.alias("v"), F.array_min(v).alias("low"), F.array_max(v).alias("high"))
    each = lambda r: F.transform(r["v"], lambda x: F.when(r["high"] == r["low"], F.lit(0.0)).otherwise((x - r["low"]) / (r["high"] - r["low"])))
    return let(let(values, ends), each)


def parts_within(rows: DataFrame, seed_top_s: Column, max_hops: Column, type_weights: Mapping[str, float], keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """(keys, parts): arrays of (item_id, init, query, neighbor, bridge), each scaled to 0..1 within its row of ``gathered``."""
    rows = rows.select(*keys, "ids", "norm", "asks", "links", seed_top_s.cast("int").alias("__top"), max_hops.cast("int").alias("__hops"))
    weights, names = dict(type_weights), ("item_id", "init", "query", "neighbor", "bridge")

    def parts(ids: list, norm: list, to: list, weight: list, source: list, target: list, kind: list, by: list, top: int, hops: int) -> tuple:
        told = within.rerank_parts(ids, norm, (to, weight), (source, target, kind, by), top, hops, weights)
        return tuple(told[c] for c in names)

    inputs = ("ids", "norm", "asks.target", "asks.weight", "links.source", "links.target", "links.edge_type", "links.weight", "__top", "__hops")
    rows = within.by_row(rows, inputs, {c: "array<string>" if c == "item_id" else "array<double>" for c in names}, parts, ("ids", "norm", "asks", "links", "__top", "__hops"))
    return rows.select(*keys, F.arrays_zip(*names).alias("parts"))


def components(scores: DataFrame, edges: DataFrame, config: RerankConfig) -> DataFrame:
    """(task_id, item_id, init, query, neighbor, bridge), each scaled to 0..1 within its task.

    Depends on seed_top_s, max_hops and the type weights only, so a grid over
    the lambdas reuses it.
    """
    return flat(parts_within(gathered(scores, edges), F.lit(config.seed_top_s), F.lit(config.max_hops), config.neighbor_type_weights), "parts", "item_id", "task_id")


def rerank_rows(rows: DataFrame, config: RerankConfig = RerankConfig(), also: Sequence[str] = ()) -> DataFrame:
    """(task_id, scored) from rows of (task_id, scored, edges): nothing moves; columns ``also`` stay."""
    parts = parts_within(linked(rows, also), F.lit(config.seed_top_s), F.lit(config.max_hops), config.neighbor_type_weights, ("task_id", *also))
    return parts.select("task_id", *also, F.transform("parts", lambda p: F.struct(p["item_id"].alias("item_id"), combined(p, config).alias("score"))).alias("scored"))


def combined(part, config: RerankConfig) -> Column:
    """The weighted sum, in millionths by its binary value: a decimal reading of the double would round other ties than other engines do."""
    total = config.lambda_init * part["init"] + config.lambda_query * part["query"] + config.lambda_neighbor * part["neighbor"] + config.lambda_bridge * part["bridge"]
    return F.floor(total * 1e6 + 0.5) / 1e6


def rerank(scores: DataFrame, edges: DataFrame, config: RerankConfig = RerankConfig()) -> DataFrame:
    """(task_id, item_id, score) for every candidate."""
    parts = components(scores, edges, config)
    return parts.select("task_id", "item_id", combined(parts, config).alias("score"))
