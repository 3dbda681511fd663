"""Evidence graphs: sequential, query-overlap, entity-overlap and bridge edges."""

from __future__ import annotations

import bisect
import heapq
import itertools
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import within
from .lexical import Bm25Config, scored_items
from .task_rows import flat, task_rows

EDGE_TYPES = ("sequential", "query_overlap", "entity_overlap", "bridge")
QUERY_NODE = "q"


@dataclass(frozen=True)
class GraphConfig:
    max_query_overlap: int = 20
    max_entity_degree: int = 10
    max_bridge_edges: int = 50
    use_spacy: bool = False  # accepted; named entities come from capitalised phrases alone

    def __post_init__(self) -> None:
        if min(self.max_query_overlap, self.max_entity_degree, self.max_bridge_edges) < 0:
            raise ValueError("edge limits must not be negative")


EDGE = "struct<source:string,target:string,edge_type:string,weight:double,directed:boolean>"


def _edge(source: Column, target: Column, kind: str, weight: Column, directed: bool) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("edge_type"), weight.cast("double").alias("weight"), F.lit(directed).alias("directed"))


def _sequential(items: Column) -> Column:
    """Neighbours in a group whose sequence numbers differ by exactly 1."""
    group = lambda i: F.coalesce(i["group_key"], i["source_ref"])
    placed = F.transform(F.filter(items, lambda i: group(i).isNotNull()), lambda i: F.struct(group(i).alias("g"), F.coalesce(i["sequence_index"], F.lit(0)).alias("s"), i["position"].alias("p"), i["item_id"].alias("id"), i["sequence_index"].alias("at")))

    def links(ordered: Column) -> Column:
        near = F.zip_with(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        good = F.filter(near, lambda x: (x["a"]["g"] == x["b"]["g"]) & (x["b"]["at"] - x["a"]["at"] == 1))
        return F.transform(good, lambda x: _edge(x["a"]["id"], x["b"]["id"], "sequential", F.lit(1.0), False))

    return T.let(F.sort_array(placed), links)


def _query_overlap(items: Column, scores: Column, limit: int) -> Column:
    """From the question to its best lexical matches."""
    best = F.filter(F.zip_with(items, F.coalesce(scores, F.array().cast("array<double>")), lambda i, s: F.struct((-s).alias("s"), i["item_id"].alias("id"))), lambda x: x["s"] < 0)
    first = F.slice(F.sort_array(best), 1, limit) if limit else F.slice(best, 1, 0)
    return F.transform(first, lambda x: _edge(F.lit(QUERY_NODE), x["id"], "query_overlap", -x["s"], True))


def shared_pairs(entities: list[list[str]], groups: list[str | None] | None = None) -> Counter:
    """How many entities two items share, by their places: over an index of entities, so that only pairs that share something are formed; with ``groups`` only pairs of different ones."""
    bearers: dict[str, list[int]] = {}
    for k, own in enumerate(entities):
        for entity in own or ():
            bearers.setdefault(entity, []).append(k)
    out: Counter = Counter()
    for places in bearers.values():
        if len(places) > 1:
            pairs = itertools.combinations(places, 2)
            out.update(pairs if groups is None else ((a, b) for a, b in pairs if groups[a] != groups[b]))
    return out


def mentions(aliases: list[list[str]], texts: list[str], groups: list[str | None]) -> Counter:
    """In how many ways two items of different groups mention each other's title: each alias is looked for once in each text."""
    bearers: dict[str, list[int]] = {}
    for k, own in enumerate(aliases):
        for alias in own or ():
            bearers.setdefault(alias, []).append(k)
    out: Counter = Counter()
    # All texts as one, so that an alias is looked for by one search that goes on at the next text.
    known = [k for k, text in enumerate(texts) if text is not None]
    whole = "\0".join(texts[k] for k in known)
    starts = list(itertools.accumulate((len(texts[k]) + 1 for k in known), initial=0))
    for alias, places in bearers.items():
        at = whole.find(alias)
        while at >= 0:
            own = bisect.bisect_right(starts, at) - 1
            k = known[own]
            for p in places:
                if p != k and groups[p] != groups[k]:
                    out[(p, k) if p < k else (k, p)] += 1
            at = whole.find(alias, starts[own + 1])
    return out


def capped(pairs: Counter, ids: list[str], limit: int) -> list[tuple[int, int, int]]:
    """Strongest pairs first, each node in ``limit`` of them at most; ends when no two nodes are open."""
    degree = [0] * len(ids)
    open_nodes, out = len(ids), []
    for (a, b), weight in sorted(pairs.items(), key=lambda x: (-x[1], ids[x[0][0]], ids[x[0][1]])):
        if open_nodes < 2:
            break
        if degree[a] < limit and degree[b] < limit:
            out.append((a, b, weight))
            for end in (a, b):
                degree[end] += 1
                open_nodes -= degree[end] == limit
    return out


def pair_edges(own: within.Features, ids: list[str], groups: list[str | None], config: GraphConfig, rules: tuple[str, ...]) -> list[dict]:
    """The edges of a task's row by the rules that compare candidates with each other; one without a title shares no entities."""
    out = []
    entities = [e if named else [] for e, named in zip(own.entities, own.named, strict=True)]
    if "entity_overlap" in rules and config.max_entity_degree:
        out += [(a, b, "entity_overlap", w) for a, b, w in capped(shared_pairs(entities), ids, config.max_entity_degree)]
    if "bridge" in rules:
        total = mentions(own.aliases, own.low_text, groups)
        total.update(shared_pairs(entities, groups))
        # Only pairs as strong as the last that is taken are put in order.
        least = heapq.nlargest(config.max_bridge_edges, total.values())[-1:] or [0]
        strong = [x for x in total.items() if x[1] >= least[0]]
        best = heapq.nsmallest(config.max_bridge_edges, strong, key=lambda x: (-x[1], ids[x[0][0]], ids[x[0][1]]))
        out += [(a, b, "bridge", w) for (a, b), w in best]
    return [{"source": ids[a], "target": ids[b], "edge_type": kind, "weight": float(w), "directed": False} for a, b, kind, w in out]


def with_edges(rows: DataFrame, config: GraphConfig = GraphConfig(), rules: tuple[str, ...] = EDGE_TYPES, bm25: Bm25Config | None = None, hashed: bool = False) -> DataFrame:
    """(task_id, asked, items, edges) from task rows: all rules within the row, edges in a fixed order.

    Features are made once, in Arrow batches, for the question's matches and
    for the rules that compare candidates with each other. With ``bm25`` the
    same pass scores the candidates too, as ``lexical.bm25_within`` does, and
    adds scored. With ``hashed`` beside it the pass adds dense, scores as
    ``lexical.hashed_within`` gives them, and n_tokens, the content tokens of
    question and texts.
    """
    cols = ["task_id", "asked", "items"]
    sequential = _sequential(F.col("items")) if "sequential" in rules else F.array().cast(f"array<{EDGE}>")
    if bm25 is None and not set(rules) - {"sequential"}:
        return rows.select(*cols, F.sort_array(sequential).alias("edges"))
    part = lambda f: F.transform("items", f)
    inputs = {"__ids": part(lambda i: i["item_id"]), "__sources": part(lambda i: i["source_ref"]), "__texts": part(lambda i: i["text"]), "__groups": part(lambda i: F.coalesce(i["group_key"], i["source_ref"]))}
    outputs = {"__scores": "array<double>", "pairs": f"array<{EDGE}>"}
    if bm25 is not None:
        inputs["__titles"], outputs["__bm25"] = part(lambda i: i["title"]), "array<double>"
        if hashed:
            outputs |= {"__hashed": "array<double>", "n_tokens": "long"}
    asks = "query_overlap" in rules

    def of_task(asked: str | None, ids: list[str], sources: list, texts: list, groups: list, titles: list | None = None) -> tuple:
        own = within.Features(sources, texts)
        told = own.overlap(asked) if asks else None, pair_edges(own, ids, groups, config, rules)
        if bm25 is None:
            return told
        words = own.words if titles == sources else None
        told = *told, within.bm25(asked, titles, texts, bm25.k1, bm25.b, bm25.epsilon, words)
        return (*told, within.hashed_products(asked, titles, texts, words), own.read(asked)) if hashed else told

    rows = within.by_row(rows.select(*cols, *[c.alias(name) for name, c in inputs.items()]), ("asked", *inputs), outputs, of_task, [c for c in inputs if c != "__ids" or bm25 is None])
    rounded = F.transform("__scores", lambda s: F.round(s, 6))
    asked = _query_overlap(F.col("items"), rounded, config.max_query_overlap) if asks else F.array().cast(f"array<{EDGE}>")
    scored = [scored_items("__ids", "__bm25").alias("scored")] if bm25 is not None else []
    if scored and hashed:
        scored += [scored_items("__ids", "__hashed").alias("dense"), F.col("n_tokens")]
    return rows.select(*cols, F.sort_array(F.concat(sequential, asked, "pairs")).alias("edges"), *scored)


def flat_edges(rows: DataFrame) -> DataFrame:
    """(task_id, source, target, edge_type, weight, directed) of rows with edges."""
    return flat(rows, "edges", "source", "task_id")


def _no_tasks(items: DataFrame) -> DataFrame:
    return items.select("task_id", F.lit(None).cast("string").alias("question")).limit(0)


def sequential_edges(items: DataFrame) -> DataFrame:
    """Neighbours in a group whose sequence numbers differ by exactly 1."""
    return build_graph(items, _no_tasks(items), rules=("sequential",))


def query_overlap_edges(items: DataFrame, tasks: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """From the question to its best lexical matches."""
    return build_graph(items, tasks, config, ("query_overlap",))


def entity_pairs(items: DataFrame, across_groups: bool = False) -> DataFrame:
    """(task_id, source, target, weight): shared entities of two items, the earlier one first; on request only of different groups.

    An inverted index joined with itself on (task, entity), for tables of items
    that are no rows of tasks yet.
    """
    own = F.array_union(T.entities(F.concat_ws(". ", "source_ref", "text")), T.title_aliases("source_ref"))
    left = items.select("task_id", "item_id", "position", F.coalesce("group_key", "source_ref").alias("g"), F.explode(own).alias("entity"))
    right = left.select("task_id", "entity", F.col("item_id").alias("target"), F.col("position").alias("p2"), F.col("g").alias("g2"))
    both = left.join(right, ["task_id", "entity"]).where("position < p2")
    if across_groups:
        both = both.where(~F.col("g").eqNullSafe(F.col("g2")))
    return both.groupBy("task_id", F.col("item_id").alias("source"), "target").agg(F.count(F.lit(1)).alias("weight"))


def entity_overlap_edges(items: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Strongest pairs first, each node in ``max_entity_degree`` edges at most."""
    return build_graph(items, _no_tasks(items), config, ("entity_overlap",))


def bridge_edges(items: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """Across groups: shared entities and mentions of one's title in the other's text."""
    return build_graph(items, _no_tasks(items), config, ("bridge",))


def build_graph(items: DataFrame, tasks: DataFrame, config: GraphConfig = GraphConfig(), rules: tuple[str, ...] = EDGE_TYPES, given: DataFrame | None = None) -> DataFrame:
    """(task_id, source, target, edge_type, weight, directed) of all rules.

    ``given`` edges come first; of equal ones only the first is kept. The
    rules themselves never make an edge twice.
    """
    edges = flat_edges(with_edges(task_rows(items, tasks), config, rules))
    if given is None:
        return edges
    both = given.select(edges.columns).withColumn("rule", F.lit(0)).unionByName(edges.withColumn("rule", F.lit(1)))
    return deduplicated(both).drop("rule")


def deduplicated(edges: DataFrame) -> DataFrame:
    """The first edge of equal ends and type; an undirected edge equals its reverse."""
    low = F.when(F.col("directed"), F.col("source")).otherwise(F.least("source", "target"))
    high = F.when(F.col("directed"), F.col("target")).otherwise(F.greatest("source", "target"))
    w = W.partitionBy("task_id", low, high, "edge_type", "directed").orderBy("rule", F.desc("weight"), "source", "target")
    return edges.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def visible(edges: DataFrame, types: tuple[str, ...]) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*types))


def both_ways(edges: DataFrame) -> DataFrame:
    """Traversal view: undirected edges in both directions."""
    back = edges.where(~F.col("directed")).select("task_id", F.col("target").alias("source"), F.col("source").alias("target"), "edge_type", "weight", "directed")
    return edges.select("task_id", "source", "target", "edge_type", "weight", "directed").unionByName(back)


def expand(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(task_id, item_id) within ``max_hops`` of the seeds, never through the question."""
    links = both_ways(edges).where((F.col("source") != QUERY_NODE) & (F.col("target") != QUERY_NODE)).select("task_id", "source", "target").distinct()
    found = seeds.select("task_id", "item_id").distinct()
    for _ in range(max_hops):
        step = found.withColumnRenamed("item_id", "source").join(links, ["task_id", "source"]).select("task_id", F.col("target").alias("item_id"))
        found = found.unionByName(step).distinct()
    return found


def graph_statistics(items: DataFrame, tasks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: graphs, mean nodes and edges, edges by type, isolated candidates."""
    graphs = tasks.agg(F.count(F.lit(1)).alias("num_graphs"))
    nodes = items.agg(F.count(F.lit(1)).alias("num_items"))
    by_type = edges.agg(F.count(F.lit(1)).alias("num_edges"), *[F.count(F.when(F.col("edge_type") == t, 1)).alias(f"num_{t}") for t in EDGE_TYPES])
    touched = edges.select("task_id", F.col("source").alias("item_id")).unionByName(edges.select("task_id", F.col("target").alias("item_id"))).distinct()
    isolated = items.select("task_id", "item_id").join(touched, ["task_id", "item_id"], "left_anti").agg(F.count(F.lit(1)).alias("num_isolated"))
    row = graphs.join(nodes).join(by_type).join(isolated)  # one row each
    return row.withColumns(
        {
            "avg_nodes": F.round(F.try_divide(F.col("num_items") + F.col("num_graphs"), F.col("num_graphs")), 6),
            "avg_edges": F.round(F.try_divide("num_edges", "num_graphs"), 6),
        }
    )
