"""Wide metric tables: methods with unequal columns side by side, cut into reports, and ablations looked up by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed columns of the three reports, by the metric names in use here.
MAIN = ("recall_2", "recall_5", "recall_10", "f1_5", "f1_10", "full_5", "full_10", "mrr")
PATHS = ("connected_5", "connected_10", "query_connected_10", "edge_recall_10", "path_recall_10")
EFFICIENCY = ("avg_edges", "input_tokens", "index_build_time", "graph_construction_time")
REPORTS = {"main": MAIN, "path": PATHS, "efficiency": EFFICIENCY}
#: How a value that a method doesn't have is written.
MISSING = "N/A"


def side_by_side(tables: Mapping[str, DataFrame], key: str = "method") -> DataFrame:
    """Rows of all tables with all of their columns; what a table lacks is null. A table's name fills ``key`` where it has no such column."""
    named = [t if key in t.columns else t.select(F.lit(name).alias(key), "*") for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def report(table: DataFrame, kind: str, keys: Sequence[str] = ("method",)) -> DataFrame:
    """The columns of one report; metrics that no method has are null."""
    if kind not in REPORTS:
        raise ValueError(f"unknown report {kind}; known: {sorted(REPORTS)}")
    has = set(table.columns)
    return table.select(*keys, *[(F.col(c) if c in has else F.lit(None)).cast("double").alias(c) for c in REPORTS[kind]])


def rendered(table: DataFrame, keys: Sequence[str] = ("method",), digits: int = 4) -> DataFrame:
    """Numbers as text, for sinks; null becomes N/A."""
    show = lambda c: F.coalesce(F.format_string(f"%.{digits}f", F.col(c).cast("double")), F.lit(MISSING)).alias(c)
    number = lambda c: F.when(F.col(c).isNull(), F.lit(MISSING)).otherwise(show(c))
    return table.select(*keys, *[number(c).alias(c) for c in table.columns if c not in keys])


def tall(table: DataFrame, keys: Sequence[str] = ("method",)) -> DataFrame:
    """(keys, metric, value), a row for each value that is there."""
    values = [c for c in table.columns if c not in keys]
    return table.select(*keys, *[F.col(c).cast("double").alias(c) for c in values]).unpivot(list(keys), values, "metric", "value").where("value is not null")


def by_metric(table: DataFrame, methods: Sequence[str], key: str = "method") -> DataFrame:
    """(metric, a column for each method): the table turned over."""
    return tall(table, (key,)).groupBy("metric").pivot(key, list(methods)).agg(F.first("value"))


def differences(table: DataFrame, base: str, key: str = "method") -> DataFrame:
    """(method, metric, value, change): how far each method is from ``base`` on the metrics that both have."""
    rows = tall(table, (key,))
    own = rows.where(F.col(key) == base).select("metric", F.col("value").alias("base"))
    return rows.join(F.broadcast(own), "metric").select(key, "metric", "value", F.round(F.col("value") - F.col("base"), 6).alias("change"))


def chosen(table: DataFrame, index: DataFrame, wanted: Sequence[tuple[str, str]]) -> DataFrame:
    """Rows of ``table`` for wanted (method, ablation) pairs, in that order, through index(method, ablation, run).

    A pair that the index doesn't have, or whose run has no metrics, raises.
    """
    asked = table.sparkSession.createDataFrame([(k, m, a) for k, (m, a) in enumerate(wanted)], "place int, method string, ablation string")
    found = asked.join(index.select("method", "ablation", "run"), ["method", "ablation"], "left")
    if lost := found.where("run is null").orderBy("place").take(3):
        raise ValueError(f"not in the index: {[(r.method, r.ablation) for r in lost]}")
    rows = found.join(table.drop("method"), "run", "left_anti")
    if lost := rows.orderBy("place").take(3):
        raise ValueError(f"no metrics for runs {[r.run for r in lost]}")
    return found.join(table.drop("method"), "run").select("place", "method", "ablation", "run", *[c for c in table.columns if c not in ("method", "run")])


def means(metrics: DataFrame, paths: DataFrame | None, extra: Mapping[str, Column], keys: Sequence[str] = ("method",)) -> DataFrame:
    """One row per method: means of ranking metrics, of path metrics where a task has them (null where none has), and further columns."""
    names = [c for c in metrics.columns if c not in (*keys, "task_id", "n_gold")]
    out = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tasks"), *[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(c) for c in names])
    if paths is not None:
        own = [c for c in paths.columns if c not in (*keys, "task_id")]
        out = out.join(paths.groupBy(*keys).agg(*[F.round(F.avg(c), 6).alias(c) for c in own]), list(keys), "left")
    return out.withColumns(dict(extra)) if extra else out
