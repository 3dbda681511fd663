"""Temporal memory ranking and cleaning of importance scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions.text import min_max, round_half_up



def _task() -> WindowSpec:
    """All candidates of a task. A window needs a session, so it isn't made at import."""
    return W.partitionBy("task_id")


@dataclass(frozen=True)
class MemoryConfig:
    relevance_weight: float = 1.0
    recency_weight: float = 0.0
    importance_weight: float = 0.01
    recency_decay: float = 0.99

    def __post_init__(self) -> None:
        if min(self.relevance_weight, self.recency_weight, self.importance_weight) < 0 or not 0 < self.recency_decay <= 1:
            raise ValueError("weights must not be negative and the decay must be in (0, 1]")


def memory_signals(items: DataFrame, relevance: DataFrame, importance: DataFrame, decay: float) -> DataFrame:
    """(task_id, item_id, relevance, recency, importance), each scaled to 0..1 within its task."""
    keys = ["task_id", "item_id"]
    rows = items.select(*keys, "position").join(relevance.select(*keys, F.col("score").alias("rel")), keys).join(importance.select(*keys, F.col("score").alias("imp")), keys)
    age = F.max("position").over(_task()) - F.col("position")
    rows = rows.withColumn("rec", F.pow(F.lit(decay), age))
    return rows.select(*keys, *[min_max(F.col(c).cast("double"), _task()).alias(n) for c, n in (("rel", "relevance"), ("rec", "recency"), ("imp", "importance"))])


def memory_scores(signals: DataFrame, config: MemoryConfig = MemoryConfig()) -> DataFrame:
    total = config.relevance_weight * F.col("relevance") + config.importance_weight * F.col("importance")
    if config.recency_weight:
        total = total + config.recency_weight * F.col("recency")
    return signals.select("task_id", "item_id", F.round(total, 6).alias("score"))


def cleaned_importance(raw: DataFrame) -> DataFrame:
    """(task_id, item_id, raw, score): levels of a task's distinct raw scores spread over 1..10; one level gives 5."""
    level = F.dense_rank().over(_task().orderBy("raw"))
    rows = raw.withColumn("level", level).withColumn("levels", F.max("level").over(_task()))
    spread = 1 + round_half_up(9.0 * (F.col("level") - 1) / F.nullif(F.col("levels") - 1, F.lit(0)))
    return rows.select("task_id", "item_id", "raw", F.coalesce(spread, F.lit(5)).cast("int").alias("score"))


def distribution(scores: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Count, min, max, mean, median, population deviation and counts of 1..10."""
    s = F.col("score")
    digits = lambda c: F.round(c, 6)
    return scores.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(s).alias("min"),
        F.max(s).alias("max"),
        digits(F.avg(s)).alias("mean"),
        digits(F.median(s)).alias("median"),
        digits(F.stddev_pop(s)).alias("stdev"),
        *[F.count(F.when(s == k, 1)).alias(f"n_{k}") for k in range(1, 11)],
    )


def shard_distribution(scores: DataFrame, tasks_per_shard: int = 40) -> DataFrame:
    """``distribution`` for each run of consecutive tasks."""
    return distribution(scores.withColumn("shard", F.floor(F.col("task_ord") / tasks_per_shard)), ("shard",))


def duplicate_vectors(scores: DataFrame) -> DataFrame:
    """(vector, n_tasks): score vectors that more than one task has."""
    vector = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("item_ord", "score"))), lambda x: x["score"].cast("string")), ",")
    return scores.groupBy("task_id").agg(vector.alias("vector")).groupBy("vector").agg(F.count(F.lit(1)).alias("n_tasks")).where("n_tasks > 1")


def order_violations(cleaned: DataFrame) -> DataFrame:
    """Neighbours in raw order whose cleaned scores fall, or differ although the raw scores are equal."""
    w = _task().orderBy("raw", "item_id")
    step = cleaned.withColumns({"raw0": F.lag("raw").over(w), "score0": F.lag("score").over(w)})
    return step.where((F.col("score") < F.col("score0")) | ((F.col("raw") == F.col("raw0")) & (F.col("score") != F.col("score0"))))
