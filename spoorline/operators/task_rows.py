"""A task in one row: its question and its candidates in order.

A task is one question with its candidates, so a row is as large as one of
those. What works within the row needs no further exchange, whatever number of
rules and scores it combines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"position": "int", "item_id": "string", "title": "string", "source_ref": "string", "group_key": "string", "sequence_index": "int", "text": "string"}
ITEM = "struct<" + ",".join(f"{c}:{t}" for c, t in FIELDS.items()) + ">"


def task_rows(items: DataFrame, tasks: DataFrame) -> DataFrame:
    """(task_id, asked, items): one exchange by task; columns that ``items`` lacks are null, and tasks without candidates have no row."""
    has = set(items.columns)
    item = F.struct(*[(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
    left = items.select("task_id", F.lit(None).cast("string").alias("asked"), item.alias("item"))
    right = tasks.select("task_id", F.col("question").alias("asked"), F.lit(None).cast(ITEM).alias("item"))
    rows = left.unionByName(right).groupBy("task_id").agg(F.max("asked").alias("asked"), F.sort_array(F.collect_list("item")).alias("items"))
    return rows.where(F.size("items") > 0)


def flat(rows: DataFrame, array: Column | str, field: str, *keys: str) -> DataFrame:
    """A row for each struct of an array, told by a field that is never null.

    The outer form, as the other makes the optimizer test the array's size
    further down, where the whole of what the array is made of is computed
    again.
    """
    return rows.select(*keys, F.inline_outer(array)).where(F.col(field).isNotNull())
