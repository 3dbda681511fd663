"""JSON, JSON lines and CSV, with schemas given and never guessed."""

from __future__ import annotations

import json
import os
import tempfile
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str, lines: bool = False) -> DataFrame:
    """A JSON array (or one object) per file, or an object per line."""
    return spark.read.schema(schema).json(path, multiLine=not lines)


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """With a header; all columns are strings unless a schema says otherwise."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, single_file: bool = False, mode: str = "errorifexists") -> None:
    """Columns that aren't named raise; ``single_file`` is for reports of a few rows."""
    if columns is not None:
        if extra := set(df.columns) - set(columns):
            raise ValueError(f"columns that aren't expected: {sorted(extra)}")
        df = df.select(*columns)
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)


def strict_json(text: str) -> Any:
    """Parse one document; repeated keys raise."""

    def unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        keys = [k for k, _ in pairs]
        if twice := {k for k in keys if keys.count(k) > 1}:
            raise ValueError(f"repeated keys: {sorted(twice)}")
        return dict(pairs)

    return json.loads(text, object_pairs_hook=unique)


def write_document(path: str, value: Any) -> None:
    """A small JSON document on the driver, sorted and replaced in one step."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    fd, temp = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as out:
            json.dump(value, out, sort_keys=True, indent=2, ensure_ascii=False)
            out.write("\n")
            out.flush()
            os.fsync(out.fileno())
        os.replace(temp, path)
    except BaseException:
        if os.path.exists(temp):
            os.unlink(temp)
        raise
