"""Manifests of files by content: digests made by Spark, what changed between two of them, and what is delivered.

Files are read where the executors are; contents never reach the driver. Sizes
are read without contents, so files beyond a limit are listed and never opened.
Files of a folder that the executors mount are read a piece at a time, so that
a task holds ``PIECE`` bytes whatever a file's size; of other file systems a
content is one value of a row.
Empty files hold nothing and aren't listed, as Spark's file sources leave them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that is digested or delivered.
LIMIT = 1 << 30
#: Bytes of a file that are read at once.
PIECE = 1 << 20


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def _relative(path: str) -> F.Column:
    """The part of a file's path behind the folder's, or its name for a file alone."""
    root = F.lit(path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    at = F.instr(F.col("path"), root)
    return F.when(at > 0, F.substr("path", at + F.length(root))).otherwise(F.element_at(F.split("path", "/"), -1))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha256) of local files, each read in pieces."""
    for batch in batches:
        told = []
        for path in batch.column("path").to_pylist():
            digest = hashlib.sha256()
            with open("/" + path.split(":", 1)[1].lstrip("/"), "rb", buffering=0) as file:
                while piece := file.read(PIECE):
                    digest.update(piece)
            told.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(told, pa.string())], names=["path", "sha256"])


def file_digests(spark: SparkSession, path: str, limit: int = LIMIT) -> DataFrame:
    """(file, bytes, sha256) of all files under a path; sha256 is null beyond ``limit``."""
    listed = _listed(spark, path)
    sized = listed.select(_relative(path).alias("file"), F.col("length").alias("bytes"))
    some = listed.select("path").first()
    if some is not None and some.path.startswith("file:"):
        # Dealt by path, so that large files that are listed together are read by several tasks.
        paths = listed.where(F.col("length") <= limit).select("path").repartition(spark.sparkContext.defaultParallelism, "path")
        hashed = paths.mapInArrow(_streamed, "path string, sha256 string").select(_relative(path).alias("file"), "sha256")
    else:
        hashed = listed.where(F.col("length") <= limit).select(_relative(path).alias("file"), F.sha2("content", 256).alias("sha256"))
    return sized.join(hashed, "file", "left")


def tree_digest(files: DataFrame) -> str:
    """One SHA-256 for a manifest: of its lines in order of file. A manifest has a line per file, which is what the driver gets."""
    line = F.concat_ws(" ", F.coalesce("sha256", F.concat(F.lit("size:"), F.col("bytes").cast("string"))), "file")
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("file", line.alias("line")))).getField("line"), "\n").cast("binary"), 256).alias("d")).first().d


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change): added, removed or changed; equal files are left out."""
    both = old.select("file", F.struct("bytes", "sha256").alias("a")).join(new.select("file", F.struct("bytes", "sha256").alias("b")), "file", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return both.select("file", change.alias("change")).where("change is not null")


def verified(files: DataFrame, expected: DataFrame) -> None:
    """Raise unless each file of expected(file, bytes, sha256) is there with that size and digest."""
    bad = changes(expected, files.join(expected.select("file"), "file", "left_semi")).orderBy("file").take(3)
    if bad:
        raise ValueError(f"files that aren't as expected: {[(r.file, r.change) for r in bad]}")


def classified(files: DataFrame, include: Sequence[str], exclude: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """Add status: excluded or unlisted by file name patterns (excluding ones win), too_large, or included."""
    like = lambda patterns: reduce(lambda a, p: a | F.col("file").rlike(p), patterns, F.lit(False))
    status = F.when(like(exclude), "excluded").when(~like(include), "unlisted").when(F.col("bytes") > limit, "too_large").otherwise("included")
    return files.withColumn("status", status)


def provenance(spark: SparkSession, method: str, settings: dict[str, str], inputs: dict[str, str]) -> DataFrame:
    """One row per input of a run: the method, its settings, and the digest of what it read."""
    rows = [(method, name, path, tree_digest(file_digests(spark, path)), dict(settings)) for name, path in sorted(inputs.items())]
    return spark.createDataFrame(rows, "method string, input string, path string, sha256 string, settings map<string,string>")
