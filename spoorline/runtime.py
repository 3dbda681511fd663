"""Tables kept in the shared folder that a cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where all runs in one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not re.match(r"local(\[.*\])?$", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spoorline-ckpt-"))
    return context.getCheckpointDir()


def kept(df: DataFrame, by: str | tuple[str, ...] | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files, in folders by the column or columns ``by`` if given.

    For what several jobs read: each of them starts from the files, so a lost
    executor costs the reading of its part.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(*([by] if isinstance(by, str) else by))
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
