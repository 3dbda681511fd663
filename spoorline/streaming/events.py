"""Event streams: windowed counts with late data, for batch tables and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def windowed_counts(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) over tumbling windows; the same plan runs on a stream."""
    rows = events.where("ts is not null").groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_stream(spark: SparkSession, folder: str, watermark: str = "10 minutes") -> DataFrame:
    """Parquet files of a folder as a stream with a watermark on the event time."""
    return spark.readStream.schema(EVENT_SCHEMA).parquet(folder).withWatermark("ts", watermark)
