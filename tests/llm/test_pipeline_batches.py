"""The pipeline's stages hold small batches of texts."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spoorline.llm.common import BATCH_ROWS

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("name", ["quality", "language", "near_duplicates", "packing"])
def test_stages_read_small_batches(spark, tmp_path, name):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id")).alias("text"), F.lit("en").alias("lang"), F.lit("a").alias("source"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.conf.get(NAME)
    stage = dict(corpus_pipeline.STAGES)[name]
    try:
        spark.conf.set(NAME, "10000")
        large = stage(spark, rows, str(tmp_path))
        assert int(spark.conf.get(NAME)) == BATCH_ROWS
        found = sorted(map(str, large.collect()))
        spark.conf.set(NAME, "7")  # a smaller number stays
        small = sorted(map(str, stage(spark, rows, str(tmp_path)).collect()))
        assert spark.conf.get(NAME) == "7"
        assert found and len(small) == len(found) and (name == "packing" or small == found)
    finally:
        spark.conf.set(NAME, before)
