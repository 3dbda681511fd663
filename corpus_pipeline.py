"""A training corpus from ``documents`` in five stages.

1. ``quality``: importance resampling drops what the labelled good documents don't resemble.
2. ``language``: a byte network drops texts whose language it can't tell (no letters, or under even odds).
3. ``near_duplicates``: documents link whose SimHash fingerprints, found by Golay-code fuzzy hashing, tell a similarity of their 5-word shingles of 0.8 or more; of each component the one with the smallest id stays.
4. ``mixing``: documents are sampled towards target weights of source, language and topic.
5. ``packing``: what is left is tokenised and packed; the result has one row per piece.

Each stage gets (spark, docs, sf_dir); all but the last return the columns of
``documents`` for the documents they keep. ``run`` writes each stage's result
to the shared folder before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoorline.llm import importance, langid, mixing, packing, simhash
from spoorline.llm.common import doc_bucket, read_table, saved, small_batches

#: A document stays if its language has at least this probability.
MIN_LANGUAGE_SCORE = 0.35


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that importance resampling towards the labelled good documents keeps.

    Rows are judged one by one, null ids and repeated rows too; empty texts have
    weight 0. Columns are returned as they came.
    """
    small_batches(spark)
    return importance.keep(docs, read_table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a letter and a language told with ``MIN_LANGUAGE_SCORE`` or more.

    Without any labelled text to learn from only texts without a letter go.
    Columns are returned as they came.
    """
    small_batches(spark)
    model = langid.fit(docs, F.coalesce(doc_bucket("doc_id", 4) != 2, F.lit(True)))
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    told = langid.identify(docs, model, lang_out="__lang", score_out="__score")
    return told.where((F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id; a null id stays only where there is no other."""
    small_batches(spark)
    return simhash.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn towards the target shares; rows of equal id are drawn alike, a null id by its text. Columns are returned as they came."""
    return mixing.draw(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence; a null or empty text is one end token."""
    small_batches(spark)
    return packing.pack(docs, with_ids=False)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
#: No stage but the mixing can be put in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = saved(docs)
    return docs
