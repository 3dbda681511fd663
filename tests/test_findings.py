"""Faults that were found at size, on tables small enough to see them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spoorline.functions import text as T
from spoorline.llm import hard_negatives
from spoorline.operators import vector_search, within
from spoorline.plans import corpora, registry


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents without candidates, and one whose line has over 100 sentences."""
    path = str(tmp_path_factory.mktemp("tables"))
    many = ". ".join(f"Paris word{k % 7} Seine" for k in range(130))
    rows = [(1, "Only one sentence", "en", "a"), (2, "", "en", "a"), (3, None, "en", "a"), (4, f"{many}\nLyon art. Rhone word3", "en", "b"), (17, many, "fr", "b"), (5, "One two. Three four. Five six. Seven eight", "de", "c")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def against_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = registry.queries()[name](spark, folder)
    want = con.sql(registry.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda rows: sorted(str([None if x != x else x for x in r]) for r in rows)
    return plain(got.select(cols).toPandas().values.tolist()), plain(want[cols].values.tolist())


def test_summary_counts_tasks_without_candidates(spark, folder):
    got, want = against_sql(spark, folder, "pair_summary")
    assert got == want
    assert registry.pair_summary(spark, folder).first().n_tasks == 4


@pytest.mark.parametrize("name", ["record_reasons", "record_items"])
def test_a_planted_place_is_in_no_line(spark, folder, name):
    got, want = against_sql(spark, folder, name)
    assert got == want
    assert {r.error for r in corpora.record_reasons(spark, folder).collect()} >= {"unmapped_fact"}


def test_hard_negatives_write_no_tiles(spark, monkeypatch):
    seen = []
    write = hard_negatives.written
    monkeypatch.setattr(hard_negatives, "written", lambda df: seen.append(df.columns) or write(df))
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5)], k % 3) for k in range(40)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(rows, F.col("vec_id") % 10 == 0).count()
    assert seen and not any("tile" in columns for columns in seen)


def test_nearest_streams_past_blocks_of_queries(spark, monkeypatch):
    for name, n in (("QUERY_ROWS", 5), ("BLOCK_ROWS", 8), ("CELLS", 9), ("STRIDE", 3), ("HELD", 4)):
        monkeypatch.setattr(vector_search, name, n)
    rng = np.random.default_rng(3)
    vecs = rng.integers(-3, 4, (60, 4)).astype(float)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vecs)], "item_id long, vec array<double>")
    found = vector_search.nearest(frame.where("item_id % 4 = 0").selectExpr("item_id as query_id", "vec as q_vec"), frame, 6)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # blocks aren't broadcast
    want = {(q, i, float(vecs[q] @ vecs[i]), r) for q in range(0, 60, 4) for r, i in enumerate(sorted((i for i in range(60) if i != q), key=lambda i: (-(vecs[q] @ vecs[i]), i))[:6], 1)}  # noqa: B023
    assert {tuple(r) for r in found.collect()} == want


def test_helpers_of_a_row_equal_the_columns(spark):
    texts = ["The Red river runs by Old Paris and art 7b of Lyon", "İstanbul and K2's Über-Alps, Kelvin_The x A-b'c  D\n\tE", "", "of the", "é Art Nice ÀB Cd _Ef 9Gh"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.content_tokens("t").alias("c"), T.entities("t").alias("e"), T.title_aliases("t").alias("a"), T.hashed_vector("t").alias("h")).collect()
    for r in rows:
        assert (within.tokens(r.t), within.entities(r.t), within.aliases(r.t)) == (r.c, r.e, r.a)
        own = within.hashed(r.t)
        assert [own.get(d, 0.0) for d in range(within.DIMS)] == r.h
