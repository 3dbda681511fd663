"""Hard negatives against a plain ranking of all rows, and the registered queries against their SQL."""

import os
import random

import numpy as np
import pytest

import __spark_entry__
from spoorline.llm import hard_negatives, registry
from pyspark.sql import functions as F

SF_DIR = __spark_entry__.SMOKE_DIR


def brute(rows, is_anchor, k=5, m=5):
    good = [(i, np.floor(np.array(v, float) * 256).astype(int), label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, label in good:
        if not is_anchor(i):
            continue
        scored = sorted(((-int(v @ w), j, other) for j, w, other in good if j != i), key=lambda x: x[:2])
        for s, j, other in [x for x in scored if x[2] == label][:k]:
            kept = [(n, t) for t, n, o in scored if o != label and 80 * -s <= 100 * -t <= 100 * -s][:m]
            out += [(i, j, r, n, -s, -t) for r, (n, t) in enumerate(kept, 1)]
    return out


@pytest.mark.parametrize("dims,size", [(1, 2), (5, 3), (40, 64)])
def test_against_brute_force(spark, monkeypatch, dims, size):
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", size)
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 2 * size)
    monkeypatch.setattr(hard_negatives, "CHUNK_DIMS", 4)
    rng = random.Random(dims)
    draw = lambda: [rng.choice([-0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(dims)]
    rows = [(k, draw(), rng.choice([0, 1, 1, 1, 2])) for k in range(60)]
    rows += [(100, [1.0] * dims, None), (101, None, 1), (102, [float("nan")] * dims, 1), (103, [float("inf")] * dims, 0), (None, draw(), 1), (104, [None] * dims, 0), (105, draw(), 9)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, score int")
    got = hard_negatives.mine(frame, F.col("vec_id") % 5 == 0).collect()
    want = brute(rows, lambda i: i % 5 == 0)
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_many_anchors_are_joined_by_block(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BROADCAST_ANCHORS", 0)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 4)
    rows = [(k, [float(k % 7), float(k % 5)], k % 3) for k in range(40)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, hard_negatives.mine(frame, F.lit(True)).collect())) == sorted(brute(rows, lambda i: True))


def test_empty_tables_no_anchors_and_one_label(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.mine(frame, F.lit(True)).collect() == []
    one = spark.createDataFrame([(k, [1.0], 4) for k in range(8)], "vec_id long, embedding array<double>, label int")
    assert hard_negatives.mine(one, F.lit(True)).collect() == [] == hard_negatives.mine(one, F.lit(False)).collect()


def test_repeated_ids_are_candidates_each(spark):
    rows = [(0, [2.0], 3), (0, [1.5], 1), (0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2), (2, [0.9], 2), (3, [1.0], 2)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, hard_negatives.mine(frame, F.col("vec_id") == 0).collect()))
    assert got == [(0, 1, 1, 3, 65536, 65536), (0, 1, 2, 2, 65536, 58880), (0, 1, 3, 2, 65536, 58880)]


def test_products_beyond_floating_point_are_exact():
    a = np.array([[2**40, 3], [-(2**31), 5]])
    assert (hard_negatives.product(a, a[:1] // 2**10) == a @ (a[:1] // 2**10).T).all()
    b = np.array([[2**22 + 1, -7]])
    assert (hard_negatives.product(a, b) == a @ b.T).all()


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{file}'")
    plain = lambda df: df[sorted(df.columns)].astype(object).where(lambda d: d.notna(), "~").astype(str).sort_values(sorted(df.columns)).reset_index(drop=True)
    got = registry.queries()[name](spark, SF_DIR).toPandas()
    want = con.sql(registry.oracle_sql()[name]).df()
    pd.testing.assert_frame_equal(plain(got), plain(want), check_dtype=False)
