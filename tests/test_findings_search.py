"""Fine-tuning at size: ranks of gold candidates over one corpus without a list of the nearest, examples made within the row."""

import random

import numpy as np
import pytest

from spoorline.operators import dense_finetune, evaluate, lexical, pairs, ranking, vector_search
from spoorline.operators.encoder import HashedBag, encoded
from spoorline.plans import learned
from spoorline.plans.tasks import document_tasks

FOLDER = "/root/testdata/sf0.001"


def blocks(spark, queries, items, wanted, size=7):
    """BLOCKS of {id: vector} and (query, item) pairs."""
    names, told = list(queries), []
    score = lambda q, i: round(float(np.dot(queries[q].astype(float), items[i].astype(float))), 6)
    for lo in range(0, len(names), 3):
        own = names[lo : lo + 3]
        asks = [(own.index(q), i, score(q, i)) for q, i in wanted if q in own]
        told.append(vector_search.block(True, own, np.stack([queries[q] for q in own]), tuple(zip(*asks, strict=True)) if asks else ((), (), ())))
    keys = list(items)
    told += [vector_search.block(False, keys[lo : lo + size], np.stack([items[i] for i in keys[lo : lo + size]])) for lo in range(0, len(keys), size)]
    rows = [tuple(c[0].as_py() for c in b.columns) for b in told]
    return spark.createDataFrame([(*r[:3], bytearray(r[3]), *r[4:]) for r in rows], vector_search.BLOCKS)


@pytest.mark.parametrize("k", [1, 4, 60])
def test_ranks_against_brute_force(spark, monkeypatch, k):
    for name, n in (("SAMPLE_BLOCKS", 2), ("CELL_QUERIES", 5), ("CELL_VECTORS", 11), ("BLOCK_ROWS", 7), ("FIRST", 2), ("STRIDE", 5), ("PAIRS", 9)):
        monkeypatch.setattr(vector_search, name, n)
    rng = random.Random(3)
    draw = lambda: np.array([rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)], np.float32)
    queries, items = {f"q{n}": draw() for n in range(14)}, {f"i{n}": draw() for n in range(50)}  # many ties
    items["q1"] = queries["q1"]  # a vector of the query's own id
    wanted = sorted({(q, rng.choice([i for i in items if i[0] == "i"])) for q in queries for _ in range(3) if q != "q5"})
    got = sorted(tuple(r) for r in vector_search.ranks(blocks(spark, queries, items, wanted), 3, k).collect())
    want = []
    for q, i in wanted:
        order = sorted((j for j in items if j != q), key=lambda j: (-round(float(np.dot(queries[q].astype(float), items[j].astype(float))), 6), j))
        if order.index(i) < k:
            want.append((q, i, order.index(i) + 1))
    assert got == sorted(want) and got


def test_what_stands_low_is_settled_by_few_vectors(monkeypatch):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(20_000, 8)).astype(np.float32)
    seen = []
    look = vector_search.Wanted._see
    monkeypatch.setattr(vector_search.Wanted, "_see", lambda self, own, ids, v, *rest: seen.append(len(own) * len(v)) or look(self, own, ids, v, *rest))
    queries = rng.normal(size=(50, 8)).astype(np.float32)
    middle = np.median(queries.astype(float) @ vecs.T.astype(float), 1)
    own = vector_search.Wanted([f"q{n}" for n in range(50)], queries, (list(range(50)), ["x"] * 50, middle.tolist()), 10, 6)
    own.see(np.array([f"i{n}" for n in range(len(vecs))]), vecs)
    assert (own.count >= 10).all() and sum(seen) < 50 * 300  # of 50 * 20,000 pairs


def test_examples_of_rows_equal_those_of_triples(spark):
    own = document_tasks(spark, FOLDER)
    gold, items = learned._of(own.gold, "train"), learned._of(own.items, "train")
    triples = pairs.contrastive_triples(pairs.training_pairs(gold, {"easy_random": pairs.easy_random(items, gold, 1)}), 1)
    told = lambda df: sorted((r.task_id, r.question, r.positive, r.negatives) for r in df.collect())
    want = told(dense_finetune.examples(triples, own.tasks, lexical.ranking_text(own.items)))
    assert told(dense_finetune.examples_within(learned._light(own.rows).where("fold = 'train'"))) == want and want


def test_corpus_metrics_and_rankings_equal_those_over_tables(spark):
    own, bag = document_tasks(spark, FOLDER), HashedBag()
    q = encoded(own.tasks, "question", bag, "q_vec", prefix="query: ").select("task_id", "q_vec")
    v = encoded(lexical.ranking_text(own.items), "ranking_text", bag, prefix="passage: ").select("task_id", "item_id", "vec")
    rows = learned._light(own.rows)
    name = "concat(task_id, '::', item_id) as item_id"
    for fold in ("dev", "test"):
        asked, told = learned._of(q, fold).withColumnRenamed("task_id", "query_id"), learned._of(v, fold).selectExpr(name, "vec")
        found = vector_search.nearest(asked, told, 100).select("query_id", "item_id", "rank")
        want = evaluate.ir_metrics(found, learned._of(own.gold, fold).selectExpr("task_id as query_id", name)).first()
        assert learned.corpus_metrics(rows, bag, fold).first() == want
        assert learned.corpus_metrics(rows, bag, fold, 10).first().mrr_10 == want.mrr_10
    seen = lambda df: sorted((r.task_id, r["rank"], r.item_id, r.score) for r in df.collect())
    items = rows.selectExpr("task_id", "asked", "own as items")
    assert seen(ranking.ranked_within(learned.with_vectors(items, bag))) == seen(ranking.ranked(ranking.dense_scores(q, v)))
