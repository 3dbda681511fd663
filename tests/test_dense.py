"""Encoder interface, vector search by blocks and dense fine-tuning."""

import random
import sys
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark import cloudpickle

from spoorline.operators import dense_finetune, encoder, vector_search
from spoorline.operators.dense_finetune import FinetuneConfig, finetune, ranking_gradient
from spoorline.operators.encoder import HashedBag, checked, encoded

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import test modules


@dataclass
class Lengths:
    """An encoder that tells a text's length, and breaks on request."""

    dims: int = 2
    fault: str = ""
    most: int = 3

    def open(self):
        def run(texts):
            if len(texts) > self.most:
                raise AssertionError("a batch is too long")
            out = np.array([[len(t), 1.0] for t in texts]).reshape(-1, 2)
            return {"": out, "rows": out[1:], "dims": out[:, :1], "flat": out.ravel(), "nan": out * np.nan}[self.fault]

        return run


def test_texts_and_lists_are_encoded_in_batches(spark):
    rows = [(1, "abc", ["a", None, "abcd"]), (2, None, []), (3, "", None), (4, "xy", ["q"] * 7)]
    df = spark.createDataFrame(rows, "id int, text string, many array<string>").coalesce(1)
    got = {r.id: r.vec for r in encoded(df, "text", Lengths(), prefix="p:", batch_size=3, normalise=False).collect()}
    assert got == {1: [5.0, 1.0], 2: [2.0, 1.0], 3: [2.0, 1.0], 4: [4.0, 1.0]}
    many = {r.id: r.vec for r in encoded(df, "many", Lengths(), batch_size=3, normalise=False).collect()}
    assert many == {1: [[1.0, 1.0], [0.0, 1.0], [4.0, 1.0]], 2: [], 3: None, 4: [[1.0, 1.0]] * 7}
    one = encoded(df, "text", Lengths(), batch_size=2).where("id = 1").first().vec
    assert sum(x * x for x in one) == pytest.approx(1)
    assert encoded(df.limit(0), "text", Lengths()).collect() == []
    with pytest.raises(ValueError):
        encoded(df, "text", Lengths(), out_col="many")


@pytest.mark.parametrize("fault", ["rows", "dims", "flat", "nan"])
def test_bad_shapes_raise(spark, fault):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    with pytest.raises(Exception, match="an encoder"):
        encoded(df, "text", Lengths(fault=fault)).collect()
    with pytest.raises(ValueError):
        checked(np.zeros((2, 3)), 2, 4)


def test_bag_places_against_a_plain_count():
    bag = HashedBag(dims=4, buckets=101)
    texts = ["Hello", "", "ä b", "x" * 50]
    places, offsets = bag.places(texts)

    def code(gram):
        x = len(gram)
        for b in gram:
            x = (x * 0x100000001B3) % 2**64 ^ b
        x ^= x >> 29
        return (x * 0x9E3779B97F4A7C15 % 2**64 >> 20) % 101

    for k, text in enumerate(texts):
        raw = b" " + text.lower().encode() + b" "
        want = sorted(code(raw[i : i + n]) for n in encoder.GRAMS for i in range(len(raw) - n + 1))
        assert sorted(places[offsets[k] : offsets[k + 1]].tolist()) == want
    sums = encoder.bag_sums(bag.weights(), places, offsets)
    assert np.allclose(sums[0], bag.weights()[places[: offsets[1]]].sum(0)) and (sums[1] == 0).all()


def test_long_texts_are_added_in_parts(monkeypatch):
    bag = HashedBag(dims=3, buckets=50)
    places, offsets = bag.places(["abc def ghi " * 20, "", "zz top"])
    whole = encoder.bag_sums(bag.weights(), places, offsets)
    monkeypatch.setattr(encoder, "STRIDE", 7)
    assert np.allclose(whole, encoder.bag_sums(bag.weights(), places, offsets))


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "QUERY_ROWS", 3)
    monkeypatch.setattr(vector_search, "BLOCK_ROWS", 7)
    rng = random.Random(1)
    vecs = [(k, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for k in range(40)]
    base = spark.createDataFrame([*vecs, (None, [1.0] * 4), (99, None)], "item_id long, vec array<float>")
    asks = base.where("item_id % 5 = 0").selectExpr("item_id as query_id", "vec as q_vec")
    got = sorted((r.query_id, r["rank"], r.item_id, r.score) for r in vector_search.nearest(asks, base, 6).collect())
    want = []
    for q, v in vecs:
        if q % 5 == 0:
            scored = sorted((-round(float(np.dot(v, w)), 6), j) for j, w in vecs if j != q)[:6]
            want += [(q, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    assert got == sorted(want)
    few = vector_search.nearest(asks.where("query_id = 0"), base.where("item_id < 3"), 10)
    assert [r.item_id for r in few.orderBy("rank").collect()] and few.count() == 2
    assert vector_search.nearest(asks.limit(0), base, 3).collect() == []


def test_ranking_gradient_equals_numeric_one():
    rng = random.Random(2)
    draw = lambda: [rng.randrange(12) for _ in range(rng.randrange(1, 6))]
    batch = [{"task_id": f"t{k // 2}", "asked": draw(), "positive": draw(), "negatives": [draw() for _ in range(k % 3)]} for k in range(6)]
    table = np.random.default_rng(3).normal(0, 1, (12, 3))
    loss, rows, gradient = ranking_gradient(table, batch, 3.0)
    assert loss > 0
    for k, row in enumerate(rows):
        for d in range(3):
            moved = [table.copy(), table.copy()]
            moved[0][row, d] += 1e-6
            moved[1][row, d] -= 1e-6
            up, down = (ranking_gradient(t, batch, 3.0)[0] for t in moved)
            assert gradient[k, d] == pytest.approx((up - down) / 2e-6, abs=1e-5, rel=1e-4)


@pytest.fixture(scope="module")
def world(spark):
    """Questions and evidence share a topic's letters, never a word."""
    rng = random.Random(5)
    sets = ["abcde", "fghij", "klmno", "pqrst", "uvwxy"]
    say = lambda k, n: " ".join("".join(rng.choice(sets[k]) for _ in range(5)) for _ in range(n))
    rows = [(f"t{i:03}", say(i % 5, 6), say(i % 5, 6), [say((i + 1) % 5, 6)]) for i in range(300)]
    return spark.createDataFrame(rows, "task_id string, question string, positive string, negatives array<string>"), sets, say


def test_finetuning_learns_topics(spark, world):
    rows, sets, say = world
    dev = [(k, say(k, 6), say(k, 6)) for k in range(5) for _ in range(8)]

    def measure(bag):
        run = bag.open()
        q, p = encoder.unit(run([x[1] for x in dev])), encoder.unit(run([x[2] for x in dev]))
        same = np.array([x[0] for x in dev])
        return float((same[np.argmax(q @ p.T, 1)] == same).mean())

    bag = HashedBag(dims=16, buckets=2048)
    result = finetune(rows, bag, measure, FinetuneConfig(epochs=3, steps=2, rate=0.1))
    assert result.best_epoch > 0 and measure(result.encoder) > measure(bag) and measure(result.encoder) > 0.9
    assert result.history[0]["epoch"] == 0 and result.history[-1]["train_loss"] < result.history[1]["train_loss"]
    again = finetune(rows, bag, measure, FinetuneConfig(epochs=3, steps=2, rate=0.1))
    assert (again.encoder.weights() == result.encoder.weights()).all()


def test_the_baseline_stays_without_improvement(spark, world):
    bag = HashedBag(dims=4, buckets=64)
    result = finetune(world[0].limit(20), bag, lambda _: 0.5, FinetuneConfig(epochs=1, steps=1))
    assert result.best_epoch == 0 and result.encoder is bag
    none = finetune(world[0].limit(0), bag, lambda _: 0.0, FinetuneConfig(epochs=1, steps=2))
    assert none.best_epoch == 0
    for bad in ({"batch": 1}, {"scale": 0}, {"epochs": 0}):
        with pytest.raises(ValueError):
            FinetuneConfig(**bad)


def test_examples_from_triples(spark):
    triples = spark.createDataFrame([("t", "m0", "m2"), ("t", "m0", "m1"), ("u", "m0", None)], "task_id string, positive string, negative string")
    tasks = spark.createDataFrame([("t", "Q?"), ("u", "R?")], "task_id string, question string")
    items = spark.createDataFrame([(t, f"m{k}", f"text {t}{k}") for t in "tu" for k in range(3)], "task_id string, item_id string, ranking_text string")
    got = {r.task_id: r for r in dense_finetune.examples(triples, tasks, items).collect()}
    assert got["t"].question == "Q?" and got["t"].positive == "text t0" and got["t"].negatives == ["text t1", "text t2"] and got["u"].negatives == []
