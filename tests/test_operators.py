"""Golden values of single operators, and small graphs against a plain version."""

import json
import math
import random

import pytest

from pyspark.sql import functions as F
from spoorline.functions import text as T
from spoorline.operators import evaluate, graph, lexical, memory, pairs, ranking, rerank, rgcn, tuning, validate
from spoorline.sources import io, records, splits


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expr.alias("x")).first()["x"]


def test_tokens_entities_aliases(spark):
    assert one(spark, T.content_tokens("t"), t="The Eiffel-Tower is in Paris, by 9 of us42") == ["eiffel", "tower", "paris", "us42"]
    assert one(spark, T.content_tokens("t", F.array(F.lit("x1"))), t="x1 y2 abc") == ["x1", "abc"]
    assert sorted(one(spark, T.title_aliases("t"), t="Eiffel Tower")) == ["eiffel", "eiffel tower", "tower"]
    assert one(spark, T.entities("t"), t="The Eiffel Tower stands. Near Éaux is Lyon") == ["eiffel tower", "near", "lyon"]


def test_idf(spark):
    items = spark.createDataFrame([("t", "m0", None, "paris river")], "task_id string, item_id string, source_ref string, text string")
    tasks = spark.createDataFrame([("t", "paris")], "task_id string, question string")
    got = {r["token"]: r["idf"] for r in lexical.document_frequency(items, tasks).collect()}
    assert got["paris"] == pytest.approx(math.log(3 / 3) + 1) and got["river"] == pytest.approx(math.log(3 / 2) + 1)


def test_scalars(spark):
    assert one(spark, T.round_half_up(F.col("v")), v=2.5) == 3
    assert one(spark, T.folded("t"), t="  Straße \t A ") == "strasse a"
    score = T.support_score(*(F.col(c) for c in "abcde"))
    assert one(spark, score, a="Lyon", b="Lyon lies in France", c="lyon", d="lies in", e="France") == 8 + 4 + 2 + 1
    assert one(spark, T.node_number("t"), t="m12") == 12


def test_digest(spark):
    items = [("m0", 0, "A", 'quote " slash / é \u001f'), ("m1", 1, None, "x")]
    df = spark.createDataFrame([(items,)], "i array<struct<id:string,position:int,source:string,text:string>>")
    import hashlib

    want = json.dumps({"items": [dict(zip(("id", "position", "source", "text"), i)) for i in items]}, ensure_ascii=False, separators=(",", ":"))
    assert df.select(T.content_digest(F.col("i")).alias("x")).first()["x"] == hashlib.sha256(want.encode()).hexdigest()


def ranks(spark, ids, task="t"):
    return spark.createDataFrame([(task, i, float(-k), k + 1) for k, i in enumerate(ids)], "task_id string, item_id string, score double, rank int")


def gold_of(spark, ids, task="t"):
    return spark.createDataFrame([(task, i, k) for k, i in enumerate(ids)], "task_id string, item_id string, ord int")


def edges_of(spark, rows):
    return spark.createDataFrame([("t", s, t, k, float(w), d) for s, t, k, w, d in rows] or [], "task_id string, source string, target string, edge_type string, weight double, directed boolean")


def test_metrics(spark):
    r = evaluate.task_metrics(ranks(spark, ["m2", "m0", "m1"]), gold_of(spark, ["m0", "m1"]), ks=(2, 3, 5, 10)).first()
    assert (r["recall_2"], r["f1_2"], r["full_2"], r["full_3"], r["mrr"]) == (0.5, 0.5, 0.0, 1.0, 0.5)
    assert r["f1_5"] == pytest.approx(0.571429) and r["f1_10"] == pytest.approx(0.333333)


def test_paths_and_connectivity(spark):
    want = spark.createDataFrame([("t", "m0", "m1"), ("t", "m2", "m1")], "task_id string, source string, target string")
    edges = edges_of(spark, [("m0", "m1", "bridge", 1, True), ("m1", "m2", "bridge", 1, True)])
    r = evaluate.path_metrics(ranks(spark, ["m0", "m1", "m2"]), want, edges, 5).first()
    assert (r["edge_recall_5"], r["path_recall_5"]) == (0.5, 0.0)
    hop = spark.createDataFrame([("t", "m0", "m2")], "task_id string, source string, target string")
    assert evaluate.path_metrics(ranks(spark, ["m0", "m1", "m2"]), hop, edges, 5).first()["path_recall_5"] == 1.0
    c = evaluate.connectivity(ranks(spark, ["m0", "m1", "m2"]), gold_of(spark, ["m0", "m2"]), edges, 5).first()
    assert (c["connected_5"], c["query_connected_5"]) == (1.0, 0.0)


def test_memory_scores(spark):
    items = spark.createDataFrame([("t", "m0", 0), ("t", "m1", 1)], "task_id string, item_id string, position int")
    rel = spark.createDataFrame([("t", "m0", 1.0), ("t", "m1", 1.0)], "task_id string, item_id string, score double")
    imp = spark.createDataFrame([("t", "m0", 1), ("t", "m1", 10)], "task_id string, item_id string, score int")
    signals = memory.memory_signals(items, rel, imp, 0.99)
    assert {r["item_id"]: (r["relevance"], r["recency"], r["importance"]) for r in signals.collect()} == {"m0": (0.0, 0.0, 0.0), "m1": (0.0, 1.0, 1.0)}
    config = memory.MemoryConfig(2.0, 3.0, 5.0)
    assert {r["item_id"]: r["score"] for r in memory.memory_scores(signals, config).collect()} == {"m0": 0.0, "m1": 8.0}
    with pytest.raises(ValueError):
        memory.MemoryConfig(recency_decay=0.0)


def test_cleaned_importance(spark):
    raw = spark.createDataFrame([("t", f"m{k}", v) for k, v in enumerate([0.1, 0.9, 0.1, 0.5])] + [("u", "m0", 3.0)], "task_id string, item_id string, raw double")
    got = {(r["task_id"], r["item_id"]): r["score"] for r in memory.cleaned_importance(raw).collect()}
    assert got == {("t", "m0"): 1, ("t", "m1"): 10, ("t", "m2"): 1, ("t", "m3"): 6, ("u", "m0"): 5}
    assert memory.order_violations(memory.cleaned_importance(raw)).count() == 0


def plain_rerank(scores, edges, config):
    """The combined score, from its definition."""
    scale = lambda d: {k: 0.0 if max(d.values()) == min(d.values()) else (v - min(d.values())) / (max(d.values()) - min(d.values())) for k, v in d.items()}
    init = scale(scores)
    near = {}
    for s, t, _, _, directed in edges:
        near.setdefault(s, set()).add(t)
        if not directed:
            near.setdefault(t, set()).add(s)
    allowed = set(sorted(init, key=lambda k: (-init[k], k))[: config.seed_top_s])
    front = set(allowed)
    for _ in range(config.max_hops):
        front = {n for f in front for n in near.get(f, ()) if n != "q"} - allowed
        allowed |= front
    query, num, den, bridge = ({k: 0.0 for k in init} for _ in range(4))
    for s, t, kind, w, directed in edges:
        if s == "q":
            query[t] += w
            continue
        w *= config.neighbor_type_weights[kind]
        for a, b in [(s, t)] + [(t, s)] * (not directed):
            num[b] += init[a] * w
            den[b] += w
            bridge[b] += init[a] * w * (kind == "bridge")
    parts = {"query": query, "neighbor": {k: num[k] / den[k] if den[k] else 0.0 for k in init}, "bridge": bridge}
    parts = {n: scale({k: v if k in allowed else 0.0 for k, v in d.items()}) for n, d in parts.items()}
    return {k: config.lambda_init * init[k] + config.lambda_query * parts["query"][k] + config.lambda_neighbor * parts["neighbor"][k] + config.lambda_bridge * parts["bridge"][k] for k in init}


def test_rerank_on_random_graphs(spark):
    rng = random.Random(1)
    ids = [f"m{k}" for k in range(12)]
    scores = {i: float(rng.randint(0, 5)) for i in ids}
    rows = {}
    for _ in range(25):
        a, b = rng.sample(ids, 2)
        kind = rng.choice(["sequential", "entity_overlap", "bridge"])
        rows[min(a, b), max(a, b), kind] = (min(a, b), max(a, b), kind, rng.randint(1, 4), False)
    edges = [*rows.values(), *[("q", i, "query_overlap", rng.randint(1, 3), True) for i in rng.sample(ids, 4)]]
    frame = spark.createDataFrame([("t", i, s) for i, s in scores.items()], "task_id string, item_id string, score double")
    config = rerank.RerankConfig(seed_top_s=3, max_hops=1)
    got = {r["item_id"]: r["score"] for r in rerank.rerank(frame, edges_of(spark, edges), config).collect()}
    want = plain_rerank(scores, edges, config)
    assert got == pytest.approx(want, abs=1e-6)
    with pytest.raises(ValueError):
        rerank.RerankConfig(lambda_path=0.1)


def test_degree_cap(spark):
    items = spark.createDataFrame([("t", f"m{k}", k, "Paris Seine", f"g{k}", 0, f"Paris text {k}") for k in range(8)], "task_id string, item_id string, position int, source_ref string, group_key string, sequence_index int, text string")
    rows = graph.entity_overlap_edges(items, graph.GraphConfig(max_entity_degree=2)).collect()
    degree = {}
    for r in rows:
        for e in (r["source"], r["target"]):
            degree[e] = degree.get(e, 0) + 1
    assert max(degree.values()) <= 2
    assert [(r["source"], r["target"]) for r in sorted(rows, key=lambda r: (r["source"], r["target"]))] == [("m0", "m1"), ("m0", "m2"), ("m1", "m2"), ("m3", "m4"), ("m3", "m5"), ("m4", "m5"), ("m6", "m7")]


def test_sequential_edges_need_a_step_of_one(spark):
    items = spark.createDataFrame([("t", f"m{k}", k, None, g, s, "x") for k, (g, s) in enumerate([("a", 0), ("a", 1), ("a", 3), ("b", 0)])], "task_id string, item_id string, position int, source_ref string, group_key string, sequence_index int, text string")
    assert [(r["source"], r["target"]) for r in graph.sequential_edges(items).collect()] == [("m0", "m1")]


def test_pairs_and_triples(spark):
    items = spark.createDataFrame([("t", f"m{k}") for k in range(6)], "task_id string, item_id string")
    gold = gold_of(spark, ["m1", "m3"])
    rows = pairs.training_pairs(gold, {"easy_random": pairs.easy_random(items, gold, 1), "hard_bm25": pairs.hard_by_rank(ranks(spark, [f"m{k}" for k in range(6)]).drop("rank"), gold, 1)})
    assert validate.pair_rules(rows, gold).count() == 0
    assert sorted(r["item_id"] for r in rows.where("sample_type = 'hard_bm25'").collect()) == ["m0", "m2"]
    triples = pairs.contrastive_triples(rows, 2).collect()
    assert {(r["positive"], r["negative"]) for r in triples} == {(p, n) for p in ("m1", "m3") for n in ("m0", "m2")}


def test_grid_and_splits():
    grid = tuning.parameter_grid(tuning.RERANK_GRID)
    assert len(grid) == 320 and grid[0]["lambda_query"] == 0.0 and grid[-1]["max_hops"] == 2
    with pytest.raises(ValueError):
        tuning.parameter_grid({"a": [1]}, {"a": 2})
    assert splits.permutation(5, 13) == splits.permutation(5, 13) != list(range(5))
    with pytest.raises(ValueError):
        splits.check_range(10, 8, 3)


ITEMS = "task_id string, item_id string, position int, source_ref string, group_key string, sequence_index int, text string"


def test_graph_neighbours_follow_the_order_of_edges(spark):
    items = spark.createDataFrame([("t", f"m{k}", k, "A", f"g{k % 2}", k // 2, "x") for k in range(8)], ITEMS)
    edges = edges_of(spark, [("m1", "m3", "sequential", 1, False), ("m3", "m5", "sequential", 1, False), ("m2", "m4", "sequential", 1, False), ("m3", "m7", "bridge", 9, False), ("m0", "m3", "entity_overlap", 1, False), ("q", "m3", "query_overlap", 5, True)])
    near = lambda n: [r["item_id"] for r in pairs.graph_neighbours(edges, items, gold_of(spark, ["m3"]), n).orderBy("ord").collect()]
    assert near(2) == ["m1", "m5"] and near(9) == ["m1", "m5", "m0", "m7"]
    assert [r["item_id"] for r in pairs.graph_neighbours(edges, items, gold_of(spark, ["m2", "m3"]), 1).orderBy("ord").collect()] == ["m4", "m1"]


def test_bridges_equal_all_pairs(spark):
    rng = random.Random(3)
    words = ["paris", "seine", "lyon", "rhone", "art", "start", "Alps", "Nice"]
    rows = [("t", f"m{k}", k, " ".join(rng.sample(words, 2)) if k % 4 else None, f"g{k % 3}" if k % 5 else None, k, " ".join(rng.choices(words, k=4))) for k in range(14)]
    items = spark.createDataFrame(rows, ITEMS)
    alias = {r["item_id"]: (r["a"] or [], r["e"] or []) for r in items.select("item_id", T.title_aliases("source_ref").alias("a"), F.array_union(T.entities(F.concat_ws(". ", "source_ref", "text")), F.coalesce(T.title_aliases("source_ref"), F.array().cast("array<string>"))).alias("e")).collect()}
    want = {}
    for a in rows:
        for b in rows:
            if a[2] < b[2] and (a[4] or a[3]) != (b[4] or b[3]):
                mentions = sum(x in b[6].lower() for x in alias[a[1]][0]) + sum(x in a[6].lower() for x in alias[b[1]][0])
                both = set(alias[a[1]][1]) & set(alias[b[1]][1]) if a[3] and b[3] else set()
                if mentions + len(both):
                    want[a[1], b[1]] = mentions + len(both)
    got = {(r["source"], r["target"]): r["weight"] for r in graph.bridge_edges(items, graph.GraphConfig(max_bridge_edges=1000)).collect()}
    assert got == want and want


def test_objective_and_choice(spark):
    scored = spark.createDataFrame([(c, "t", f"m{k}", s) for c, order in ((0, "0123"), (1, "3210")) for k, s in ((int(i), float(9 - n)) for n, i in enumerate(order))] + [(0, "u", "m0", 1.0)], "config_id int, task_id string, item_id string, score double")
    edges = edges_of(spark, [("m0", "m1", "sequential", 1, False), ("m3", "m1", "bridge", 1, True), ("q", "m0", "query_overlap", 1, True)])
    got = {r["config_id"]: r.asDict() for r in tuning.with_objective(tuning.evaluated(scored, gold_of(spark, ["m0", "m3"]), edges)).collect()}
    assert got[0] == {"config_id": 0, "full_5": 1.0, "recall_5": 1.0, "full_10": 1.0, "mrr": 1.0, "connected_10": 1.0, "avg_edges": 2.0, "objective": 1.0}
    apart = tuning.with_objective(tuning.evaluated(scored, gold_of(spark, ["m0", "m2"]), edges, subgraph=False)).orderBy("config_id").first()
    assert (apart["connected_10"], apart["objective"], apart["avg_edges"]) == (0.0, 0.8, 0.0)
    rows = spark.createDataFrame([(0, 0.8, 1.0, 5.0), (1, 0.8, 1.0, 4.0), (2, 0.8, 1.0, 4.0), (3, 0.8, 0.5, 0.0)], "config_id int, objective double, full_10 double, avg_edges double")
    assert tuning.selected(rows).first()["config_id"] == 1
    one_gold = evaluate.connected_evidence(ranks(spark, ["m0", "m1", "m3"]), gold_of(spark, ["m0", "m3"]), edges, 2).first()
    assert (one_gold["connected_2"], one_gold["edges_2"]) == (0.0, 1)


def test_hashed_vectors(spark):
    v = one(spark, T.hashed_vector("t", 8), t="paris paris lyon")
    assert len(v) == 8 and sum(x * x for x in v) == pytest.approx(1.0)
    assert one(spark, T.hashed_vector("t", 8), t="of the") == [0.0] * 8


RAW = {
    "_id": "1", "question": "Where?", "answer": "x", "type": "compositional",
    "context": [["Eiffel Tower", ["The tower is in Paris.", "It is tall."]], ["Paris", ["Paris lies on the Seine.", "Big."]]],
    "supporting_facts": [["Eiffel Tower", 0], ["Paris", 0]],
    "evidences": [["Eiffel Tower", "city", "Paris"], ["Paris", "river", "Seine"]],
}


def test_records(spark, tmp_path):
    bad = dict(RAW, _id="2", question=" ")
    (tmp_path / "raw.json").write_text(json.dumps([RAW, bad]))
    raw = io.read_json(spark, str(tmp_path / "raw.json"), records.RAW_TRIPLES_SCHEMA)
    rows = records.parsed(raw, "2wiki", triples=True)
    assert {r["error"]: r["n"] for r in records.invalid_reasons(rows).collect()} == {"question": 1}
    tasks, items, gold = records.converted(rows)
    assert [r["item_id"] for r in gold.orderBy("ord").collect()] == ["m0", "m2"]
    assert [(r["source"], r["target"]) for r in records.dependency_edges(rows, items, gold).collect()] == [("m0", "m2")]
    assert records.unmapped(rows, items).count() == 0 and tasks.count() == 1
    with pytest.raises(ValueError):
        io.strict_json('{"a": 1, "a": 2}')
    assert validate.leaked_fields(rows.schema) == ["answer", "evidences"]
    assert validate.leaked_fields(items.schema) == []


def test_message_edges(spark):
    edges = edges_of(spark, [("m0", "m1", "sequential", 1, False), ("q", "m0", "query_overlap", 2, True)])
    rows = {(r["source"], r["target"], r["relation"]): r["norm"] for r in rgcn.message_edges(edges).collect()}
    assert rows == {("m0", "m1", "sequential_forward"): 1.0, ("m1", "m0", "sequential_reverse"): 1.0, ("q", "m0", "query_overlap_forward"): 1.0}


def test_workflow(tmp_path):
    from spoorline import workflow as w

    assert w.merged({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    assert w.train_order(["dense_ft_rgcn_graph_retriever"]) == ["dense_ft", "dense_ft_rgcn_graph_retriever"]
    assert w.stages_of("bm25") == ["prepare", "retrieve", "evaluate", "aggregate"]
    with pytest.raises(ValueError):
        w.structured(rerank.RerankConfig, {"type_weights": {}})
    ran = []
    flow = w.Workflow(str(tmp_path), [w.Stage("a", lambda: ran.append("a")), w.Stage("b", lambda: ran.append("b"))])
    assert flow.run() == ["a", "b"] and flow.run() == []
    flow.stages[1] = w.Stage("b", lambda: ran.append("b2"), config={"x": 1})
    assert flow.run() == ["b"] and ran == ["a", "b", "b2"]
    w.init_manifest(str(tmp_path / "m.json"), {"x": 1})
    with pytest.raises(ValueError):
        w.init_manifest(str(tmp_path / "m.json"), {"x": 2})


def test_event_stream(spark, tmp_path):
    from spoorline.streaming.events import event_stream, windowed_counts

    rows = spark.createDataFrame([(k, f"2024-01-01 0{k % 3}:10:00", 1, "a", 1.0, "{}") for k in range(9)], "event_id bigint, t string, user_id bigint, event_type string, value double, props string")
    rows.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", "event_type", "value", "props").write.parquet(str(tmp_path / "e"))
    query = windowed_counts(event_stream(spark, str(tmp_path / "e"))).writeStream.outputMode("complete").format("memory").queryName("ev").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r["n"] for r in spark.sql("select n from ev").collect()] == [3, 3, 3]
