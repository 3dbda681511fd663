"""The registry's queries in DuckDB SQL, from common table expressions."""

from __future__ import annotations

from ..functions.text import STOP_WORDS
from .tasks import CONVERSATION_SQL, DOCUMENT_SQL, GOLD_SQL

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_NOT_WORD = r"(?:^|[^\p{L}\p{N}_])"
_PHRASE = _NOT_WORD + r"([A-Z][A-Za-z0-9''_-]*(?:\s+[A-Z][A-Za-z0-9''_-]*)*)"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({_STOP}))"


def normal(x: str) -> str:
    return f"array_to_string({tokens(x)}, ' ')"


def entities(x: str) -> str:
    return f"list_distinct(list_filter(list_transform(regexp_extract_all({x}, '{_PHRASE}', 1), lambda p: {normal('p')}), lambda e: e <> ''))"


def aliases(x: str) -> str:
    return f"list_distinct(list_filter(list_concat([{normal(x)}], {tokens(x)}), lambda e: e <> ''))"


def scaled(x: str, over: str = "PARTITION BY task_id") -> str:
    return f"CASE WHEN max({x}) OVER ({over}) = min({x}) OVER ({over}) THEN 0.0 ELSE ({x} - min({x}) OVER ({over})) / (max({x}) OVER ({over}) - min({x}) OVER ({over})) END"


OVERLAP = f"""
docs_of AS (SELECT task_id, concat_ws('. ', source_ref, text) AS t FROM items UNION ALL SELECT task_id, question FROM tasks),
idf AS (SELECT task_id, token, df, ln((n + 1) / (df + 1)) + 1.0 AS idf
        FROM (SELECT task_id, token, count(*) AS df FROM (SELECT task_id, unnest(list_distinct({tokens('t')})) AS token FROM docs_of) GROUP BY ALL) JOIN (SELECT task_id, count(*) AS n FROM docs_of GROUP BY ALL) USING (task_id)),
feats AS (SELECT task_id, item_id, list_intersect(list_distinct({tokens("concat_ws('. ', source_ref, text)")}), list_distinct({tokens('question')})) AS shared,
                 len(list_filter({aliases('source_ref')}, lambda a: contains(lower(question), a) AND contains(lower(concat_ws('. ', source_ref, text)), a))) AS n_aliases,
                 len(list_intersect(list_distinct(list_concat({entities("concat_ws('. ', source_ref, text)")}, {aliases('source_ref')})), {entities('question')})) AS common
          FROM items JOIN tasks USING (task_id)),
overlap AS (SELECT f.task_id, f.item_id, round(coalesce(s, 0) + 1.5 * n_aliases + 2.0 * common, 6) AS score FROM feats f
            LEFT JOIN (SELECT task_id, item_id, sum(idf) AS s FROM (SELECT task_id, item_id, unnest(shared) AS token FROM feats) JOIN idf USING (task_id, token) GROUP BY ALL) USING (task_id, item_id))"""

BM25 = f"""
sized AS (SELECT task_id, item_id, {tokens("coalesce(title, '') || '. ' || text")} AS toks FROM items),
totals AS (SELECT task_id, count(*) AS n, avg(len(toks)) AS avgdl FROM sized GROUP BY ALL),
tf AS (SELECT task_id, item_id, token, dl, count(*) AS tf FROM (SELECT task_id, item_id, len(toks) AS dl, unnest(toks) AS token FROM sized) GROUP BY ALL),
bidf AS (SELECT task_id, token, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT task_id, token, count(*) AS df FROM tf GROUP BY ALL) JOIN totals USING (task_id)),
lowest AS (SELECT task_id, avg(raw) AS mean FROM bidf GROUP BY ALL),
asked AS (SELECT task_id, token, count(*) AS qf FROM (SELECT task_id, unnest({tokens('question')}) AS token FROM tasks) GROUP BY ALL),
hits AS (SELECT task_id, item_id, sum(qf * (CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s
         FROM tf JOIN asked USING (task_id, token) JOIN bidf USING (task_id, token) JOIN lowest USING (task_id) JOIN totals USING (task_id) GROUP BY ALL),
scores AS (SELECT task_id, item_id, round(coalesce(s, 0), 6) AS score FROM items LEFT JOIN hits USING (task_id, item_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM scores)"""


def task_metrics(source: str, keys: str = "task_id", rounded: bool = True) -> str:
    ks = (2, 5, 10)
    cut = (lambda x: f"round({x}, 6)") if rounded else (lambda x: x)
    cols = ", ".join(
        f"{cut(f'h{k} / n_gold')} AS recall_{k}, {cut(f'2.0 * h{k} / (n_gold + {k})')} AS f1_{k}, CAST(h{k} = n_gold AS DOUBLE) AS full_{k}" for k in ks
    )
    on = " AND ".join(f"r.{k} = e.{k}" for k in keys.split(", "))
    group = ", ".join(f"e.{k}" for k in keys.split(", "))
    counts = ", ".join(f"count(CASE WHEN g.item_id IS NOT NULL AND r.rank <= {k} THEN 1 END) AS h{k}" for k in ks)
    return f"""
total AS (SELECT task_id, count(*) AS n_gold FROM gold GROUP BY ALL),
every AS (SELECT DISTINCT {keys} FROM {source}),
metrics AS (SELECT {keys}, n_gold, {cols}, {cut('coalesce(1.0 / first, 0.0)')} AS mrr
  FROM (SELECT {group}, n_gold, {counts}, min(CASE WHEN g.item_id IS NOT NULL THEN r.rank END) AS first
        FROM every e JOIN total t ON t.task_id = e.task_id JOIN {source} r ON {on} LEFT JOIN gold g ON g.task_id = r.task_id AND g.item_id = r.item_id GROUP BY {group}, n_gold))"""


METRIC_NAMES = [f"{m}_{k}" for k in (2, 5, 10) for m in ("recall", "f1", "full")] + ["mrr"]
MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRIC_NAMES)

SEQUENTIAL = """
sequential AS (SELECT task_id, source, target, 'sequential' AS edge_type, 1.0::DOUBLE AS weight, false AS directed FROM (
  SELECT task_id, item_id AS source, lead(item_id) OVER w AS target, lead(sequence_index) OVER w - sequence_index AS step FROM items
  WINDOW w AS (PARTITION BY task_id, group_key ORDER BY sequence_index, position)) WHERE step = 1)"""
QUERY_OVERLAP = """
query_overlap AS (SELECT task_id, 'q' AS source, item_id AS target, 'query_overlap' AS edge_type, CAST(score AS DOUBLE) AS weight, true AS directed FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS r FROM overlap WHERE score > 0) WHERE r <= 20)"""
PAIRS = f"""
ents AS (SELECT task_id, item_id, position, unnest(list_distinct(list_concat({entities("concat_ws('. ', source_ref, text)")}, {aliases('source_ref')}))) AS entity FROM items),
shared AS (SELECT a.task_id, a.item_id AS source, b.item_id AS target, count(*) AS weight FROM ents a JOIN ents b ON a.task_id = b.task_id AND a.entity = b.entity AND a.position < b.position GROUP BY ALL)"""
BRIDGE = f"""
alias_of AS (SELECT task_id, item_id, position, group_key, {aliases('source_ref')} AS al, lower(text) AS low FROM items),
bridging AS (SELECT a.task_id, a.item_id AS source, b.item_id AS target, len(list_filter(a.al, lambda x: contains(b.low, x))) + len(list_filter(b.al, lambda x: contains(a.low, x))) AS mention
             FROM alias_of a JOIN alias_of b ON a.task_id = b.task_id AND a.position < b.position AND a.group_key IS DISTINCT FROM b.group_key),
bridge AS (SELECT task_id, source, target, 'bridge' AS edge_type, CAST(weight AS DOUBLE) AS weight, false AS directed FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY weight DESC, source, target) AS r FROM (
    SELECT b.task_id, b.source, b.target, mention + coalesce(s.weight, 0) AS weight FROM bridging b LEFT JOIN shared s USING (task_id, source, target)) WHERE weight > 0) WHERE r <= 50)"""
EDGES_ONLY = "edges AS (SELECT * FROM sequential UNION ALL SELECT * FROM query_overlap UNION ALL SELECT * FROM bridge)"
WALK = """
walk AS (SELECT task_id, source, target, edge_type, weight FROM edges UNION ALL SELECT task_id, target, source, edge_type, weight FROM edges WHERE NOT directed)"""

EDGES = f"{EDGES_ONLY},{WALK}"
FULL_EDGES = f"{EDGES_ONLY.replace('edges AS (', 'edges AS (SELECT * FROM entity_overlap UNION ALL ')},{WALK}"


def doc(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join((DOCUMENT_SQL, GOLD_SQL, *parts)) + "\n"


def conv(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join((CONVERSATION_SQL, GOLD_SQL, *parts)) + "\n"


GRAPH = (OVERLAP, BM25, SEQUENTIAL, QUERY_OVERLAP, PAIRS, BRIDGE, EDGES)


def hashed_vector(x: str, dims: int = 64) -> str:
    """Counts of tokens by hashed place."""
    places = f"list_transform({tokens(x)}, lambda t: CAST('0x' || substr(md5(t), 1, 6) AS BIGINT) % {dims})"
    return f"list_transform(range({dims}), lambda d: CAST(len(list_filter({places}, lambda p: p = d)) AS DOUBLE))"


DENSE = f"""
qv AS (SELECT task_id, {hashed_vector('question')} AS q FROM tasks),
pv AS (SELECT task_id, item_id, {hashed_vector("coalesce(title, '') || '. ' || text")} AS v FROM items),
scores AS (SELECT task_id, item_id, round(coalesce(list_dot_product(q, v) / nullif(sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v)), 0.0), 0.0), 6) AS score FROM pv JOIN qv USING (task_id)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM scores)"""


def expanded(top_s: int, hops: int, name: str = "allowed") -> str:
    """Seeds by scaled score and everything within some hops."""
    steps = [f"{name}0 AS (SELECT task_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY norm DESC, item_id) AS r FROM seeds) WHERE r <= {top_s})"]
    for k in range(hops):
        steps.append(f"{name}{k + 1} AS (SELECT * FROM {name}{k} UNION SELECT w.task_id, w.target FROM {name}{k} a JOIN walk w ON w.task_id = a.task_id AND w.source = a.item_id WHERE w.source <> 'q' AND w.target <> 'q')")
    return ",\n".join(steps) + f",\n{name} AS (SELECT * FROM {name}{hops})"


SEEDS = f"seeds AS (SELECT task_id, item_id, {scaled('score')} AS norm FROM scores)"


def components(name: str, allowed: str) -> str:
    return f"""
{name}_raw AS (SELECT s.task_id, s.item_id, s.norm,
  CASE WHEN a.item_id IS NULL THEN 0.0 ELSE coalesce(q.x, 0.0) END AS query, CASE WHEN a.item_id IS NULL THEN 0.0 ELSE coalesce(f.neighbor, 0.0) END AS neighbor,
  CASE WHEN a.item_id IS NULL THEN 0.0 ELSE coalesce(f.bridge, 0.0) END AS bridge
  FROM seeds s LEFT JOIN {allowed} a USING (task_id, item_id)
  LEFT JOIN (SELECT task_id, target AS item_id, sum(weight) AS x FROM edges WHERE source = 'q' GROUP BY ALL) q USING (task_id, item_id)
  LEFT JOIN (SELECT w.task_id, w.target AS item_id, sum(n.norm * w.w) / sum(w.w) AS neighbor, sum(CASE WHEN w.edge_type = 'bridge' THEN n.norm * w.w END) AS bridge
             FROM (SELECT *, weight * CASE edge_type WHEN 'sequential' THEN 0.3 WHEN 'entity_overlap' THEN 0.7 WHEN 'bridge' THEN 1.0 ELSE 0.0 END AS w FROM walk WHERE source <> 'q' AND target <> 'q') w
             JOIN seeds n ON n.task_id = w.task_id AND n.item_id = w.source WHERE w.w > 0 GROUP BY ALL) f USING (task_id, item_id)),
{name} AS (SELECT task_id, item_id, norm AS init, {scaled('query')} AS query, {scaled('neighbor')} AS neighbor, {scaled('bridge')} AS bridge FROM {name}_raw)"""


RERANK = ",".join((SEEDS, expanded(30, 2), components("parts", "allowed"), "reranked AS (SELECT task_id, item_id, round(init + 0.1 * query + 0.2 * neighbor + 0.1 * bridge, 6) AS score FROM parts)"))
CLEANED = """
cleaned AS (SELECT task_id, item_id, raw, CAST(CASE WHEN levels = 1 THEN 5 ELSE 1 + floor(9.0 * (level - 1) / (levels - 1) + 0.5) END AS INTEGER) AS score
            FROM (SELECT *, max(level) OVER (PARTITION BY task_id) AS levels FROM (SELECT *, dense_rank() OVER (PARTITION BY task_id ORDER BY raw) AS level FROM raws)))"""
CONV_RAW = "raws AS (SELECT task_id, item_id, length(text) AS raw FROM items)"
EVENT_RAW = "raws AS (SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(event_id AS VARCHAR) AS item_id, value AS raw, user_id AS task_ord FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL)"
SIGNALS = f"""
sig0 AS (SELECT task_id, item_id, s.score AS rel, CAST(c.score AS DOUBLE) AS imp, pow(0.99, max(position) OVER (PARTITION BY task_id) - position) AS rec FROM items JOIN scores s USING (task_id, item_id) JOIN cleaned c USING (task_id, item_id)),
signals AS (SELECT task_id, item_id, {scaled('rel')} AS relevance, {scaled('rec')} AS recency, {scaled('imp')} AS importance FROM sig0)"""
HISTOGRAM = "count(*) AS n, min(score) AS min, max(score) AS max, round(avg(score), 6) AS mean, round(CAST(median(score) AS DOUBLE), 6) AS median, round(stddev_pop(score), 6) AS stdev, " + ", ".join(
    f"count(CASE WHEN score = {k} THEN 1 END) AS n_{k}" for k in range(1, 11)
)
WANTED = "counts AS (SELECT task_id, count(*) AS n FROM gold GROUP BY ALL)"
TRAIN_PAIRS = f"""{WANTED},
rest AS (SELECT i.task_id, i.item_id FROM items i ANTI JOIN gold g ON i.task_id = g.task_id AND i.item_id = g.item_id),
easy AS (SELECT task_id, item_id, r AS ord FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY md5('13|' || task_id || '|' || item_id), item_id) AS r FROM rest) JOIN counts USING (task_id) WHERE r <= 2 * n),
hard AS (SELECT task_id, item_id, r AS ord FROM (SELECT k.task_id, k.item_id, row_number() OVER (PARTITION BY k.task_id ORDER BY rank) AS r FROM ranked k ANTI JOIN gold g ON k.task_id = g.task_id AND k.item_id = g.item_id) JOIN counts USING (task_id) WHERE r <= least(20, 2 * n)),
group_at AS (SELECT task_id, item_id, min(position) OVER (PARTITION BY task_id, group_key) AS g, sequence_index AS s, position FROM items),
made AS (SELECT e.task_id, source, target, row_number() OVER (PARTITION BY e.task_id ORDER BY kind, CASE WHEN kind = 0 THEN g ELSE 0 END, CASE WHEN kind = 0 THEN s ELSE 0 END, CASE WHEN kind = 0 THEN position ELSE 0 END, weight DESC, source, target) AS place
  FROM (SELECT *, 0 AS kind FROM sequential UNION ALL SELECT *, 3 FROM bridge) e JOIN group_at p ON p.task_id = e.task_id AND p.item_id = e.source),
near AS (SELECT task_id, item_id, r AS ord FROM (
  SELECT task_id, item_id, row_number() OVER (PARTITION BY task_id ORDER BY place, item_id) AS r FROM (
    SELECT n.task_id, n.target AS item_id, min(n.place) AS place FROM (SELECT task_id, source, target, place FROM made UNION ALL SELECT task_id, target, source, place FROM made) n
    JOIN gold g ON g.task_id = n.task_id AND g.item_id = n.source ANTI JOIN gold x ON x.task_id = n.task_id AND x.item_id = n.target GROUP BY ALL)) JOIN counts USING (task_id) WHERE r <= n),
pairs AS (SELECT task_id, item_id, CAST(1 AS INTEGER) AS label, 'positive' AS sample_type, ord + 1 AS ord FROM gold
  UNION ALL SELECT task_id, item_id, 0, 'easy_random', ord FROM easy UNION ALL SELECT task_id, item_id, 0, 'hard_bm25', ord FROM hard UNION ALL SELECT task_id, item_id, 0, 'hard_graph_neighbor', ord FROM near)"""
VECTORS = """
asks AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL),
vscored AS (SELECT query_id, vec_id AS item_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: CAST(q[i] AS DOUBLE) * CAST(embedding[i] AS DOUBLE))), 6) AS score FROM embeddings JOIN asks ON vec_id <> query_id),
vranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM vscored)"""


def _grid() -> str:
    from ..operators.tuning import RERANK_GRID, parameter_grid

    rows = ", ".join(f"({k}, {p['lambda_query']}, {p['lambda_neighbor']}, {p['lambda_bridge']}, {p['seed_top_s']}, {p['max_hops']})" for k, p in enumerate(parameter_grid(RERANK_GRID)))
    return f"configs AS (SELECT * FROM (VALUES {rows}) AS v(config_id, lq, ln_, lb, s, h))"


def _grid_parts() -> str:
    out = []
    for s in (20, 30):
        for h in (1, 2):
            out += [expanded(s, h, f"al_{s}_{h}_"), components(f"pa_{s}_{h}", f"al_{s}_{h}_")]
    union = " UNION ALL ".join(f"SELECT *, {s} AS s, {h} AS h FROM pa_{s}_{h}" for s in (20, 30) for h in (1, 2))
    return ",".join((*out, f"allparts AS ({union})"))


GRID_EVAL = "granked AS (SELECT *, row_number() OVER (PARTITION BY config_id, task_id ORDER BY score DESC, item_id) AS rank FROM gscored)"
UNDIRECTED = "undirected AS (SELECT task_id, source, target FROM edges UNION SELECT task_id, target, source FROM edges)"


def connected(source: str, keys: str, k: int = 10) -> str:
    """Connected evidence and edges within the first k, from recursive reachability."""
    cols = keys.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)
    of = lambda a: ", ".join(f"{a}.{c}" for c in cols)
    return f"""
ktop AS (SELECT {keys}, item_id FROM {source} WHERE rank <= {k}),
kone AS (SELECT {of('t')}, min(g.item_id) AS node FROM (SELECT DISTINCT {keys} FROM ktop) t JOIN gold g ON g.task_id = t.task_id GROUP BY ALL),
kreach AS (SELECT {keys}, node FROM kone UNION SELECT {of('r')}, u.target FROM kreach r JOIN undirected u ON u.task_id = r.task_id AND u.source = r.node JOIN ktop b ON {on('b', 'r')} AND b.item_id = u.target JOIN ktop a ON {on('a', 'r')} AND a.item_id = u.source),
kedges AS (SELECT {of('a')}, count(*) AS n FROM edges e JOIN ktop a ON a.task_id = e.task_id AND a.item_id = e.source JOIN ktop b ON {on('b', 'a')} AND b.item_id = e.target GROUP BY ALL),
linked AS (SELECT {of('o')}, CAST(bool_and(t.item_id IS NOT NULL AND r.node IS NOT NULL) AS DOUBLE) AS connected_{k}, CAST(coalesce(any_value(e.n), 0) AS BIGINT) AS edges_{k}
  FROM kone o JOIN gold g ON g.task_id = o.task_id LEFT JOIN ktop t ON {on('t', 'o')} AND t.item_id = g.item_id LEFT JOIN kreach r ON {on('r', 'o')} AND r.node = g.item_id LEFT JOIN kedges e ON {on('e', 'o')} GROUP BY ALL)"""


def grid_out(edges: str = "avg(edges_10)") -> str:
    means = ", ".join(f"round(avg({c}), 6) AS {c}" for c in ("full_5", "recall_5", "full_10", "mrr", "connected_10"))
    return f"""SELECT *, round(0.5 * full_5 + 0.3 * recall_5 + 0.2 * connected_10, 6) AS objective FROM (
 SELECT CAST(config_id AS BIGINT) AS config_id, {means}, round({edges}, 6) AS avg_edges FROM metrics JOIN linked USING (config_id, task_id) GROUP BY config_id)"""


def greedy(cap: int) -> str:
    """Entity pairs strongest first, each node in ``cap`` at most: one step of the recursion for each pair of a task."""
    free = lambda node: f"len(list_filter(g.used, lambda u: u = {node})) < {cap}"
    return f"""
numbered AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY weight DESC, source, target) AS r FROM shared),
scan AS (SELECT DISTINCT task_id, CAST(0 AS BIGINT) AS r, CAST([] AS VARCHAR[]) AS used, '' AS source, '' AS target, CAST(0 AS BIGINT) AS weight, false AS kept FROM shared
  UNION ALL SELECT task_id, r, CASE WHEN ok THEN list_concat(used, [source, target]) ELSE used END, source, target, weight, ok FROM (
    SELECT p.task_id, p.r, g.used, p.source, p.target, p.weight, {free('p.source')} AND {free('p.target')} AS ok FROM scan g JOIN numbered p ON p.task_id = g.task_id AND p.r = g.r + 1)),
entity_overlap AS (SELECT task_id, source, target, 'entity_overlap' AS edge_type, CAST(weight AS DOUBLE) AS weight, false AS directed FROM scan WHERE kept)"""
RERANK_GRID_SQL = conv(
    *GRAPH, SEEDS, _grid(), _grid_parts(),
    "gscored AS (SELECT config_id, task_id, item_id, round(init + lq * query + ln_ * neighbor + lb * bridge, 6) AS score FROM allparts JOIN configs USING (s, h))",
    GRID_EVAL, task_metrics("granked", "config_id, task_id", False), UNDIRECTED, connected("granked", "config_id, task_id"),
) + grid_out()
MEMORY_VALUES = "mconfigs AS (SELECT * FROM (VALUES (0, 0.0), (1, 0.01), (2, 0.05), (3, 0.1), (4, 0.2), (5, 0.5), (6, 1.0)) AS v(config_id, wi))"

FULL_GRAPH = (OVERLAP, BM25, SEQUENTIAL, QUERY_OVERLAP, PAIRS, greedy(10), BRIDGE, FULL_EDGES)
GRAPH_ONLY = (OVERLAP, SEQUENTIAL, QUERY_OVERLAP, PAIRS, BRIDGE, EDGES)
#: What each rule must count in the tables with faults put in.
PLANTED = """, few AS (SELECT * FROM tasks WHERE task_id NOT LIKE '%0')
SELECT * FROM (VALUES
 ('alignment', (SELECT count(DISTINCT i.task_id) FROM items i ANTI JOIN few USING (task_id)) + (SELECT count(*) FROM few ANTI JOIN items USING (task_id))),
 ('items', (SELECT count(*) FROM items WHERE position % 5 = 1) + (SELECT count(*) FROM items WHERE position % 5 = 2 OR trim(text) = '') + (SELECT count(*) FROM items ANTI JOIN few USING (task_id)) + (SELECT count(*) FROM few WHERE trim(question) = '')),
 ('gold', (SELECT count(*) FROM gold) + (SELECT count(*) FROM gold) + (SELECT count(*) FROM (SELECT task_id FROM gold GROUP BY ALL HAVING count(*) > 1))),
 ('graph', (SELECT count(*) FROM edges WHERE edge_type = 'bridge') + (SELECT count(*) FROM edges WHERE weight > 0) + (SELECT count(*) FROM edges WHERE source <> 'q')),
 ('ranking', (SELECT count(*) FROM ranked WHERE rank = 1 OR rank > 3) + (SELECT count(*) FROM ranked WHERE rank = 3) * 2),
 ('importance', (SELECT count(*) FROM cleaned WHERE score * 2 > 10)),
 ('metrics', (SELECT count(*) FROM metrics WHERE mrr + 0.75 > 1))) AS v("check", n)"""

SQL = {
    "task_items": doc() + "SELECT task_id, item_id, position, title, group_key, sequence_index, CAST(length(text) AS INTEGER) AS n_chars FROM items JOIN tasks USING (task_id)",
    "content_tokens": doc() + f"SELECT task_id, item_id, CAST(len({tokens('text')}) AS BIGINT) AS n_tokens, array_to_string({tokens('text')}, ' ') AS tokens, array_to_string(list_sort({aliases('title')}), '|') AS aliases FROM items",
    "item_entities": doc() + f"SELECT task_id, item_id, array_to_string(list_sort({entities('text')}), '|') AS entities FROM items",
    "idf_table": doc(OVERLAP) + "SELECT task_id, token, df, round(idf, 6) AS idf FROM idf",
    "lexical_overlap": doc(OVERLAP) + "SELECT * FROM overlap",
    "input_tokens": doc() + f"SELECT task_id, CAST(sum(len({tokens('t')})) AS BIGINT) AS input_tokens FROM (SELECT task_id, text AS t FROM items UNION ALL SELECT task_id, question FROM tasks) GROUP BY task_id",
    "bm25_ranking": doc(BM25) + "SELECT task_id, item_id, score, rank FROM ranked",
    "bm25_task_metrics": doc(BM25, task_metrics("ranked")) + "SELECT * FROM metrics",
    "bm25_metrics": doc(BM25, task_metrics("ranked", rounded=False)) + f"SELECT 'bm25' AS method, count(*) AS n_tasks, {MEANS} FROM metrics",
    "seed_signals": doc(BM25) + "SELECT task_id, item_id, score, rank, round(CASE WHEN count(*) OVER (PARTITION BY task_id) = 1 THEN 0.0 ELSE (rank - 1) / (count(*) OVER (PARTITION BY task_id) - 1) END, 6) AS percentile FROM ranked",
    "failure_cases": doc(BM25) + "SELECT task_id, array_to_string(list_sort(list(item_id)), ',') AS missing, any_value(n) AS n_gold FROM gold JOIN (SELECT task_id, count(*) AS n FROM gold GROUP BY ALL) USING (task_id) JOIN ranked USING (task_id, item_id) WHERE rank > 5 GROUP BY task_id",
    "dense_ranking": f"WITH {VECTORS} SELECT * FROM vranked WHERE rank <= 10",
    "dense_ir_metrics": f"WITH {VECTORS}," + """
labelled AS (SELECT vec_id, label FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL),
relevant AS (SELECT a.vec_id AS query_id, b.vec_id AS item_id FROM labelled a JOIN labelled b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
rtotal AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY ALL),
rhits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM vranked SEMI JOIN relevant USING (query_id, item_id) WHERE rank <= 100),
per AS (SELECT t.query_id, n, min(rank) AS first, coalesce(sum(nth / rank), 0.0) / least(n, 100) AS ap, coalesce(sum(CASE WHEN rank <= 10 THEN 1.0 / log2(rank + 1.0) END), 0.0) AS dcg,
               count(CASE WHEN rank <= 1 THEN 1 END) AS h1, count(CASE WHEN rank <= 3 THEN 1 END) AS h3, count(CASE WHEN rank <= 5 THEN 1 END) AS h5, count(CASE WHEN rank <= 10 THEN 1 END) AS h10
        FROM rtotal t LEFT JOIN rhits USING (query_id) GROUP BY t.query_id, n)
SELECT count(*) AS n_queries, """ + ", ".join(f"round(avg(CAST(h{c} > 0 AS DOUBLE)), 6) AS accuracy_{c}, round(avg(h{c} / {c}), 6) AS precision_{c}, round(avg(h{c} / n), 6) AS recall_{c}" for c in (1, 3, 5, 10)) + """,
  round(avg(coalesce(CASE WHEN first <= 10 THEN 1.0 / first END, 0.0)), 6) AS mrr_10, round(avg(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0 / log2(i + 1.0)))), 6) AS ndcg_10, round(avg(ap), 6) AS map_100 FROM per""",
    "sequential_edges": doc(SEQUENTIAL) + "SELECT * FROM sequential",
    "query_overlap_edges": doc(OVERLAP, QUERY_OVERLAP) + "SELECT * FROM query_overlap",
    "entity_pairs": conv(PAIRS) + "SELECT * FROM shared",
    "bridge_edges": conv(PAIRS, BRIDGE) + "SELECT * FROM bridge",
    "graph_edges": conv(*GRAPH) + "SELECT * FROM edges",
    "document_graph_edges": doc(*GRAPH) + "SELECT * FROM edges",
    "entity_overlap_capped": conv(PAIRS, greedy(2)) + "SELECT * FROM entity_overlap",
    "full_graph": conv(*FULL_GRAPH) + "SELECT * FROM edges",
    "graph_rerank_full": conv(*FULL_GRAPH, RERANK) + "SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM reranked",
    "document_graph_rerank": doc(*GRAPH, RERANK) + "SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM reranked",
    "connected_evidence": doc(*GRAPH, UNDIRECTED, connected("ranked", "task_id")) + "SELECT * FROM linked",
    "path_metrics": doc(*GRAPH, """
ptop AS (SELECT task_id, item_id FROM ranked WHERE rank <= 10),
inside AS (SELECT DISTINCT w.task_id, w.source, w.target FROM walk w SEMI JOIN ptop a ON a.task_id = w.task_id AND a.item_id = w.source SEMI JOIN ptop b ON b.task_id = w.task_id AND b.item_id = w.target),
preach AS (SELECT g.task_id, g.source AS start, g.source AS node FROM gold_edges g JOIN ptop t ON t.task_id = g.task_id AND t.item_id = g.source
  UNION SELECT r.task_id, r.start, i.target FROM preach r JOIN inside i ON i.task_id = r.task_id AND i.source = r.node)""")
    + """SELECT g.task_id, round(count(i.source) / count(*), 6) AS edge_recall_10, CAST(bool_and(p.node IS NOT NULL) AS DOUBLE) AS path_recall_10
 FROM gold_edges g LEFT JOIN inside i ON i.task_id = g.task_id AND i.source = g.source AND i.target = g.target LEFT JOIN preach p ON p.task_id = g.task_id AND p.start = g.source AND p.node = g.target GROUP BY g.task_id""",
    "dense_task_ranking": doc(DENSE) + "SELECT * FROM ranked",
    "dense_graph_rerank": doc(OVERLAP, DENSE, SEQUENTIAL, QUERY_OVERLAP, PAIRS, BRIDGE, EDGES, RERANK) + "SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM reranked",
    "graph_statistics": conv(*GRAPH) + """SELECT *, round((num_items + num_graphs) / num_graphs, 6) AS avg_nodes, round(num_edges / num_graphs, 6) AS avg_edges FROM (
 SELECT (SELECT count(*) FROM tasks) AS num_graphs, (SELECT count(*) FROM items) AS num_items, count(*) AS num_edges, count(CASE WHEN edge_type = 'sequential' THEN 1 END) AS num_sequential,
 count(CASE WHEN edge_type = 'query_overlap' THEN 1 END) AS num_query_overlap, count(CASE WHEN edge_type = 'entity_overlap' THEN 1 END) AS num_entity_overlap, count(CASE WHEN edge_type = 'bridge' THEN 1 END) AS num_bridge,
 (SELECT count(*) FROM items i WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.task_id = i.task_id AND (e.source = i.item_id OR e.target = i.item_id))) AS num_isolated FROM edges)""",
    "candidate_expansion": conv(*GRAPH, "seeds AS (SELECT task_id, item_id, score AS norm FROM scores)", expanded(2, 2)) + "SELECT * FROM allowed",
    "graph_rerank": conv(*GRAPH, RERANK) + "SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM reranked",
    "retrieved_subgraph": conv(*GRAPH, "top AS (SELECT task_id, item_id FROM ranked WHERE rank <= 3)") + "SELECT e.* FROM edges e SEMI JOIN top a ON e.task_id = a.task_id AND e.source = a.item_id SEMI JOIN top b ON e.task_id = b.task_id AND e.target = b.item_id",
    "connectivity": conv(*GRAPH, """
top AS (SELECT task_id, item_id FROM ranked WHERE rank <= 5),
und AS (SELECT w.task_id, w.source, w.target FROM (SELECT task_id, source, target FROM edges UNION SELECT task_id, target, source FROM edges) w JOIN top a ON a.task_id = w.task_id AND a.item_id = w.source JOIN top b ON b.task_id = w.task_id AND b.item_id = w.target),
dirw AS (SELECT DISTINCT w.task_id, w.source, w.target FROM walk w JOIN top b ON b.task_id = w.task_id AND b.item_id = w.target LEFT JOIN top a ON a.task_id = w.task_id AND a.item_id = w.source WHERE w.source = 'q' OR a.item_id IS NOT NULL),
reach AS (SELECT task_id, min(item_id) AS node FROM gold GROUP BY task_id UNION SELECT r.task_id, u.target FROM reach r JOIN und u ON u.task_id = r.task_id AND u.source = r.node),
qreach AS (SELECT task_id, 'q' AS node FROM tasks UNION SELECT r.task_id, u.target FROM qreach r JOIN dirw u ON u.task_id = r.task_id AND u.source = r.node)""")
    + """SELECT g.task_id, CAST(bool_and(t.item_id IS NOT NULL AND r.node IS NOT NULL) AS DOUBLE) AS connected_5, CAST(bool_and(t.item_id IS NOT NULL AND q.node IS NOT NULL) AS DOUBLE) AS query_connected_5
 FROM gold g LEFT JOIN top t ON t.task_id = g.task_id AND t.item_id = g.item_id LEFT JOIN reach r ON r.task_id = g.task_id AND r.node = g.item_id LEFT JOIN qreach q ON q.task_id = g.task_id AND q.node = g.item_id GROUP BY g.task_id""",
    "memory_stream": conv(BM25, CONV_RAW, CLEANED, SIGNALS, "ms AS (SELECT task_id, item_id, round(relevance + 0.1 * importance + 0.05 * recency, 6) AS score FROM signals)") + "SELECT *, CAST(row_number() OVER (PARTITION BY task_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM ms",
    "memory_grid": conv(*GRAPH, CONV_RAW, CLEANED, SIGNALS, MEMORY_VALUES, "gscored AS (SELECT config_id, task_id, item_id, round(relevance + wi * importance, 6) AS score FROM signals, mconfigs)", GRID_EVAL, task_metrics("granked", "config_id, task_id", False), UNDIRECTED, connected("granked", "config_id, task_id")) + grid_out("0.0::DOUBLE"),
    "rerank_grid": RERANK_GRID_SQL,
    "tuned_rerank": f"SELECT * FROM ({RERANK_GRID_SQL}) ORDER BY objective DESC, full_10 DESC, avg_edges, config_id LIMIT 1",
    "cleaned_importance": f"WITH {EVENT_RAW}, {CLEANED} SELECT task_id, item_id, score FROM cleaned",
    "importance_distribution": f"WITH {EVENT_RAW}, {CLEANED} SELECT {HISTOGRAM} FROM cleaned",
    "importance_shards": f"WITH {EVENT_RAW}, {CLEANED} SELECT CAST(task_ord // 40 AS BIGINT) AS shard, {HISTOGRAM} FROM cleaned JOIN (SELECT item_id, task_ord FROM raws) USING (item_id) GROUP BY 1",
    "importance_order_violations": "SELECT CAST(0 AS BIGINT) AS n",
    "planted_order_violations": f"WITH {EVENT_RAW}, {CLEANED}, " + """turned AS (SELECT task_id, item_id, raw, CASE WHEN CAST(item_id AS BIGINT) % 7 = 0 THEN 11 - score ELSE score END AS score FROM cleaned),
stepped AS (SELECT raw, score, lag(raw) OVER w AS raw0, lag(score) OVER w AS score0 FROM turned WINDOW w AS (PARTITION BY task_id ORDER BY raw, item_id))
SELECT count(*) AS n FROM stepped WHERE score < score0 OR (raw = raw0 AND score <> score0)""",
    "duplicate_vectors": conv(CONV_RAW, CLEANED) + "SELECT vector, count(*) AS n_tasks FROM (SELECT task_id, string_agg(CAST(score AS VARCHAR), ',' ORDER BY CAST(substr(item_id, 2) AS INTEGER)) AS vector FROM cleaned GROUP BY task_id) GROUP BY vector HAVING count(*) > 1",
    "training_pairs": doc(BM25, SEQUENTIAL, PAIRS, BRIDGE, TRAIN_PAIRS) + "SELECT task_id, item_id, label, sample_type FROM pairs",
    "dense_training_pairs": doc(BM25, DENSE.replace("scores AS", "dscores AS").replace("FROM scores", "FROM dscores").replace("ranked AS", "dranked AS"), WANTED, """
hard AS (SELECT task_id, item_id FROM (SELECT k.task_id, k.item_id, row_number() OVER (PARTITION BY k.task_id ORDER BY rank) AS r FROM ranked k ANTI JOIN gold g ON k.task_id = g.task_id AND k.item_id = g.item_id) JOIN counts USING (task_id) WHERE r <= least(20, n)),
dhard AS (SELECT task_id, item_id FROM (SELECT k.task_id, k.item_id, row_number() OVER (PARTITION BY k.task_id ORDER BY rank) AS r FROM dranked k ANTI JOIN gold g ON k.task_id = g.task_id AND k.item_id = g.item_id) JOIN counts USING (task_id) WHERE r <= least(20, 2 * n))
""") + "SELECT task_id, item_id, CAST(1 AS INTEGER) AS label, 'positive' AS sample_type FROM gold UNION ALL SELECT task_id, item_id, 0, 'hard_bm25' FROM hard UNION ALL SELECT task_id, item_id, 0, 'hard_dense' FROM dhard",
    "pair_summary": doc(BM25, SEQUENTIAL, PAIRS, BRIDGE, TRAIN_PAIRS) + """SELECT *, round(positives / n_tasks, 6) AS positives_per_task, round(negatives / n_tasks, 6) AS negatives_per_task FROM (
 SELECT count(CASE WHEN label = 1 THEN 1 END) AS positives, count(CASE WHEN label = 0 THEN 1 END) AS negatives, count(CASE WHEN sample_type = 'easy_random' THEN 1 END) AS n_easy_random, count(CASE WHEN sample_type = 'hard_bm25' THEN 1 END) AS n_hard_bm25,
 count(CASE WHEN sample_type = 'hard_dense' THEN 1 END) AS n_hard_dense, count(CASE WHEN sample_type = 'hard_graph_neighbor' THEN 1 END) AS n_hard_graph_neighbor, (SELECT count(*) FROM tasks) AS n_tasks FROM pairs)""",
    "contrastive_triples": doc(BM25, SEQUENTIAL, PAIRS, BRIDGE, TRAIN_PAIRS, """
kinds AS (SELECT task_id, item_id, min({'k': CASE sample_type WHEN 'hard_dense' THEN 0 WHEN 'hard_bm25' THEN 1 WHEN 'hard_graph_neighbor' THEN 2 ELSE 3 END, 'o': ord}) AS x FROM pairs WHERE label = 0 GROUP BY ALL),
negs AS (SELECT task_id, item_id FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY x.k, x.o, item_id) AS r FROM kinds) WHERE r <= 3)""") + "SELECT g.task_id, g.item_id AS positive, n.item_id AS negative FROM gold g LEFT JOIN negs n USING (task_id)",
    "message_edges": conv(*GRAPH, "msgs AS (SELECT task_id, source, target, edge_type || '_forward' AS relation, weight FROM edges UNION ALL SELECT task_id, target, source, edge_type || '_reverse', weight FROM edges WHERE NOT directed)") + "SELECT *, round(1.0 / count(*) OVER (PARTITION BY task_id, target, relation), 6) AS norm FROM msgs",
    "node_features": conv(BM25) + "SELECT task_id, item_id AS node_id, score AS seed_score, round(CASE WHEN count(*) OVER (PARTITION BY task_id) = 1 THEN 0.0 ELSE (rank - 1) / (count(*) OVER (PARTITION BY task_id) - 1) END, 6) AS percentile, 0.0::DOUBLE AS is_question FROM ranked UNION ALL SELECT DISTINCT task_id, 'q', 0.0, 1.0, 1.0 FROM items",
    "split_assignment": "SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM (SELECT doc_id, CAST('0x' || substr(md5('0|' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 AS u FROM documents)",
    "content_digests": conv() + """SELECT task_id, sha256('{"items":[' || string_agg('{"id":' || to_json(item_id) || ',"position":' || position || ',"source":' || to_json(source_ref) || ',"text":' || to_json(text) || '}', ',' ORDER BY position) || ']}') AS digest FROM items GROUP BY task_id""",
    "planted_violations": conv(BM25, CONV_RAW, CLEANED, task_metrics("ranked"), *GRAPH_ONLY) + PLANTED,
    "violations": 'SELECT unnest([\'alignment\', \'items\', \'gold\', \'graph\', \'ranking\', \'importance\', \'metrics\']) AS "check", CAST(0 AS BIGINT) AS n',
    "method_table": conv(*GRAPH, RERANK, CONV_RAW, CLEANED, SIGNALS, """
methods AS (SELECT 'bm25' AS method, task_id, item_id, score FROM scores UNION ALL SELECT 'bm25_graph_rerank', task_id, item_id, score FROM reranked UNION ALL SELECT 'memory_stream', task_id, item_id, round(relevance + 0.01 * importance, 6) FROM signals),
mranked AS (SELECT *, row_number() OVER (PARTITION BY method, task_id ORDER BY score DESC, item_id) AS rank FROM methods)""", task_metrics("mranked", "method, task_id", False)) + f"SELECT method, count(*) AS n_tasks, {MEANS} FROM metrics GROUP BY method",
    "event_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
SQL["tuned_memory"] = f"SELECT * FROM ({SQL['memory_grid']}) ORDER BY objective DESC, full_10 DESC, avg_edges, config_id LIMIT 1"
