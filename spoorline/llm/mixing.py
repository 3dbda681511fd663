"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked: their weights
are scaled to the target shares of the sources, then of the languages, then of
the topics, sweep after sweep. A cell's documents are then sampled with one
probability, ``min(1, rate * weight / tokens)``, where ``rate`` spends the
token budget. A document's draw depends on its id alone.

DataFrame functions only. Documents are aggregated to cells map-side, so a hot
source costs no more than any other; raking works on the cell table alone,
which has a row for each combination of values and no text. Sweeps go on until all
marginals are within ``TOLERANCE`` of their targets, or ``MAX_SWEEPS`` is
reached, as targets may contradict each other.

Targets are explicit shares, or the observed share to a power below 1, which
lifts small values. Defined results: null keys count as the empty string; a
value that has tokens but no explicit share gets none, so its documents have
probability 0; cells without a token have probability 1; a null id draws by
its text; rows of equal id draw alike; an empty table gives an empty result.
``mix`` replaces columns named as its own, ``draw`` returns rows as they came;
names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

DIMS = ("source", "lang", "topic")
#: Powers of the observed shares that the query aims at.
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Sweeps before the marginals are looked at, and at most.
SWEEPS = 8
MAX_SWEEPS = 64
#: Largest difference of a marginal share and its target.
TOLERANCE = 1e-4
#: Share of all tokens that is sampled.
BUDGET = 0.6
#: Most cells that are broadcast to the documents.
BROADCAST_CELLS = 100_000
#: Tasks that a hot cell's documents are dealt to beyond that.
SALTS = 64
_WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A coarse topic from cues in the text, for tables without one."""
    lowered = F.lower(text)
    has = lambda *phrases: F.greatest(*[F.contains(lowered, F.lit(p)) for p in (*phrases, phrases[0])])
    return (
        F.when(has("license", "all rights reserved", "copyright"), "legal")
        .when(has("http://", "https://", "www.", "token =", "api_key", "password"), "technical")
        .when(has("@", "555-", "iban", "phone"), "contact")
        .when(F.contains(text, F.lit(" | ")), "listing")
        .when(F.length(text) < 400, "note")
        .when(F.length(text) < 4000, "article")
        .otherwise("longform")
    )


def with_cells(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the cell of each document and its words, as ``__source``, ``__lang``, ``__topic`` and ``__tokens``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    topic = F.coalesce(F.col("topic"), F.lit("")) if "topic" in docs.columns else topic_of(text)
    return docs.withColumns(
        {
            "__source": F.coalesce("source", F.lit("")),
            "__lang": F.coalesce("lang", F.lit("")),
            "__topic": topic,
            "__tokens": F.regexp_count(text, F.lit(_WORD)).cast("long"),
        }
    )


def raked(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """(source, lang, topic, tokens, w): weights that sum to 1, with the target marginals.

    Each cell carries its three target shares, so a sweep is three window sums
    over the cell table, and the plan grows by three steps a sweep.
    """
    spark = cells.sparkSession
    cur = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim in DIMS:
        given = (targets or {}).get(dim)
        present = cells.where("tokens > 0").groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
        if given is not None:
            want = spark.createDataFrame(list(given.items()), f"{dim} string, x double")
            want = present.join(want, dim, "left").select(dim, F.coalesce("x", F.lit(0.0)).alias("x"))
        else:
            want = present.select(dim, F.pow("t", F.lit(POWERS[dim])).alias("x"))
        shares = want.select(dim, F.try_divide("x", F.sum("x").over(W.partitionBy(F.lit(1)))).alias(f"to_{dim}"))
        cur = cur.join(shares, dim, "left")
    for done in range(0, MAX_SWEEPS, sweeps):
        cur = saved(cur)
        if done and _farthest(cur) <= TOLERANCE:
            break
        for _ in range(sweeps):
            for dim in DIMS:
                factor = F.try_divide(F.col(f"to_{dim}"), F.sum("w").over(W.partitionBy(dim)))
                cur = cur.withColumn("w", F.col("w") * F.coalesce(factor, F.lit(0.0)))
    return cur.select(*DIMS, "tokens", "w")


def _farthest(cells: DataFrame) -> float:
    """Largest difference of a marginal share of the weights and its target."""
    sums = [cells.groupBy(dim).agg(F.abs(F.sum("w") - F.coalesce(F.first(f"to_{dim}"), F.lit(0.0))).alias("far")).select("far") for dim in DIMS]
    return sums[0].unionAll(sums[1]).unionAll(sums[2]).agg(F.max("far")).first()[0] or 0.0


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, p): one rate for all cells that aren't taken whole spends ``budget`` of the tokens."""
    order = W.orderBy(F.desc("r"), "source", "lang", "topic")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(1))
    rows = (
        cells.where("tokens > 0")
        .withColumn("r", F.col("w") / F.col("tokens"))
        .withColumns(
            {
                "t0": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
                "w0": F.coalesce(F.sum("w").over(before), F.lit(0.0)),
                "t": F.sum("tokens").over(every),
                "ws": F.sum("w").over(every),
            }
        )
        .withColumn("rate", F.try_divide(F.col("t") * F.lit(budget) - F.col("t0"), F.col("ws") - F.col("w0")))
        # Cells before the first that its own rate doesn't take whole are taken whole.
        .withColumn("rest", F.max(F.when((F.col("rate") * F.col("r") <= 1) | F.col("rate").isNull(), 1).otherwise(0)).over(order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("final", F.first(F.when(F.col("rest") == 1, F.col("rate")), ignorenulls=True).over(every.orderBy(F.desc("r"), "source", "lang", "topic").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    p = F.when(F.col("rest") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col("final") * F.col("r"), F.lit(0.0)))))
    some = rows.select("source", "lang", "topic", p.alias("p"))
    return some.unionByName(cells.where("tokens <= 0 or tokens is null").select("source", "lang", "topic", F.lit(1.0).alias("p")))


def _drawn(docs: DataFrame, targets, budget: float, sweeps: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__source``, ``__lang``, ``__topic``, ``__tokens``, ``__p`` and ``__kept``."""
    own = with_cells(docs, text_col)
    hidden = {f"__{dim}": dim for dim in DIMS}
    cells = saved(own.groupBy(*hidden).agg(F.sum("__tokens").alias("tokens")).withColumnsRenamed(hidden))
    p = saved(probabilities(raked(cells, targets, sweeps), budget)).withColumnsRenamed({dim: f"__{dim}" for dim in DIMS} | {"p": "__p"})
    draw = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    # Few cells go to every task, so no document moves; beyond that a join deals documents by cell and salt.
    if p.count() <= BROADCAST_CELLS:
        joined = own.join(F.broadcast(p), list(hidden), "left")
    else:
        salted = p.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(id_col, text_col), F.lit(SALTS)).cast("int")
        joined = own.withColumn("__salt", salt).join(salted, [*hidden, "__salt"], "left").drop("__salt")
    return joined.withColumn("__p", F.coalesce("__p", F.lit(1.0))).withColumn("__kept", draw < F.col("__p"))


def mix(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET,
    sweeps: int = SWEEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Add source, lang and topic without nulls, n_tokens, p and kept."""
    out = _drawn(docs, targets, budget, sweeps, id_col, text_col)
    added = {"source": "__source", "lang": "__lang", "topic": "__topic", "n_tokens": "__tokens", "p": "__p", "kept": "__kept"}
    return out.withColumns({name: F.col(c) for name, c in added.items()}).drop(*added.values())


def draw(
    docs: DataFrame,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    budget: float = BUDGET,
    sweeps: int = SWEEPS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that are drawn, as they came."""
    return _drawn(docs, targets, budget, sweeps, id_col, text_col).where("__kept").select(docs.columns)


def oracle_sql() -> str:
    blank = r"[^ \t\n\x0b\x0c\r]+"
    has = lambda *xs: " OR ".join(f"contains(lower(text), '{x}')" for x in xs)
    ctes = [
        f"""d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, length(regexp_extract_all(text, '{blank}')) AS n_tokens,
  CASE WHEN {has('license', 'all rights reserved', 'copyright')} THEN 'legal'
       WHEN {has('http://', 'https://', 'www.', 'token =', 'api_key', 'password')} THEN 'technical'
       WHEN {has('@', '555-', 'iban', 'phone')} THEN 'contact' WHEN contains(text, ' | ') THEN 'listing'
       WHEN length(text) < 400 THEN 'note' WHEN length(text) < 4000 THEN 'article' ELSE 'longform' END AS topic
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents))""",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL)",
    ]
    for dim in DIMS:
        ctes.append(f"s_{dim} AS MATERIALIZED (SELECT {dim}, x / sum(x) OVER () AS share FROM (SELECT {dim}, pow(CAST(sum(tokens) AS DOUBLE), {POWERS[dim]}) AS x FROM c WHERE tokens > 0 GROUP BY {dim}))")
    last = "c0"
    ctes.append("c0 AS MATERIALIZED (SELECT *, CAST(tokens AS DOUBLE) AS w FROM c)")
    for k in range(SWEEPS * 3):
        dim = DIMS[k % 3]
        ctes.append(f"c{k + 1} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.tokens, a.w * coalesce(s.share / nullif(sum(a.w) OVER (PARTITION BY a.{dim}), 0), 0) AS w FROM {last} a LEFT JOIN s_{dim} s USING ({dim}))")
        last = f"c{k + 1}"
    return f"""
WITH {', '.join(ctes)},
r AS (SELECT *, w / tokens AS r FROM {last} WHERE tokens > 0),
o AS (SELECT *, coalesce(sum(tokens) OVER b, 0) AS t0, coalesce(sum(w) OVER b, 0) AS w0, sum(tokens) OVER () AS t, sum(w) OVER () AS ws FROM r
      WINDOW b AS (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (t * {BUDGET} - t0) / nullif(ws - w0, 0) AS rate FROM o),
e AS (SELECT *, max(CASE WHEN rate * r <= 1 OR rate IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY r DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rest FROM q),
f AS (SELECT max(rate) AS rate FROM (SELECT rate FROM e WHERE rest = 1 ORDER BY r DESC, source, lang, topic LIMIT 1)),
p AS (SELECT source, lang, topic, CASE WHEN rest = 0 THEN 1.0 ELSE greatest(0.0, least(1.0, coalesce(f.rate * r, 0.0))) END AS p FROM e, f
      UNION ALL SELECT source, lang, topic, 1.0 FROM c WHERE tokens <= 0)
SELECT doc_id, source, lang, topic, CAST(n_tokens AS BIGINT) AS n_tokens, round(p, 9) AS p,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < p AS kept
FROM d JOIN p USING (source, lang, topic)"""
