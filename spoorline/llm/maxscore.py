"""Exact top-k by inner product with MaxScore over sharded signed postings.

A dimension is a term with two posting lists: the vectors that are positive
and those that are negative there. For a query, a term can add at most its
weight times the shard's largest value on the matching side; mismatched signs
only take away. Terms are ordered by that bound. While the bounds of the last
terms sum to less than the k-th score found, those are non-essential: a vector
that stands in no essential posting list can't enter the result. Candidates
from the essential lists are scored on the essential terms, and the others are
probed, largest bound first, for as long as a candidate is competitive. Shards'
results are merged.

Queries and vectors are dealt to a grid of (shard of vectors, block of
queries); both have bounded sizes, so a task's memory is bounded, and a shard
is dealt by a hash of the id, so equal vectors spread.

Defined results: vectors that are null, or hold null or non-finite components,
take no part, neither do null ids; shorter vectors count as padded with zeros;
an empty vector scores 0; rows of equal id are candidates each, but never for
a query of that id; ties go to the smaller id; with fewer than k candidates all
are returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors in a shard, queries in a block, and rows that are scanned at once.
SHARD_ROWS = 50_000
BLOCK_QUERIES = 2_048
STRIDE = 4_096
PROBE = 8


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int, *more: Column) -> DataFrame:
    """(id, v) and further columns: floor(scale * x) of every component, for vectors that take part."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), *more
    )


def matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Lists as rows of equal length, padded with zeros."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], arr.type)
    size = np.diff(np.asarray(arr.offsets))
    flat = np.asarray(arr.flatten())
    out = np.zeros((len(arr), dims), np.int64)
    if len(arr) and (size == dims).all():
        return flat.reshape(len(arr), dims).copy()
    start = np.cumsum(size) - size
    for i, (s, n) in enumerate(zip(start, size, strict=True)):
        out[i, :n] = flat[s : s + n]
    return out


class Shard:
    """Vectors in order of id, with their signed posting lists and bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.v = ids[order], vectors[order]
        self.positive, self.negative = self.v > 0, self.v < 0
        self.most = np.maximum(self.v.max(0, initial=0), 0)
        self.least = np.minimum(self.v.min(0, initial=0), 0)

    def search(self, own_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best, best first."""
        bound = np.where(query > 0, query * self.most, query * self.least)
        order = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        weights = query[order]
        best_ids, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for lo in range(0, len(self.ids), STRIDE):
            full = len(best) >= k
            floor = best[-1] if full else None
            essential = int(np.searchsorted(-rest, -floor, "right")) if full else len(order)
            essential = min(essential, len(order))
            part = slice(lo, lo + STRIDE)
            at = np.flatnonzero(self.ids[part] != own_id) + lo
            if full:
                met = np.zeros(len(self.ids[part]), bool)
                for t in order[:essential]:
                    met |= (self.positive if query[t] > 0 else self.negative)[part, t]
                    if met.all():
                        break
                if rest[0] >= floor and rest[essential] < floor:
                    at = at[met[at - lo]]
                elif rest[0] < floor:
                    break
            first = min(essential, PROBE) if full else len(order)
            score = self.v[at[:, None], order[:first]] @ weights[:first]
            done = first
            while done < len(order) and len(at):
                alive = score + rest[done] >= floor
                at, score = at[alive], score[alive]
                step = order[done : done + PROBE]
                score = score + self.v[at[:, None], step] @ weights[done : done + PROBE]
                done += PROBE
            ids, scores = np.concatenate([best_ids, self.ids[at]]), np.concatenate([best, score])
            top = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[top], scores[top]
        return best_ids, best


def exact_top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, ``id_col``, score) for the rows where the column ``is_query`` holds."""
    base = quantised(vectors, id_col, vec_col, scale)
    queries = quantised(vectors.where(is_query), id_col, vec_col, scale)
    n, dims = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    nq = queries.count()
    shards, blocks, dims = max(1, math.ceil(n / SHARD_ROWS)), max(1, math.ceil(nq / BLOCK_QUERIES)), dims or 0
    deal = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = base.select("id", "v", deal(shards).alias("shard"), each(blocks).alias("block"))
    right = queries.select("id", "v", deal(blocks).alias("block"), each(shards).alias("shard"))

    def run(vecs: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if vecs.num_rows and asks.num_rows:
            shard = Shard(np.asarray(vecs["id"]), matrix(vecs["v"], dims))
            for own, query in zip(np.asarray(asks["id"]), matrix(asks["v"], dims), strict=True):
                ids, scores = shard.search(own, query, k)
                for column, values in zip(out, (np.full(len(ids), own), ids, scores), strict=True):
                    column.append(values)
        return pa.table({name: np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for name, c in zip(("query_id", "id", "score"), out, strict=True)})

    keys = ("shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def oracle_sql() -> str:
    return """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
