"""Hard negatives by a two-dimensional block matrix product.

Scores of all anchors with all rows are one product, A times B transposed.
Anchors and rows are dealt to blocks by a hash of the id, and every block is cut
into chunks of dimensions. As in SUMMA, the product is laid out on a grid: the
chunks of an anchor block go to each row block and those of a row block to each
anchor block; cell (i, j) stays where it is, adds up the products of its chunks
and reduces the tile to its own best few at once. The grid is gone through
twice: for each anchor's best rows of its label, and, when these positives and
so the windows are known, for the best rows of other labels within each
anchor-positive window. So no tile is moved or written; what is moved grows with
a side's rows times the other side's blocks, and what is ranked per anchor with
the number of row blocks, not with rows.

Sizes: a cell holds ``ANCHOR_ROWS`` anchors and ``BLOCK_ROWS`` rows at most and
makes its tile ``STRIDE`` anchors at a time (16 MB). Components travel in the
narrowest whole numbers that hold them. Dimensions are cut into ``CHUNKS`` parts
at most. Blocks are dealt by hash, so equal vectors and hot labels spread.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part; shorter vectors count as padded with zeros;
rows of an anchor's own id are not its candidates; rows of equal id are
candidates each, but as anchors only the one of smallest label, then vector,
asks; ties go to the smaller id; an anchor without other rows of its
label, or whose window is empty, has no rows; an empty table gives no rows;
other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .maxscore import matrix, quantised

ANCHOR_ROWS = 2048
BLOCK_ROWS = 8192
STRIDE = 256
#: Dimensions of a chunk, and most chunks; more dimensions make longer chunks.
CHUNK_DIMS = 16
CHUNKS = 8
#: Positives of up to this many anchors (some 100 bytes each) are sent to all tasks; more are joined by anchor block.
BROADCAST_ANCHORS = 100_000

BLOCK = "block int, chunk int, ids binary, labels binary, kind string, data binary"


def narrowed(values: np.ndarray) -> np.ndarray:
    """The same in the smallest of three types of whole numbers that holds them."""
    low, high = values.min(initial=0), values.max(initial=0)
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _blocks(rows: DataFrame, count: int, dims: int, width: int, unique: bool) -> DataFrame:
    """(block, chunk, ids, labels, data): rows of a block with one chunk of their dimensions, as bytes of int64."""

    def run(table: pa.Table) -> pa.Table:
        ids, labels, values = np.asarray(table["id"]), np.asarray(table["label"]), matrix(table["v"], dims)
        order = np.lexsort((*values.T[::-1], labels, ids))
        if unique:
            order = order[np.unique(ids[order], return_index=True)[1]]
        ids, labels, values = ids[order], labels[order], values[order]
        values = narrowed(values)
        block = table["block"][0].as_py()
        cuts = range(0, max(dims, 1), width)
        n = len(cuts)
        return pa.table(
            {
                "block": pa.array([block] * n, pa.int32()), "chunk": pa.array(range(n), pa.int32()), "ids": [ids.tobytes()] * n, "labels": [labels.tobytes()] * n, "kind": [values.dtype.str] * n,
                "data": [np.ascontiguousarray(values[:, k : k + width]).tobytes() for k in cuts],
            }
        )

    dealt = rows.select("id", "label", "v", F.pmod(F.xxhash64("id", F.lit(count)), F.lit(count)).cast("int").alias("block"))
    return dealt.groupBy("block").applyInArrow(run, BLOCK)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exactly; in floating point where all sums are below 2**24 or 2**53."""
    most = lambda x: float(np.abs(x.astype(np.float64)).max(initial=0))
    bound = most(a) * most(b) * max(a.shape[1], 1)
    for kind, limit in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if bound < limit:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _sides(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, dims: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Blocks of both sides from files, and how many there are: linear in the rows."""
    width = max(CHUNK_DIMS, math.ceil(dims / CHUNKS))
    n_i, n_j = math.ceil(n_anchors / ANCHOR_ROWS), math.ceil(n_rows / BLOCK_ROWS)
    left = written(_blocks(anchors, n_i, dims, width, True).withColumnRenamed("block", "i"))
    return left, written(_blocks(rows, n_j, dims, width, False).withColumnRenamed("block", "j")), n_i, n_j


def _cells(sides: tuple[DataFrame, DataFrame, int, int], make: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``make`` over the grid: both sides name the cells that they go to, so a cell meets all chunks of one block each."""
    left, right, n_i, n_j = sides
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = left.select("*", each(n_j).alias("j")).groupBy("i", "j")
    return own.cogroup(right.select("*", each(n_i).alias("i")).groupBy("i", "j")).applyInArrow(make, schema)


def _chunks(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """ids, labels and the chunks in order."""
    n = table.num_rows
    order = sorted(range(n), key=[c.as_py() for c in table["chunk"]].__getitem__)
    ids, labels = (np.frombuffer(table[c][0].as_py(), np.int64) for c in ("ids", "labels"))
    return ids, labels, [np.frombuffer(table["data"][k].as_py(), table["kind"][k].as_py()).reshape(len(ids), -1) for k in order]


def _strips(left: pa.Table, right: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """The cell's tile, ``STRIDE`` anchors at a time: (anchors, their labels, ids, labels, scores), added up over the chunks."""
    if not left.num_rows or not right.num_rows:
        return
    (anchors, anchor_labels, a), (ids, labels, b) = _chunks(left), _chunks(right)
    for lo in range(0, len(anchors), STRIDE):
        tile = np.zeros((len(anchors[lo : lo + STRIDE]), len(ids)), np.int64)
        for x, y in zip(a, b, strict=True):
            tile += product(x[lo : lo + STRIDE], y)
        yield anchors[lo : lo + STRIDE], anchor_labels[lo : lo + STRIDE], ids, labels, tile


def _first(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` (in order of id) the k with the highest scores, best first, ties in order."""
    if len(at) > k:
        floor = np.partition(score[at], len(at) - k)[len(at) - k]
        above = at[score[at] > floor]
        at = np.sort(np.concatenate([above, at[score[at] == floor][: k - len(above)]]))
    return at[np.argsort(-score[at], kind="stable")]


def _table(columns: list[list], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


def _positives(sides: tuple, k: int) -> DataFrame:
    """(i, anchor_id, positive_id, positive_score): each cell's best rows of the anchor's label, then the best of all cells."""
    names = ("i", "anchor_id", "positive_id", "positive_score")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        for anchors, anchor_labels, ids, labels, tile in _strips(left, right):
            i = left["i"][0].as_py()
            of = {label: np.flatnonzero(labels == label) for label in np.unique(anchor_labels)}
            for own, label, score in zip(anchors, anchor_labels, tile, strict=True):
                same = of[label]
                best = _first(score, same[ids[same] != own], k)
                for column, values in zip(out, ([i] * len(best), [own] * len(best), ids[best], score[best]), strict=True):
                    column.extend(values)
        return _table(out, names)

    found = _cells(sides, run, ", ".join(f"{c} long" for c in names))
    w = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    return found.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)


def _negatives(sides: tuple, windows: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, nth, positive_score, negative_id, negative_score): each cell's best in every window."""
    names = ("anchor_id", "positive_id", "nth", "positive_score", "negative_id", "negative_score")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in names]
        asked: dict[int, list[dict]] = {}
        for w in (w for own in left["windows"].to_pylist() for w in own or ()):
            asked.setdefault(w["anchor_id"], []).append(w)
        for anchors, anchor_labels, ids, labels, tile in _strips(left, right):
            others = {label: np.flatnonzero(labels != label) for label in np.unique(anchor_labels)}
            for own, label, score in zip(anchors.tolist(), anchor_labels, tile, strict=True):
                if own not in asked:
                    continue
                other = others[label]
                other = other[ids[other] != own]
                seen = score[other]
                for w in asked[own]:
                    top = w["positive_score"]
                    # The bounds as whole numbers: ceil(low * top / 100) up to floor(high * top / 100).
                    best = _first(score, other[(seen >= -(-low * top // 100)) & (seen <= high * top // 100)], k)
                    n = len(best)
                    for column, values in zip(out, ([own] * n, [w["positive_id"]] * n, [w["nth"]] * n, [top] * n, ids[best], score[best]), strict=True):
                        column.extend(values)
        return _table(out, names)

    left, *rest = sides
    # The windows go with one chunk of their block.
    left = left.join(windows, "i").withColumn("windows", F.when(F.col("chunk") == 0, F.col("windows")))
    return _cells((left, *rest), run, ", ".join(f"{c} long" for c in names))


def mine(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor (rows where ``is_anchor`` holds) and each of its first
    ``positives`` rows of equal label: the first ``negatives`` rows of other
    labels with low / 100 to high / 100 of the positive's score, both ends
    included.
    """
    names = {id_col, vec_col, label_col}
    rows = rows.select(*names, is_anchor.alias("__anchor")).where(F.col(label_col).isNotNull())
    label = F.col(label_col).cast("long").alias("label")
    base = quantised(rows, id_col, vec_col, scale, label)
    asks = quantised(rows.where("__anchor"), id_col, vec_col, scale, label)
    n_rows, dims = base.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    n_anchors = asks.count()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return rows.sparkSession.createDataFrame([], out)
    sides = _sides(asks, base, n_anchors, n_rows, dims or 0)
    best = _positives(sides, positives)
    windows = best.groupBy(F.col("i").cast("int").alias("i")).agg(F.collect_list(F.struct("anchor_id", "positive_id", F.col("__r").alias("nth"), "positive_score")).alias("windows"))
    found = _negatives(sides, F.broadcast(windows) if n_anchors <= BROADCAST_ANCHORS else windows, negatives, low, high)
    w = W.partitionBy("anchor_id", "positive_id", "nth").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle_sql() -> str:
    return """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same,
             CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score
      FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
