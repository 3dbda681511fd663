"""The nearest vectors of a set of queries, and the ranks of given ones, by products of blocks.

Queries are dealt to blocks of bounded size and vectors to slices, both by a
hash of the id. A cell of the grid is one block and one slice: its rows stand
one after the other in a partition, queries first, so that vectors stream past
the block a stride at a time and only each query's best k so far are held. No
pair of a query and a vector ever becomes a row, and nothing is broadcast.
There are as many slices as it takes to keep the cells at ``CELLS``, one where
there are that many blocks: what is moved is a copy of the vectors for each
block, and what is merged is k rows for each query and slice.

``ranks`` answers where given vectors of each query stand, up to k. It needs no
list of the nearest: a given vector is done with as soon as k better ones are
seen. A sample of bounded size settles all but those that stand high, and only
these go through all vectors, so that work grows little faster than the tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..runtime import kept

QUERY_ROWS = 4096
BLOCK_ROWS = 4096
CELLS = 64
#: Vectors that are multiplied at once, and pairs that are held before they are cut to the best.
STRIDE = 1024
HELD = 1 << 21


class Cell:
    """A block of queries and each one's best k of the vectors seen."""

    def __init__(self, ids: list, vecs: np.ndarray, k: int, digits: int) -> None:
        self.ids, self.q, self.k, self.digits = ids, vecs, k, digits
        self.places: dict[object, list[int]] = {}
        for n, own in enumerate(ids):
            self.places.setdefault(own, []).append(n)
        self.floor = np.full(len(ids), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def see(self, ids: list, vecs: np.ndarray) -> None:
        if vecs.shape[1] != self.q.shape[1]:
            raise ValueError(f"queries of {self.q.shape[1]} and vectors of {vecs.shape[1]} dimensions")
        score = self.q @ vecs.T
        score[~np.isfinite(score)] = -np.inf
        for n, own in enumerate(ids):
            if own in self.places:
                score[self.places[own], n] = -np.inf
        floor = self.floor
        if len(ids) > self.k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(score, len(ids) - self.k, axis=1)[:, len(ids) - self.k])
        # Scores are compared before they are rounded, so all that may round to the floor stay.
        q, at = np.nonzero((score >= floor[:, None] - 10.0**-self.digits) & (score > -np.inf))
        if len(q):
            self.held.append((q, np.round(score[q, at], self.digits), np.array(ids)[at]))
            self.size += len(q)
            if self.size > HELD or np.isneginf(self.floor).any():
                self.cut()

    def cut(self) -> None:
        """Only the best k of each query stay; ties by id."""
        if not self.held:
            return
        q, score, ids = (np.concatenate(c) for c in zip(*self.held, strict=True))
        order = np.lexsort((ids, -score, q))
        q, score, ids = q[order], score[order], ids[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.floor[q[last]] = score[last]
        stay = rank < self.k
        self.held = [(q[stay], score[stay], ids[stay])]
        self.size = int(stay.sum())


def _matrix(column: pa.ListArray) -> np.ndarray:
    dims = set(column.value_lengths().to_pylist())
    if len(dims) != 1:
        raise ValueError(f"vectors of {sorted(dims)} dimensions in one column")
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dims.pop())


def nearest(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 6, query_id: str = "query_id", query_vec: str = "q_vec", item_id: str = "item_id", vec: str = "vec", sizes: tuple[int, int] | None = None) -> DataFrame:
    """(``query_id``, ``item_id``, score, rank): the k best by inner product, rounded before ranking; ties by item id.

    A vector is no candidate of a query of its own id. Null ids and vectors take
    no part. ``sizes``: about how many queries and vectors there are, where that is known.
    """
    queries, vectors = queries.where(F.col(query_id).isNotNull() & F.col(query_vec).isNotNull()), vectors.where(F.col(item_id).isNotNull() & F.col(vec).isNotNull())
    n_q, n_v = sizes or (queries.count(), vectors.count())
    n_i = max(1, math.ceil(n_q / QUERY_ROWS))
    n_j = max(1, min(math.ceil(n_v / BLOCK_ROWS), math.ceil(CELLS / n_i)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit(n)), F.lit(n)).cast("int")
    left = queries.select(dealt(query_id, n_i).alias("i"), each(n_j).alias("j"), F.lit(0).alias("kind"), F.col(query_id).alias("q"), F.lit(None).cast(vectors.schema[item_id].dataType).alias("v"), F.col(query_vec).alias("vec"))
    right = vectors.select(each(n_i).alias("i"), dealt(item_id, n_j).alias("j"), F.lit(1).alias("kind"), F.lit(None).cast(queries.schema[query_id].dataType).alias("q"), F.col(item_id).alias("v"), F.col(vec).alias("vec"))
    rows = left.unionByName(right).repartition(n_i * n_j, "i", "j").sortWithinPartitions("i", "j", "kind")
    out = StructType().add(query_id, queries.schema[query_id].dataType).add(item_id, vectors.schema[item_id].dataType).add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, cell, types = None, [], None, None

        def told(cell: Cell) -> Iterator[pa.RecordBatch]:
            cell.cut()
            for q, score, ids in cell.held:
                for lo in range(0, len(q), 1 << 16):
                    own = slice(lo, lo + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([cell.ids[n] for n in q[own].tolist()], types[0]), pa.array(ids[own].tolist(), types[1]), pa.array(score[own])], names=out.names)

        for batch in batches:
            types = batch.schema.field("q").type, batch.schema.field("v").type
            keys = np.stack([np.asarray(batch.column(c)) for c in ("i", "j", "kind")], 1)
            starts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if hi == lo:
                    continue
                if tuple(keys[lo][:2]) != at:
                    if cell is not None:
                        yield from told(cell)
                    at, asked, cell = tuple(keys[lo][:2]), [], None
                own = batch.slice(lo, hi - lo)
                if keys[lo][2] == 0:
                    asked.append((own.column("q").to_pylist(), _matrix(own.column("vec"))))
                    continue
                if not asked:
                    continue
                if cell is None:
                    if len(dims := {m.shape[1] for _, m in asked}) != 1:
                        raise ValueError(f"vectors of {sorted(dims)} dimensions in one column")
                    cell = Cell([x for ids, _ in asked for x in ids], np.concatenate([m for _, m in asked]), k, digits)
                for n in range(0, hi - lo, STRIDE):
                    part = own.slice(n, STRIDE)
                    cell.see(part.column("v").to_pylist(), _matrix(part.column("vec")))
        if cell is not None:
            yield from told(cell)

    w = W.partitionBy(query_id).orderBy(F.desc("score"), F.asc(item_id))
    return rows.mapInArrow(run, out).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)


#: Rows of ids and their vectors one after the other as float32. Of queries, ``ask`` tells which of them wants ``item``, whose score is ``score``.
BLOCKS = "asks boolean, n int, ids array<string>, vecs binary, ask array<int>, item array<string>, score array<double>"
_BLOCK = [("asks", pa.bool_()), ("n", pa.int32()), ("ids", pa.list_(pa.string())), ("vecs", pa.binary()), ("ask", pa.list_(pa.int32())), ("item", pa.list_(pa.string())), ("score", pa.list_(pa.float64()))]
#: Rows of items whose vectors are the sample.
SAMPLE_BLOCKS = 8
#: Queries of a cell at most, and vectors.
CELL_QUERIES = 1 << 16
CELL_VECTORS = 1 << 18
#: Vectors that are compared at once, fewer of the first ones, and wanted items at once.
FIRST, PAIRS = 64, 1 << 21


def block(asks: bool, ids: list[str], vecs: np.ndarray, wanted: tuple[list[int], list[str], list[float]] = ((), (), ())) -> pa.RecordBatch:
    """One row of ``BLOCKS``."""
    values = (asks, len(ids), ids, np.ascontiguousarray(vecs, np.float32).tobytes(), *map(list, wanted))
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, _BLOCK, strict=True)], names=[n for n, _ in _BLOCK])


class Wanted:
    """For each wanted item of some queries how many vectors stand before it, counted up to k."""

    def __init__(self, ids: list[str], vecs: np.ndarray, wanted: tuple[list[int], list[str], list[float]], k: int, digits: int) -> None:
        self.ids, self.vecs, self.k, self.digits = ids, vecs, k, digits
        self.ask, self.item, self.score = np.asarray(wanted[0], np.int64), np.asarray(wanted[1], str), np.asarray(wanted[2], np.float64)
        self.norm = np.sqrt((vecs.astype(np.float64) ** 2).sum(1))
        self.count = np.zeros(len(self.ask), np.int64)
        self.places = {own: n for n, own in enumerate(ids)}

    def see(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        size, lo = FIRST, 0
        mine = [(n, self.places[own]) for n, own in enumerate(ids.tolist()) if own in self.places]
        longest = float(np.sqrt((vecs.astype(np.float64) ** 2).sum(1).max(initial=0)))
        while lo < len(vecs):
            open_ = np.flatnonzero(self.count < self.k)
            if not len(open_):
                return
            step = max(1, PAIRS // size)
            for at in range(0, len(open_), step):
                self._see(open_[at : at + step], ids[lo : lo + size], vecs[lo : lo + size], longest, [(n - lo, p) for n, p in mine if lo <= n < lo + size])
            lo += size
            size = min(2 * size, STRIDE)

    def _see(self, own: np.ndarray, ids: np.ndarray, vecs: np.ndarray, longest: float, mine: list[tuple[int, int]]) -> None:
        ask = self.ask[own]
        near = self.vecs[ask] @ vecs.T
        for n, place in mine:
            near[ask == place, n] = -np.inf
        # What single precision and rounding can move a score by: only scores within it are made anew.
        slack = 2.0**-23 * (vecs.shape[1] + 2) * self.norm[ask] * longest + 10.0**-self.digits
        flat = np.flatnonzero(near >= (self.score[own] - slack).astype(np.float32)[:, None])
        row, col = flat // len(vecs), flat % len(vecs)
        sure = near.ravel()[flat] > (self.score[own] + slack)[row]
        count = np.bincount(row[sure], minlength=len(own))
        row, col = row[~sure], col[~sure]
        for at in range(0, len(row), 1 << 16):
            r, c = row[at : at + (1 << 16)], col[at : at + (1 << 16)]
            exact = np.round((self.vecs[ask[r]].astype(np.float64) * vecs[c].astype(np.float64)).sum(1), self.digits)
            level = self.score[own[r]]
            before = (exact > level) | ((exact == level) & (ids[c] < self.item[own[r]]))
            count += np.bincount(r[before], minlength=len(own))
        self.count[own] += count

    def left(self) -> tuple[list[str], np.ndarray, tuple[list[int], list[str], list[float]]]:
        """Queries that still want something, and what."""
        own = np.flatnonzero(self.count < self.k)
        asks, place = np.unique(self.ask[own], return_inverse=True)
        return [self.ids[a] for a in asks.tolist()], self.vecs[asks], (place.tolist(), self.item[own].tolist(), self.score[own].tolist())


def ranks(blocks: DataFrame, dims: int, k: int, digits: int = 6) -> DataFrame:
    """(query_id, item_id, rank) of the wanted items of ``BLOCKS`` that are among a query's first k, by inner product and then item id.

    ``blocks`` are read several times, so they should come from files. Scores
    must be rounded to ``digits``. As in ``nearest`` a vector of the query's own
    id is passed over.
    """
    read = lambda batch, r: (batch.column("ids")[r].as_py(), np.frombuffer(batch.column("vecs")[r].as_py(), np.float32).reshape(-1, dims), tuple(batch.column(c)[r].as_py() for c in ("ask", "item", "score")))
    sample = [(np.asarray(r.ids, str), np.frombuffer(r.vecs, np.float32).reshape(-1, dims)) for r in blocks.where("not asks").select("ids", "vecs").limit(SAMPLE_BLOCKS).collect()]

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                own = Wanted(*read(batch, r), k, digits)
                for ids, vecs in sample:
                    own.see(ids, vecs)
                if (own.count < k).any():
                    ids, vecs, wanted = own.left()
                    yield block(True, ids, vecs, wanted)

    asked = kept(blocks.where("asks").mapInArrow(sieve, BLOCKS))
    n_q, n_v = (int(df.agg(F.sum("n")).first()[0] or 0) for df in (asked, blocks.where("not asks")))
    n_i = max(1, math.ceil(n_q / CELL_QUERIES))
    n_j = max(1, min(math.ceil(n_v / BLOCK_ROWS), max(math.ceil(CELLS / n_i), math.ceil(n_v / CELL_VECTORS))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64(F.get("ids", 0), F.lit(n)), F.lit(n)).cast("int")
    rows = asked.select(dealt(n_i).alias("i"), each(n_j).alias("j"), "*").unionByName(blocks.where("not asks").select(each(n_i).alias("i"), dealt(n_j).alias("j"), "*"))
    rows = rows.repartition(n_i * n_j, "i", "j").sortWithinPartitions("i", "j", F.desc("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, cell = None, [], None

        def told(cell: Wanted) -> pa.RecordBatch:
            ids = np.asarray(cell.ids, object)[cell.ask].tolist()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(cell.item.tolist(), pa.string()), pa.array(cell.count)], names=["query_id", "item_id", "n"])

        for batch in batches:
            for r in range(batch.num_rows):
                key = batch.column("i")[r].as_py(), batch.column("j")[r].as_py()
                if key != at:
                    if cell is not None:
                        yield told(cell)
                    at, parts, cell = key, [], None
                ids, vecs, wanted = read(batch, r)
                if batch.column("asks")[r].as_py():
                    parts.append((ids, vecs, wanted))
                    continue
                if cell is None and parts:
                    starts = np.cumsum([0, *(len(p[0]) for p in parts)])
                    joined = [a + int(s) for s, p in zip(starts, parts, strict=False) for a in p[2][0]], *([x for p in parts for x in p[2][c]] for c in (1, 2))
                    cell = Wanted([x for p in parts for x in p[0]], np.concatenate([p[1] for p in parts]), joined, k, digits)
                if cell is not None:
                    cell.see(np.asarray(ids, str), vecs)
        if cell is not None:
            yield told(cell)

    counts = rows.mapInArrow(run, "query_id string, item_id string, n long").groupBy("query_id", "item_id").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") < k).select("query_id", "item_id", (F.col("n") + 1).cast("int").alias("rank"))
