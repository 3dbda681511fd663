"""Fine-tuning of the bag-of-n-grams encoder on questions and their evidence.

The loss is multiple negatives ranking: within a batch of examples a question
must score its positive above the positives of other tasks and above all hard
negatives, by softmax over scaled cosines. Texts become table places once and
are written to the shared folder, dealt to the steps of an epoch by a hash of
the task. A step is one job: partitions add up gradients of the table rows that
they touch, sums are added in a tree, and the driver changes those rows alone
(Adagrad by row). The table has a fixed size, and so has what reaches the
driver. Epoch 0 is the encoder as given; an epoch is taken only if it is
strictly better on the dev tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import kept
from .encoder import STRIDE, HashedBag, bag_sums
from .graph_training import FAN_IN

#: Files that a step's examples are written to, for each core.
FILES = 1
PLACES = "task_id string, asked array<int>, positive array<int>, negatives array<array<int>>, bucket int"
SUMS = "part long, loss double, n long, rows binary, gradient binary"


@dataclass(frozen=True)
class FinetuneConfig:
    epochs: int = 4
    steps: int = 4
    batch: int = 64
    scale: float = 20.0
    rate: float = 0.05
    seed: int = 17

    def __post_init__(self) -> None:
        if min(self.epochs, self.steps) < 1 or self.batch < 2 or self.scale <= 0 or self.rate <= 0:
            raise ValueError("epochs, steps, scale and rate must be positive, and a batch must hold two examples")


@dataclass(frozen=True)
class FinetuneResult:
    encoder: HashedBag
    best_epoch: int
    history: list[dict]


def examples(triples: DataFrame, tasks: DataFrame, items: DataFrame) -> DataFrame:
    """(task_id, question, positive, negatives) texts of (task_id, positive, negative) ids; negatives in order of id, none for a positive alone."""
    own = items.select("task_id", "item_id", "ranking_text")
    rows = triples.join(own.withColumnsRenamed({"item_id": "positive", "ranking_text": "p_text"}), ["task_id", "positive"])
    rows = rows.join(own.withColumnsRenamed({"item_id": "negative", "ranking_text": "n_text"}), ["task_id", "negative"], "left")
    told = F.sort_array(F.collect_list(F.when(F.col("negative").isNotNull(), F.struct("negative", "n_text"))))
    rows = rows.groupBy("task_id", "positive").agg(F.first("p_text").alias("p_text"), told.alias("n"))
    return rows.join(tasks.select("task_id", "question"), "task_id").select("task_id", "question", F.col("p_text").alias("positive"), F.transform("n", lambda x: x["n_text"]).alias("negatives"))


def examples_within(rows: DataFrame, seed: str = "13") -> DataFrame:
    """``examples`` of rows of (task_id, asked, own), own an array of (item_id, text, gold): each gold candidate with the first other one by a hash, as ``pairs.easy_random`` draws it; nothing moves."""
    place = lambda i: F.struct(F.md5(F.concat_ws("|", F.lit(seed), "task_id", i["item_id"]).cast("binary")).alias("h"), i["item_id"].alias("i"), i["text"].alias("t"))
    first = F.transform(F.slice(F.sort_array(F.transform(F.filter("own", lambda i: ~i["gold"]), place)), 1, 1), lambda x: x["t"])
    gold = F.transform(F.filter("own", lambda i: i["gold"]), lambda i: F.struct(i["text"].alias("positive")))
    return rows.select("task_id", F.col("asked").alias("question"), first.alias("negatives"), F.inline_outer(gold)).where("positive is not null")


def _placed(rows: DataFrame, encoder: HashedBag, config: FinetuneConfig) -> DataFrame:
    """Texts as table places."""

    def lists(texts: list[str]) -> pa.ListArray:
        places, offsets = encoder.places([t or "" for t in texts])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            negatives = batch.column("negatives")
            size = np.asarray(negatives.value_lengths().fill_null(0), np.int64)
            outer = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
            cols = [batch.column("task_id"), lists(batch.column("question").to_pylist()), lists(batch.column("positive").to_pylist()), pa.ListArray.from_arrays(outer, lists(negatives.flatten().to_pylist())), batch.column("bucket")]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PLACES.split(", ")])

    bucket = F.pmod(F.xxhash64("task_id", F.lit(config.seed)), F.lit(config.steps)).cast("int").alias("bucket")
    return rows.select("task_id", "question", "positive", "negatives", bucket).mapInArrow(run, PLACES)


def ranking_gradient(table: np.ndarray, batch: list[dict], scale: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Sum of the loss over a batch's examples, the table rows that take part, and their gradient."""
    texts = [*(r["asked"] for r in batch), *(r["positive"] for r in batch), *(n for r in batch for n in r["negatives"] or ())]
    places = np.concatenate([np.asarray(t, np.int64) for t in texts])
    return places_gradient(table, places, np.fromiter(map(len, texts), np.int64, len(texts)), [r["task_id"] for r in batch], scale)


def places_gradient(table: np.ndarray, places: np.ndarray, size: np.ndarray, tasks: list[str], scale: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The same from the places of all questions, then all positives, then all negatives, and how many each text has."""
    raw = bag_sums(table, places, np.concatenate([[0], np.cumsum(size)]))
    norm = np.maximum(np.sqrt((raw * raw).sum(1, keepdims=True)), 1e-12)
    v = raw / norm
    n = len(tasks)
    q, c = v[:n], v[n:]
    score = scale * (q @ c.T)
    task = np.array(tasks)
    # Other positives of the same task are no negatives.
    same = (task[:, None] == task[None, :]) & ~np.eye(n, dtype=bool)
    score[:, :n][same] = -np.inf
    top = score.max(1, keepdims=True)
    p = np.exp(score - top)
    total = p.sum(1, keepdims=True)
    loss = float((np.log(total[:, 0]) + top[:, 0] - score[np.arange(n), np.arange(n)]).sum())
    p /= total
    p[np.arange(n), np.arange(n)] -= 1
    d_v = np.concatenate([scale * (p @ c), scale * (p.T @ q)])
    d_raw = (d_v - v * (d_v * v).sum(1, keepdims=True)) / norm
    return loss, *_added(places, d_raw, np.repeat(np.arange(len(size)), size))


def _added(rows: np.ndarray, gradient: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct table rows in order, and for each the sum of ``gradient[owner]`` where it stands; a bounded number of them at a time."""
    # Two bytes are sorted by their digits.
    order = np.argsort(rows.astype(np.uint16) if len(rows) and rows.max() < 1 << 16 else rows, kind="stable")
    ordered, owner = rows[order], owner[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    out = np.zeros((len(starts), gradient.shape[1]))
    group = np.cumsum(np.diff(ordered, prepend=-1) != 0) - 1
    for lo in range(0, len(rows), STRIDE):
        own = group[lo : lo + STRIDE]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(gradient[owner[lo : lo + STRIDE]], first)
    return ordered[starts], out


class _Sums:
    """Gradients by table row, added where they stand."""

    def __init__(self, shape: tuple[int, int]) -> None:
        self.total, self.touched = np.zeros(shape), np.zeros(shape[0], bool)

    def add(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        self.total[rows] += gradient  # rows are distinct
        self.touched[rows] = True

    def told(self, part: int, loss: float, n: int) -> dict:
        rows = np.flatnonzero(self.touched)
        return {"part": pa.array([part], pa.int64()), "loss": pa.array([loss]), "n": pa.array([n], pa.int64()), "rows": pa.array([rows.tobytes()], pa.binary()), "gradient": pa.array([self.total[rows].tobytes()], pa.binary())}


def _cut(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows each, the last one of what is left."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        lo = 0
        while lo < batch.num_rows:
            own = batch.slice(lo, size - count)
            held.append(own)
            lo, count = lo + own.num_rows, count + own.num_rows
            if count == size:
                yield pa.concat_batches(held)
                held, count = [], 0
    if held:
        yield pa.concat_batches(held)


def step_gradient(rows: DataFrame, encoder: HashedBag, config: FinetuneConfig) -> tuple[float, int, np.ndarray, np.ndarray]:
    """Loss, examples, touched table rows and their gradient over all rows, added in a tree."""
    table, dims = encoder.weights(), encoder.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, sums, loss, n = table.astype(np.float64), None, 0.0, 0
        for batch in _cut(batches, config.batch):
            texts = [batch.column("asked"), batch.column("positive"), batch.column("negatives").flatten()]
            places = np.concatenate([np.asarray(t.flatten(), np.int32) for t in texts])
            size = np.concatenate([np.asarray(t.value_lengths(), np.int64) for t in texts])
            own, touched, gradient = places_gradient(wide, places, size, batch.column("task_id").to_pylist(), config.scale)
            sums = sums or _Sums(table.shape)
            sums.add(touched, gradient)
            loss, n = loss + own, n + batch.num_rows
        if sums is not None:
            row = sums.told(TaskContext.get().partitionId(), loss, n)
            yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    read = lambda r, g: (np.frombuffer(r, np.int64), np.frombuffer(g).reshape(-1, dims))

    def add(table_: pa.Table) -> pa.Table:
        own = sorted(table_.to_pylist(), key=lambda r: r["part"])
        sums = _Sums(table.shape)
        for r in own:
            sums.add(*read(r["rows"], r["gradient"]))
        return pa.table(sums.told(own[0]["part"] // FAN_IN, sum(r["loss"] for r in own), sum(r["n"] for r in own)))

    sums = rows.mapInArrow(run, SUMS)
    parts = rows.rdd.getNumPartitions()
    while parts > 1:
        sums = sums.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(add, SUMS)
        parts = -(-parts // FAN_IN)
    got = sums.collect()  # one row
    if not got:
        return 0.0, 0, np.zeros(0, np.int64), np.zeros((0, dims))
    return got[0].loss, got[0].n, *read(got[0].rows, got[0].gradient)


def finetune(rows: DataFrame, encoder: HashedBag, measure: Callable[[HashedBag], float], config: FinetuneConfig = FinetuneConfig()) -> FinetuneResult:
    """The encoder of the best epoch on ``examples``; ``measure`` tells how good an encoder is on dev tasks (more is better)."""
    # As many files a step as keep all cores busy, whatever the plan before it was cut down to; in a fixed order, as batches are cut from it.
    parts = FILES * rows.sparkSession.sparkContext.defaultParallelism
    data = kept(_placed(rows.repartition(parts, "task_id"), encoder, config).sortWithinPartitions("bucket", "task_id", "positive"), by="bucket")
    table = encoder.weights().astype(np.float64)
    squares = np.zeros(len(table))
    best, best_epoch, chosen = measure(encoder), 0, encoder
    history = [{"epoch": 0, "train_loss": None, "measure": best, "best_measure": best}]
    current = encoder
    for epoch in range(1, config.epochs + 1):
        loss = n = 0.0
        for step in range(config.steps):
            own, count, touched, gradient = step_gradient(data.where(F.col("bucket") == step), current, config)
            if not count:
                continue
            gradient = gradient / count
            squares[touched] += (gradient * gradient).mean(1)
            table[touched] -= config.rate * gradient / (np.sqrt(squares[touched]) + 1e-10)[:, None]
            current = replace(encoder, table=table.astype(np.float32))
            loss, n = loss + own, n + count
        value = measure(current)
        if value > best:
            best, best_epoch, chosen = value, epoch, current
        history.append({"epoch": epoch, "train_loss": loss / max(1.0, n), "measure": value, "best_measure": best})
    return FinetuneResult(chosen, best_epoch, history)
