"""Quality classifier by importance resampling.

Two generative models of hashed byte n-grams are counted: one of the target
(labelled good documents), one of the raw corpus (every document). A document's
log weight is the log ratio of its probabilities under the two: the sum over
its n-grams of ``log p_target - log p_raw``. Gumbel noise of unit scale, fixed
by the document's id, is added, and the k documents with the highest sums are
kept: Gumbel top-k is sampling without replacement by importance weight. ``k``
is a parameter; by default it is the number of documents whose log weight
reaches the cut that tells the labelled good from the labelled bad with the
fewest errors. With no bad labels every document is kept then.

The raw model counts all n-grams of all documents. The labels used are a
bounded sample (``max_labels``, chosen by a hash of the id), which is all that
is broadcast beside the model; the model has ``2 ** BITS`` buckets whatever the
input.

Defined results: null and empty texts have weight 0 (no evidence); a null
doc_id takes part with noise of its own text; rows of equal id have equal
noise; ties at the k-th place are all kept; empty tables give empty results;
``keep`` returns the columns it got, whatever their names (only names that
begin with ``__`` are reserved).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, spans, text_buffer

BITS = 16
#: Lengths of the n-grams in bytes.
ORDERS = (2, 4, 6, 8)
#: Most labelled rows that the target model and the cut are fitted on.
MAX_LABELS = 20_000
_BLOCK = 1 << 20
#: The bucket of places where no n-gram fits.
NONE = 1 << BITS


def gram_blocks(data: np.ndarray, offsets: np.ndarray, order: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, bucket of the n-gram at each byte); NONE where none fits in its document."""
    ends = offsets[1:]
    for lo, hi in spans(len(data), _BLOCK):
        part = np.zeros(hi - lo + order - 1, np.uint64)
        own = data[lo : hi + order - 1]
        part[: len(own)] = own
        key = np.full(hi - lo, order, np.uint64)
        for k in range(order):
            key = (key << np.uint64(8)) | part[k : k + hi - lo]
        bucket = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)
        near = ends[(ends > lo) & (ends < hi + order)]
        for k in range(1, order):
            at = near - k
            bucket[at[(at >= lo) & (at < hi)] - lo] = NONE
        yield lo, hi, bucket


def document_sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per document: sum of its n-grams' weights."""
    total = np.zeros(len(offsets) - 1)
    lengths = np.diff(offsets)
    for order in ORDERS:
        for lo, hi, bucket in gram_blocks(data, offsets, order):
            first = int(np.searchsorted(offsets, lo, "right")) - 1
            last = int(np.searchsorted(offsets, hi, "left"))
            own = np.arange(first, last)[lengths[first:last] > 0]
            starts = np.maximum(offsets[own], lo) - lo
            total[own] += np.add.reduceat(weights[bucket], starts)
    return total


def label_sample(labels: DataFrame, id_col: str, label_col: str, max_labels: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``max_labels`` (id, label) rows by hash order, sorted by id."""
    rows = (
        labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("q"))
        .where("i is not null and q is not null")
        .groupBy("i").agg(F.min("q").alias("q"))
        .orderBy(F.xxhash64("i"), "i")
        .limit(max_labels)
        .toPandas()
        .sort_values("i")
    )
    return rows["i"].to_numpy(np.int64), rows["q"].to_numpy(np.int64)


def looked_up(ids: pa.Array, known: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Label of each id, -1 if it has none."""
    out = np.full(len(ids), -1, np.int64)
    if len(known) and len(ids):
        valid = ~np.asarray(ids.is_null())
        own = np.asarray(ids.fill_null(0), dtype=np.int64)
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        hit = valid & (known[at] == own)
        out[hit] = labels[at[hit]]
    return out


def fit_log_ratio(docs: DataFrame, known: np.ndarray, labels: np.ndarray, id_col: str, text_col: str) -> np.ndarray:
    """log p_target - log p_raw for each bucket, and 0 for NONE."""
    size = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(size + 1, np.int64), np.zeros(size + 1, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            target = looked_up(batch.column(0), known, labels) == 1
            wanted = np.repeat(target, np.diff(offsets)) if target.any() else None
            for order in ORDERS:
                for lo, hi, bucket in gram_blocks(data, offsets, order):
                    raw += np.bincount(bucket, minlength=size + 1)
                    if wanted is not None:
                        good += np.bincount(bucket[wanted[lo:hi]], minlength=size + 1)
        raw[NONE] = 0
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(good[at])], ["bucket", "raw", "good"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(count, "bucket int, raw long, good long")
    table = rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas()
    raw, good = np.zeros(size), np.zeros(size)
    raw[table["bucket"]], good[table["bucket"]] = table["raw"], table["good"]
    if not good.sum():
        return np.zeros(size + 1)
    # Target and raw share a prior of one count a bucket, spread as the raw corpus is.
    prior = (raw + 1) / (raw.sum() + size)
    return np.append(np.log((good + size * prior) / (good.sum() + size)) - np.log(prior), 0.0)


def best_cut(weights: np.ndarray, labels: np.ndarray) -> float:
    """Cut with the fewest errors, in the middle of its widest gap; -inf without bad labels."""
    good, bad = np.sort(weights[labels == 1]), np.sort(weights[labels == 0])
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    mids = np.concatenate([[at[0] - 1e-9], (at[1:] + at[:-1]) / 2])
    right = len(good) - np.searchsorted(good, mids) + np.searchsorted(bad, mids)
    top = np.flatnonzero(right == right.max())
    gaps = np.append(at[1:] - at[:-1], 0.0)[np.maximum(top - 1, 0)]
    return float(mids[top[np.argmax(gaps)]])


class Sampler:
    """The fitted models and the least key that is kept."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, k: int | None, max_labels: int, seed: int) -> None:
        self.id_col, self.text_col, self.seed = id_col, text_col, seed
        known, marks = label_sample(labels, id_col, label_col, max_labels)
        self.ratio = fit_log_ratio(docs, known, marks, id_col, text_col)
        self.scored = saved(docs.select(F.col(id_col).cast("long").alias("id"), self.log_weight().alias("log_weight"), self.noise().alias("noise")))
        if k is None:
            rows = docs.sparkSession.createDataFrame(list(zip(known.tolist(), marks.tolist(), strict=True)), "id long, q long")
            fitted = self.scored.join(F.broadcast(rows), "id").groupBy("id").agg(F.first("log_weight").alias("w"), F.first("q").alias("q")).toPandas()
            cut = best_cut(fitted["w"].to_numpy(float), fitted["q"].to_numpy())
            k = self.scored.where(F.col("log_weight") >= F.lit(cut)).count()
        keyed = self.scored.select((F.col("log_weight") + F.col("noise")).alias("key"))
        self.least = kth_largest(keyed, "key", k, keyed.count())

    def log_weight(self) -> Column:
        ratio = self.ratio

        @F.arrow_udf("double")
        def weigh(texts: pa.Array) -> pa.Array:
            return pa.array(document_sums(*text_buffer(texts), ratio))

        return weigh(F.col(self.text_col))

    def noise(self) -> Column:
        """Gumbel noise: 53 bits of a hash make a uniform number in (0, 1)."""
        i = F.col(self.id_col)
        h = F.when(i.isNull(), F.xxhash64(F.col(self.text_col), F.lit(self.seed))).otherwise(F.xxhash64(i.cast("long"), F.lit(self.seed)))
        return -F.log(-F.log((F.shiftrightunsigned(h, 11).cast("double") + 0.5) / F.lit(float(1 << 53))))


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, max_labels: int = MAX_LABELS, seed: int = 17
) -> DataFrame:
    """One row per document: ``id_col``, log_weight, key, kept. The text isn't carried."""
    fitted = Sampler(docs, labels, id_col, text_col, label_col, k, max_labels, seed)
    key = F.col("log_weight") + F.col("noise")
    return fitted.scored.select(F.col("id").alias(id_col), "log_weight", key.alias("key"), (key >= F.lit(fitted.least)).alias("kept"))


def keep(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None, max_labels: int = MAX_LABELS, seed: int = 17
) -> DataFrame:
    """The rows of ``docs`` that are kept. They are weighed once more, so that no text moves."""
    fitted = Sampler(docs, labels, id_col, text_col, label_col, k, max_labels, seed)
    return docs.withColumn("__weight", fitted.log_weight()).where(F.col("__weight") + fitted.noise() >= F.lit(fitted.least)).drop("__weight")


def kth_largest(df: DataFrame, col: str, k: int, n: int) -> float:
    """The exact k-th largest value, found by narrowing a range of 4096 counted bins.

    Each pass brings one bounded histogram to the driver, and no rows.
    """
    if k <= 0:
        return float("inf")
    if k >= n:
        return float("-inf")
    lo, hi = df.agg(F.min(col), F.max(col)).first()
    above, bins = 0, 4096
    value = F.col(col)
    while hi > lo:
        width = (hi - lo) / bins
        if not width or lo + width <= lo:
            break
        slot = F.least(F.floor((value - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        inside = df.where((value >= F.lit(lo)) & (value <= F.lit(hi)))
        rows = inside.groupBy(slot.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if above + r["n"] >= k:
                if (lo, hi) == (r["lo"], r["hi"]):
                    return float(lo)
                lo, hi = r["lo"], r["hi"]
                break
            above += r["n"]
    return float(lo)
