"""Vectors of texts from an encoder that is set up once a worker.

An encoder has ``dims`` and ``open()``, which gives a function from a list of
texts to an array of (texts, dims). ``encoded`` applies it to a column of
texts, or of lists of texts: lists are flattened, encoded in batches of a given
size, and split again. Results of a wrong shape or length, or with values that
are no finite numbers, raise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructType

Encode = Callable[[list[str]], np.ndarray]
#: Byte n-grams of the bag of n-grams.
GRAMS = (3, 5)
#: Rows of the table that are added at once.
STRIDE = 200_000


class Encoder(Protocol):
    dims: int

    def open(self) -> Encode: ...


def checked(vectors: object, n: int, dims: int) -> np.ndarray:
    """The vectors as float32 if there are n of ``dims`` finite numbers."""
    out = np.asarray(vectors)
    if out.ndim != 2:
        raise ValueError(f"an encoder must give a row for each text, not an array of shape {out.shape}")
    if out.shape[0] != n:
        raise ValueError(f"an encoder gave {out.shape[0]} vectors for {n} texts")
    if out.shape[1] != dims:
        raise ValueError(f"an encoder of {dims} dimensions gave {out.shape[1]}")
    if not np.isfinite(out).all():
        raise ValueError("an encoder gave values that are no finite numbers")
    return out.astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows of zeros stay."""
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def encoded(df: DataFrame, text_col: str, encoder: Encoder, out_col: str = "vec", prefix: str = "", batch_size: int = 256, normalise: bool = True) -> DataFrame:
    """``df`` with a vector for each text of ``text_col``, or a list of vectors for each list; a null text counts as empty, a null list stays null."""
    if out_col in df.columns:
        raise ValueError(f"there is a column {out_col} already")
    many = isinstance(df.schema[text_col].dataType, ArrayType)
    vector = ArrayType(FloatType())
    schema = StructType([*df.schema]).add(out_col, ArrayType(vector) if many else vector)
    place = df.columns.index(text_col)
    dims = encoder.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder.open()
        for batch in batches:
            column = batch.column(place)
            flat = column.flatten() if many else column
            texts = [prefix + (t or "") for t in flat.to_pylist()]
            parts = [checked(encode(texts[lo : lo + batch_size]), len(texts[lo : lo + batch_size]), dims) for lo in range(0, len(texts), batch_size)]
            rows = np.concatenate(parts) if parts else np.zeros((0, dims), np.float32)
            rows = unit(rows) if normalise else rows
            ends = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * dims)
            told = pa.ListArray.from_arrays(ends, pa.array(rows.ravel(), pa.float32()))
            if many:
                size = np.asarray(column.value_lengths().fill_null(0), np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
                told = pa.ListArray.from_arrays(offsets, told, mask=column.is_null()) if column.null_count else pa.ListArray.from_arrays(offsets, told)
            yield pa.RecordBatch.from_arrays([*batch.columns, told], names=schema.names)

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class HashedBag:
    """Sums of table rows over the hashed byte n-grams of a text: an encoder that needs no model and can be trained.

    Without ``table`` the rows are seeded random numbers, which keeps the inner
    products of n-gram counts on average. The table has a fixed size.
    """

    dims: int = 48
    buckets: int = 1 << 14
    seed: int = 5
    table: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.dims < 1 or self.buckets < 1:
            raise ValueError("dims and buckets must be positive")
        if self.table is not None and self.table.shape != (self.buckets, self.dims):
            raise ValueError(f"the table must be of shape {(self.buckets, self.dims)}")

    def weights(self) -> np.ndarray:
        if self.table is not None:
            return self.table
        return (np.random.default_rng(self.seed).normal(0, 1, (self.buckets, self.dims)) / np.sqrt(self.dims)).astype(np.float32)

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of all n-grams, text after text, and the n + 1 offsets into them."""
        raw = [b" " + t.lower().encode("utf-8", "replace") + b" " for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(size)])
        found, owner = [], []
        text_of = np.repeat(np.arange(len(raw)), size)
        left = start[1:][text_of] - np.arange(len(data)) if len(data) else np.zeros(0, np.int64)
        for n in GRAMS:
            at = np.flatnonzero(left >= n)
            code = np.full(len(at), n, np.uint64)
            for k in range(n):
                code = code * np.uint64(0x100000001B3) ^ data[at + k]
            code ^= code >> np.uint64(29)
            found.append((code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(self.buckets))
            owner.append(text_of[at])
        whole, owner = np.concatenate(found).astype(np.int32), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return whole[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(raw)))]).astype(np.int64)

    def open(self) -> Encode:
        table = self.weights()

        def encode(texts: list[str]) -> np.ndarray:
            return bag_sums(table, *self.places(texts))

        return encode


def bag_sums(table: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the table's rows between offsets, over a bounded number of rows at a time."""
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    text_of = np.repeat(np.arange(len(out)), np.diff(offsets))
    for lo in range(0, len(places), STRIDE):
        own = text_of[lo : lo + STRIDE]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] += np.add.reduceat(table[places[lo : lo + STRIDE]].astype(np.float64, copy=False), first)
    return out
