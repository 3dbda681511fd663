"""Language identification by a byte convolutional network.

Texts are folded to 64 byte classes and cut into windows of fixed length that
cover the whole text. Filters of three widths slide over a window, each filter
keeps its maximum (after a rectifier), and a softmax layer gives language
probabilities; a document's are the mean over its windows. Training is
stochastic gradient descent in numpy on the driver, over a bounded sample of
labelled windows (``DOCS_PER_LANG`` documents of a language, by hash order, and
``WINDOWS_PER_DOC`` windows of each, spread over the whole text). The sample is
taken by a limit on hashes for each language, so no language's rows meet in a
task. Every language that is labelled is learned; the model has a fixed size a
language.

Defined results: ``und`` with score 0 for a null text, a text without a letter,
or when no labelled text was learned from; ties between languages go to the
first in alphabetical order; null labels are never learned from; repeated rows
get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffer

LENGTH = 128
CLASSES = 64
FILTERS = 16
DOCS_PER_LANG = 300
WINDOWS_PER_DOC = 4
#: So many times the wanted documents pass the limit on hashes, before the first of them are taken.
SPARE = 3
_HASHES = 1 << 32
EPOCHS = 4
UNKNOWN = "und"


def class_table() -> np.ndarray:
    """Class of each byte: 0 padding, white space, digits, punctuation, letters, then upper halves."""
    table = np.zeros(256, np.uint8)
    table[:128] = 3
    table[list(b" \t\n\r\x0b\x0c")] = 1
    table[list(b"0123456789")] = 2
    table[ord("'")] = 4
    for k in range(26):
        table[[ord("a") + k, ord("A") + k]] = 5 + k
    table[0x80:0xC0] = 31 + (np.arange(0x80, 0xC0) & 31)
    table[0xC0:] = 63
    return table


TABLE = class_table()


def fold(data: np.ndarray) -> np.ndarray:
    """Byte classes; the capital letters U+00C0 to U+00DE count as small ones."""
    out = TABLE[data]
    if len(data) > 1:
        capital = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
        out[capital] = TABLE[data[capital] + 0x20]
    return out


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, LENGTH) classes of all documents in order, and each one's number of windows."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // LENGTH))
    first = np.cumsum(counts) - counts
    flat = np.zeros(int(counts.sum()) * LENGTH, np.uint8)
    classes = fold(data)
    for i in range(len(lengths)):
        at = first[i] * LENGTH
        flat[at : at + lengths[i]] = classes[offsets[i] : offsets[i + 1]]
    return flat.reshape(-1, LENGTH), counts


@dataclass
class ByteCnn:
    """filters[w]: (w, CLASSES, FILTERS); bias[w]: (FILTERS,); out: (3 * FILTERS + 1, languages)."""

    langs: list[str]
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray

    @classmethod
    def new(cls, langs: list[str], widths: tuple[int, ...] = (2, 3, 4), seed: int = 5) -> ByteCnn:
        rng = np.random.default_rng(seed)
        filters = {w: rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in widths}
        return cls(langs, filters, {w: np.zeros(FILTERS, np.float32) for w in widths}, rng.normal(0, 0.1, (len(widths) * FILTERS + 1, len(langs))).astype(np.float32))

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima of all filters with a constant, and where each maximum stands."""
        parts, where = [], []
        rows = np.arange(len(x))[:, None]
        cols = np.arange(FILTERS)[None, :]
        for w, f in self.filters.items():
            n = x.shape[1] - w + 1
            conv = f[0][x[:, :n]]
            for j in range(1, w):
                conv = conv + f[j][x[:, j : j + n]]
            at = conv.argmax(1)
            parts.append(np.maximum(conv[rows, at, cols] + self.bias[w], 0))
            where.append(at)
        return np.concatenate([*parts, np.ones((len(x), 1), np.float32)], 1), where

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, batch: int = 64, seed: int = 7) -> None:
        """Gradient descent with momentum on the cross-entropy."""
        rng = np.random.default_rng(seed)
        params = [*self.filters.values(), *self.bias.values(), self.out]
        speed = [np.zeros_like(p) for p in params]
        k = len(self.filters)
        for epoch in range(epochs):
            order = rng.permutation(len(x))
            step = rate * 0.6**epoch
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                xb, yb = x[own], y[own]
                hidden, where = self.pooled(xb)
                p = softmax(hidden @ self.out)
                p[np.arange(len(own)), yb] -= 1
                p /= len(own)
                grads = [np.zeros_like(q) for q in params]
                grads[-1] = hidden.T @ p + 1e-4 * self.out
                back = (p @ self.out.T) * (hidden > 0)
                rows = np.arange(len(own))[:, None]
                cols = np.broadcast_to(np.arange(FILTERS)[None, :], (len(own), FILTERS))
                for i, w in enumerate(self.filters):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    grads[k + i] = g.sum(0)
                    for j in range(w):
                        np.add.at(grads[i][j], (xb[rows, where[i] + j], cols), g)
                for q, v, g in zip(params, speed, grads, strict=True):
                    v *= 0.9
                    v -= step * g
                    q += v

    def compiled(self) -> dict[int, np.ndarray]:
        """A filter's first two positions as one table over pairs of classes; likewise its last two if it has four."""
        out = {}
        for w, f in self.filters.items():
            out[w, 0] = (f[0][:, None, :] + f[1][None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
            if w == 3:
                out[w, 1] = f[2]
            elif w == 4:
                out[w, 1] = (f[2][:, None, :] + f[3][None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        return out

    def probabilities(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        tables = self.compiled()
        out = np.zeros((len(x), len(self.langs)), np.float32)
        for lo in range(0, len(x), block):
            xb = x[lo : lo + block].astype(np.int32)
            pair = xb[:, :-1] * CLASSES + xb[:, 1:]
            parts = []
            for w in self.filters:
                if w == 2:
                    conv = tables[2, 0].take(pair, 0)
                elif w == 3:
                    conv = tables[3, 0].take(pair[:, :-1], 0)
                    conv += tables[3, 1].take(xb[:, 2:], 0)
                else:
                    conv = tables[4, 0].take(pair[:, :-2], 0)
                    conv += tables[4, 1].take(pair[:, 2:], 0)
                parts.append(np.maximum(conv.max(1) + self.bias[w], 0))
            hidden = np.concatenate([*parts, np.ones((len(xb), 1), np.float32)], 1)
            out[lo : lo + block] = softmax(hidden @ self.out)
        return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def training_windows(docs: DataFrame, learn, id_col: str, text_col: str, lang_col: str, per_lang: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows and labels of the bounded sample. Ids travel first; only chosen texts are read."""
    row = F.xxhash64(F.col(id_col), F.col(text_col), F.col(lang_col))
    base = docs.select(row.alias("h"), F.col(lang_col).cast("string").alias("g"), F.col(text_col).alias("t"), learn.alias("k"))
    base = base.where("k and g is not null and t is not null and length(t) > 0")
    place = F.pmod("h", F.lit(_HASHES))
    counts = base.groupBy("g").agg(F.approx_count_distinct("h").alias("n"), F.min(place).alias("least"))
    limits = counts.select("g", F.greatest(F.ceil(F.lit(_HASHES) * F.lit(SPARE * per_lang) / F.col("n")), F.col("least") + 1).alias("most"))
    passed = base.select("h", "g").join(F.broadcast(limits), "g").where(place < F.col("most"))
    picked = passed.select("h", "g").distinct().toPandas()
    if not len(picked):
        return np.zeros((0, LENGTH), np.uint8), np.zeros(0, np.int64), []
    picked["order"] = picked["h"] % _HASHES
    picked = picked.sort_values(["g", "order", "h"]).groupby("g").head(per_lang)
    langs = sorted(set(picked["g"]))
    chosen = np.sort(picked["h"].to_numpy())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0))
            at = np.flatnonzero(chosen[np.minimum(np.searchsorted(chosen, own), len(chosen) - 1)] == own)
            if not len(at):
                continue
            part = batch.take(pa.array(at))
            data, offsets = text_buffer(part.column(1))
            x, counts = windows_of(data, offsets)
            first = np.cumsum(counts) - counts
            names, rows = part.column(2).to_pylist(), []
            for d, n in enumerate(counts):
                for k in np.unique(np.linspace(0, n - 1, min(n, WINDOWS_PER_DOC)).astype(int)):
                    rows.append((own[at[d]], k, x[first[d] + k].tobytes(), names[d]))
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["h", "k", "x", "g"])

    # Equal rows give equal windows; one of each is learned from.
    table = base.select("h", "t", "g").mapInArrow(cut, "h long, k long, x binary, g string").distinct().toPandas()
    table = table.sort_values(["g", "x"], kind="stable")  # the order of arrival isn't fixed
    x = np.frombuffer(b"".join(table["x"]), np.uint8).reshape(-1, LENGTH)
    y = np.searchsorted(langs, table["g"].to_numpy(str)) if len(table) else np.zeros(0, np.int64)
    return x, y, langs


def fit(docs: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = DOCS_PER_LANG) -> ByteCnn:
    """Train on the rows of ``docs`` for which the column ``learn`` is true."""
    x, y, langs = training_windows(docs, learn, id_col, text_col, lang_col, per_lang)
    model = ByteCnn.new(langs)
    if len(langs) > 1:
        model.train(x, y)
    return model


def identify(docs: DataFrame, model: ByteCnn, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add the predicted language and its probability, from the text alone."""

    @F.pandas_udf(f"{lang_out} string, {score_out} double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores = [], []
            for lo, hi in spans_by_size(texts):
                own = pa.array(texts.iloc[lo:hi], pa.string())
                data, offsets = text_buffer(own)
                x, counts = windows_of(data, offsets)
                first = np.cumsum(counts) - counts
                p = np.add.reduceat(model.probabilities(x), first, axis=0) / counts[:, None] if model.langs else np.zeros((hi - lo, 0))
                for k, t in enumerate(texts.iloc[lo:hi]):
                    if not model.langs or t is None or not has_letter(t):
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                    else:
                        best = int(p[k].argmax())
                        langs.append(model.langs[best])
                        scores.append(min(1.0, float(p[k, best])))
            yield pd.DataFrame({lang_out: langs, score_out: scores})

    out = docs.withColumn("__p", predict(F.col(text_col)))
    return out.withColumns({lang_out: F.col(f"__p.{lang_out}"), score_out: F.col(f"__p.{score_out}")}).drop("__p")


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def spans_by_size(texts, limit: int = 1 << 21):
    """Runs of rows with about ``limit`` characters, so that a batch's windows stay small."""
    lo = total = 0
    for k, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= limit:
            yield lo, k + 1
            lo, total = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
