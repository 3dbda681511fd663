"""Exact token counts of whole texts, with huge texts cut and put together again by overlap resynchronisation.

Texts of up to ``STEP`` characters are counted where they are read. Longer ones
are cut into chunks of ``STEP`` characters that reach ``OVERLAP`` characters
into the next one, and the chunks are dealt over all tasks, so one huge text is
the work of many. Each chunk is encoded with offsets and tells its boundaries
in both overlaps with the tokens before them. Neighbours are spliced at a
boundary that both have and that is proven stable: the pattern that cuts text
before the merges reads on from where it stands without looking back, so two
scans that meet at a place agree from there on; and a boundary far enough from
the end of the earlier chunk (``Vocabulary.reach``) can't change with what
follows. As the first chunk begins where the text begins, all splices are true
boundaries of the whole text. Where an overlap has no such place (a word longer
than it), the text goes into another round with chunks four times and overlaps
sixteen times as long, until they meet or the text is one chunk.

The proof needs a byte-level vocabulary without normaliser, prefix space or
added tokens that take in their neighbours. Other vocabularies, also those of
sentencepiece, are applied to whole texts.

Long texts are read by a second scan of the table, which costs a few percent of
what encoding costs; nothing else of the table moves. The driver gets two
counts of rows for each round.

Defined results: null and empty texts have 0 tokens and 0 bytes; strings of
special tokens inside texts count as the library reads them by default;
repeated rows and null ids have a row each; an empty table gives no rows; other
columns than the id are left out, whatever their names.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import saved
from .packing import default_vocabulary, encoder

#: Characters of a chunk, and of the overlap with the next one, in the first round.
STEP = 16_384
OVERLAP = 256
#: Failed texts of a round up to this number are sent to all tasks as keys; more are joined.
BROADCAST_KEYS = 100_000
KEYS = ("__id", "__hash", "__chars")
BOUNDS = ArrayType(StructType().add("at", LongType()).add("n", LongType()))


class Vocabulary:
    """Counts, and boundaries where they can be proven, of one tokenizer file."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.proven, self.reach, self.coder = False, 0, None
        if path.endswith(".model"):
            import sentencepiece

            self.coder = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        with open(path, encoding="utf-8") as lines:
            told = json.load(lines)
        added = told.get("added_tokens") or []
        cut = told.get("pre_tokenizer") or {}
        self.proven = (
            told.get("normalizer") is None and told.get("post_processor") is None and told["model"].get("dropout") is None
            and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
            and not any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word", "normalized"))
        )
        # A match looks at two characters behind its end at most, and a special token may begin there.
        self.reach = 2 + max([1, *[len(t["content"]) for t in added]])

    @functools.cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def words(self):
        """The cached reader of the same vocabulary, where its ranks lie beside it; tests hold it against ``tokenizer``."""
        ranks = self.path.removesuffix(".json") + ".tiktoken"
        return encoder(self.path, "tiktoken") if self.proven and os.path.exists(ranks) else None

    def counts(self, texts: list[str]) -> list[int]:
        if self.coder is not None:
            return [len(x) for x in self.coder.encode(texts, num_threads=1)]
        if self.words is not None:
            return [len(self.words.ids(t)) // 4 for t in texts]
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def bounds(self, text: str) -> tuple[np.ndarray, np.ndarray, int]:
        """Where pre-tokens of ``text`` begin, the tokens before each, and all tokens."""
        coded = self.tokenizer.encode(text, add_special_tokens=False)
        word = np.asarray(coded.word_ids)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        begin = np.asarray(coded.offsets, np.int64).reshape(-1, 2)[first, 0]
        return begin, first, len(word)


@functools.lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    return Vocabulary(path)


def _counted(docs: DataFrame, path: str, id_col: str, text_col: str) -> DataFrame:
    """(id, n_bytes, n_tokens) of texts that are encoded in one piece."""
    out = StructType([docs.schema[id_col]]).add("n_bytes", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary_of(path)
        for batch in batches:
            n = own.counts([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=out.names)

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    return docs.select(id_col, size, text_col).mapInArrow(run, out)


def _chunks(docs: DataFrame, step: int, overlap: int) -> DataFrame:
    """(keys, n_bytes, part, last, piece): a text's chunks, cut where the text is read."""
    out = StructType([docs.schema[c] for c in (*KEYS, "n_bytes")]).add("part", "long").add("last", "boolean").add("piece", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = batch.column(4)[k].as_py()
                parts = max(1, -(-(len(text) - overlap) // step))  # the last chunk goes on beyond the one before it
                for lo in range(0, parts, 256):
                    some = range(lo, min(parts, lo + 256))
                    same = [batch.column(c).take(pa.array([k] * len(some))) for c in range(4)]
                    own = [pa.array(some, pa.int64()), pa.array([p == parts - 1 for p in some]), pa.array([text[p * step : (p + 1) * step + overlap] for p in some])]
                    yield pa.RecordBatch.from_arrays(same + own, names=out.names)

    return docs.select(*KEYS, "n_bytes", "__text").mapInArrow(run, out)


def _bounds(chunks: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(keys, n_bytes, part, last, total, head, tail): proven boundaries in both overlaps of each chunk."""
    out = StructType([chunks.schema[c] for c in (*KEYS, "n_bytes", "part", "last")]).add("total", "long").add("head", BOUNDS).add("tail", BOUNDS)
    pair = pa.struct([("at", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary_of(path)
        for batch in batches:
            for k in range(batch.num_rows):
                part, last, piece = (batch.column(c)[k].as_py() for c in (4, 5, 6))
                at, n, total = own.bounds(piece)
                told = []
                for keep in ((at <= overlap) & (part > 0), (at >= step) & (at <= len(piece) - own.reach) & (not last)):
                    whole = pa.StructArray.from_arrays([pa.array(at[keep] + part * step, pa.int64()), pa.array(n[keep], pa.int64())], fields=list(pair))
                    told.append(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole))
                same = [batch.column(c).slice(k, 1) for c in range(6)]
                yield pa.RecordBatch.from_arrays([*same, pa.array([total], pa.int64()), *told], names=out.names)

    return chunks.mapInArrow(run, out)


def _spliced(docs: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(keys, n_bytes, n_tokens, copies) of long texts; n_tokens is null where two chunks have no common boundary."""
    dealt = _chunks(docs, step, overlap)
    dealt = dealt.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__hash", "part")
    told = _bounds(dealt, path, step, overlap)
    # Repeated rows bring the same chunks: each is taken once and the rows are counted.
    each = told.groupBy(*KEYS, "part").agg(*[F.first(c).alias(c) for c in ("n_bytes", "last", "total", "head", "tail")], F.count(F.lit(1)).alias("copies"))
    follows = F.lead("head").over(W.partitionBy(*KEYS).orderBy("part"))
    places = lambda bounds: F.transform(bounds, lambda b: b["at"])
    met = each.withColumn("next", follows).withColumn("at", F.array_min(F.array_intersect(places("tail"), places("next"))))
    before = lambda bounds: F.get(F.filter(bounds, lambda b: b["at"] == F.col("at")), 0)["n"]
    own = F.when(F.col("last"), F.col("total")).otherwise(before("tail") - before("next"))
    rows = met.select(*KEYS, "n_bytes", "copies", own.alias("own"))
    whole = F.when(F.count("own") == F.count(F.lit(1)), F.sum("own"))
    return rows.groupBy(*KEYS).agg(F.first("n_bytes").alias("n_bytes"), whole.alias("n_tokens"), F.first("copies").alias("copies"))


def _long_counts(docs: DataFrame, path: str, id_col: str, text_col: str, step: int, overlap: int) -> DataFrame:
    """(id, n_bytes, n_tokens) of texts longer than ``step``, in rounds of widening overlaps."""
    pending = docs.where(F.length(text_col) > step).select(
        F.col(id_col).alias("__id"), F.xxhash64(text_col).alias("__hash"), F.length(text_col).cast("long").alias("__chars"), F.octet_length(text_col).cast("long").alias("n_bytes"), F.col(text_col).alias("__text")
    )
    out = None
    while True:
        done = saved(_spliced(pending, path, step, overlap))
        good = done.where("n_tokens is not null").select(F.col("__id").alias(id_col), "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("col")
        out = good if out is None else out.unionByName(good)
        failed = done.where("n_tokens is null").select(*KEYS)
        if not (n := failed.count()):
            return out
        step, overlap = step * 4, min(step * 4, overlap * 16)
        keys = failed.select(*[F.col(c).alias(f"{c}_f") for c in KEYS])
        same = [F.col(c).eqNullSafe(F.col(f"{c}_f")) for c in KEYS]
        pending = pending.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys, same[0] & same[1] & same[2], "left_semi")


def count_tokens(
    docs: DataFrame,
    vocabulary: str | None = None,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    step: int = STEP,
    overlap: int = OVERLAP,
) -> DataFrame:
    """(``id_col``, n_bytes, n_tokens, over_limit) for every row of ``docs``."""
    if not 0 < overlap <= step:
        raise ValueError("overlap must be positive and no longer than step")
    path = vocabulary or default_vocabulary()
    if not vocabulary_of(path).proven:
        rows = _counted(docs, path, id_col, text_col)
    else:
        rows = _counted(docs.where(F.coalesce(F.length(text_col), F.lit(0)) <= step), path, id_col, text_col)
        rows = rows.unionByName(_long_counts(docs, path, id_col, text_col, step, overlap))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
