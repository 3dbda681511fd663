"""Packing of tokenised documents into sequences by minimum bin slack.

Whole windows of a document fill sequences by themselves. What is left of each
document (shorter than a window) waits in a bounded pool; every sequence takes
the longest piece and then the multiset of lengths that fills the rest of the
window best. That multiset is found by a subset-sum program over a bitset of
reachable sums, one shift for each use of a length, and is read back as counts
of each length. When a task's input ends, the pieces of sequences that kept
slack are joined and cut afresh, and the last of them is cut into powers of
two, which need no padding.

All is done within the task that tokenises, so nothing is shuffled and no
group can grow hot; a task that is run again gives the same sequences. Memory
is a pool of ``POOL`` pieces and a bounded cache of word tokens.

Defined results: a null or empty text is one end token; a null id is kept as
null; repeated rows are documents of their own; an empty table gives no piece.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 1024
END_ID = 0
POOL = 4096
#: Words whose ids are kept, and the longest that are.
CACHE = 250_000
CACHED_CHARS = 100
#: Places where a pre-token always ends: before a single space, and around a single line break.
_SAFE = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
_RUNS = re.compile(r"\s\s|^\s|\s$")


class _Cache(dict):
    def __init__(self, encode, prefix: str) -> None:
        self.encode, self.prefix = encode, prefix

    def __missing__(self, word: str) -> bytes:
        out = array("I", self.encode(self.prefix + word)).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


class TextEncoder:
    """Token ids of a text, word by word through a cache.

    Pre-tokens of byte-level BPE end at the places in ``_SAFE``, so the words'
    ids joined are the text's. ``tiktoken`` reads the same vocabulary as ranks
    and gives the ids that ``tokenizers`` gives, in less time. Texts that hold
    the string of a special token go to ``tokenizers`` as a whole.
    """

    def __init__(self, path: str, library: str) -> None:
        self.path, self.whole = path, None
        with open(path, encoding="utf-8") as lines:
            added = [t["content"] for t in json.load(lines).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.encode = _ranks(path).encode_ordinary if library == "tiktoken" else self.encode_whole
        self.first, self.later = _Cache(self.encode, ""), _Cache(self.encode, " ")
        self.line = array("I", self.encode("\n")).tobytes()

    def encode_whole(self, text: str) -> list[int]:
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if self.special.search(text):
            return array("I", self.encode_whole(text)).tobytes()
        if _RUNS.search(text):
            return b"".join([self.first[s] for s in _SAFE.split(text)])
        out = []
        later = self.later
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(self.line)
            words = line.split(" ")
            out.append(self.first[words[0]])
            del words[0]
            out.extend([later[w] for w in words])
        return b"".join(out)


def _ranks(path: str):
    """The vocabulary file beside ``path`` as a tiktoken encoding."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def encoder(path: str, library: str) -> TextEncoder:
    return TextEncoder(path, library)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum comes closest to ``room`` from below.

    ``lengths`` are tried in the given order; the program stops once ``room``
    itself is reachable.
    """
    mask = (1 << (room + 1)) - 1
    reach, history = 1, []
    for length in lengths:
        if length > room:
            continue
        history.append((length, reach))
        for _ in range(min(counts[length], room // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            reach = wider
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, before in reversed(history):
        used = 0
        while not before >> total & 1:
            total -= length
            used += 1
        if used:
            out[length] = used
    return out


Piece = tuple[object, int, bytes, int]  # document, start, ids, the document's tokens


class SlackPacker:
    """Pool of pieces by length, and the sequences made of them."""

    def __init__(self, window: int) -> None:
        self.window, self.size = window, 0
        self.pool: dict[int, list[Piece]] = {}

    def add(self, piece: Piece) -> None:
        self.pool.setdefault(len(piece[2]) // 4, []).append(piece)
        self.size += 1

    def _take(self, length: int) -> Piece:
        own = self.pool[length]
        piece = own.pop()
        if not own:
            del self.pool[length]
        self.size -= 1
        return piece

    def sequences(self, keep: int) -> Iterator[list[Piece]]:
        """Full sequences first of the longest pieces, until ``keep`` pieces are left."""
        while self.size > keep:
            longest = max(self.pool)
            chosen = [self._take(longest)]
            counts = {n: len(p) for n, p in self.pool.items()}
            for length, used in best_fill(sorted(counts, reverse=True), counts, self.window - longest).items():
                chosen += [self._take(length) for _ in range(used)]
            yield chosen

    def drain(self) -> Iterator[list[Piece]]:
        """All that is left; no sequence needs padding."""
        loose: list[Piece] = []
        for chosen in self.sequences(0):
            if sum(len(p[2]) for p in chosen) == 4 * self.window:
                yield chosen
            else:
                loose += chosen
        total = sum(len(p[2]) for p in loose) // 4
        sizes = [self.window] * (total // self.window) + [1 << b for b in range(self.window.bit_length() - 1, -1, -1) if (total % self.window) >> b & 1]
        loose.reverse()
        for size in sizes:
            chosen = []
            while size:
                doc, start, ids, n = loose.pop()
                have = len(ids) // 4
                if have > size:
                    loose.append((doc, start + size, ids[4 * size :], n))
                    ids, have = ids[: 4 * size], size
                chosen.append((doc, start, ids, n))
                size -= have
            yield chosen


def pack(
    docs: DataFrame,
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    library: str = "tiktoken",
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if wanted, ids."""
    path = vocabulary or default_vocabulary()
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = encoder(path, library), SlackPacker(window)
        number = (TaskContext.get().partitionId()) << 36
        rows: list[tuple] = []

        def put(sequence: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, n in sequence:
                length = len(ids) // 4
                rows.append((doc, start, length, zlib.crc32(ids), n, number, offset, ids))
                offset += length
            number += 1

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            arrays = [pa.array(c, pa.int64()) for c in cols[:7]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                flat = np.frombuffer(b"".join(cols[7]), np.uint32).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in cols[7]])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.ids(text.as_py() or "") + end
                n = len(ids) // 4
                whole = n - n % window
                for start in range(0, whole, window):
                    put([(doc, start, ids[4 * start : 4 * (start + window)], n)])
                if whole < n:
                    packer.add((doc, whole, ids[4 * whole :], n))
                if packer.size > POOL:
                    for sequence in packer.sequences(POOL // 2):
                        put(sequence)
                if len(rows) >= 20_000:
                    yield batch_of()
        for sequence in packer.drain():
            put(sequence)
        yield batch_of()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, schema)
