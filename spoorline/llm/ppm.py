"""Language-model scores by prediction by partial matching (PPM) over bytes.

A text is spelled as its lower-cased words with one space between them and an
end symbol; ``ORDER`` start symbols stand before it. A byte's contexts are the
``ORDER`` bytes before it, across words, and their shorter ends. The model is
the trie of all contexts of the training documents with counts of the bytes
that follow, by exact bytes.

A byte is coded from its longest context. A byte not seen there costs an escape
(method D: half a count for each distinct symbol) and goes to the next shorter
context, where the symbols that longer ones offered are excluded; what no
context has seen is uniform over the symbols left. Counts follow update
exclusion: a byte is counted in a shorter context only when the longer one
hasn't seen it, so a shorter context's count is the number of longer cells that
end in it, whatever the order of the texts.

A byte's code depends on the bytes before it and itself, its gram. Tasks cut
their documents into chunks of about ``CHUNK_BYTES`` and write each as
compressed spelled texts, its distinct grams with training counts and its
distinct words. Grams are dealt by the last ``SUFFIX`` context bytes, so that a
part holds all longer contexts of an escape chain; the shorter ones are a table
of 2 ** 24 cells at most, which is all that is broadcast. Parts are summed over
``FAN`` chunks at a time, level by level, give each chunk the codes of its
grams, and chunks sum them up. Texts move once, compressed; nothing else than
the table of short contexts reaches the driver.

Defined results: a null text is empty and has one token, its end; words are
compared after lower-casing A-Z; a null id belongs to the training documents;
without training documents every byte is uniform and c and N are 0; repeated
rows count and are scored as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, spans, written

#: Bytes of context; a context and the byte after it fit in 64 bits.
ORDER = 6
#: Context bytes that grams are dealt by; contexts below that length are in the shared table.
SUFFIX = 3
#: Symbols that UTF-8 doesn't use: before a text, and its end.
START, END = 0xFF, 0xFE
CHUNK_BYTES = 14 << 20
#: Spelled bytes for each part of the model.
PART_BYTES = 16 << 20
MAX_PARTS = 4096
#: Chunks that one task of the model sums or answers.
FAN = 64
#: Part number of a chunk's texts.
TEXTS = -1
_BLOCK = 1 << 20
_ZSTD = pa.Codec("zstd", compression_level=1)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def spelled(words: list[bytes]) -> bytes:
    return bytes([START]) * ORDER + b" ".join(words) + bytes([END])


def gram_blocks(buf: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(start, end, which of these bytes are symbols, their grams) of spelled texts.

    A gram is a symbol with the ORDER bytes before it, as one number: the SUFFIX
    bytes of context before the symbol, the bytes before those, the symbol. So
    a part's grams stand close together and compress well. Blocks end anywhere,
    so a long text takes no more memory than others.
    """
    layout = (*range(ORDER - SUFFIX, ORDER), *range(ORDER - SUFFIX), ORDER)
    for lo, hi in spans(len(buf) - ORDER, _BLOCK):
        key = np.zeros(hi - lo, np.uint64)
        for k in layout:
            key <<= np.uint64(8)
            key |= buf[lo + k : hi + k]
        symbol = buf[lo + ORDER : hi + ORDER] != START
        yield lo + ORDER, hi + ORDER, symbol, key[symbol]


def natural(grams: np.ndarray) -> np.ndarray:
    """Grams with their bytes in the order of the text: cells of the longest order."""
    lead = (grams >> np.uint64(8)) & np.uint64((1 << (8 * (ORDER - SUFFIX))) - 1)
    suffix = grams >> np.uint64(8 * (ORDER - SUFFIX + 1))
    return (lead << np.uint64(8 * (SUFFIX + 1))) | (suffix << np.uint64(8)) | (grams & np.uint64(255))


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of each one's weights."""
    order = np.argsort(keys, kind="stable")  # runs in order merge fast
    keys = keys[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(weights[order], first) if len(keys) else weights


def firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = firsts(keys)
    return keys[first], np.diff(np.append(first, len(keys)))


def packed(values: np.ndarray) -> bytes:
    """An array as compressed bytes: differences of unsigned numbers, split into planes of bytes."""
    kind = values.dtype.str.encode().ljust(8)
    if values.dtype.kind == "u" and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""
    return kind + len(planes).to_bytes(8, "little") + _ZSTD.compress(planes, asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    kind = np.dtype(blob[:8].decode().strip())
    size = int.from_bytes(blob[8:16], "little")
    if not size:
        return np.zeros(0, kind)
    planes = np.frombuffer(_ZSTD.decompress(blob[16:], size, asbytes=True), np.uint8).reshape(kind.itemsize, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if kind.kind == "u" else values


def packed_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _ZSTD.compress(data, asbytes=True)


def unpacked_bytes(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return _ZSTD.decompress(blob[8:], size, asbytes=True) if size else b""


def unpacked_words(blob: bytes) -> list[bytes]:
    data = unpacked_bytes(blob)
    return data.split(b" ") if data else []


class Places:
    """Places of numbers in an array, by open addressing."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.last = np.int64(len(self.table) - 1)
        rest, at = np.arange(len(keys)), self._slot(keys)
        taken = np.zeros(len(self.table), bool)
        while len(rest):
            free = ~taken[at]
            self.table[at[free]] = rest[free]
            taken[at[free]] = True
            lost = self.table[at] != rest
            rest, at = rest[lost], (at[lost] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of numbers that the array holds."""
        at = self._slot(wanted)
        out = self.table[at]
        rest = np.flatnonzero(self.keys[out] != wanted)
        at = at[rest]
        while len(rest):
            at = (at + 1) & self.last
            got = self.table[at]
            out[rest] = got
            miss = self.keys[got] != wanted[rest]
            rest, at = rest[miss], at[miss]
        return out


class Level:
    """The contexts of one length: cells (context and symbol) in order, with counts."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.cells, self.counts = cells, counts.astype(np.float64)
        contexts = cells >> np.uint64(8)
        self.start = firsts(contexts)
        self.contexts = contexts[self.start]
        self.size = np.diff(np.append(self.start, len(cells)))
        total = np.add.reduceat(self.counts, self.start) if len(cells) else np.zeros(0)
        self.share = np.log10((2 * self.counts - 1) / (2 * np.repeat(total, self.size)))


def _mask(order: int) -> np.uint64:
    """The bytes of a gram that a cell of some order has."""
    return np.uint64((1 << (8 * (order + 1))) - 1)


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Place of each key, -1 if the table hasn't it."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def shorter(cells: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of ``order`` with the number of distinct cells of the next order that end in them."""
    return counted(cells & _mask(order))


class PpmModel:
    """Levels from ORDER down to 0, of a part's cells with counts and the shared cells of order SUFFIX - 1."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, low_cells: np.ndarray, low_counts: np.ndarray) -> None:
        self.levels = {ORDER: Level(cells, counts)}
        for k in range(ORDER - 1, SUFFIX - 1, -1):
            self.levels[k] = Level(*shorter(self.levels[k + 1].cells, k))
        self.levels[SUFFIX - 1] = Level(low_cells, low_counts)
        for k in range(SUFFIX - 2, -1, -1):
            self.levels[k] = Level(*shorter(self.levels[k + 1].cells, k))

    def code(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's symbol after its context."""
        top = self.levels[ORDER]
        place = _find(top.cells, grams)
        out = np.zeros(len(grams))
        out[place >= 0] = top.share[place[place >= 0]]
        missed = np.flatnonzero(place < 0)
        for lo in range(0, len(missed), 8192):
            own = missed[lo : lo + 8192]
            out[own] = self._chain(grams[own])
        return out

    def _chain(self, grams: np.ndarray) -> np.ndarray:
        """The whole chain of escapes with exclusion."""
        n = len(grams)
        symbol = (grams & np.uint64(255)).astype(np.int64)
        out, open_ = np.zeros(n), np.ones(n, bool)
        used = np.zeros((n, 256), bool)
        used[:, START] = True
        for k in range(ORDER, -1, -1):
            level = self.levels[k]
            place = np.where(open_, _find(level.contexts, (grams & _mask(k)) >> np.uint64(8)), -1)
            own = np.flatnonzero(place >= 0)
            size = level.size[place[own]]
            row = np.repeat(own, size)
            cell = np.repeat(level.start[place[own]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            offered = (level.cells[cell] & np.uint64(255)).astype(np.int64)
            left = ~used[row, offered]
            row, offered, count = row[left], offered[left], level.counts[cell[left]]
            total, kinds = np.bincount(row, count, n), np.bincount(row, minlength=n)
            met = offered == symbol[row]
            out[row[met]] += np.log10((2 * count[met] - 1) / (2 * total[row[met]]))
            open_[row[met]] = False
            escape = open_ & (kinds > 0)
            out[escape] += np.log10(kinds[escape] / (2 * total[escape]))
            used[row, offered] = True
        out[open_] -= np.log10((~used[open_]).sum(1))
        return out


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    suffix = grams >> np.uint64(8 * (ORDER - SUFFIX + 1))
    return (((suffix * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(parts)).astype(np.uint16)


def dealt(grams: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """The parts of grams in order, and the places of each one's grams."""
    part = part_of(grams, parts)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cuts[p] < cuts[p + 1]:
            yield p, order[cuts[p] : cuts[p + 1]]


def gram_counts(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of spelled texts in order, and how often each occurs."""
    runs = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for *_, grams in gram_blocks(buf):
        runs.append(counted(grams))
        if len(runs) > 8:
            runs = [summed(*map(np.concatenate, zip(*runs, strict=True)))]
    return summed(*map(np.concatenate, zip(*runs, strict=True)))


def joined(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(texts), np.uint8)


Row = tuple[int, int, bytes, bytes]  # chunk, part, keys, values


def chunk_rows(chunk: int, ids: list, held: list[bool], texts: list[bytes], words: Counter[bytes], parts: int) -> Iterator[Row]:
    """A chunk's spelled texts, its grams by part and its words by part, with their training counts."""
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(held, pa.bool_())], ["id", "held"])
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    yield chunk, TEXTS, packed_bytes(b"".join(texts)), sink.getvalue().to_pybytes()
    grams, counts = gram_counts(joined([t for t, h in zip(texts, held, strict=True) if not h]))
    asked, _ = gram_counts(joined([t for t, h in zip(texts, held, strict=True) if h]))
    grams, counts = summed(np.concatenate([grams, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)]))
    for p, own in dealt(grams, parts):
        yield chunk, p, packed(grams[own]), packed(counts[own])
    lists: list[list[bytes]] = [[] for _ in range(parts)]
    for w in words:
        lists[zlib.crc32(w) % parts].append(w)
    for p, own in enumerate(lists):
        if own:
            yield chunk, parts + p, packed_bytes(b" ".join(own)), packed(np.fromiter((words[w] for w in own), np.int64, len(own)))


def batch_of(rows: list[Row]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["chunk", "part", "keys", "vals"])


def word_counts(keys: list[bytes], vals: list[bytes]) -> Counter[bytes]:
    total: Counter[bytes] = Counter()
    for key, val in zip(keys, vals, strict=True):
        for w, c in zip(unpacked_words(key), unpacked(val).tolist(), strict=True):
            total[w] += c
    return total


ROWS = "chunk long, part int, keys binary, vals binary"
#: The end of a text among the words.
END_WORD = bytes([END])


def chunked(docs: DataFrame, held, id_col: str, text_col: str, chunk_bytes: int, parts: int) -> DataFrame:
    """The rows of all chunks, as a written table."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        ids, held, texts, size = [], [], [], 0
        words: Counter[bytes] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for row in chunk_rows(chunk, ids, held, texts, words, parts):
                yield batch_of([row])

        for batch in batches:
            for i, text, h in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = tokens_of(text.as_py())
                ids.append(i)
                held.append(h)
                texts.append(spelled(own))
                own.append(END_WORD)
                size += len(texts[-1])
                if h:
                    words.update(dict.fromkeys(own, 0))
                else:
                    words.update(own)
                if size >= chunk_bytes:
                    yield from flush()
                    chunk, size = chunk + 1, 0
                    ids, held, texts, words = [], [], [], Counter()
        if ids:
            yield from flush()

    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col), held).mapInArrow(ask, ROWS))


def learned(rows: DataFrame, chunks: int, parts: int) -> DataFrame:
    """One row for each part: its distinct grams or words of training texts, with counts."""

    def fold(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        keys, vals = table["keys"].to_pylist(), table["vals"].to_pylist()
        if part < parts:
            grams, counts = summed(np.concatenate([unpacked(k) for k in keys]), np.concatenate([unpacked(v) for v in vals]))
            row = packed(grams[counts > 0]), packed(counts[counts > 0])
        else:
            known = {w: c for w, c in word_counts(keys, vals).items() if c}
            row = packed_bytes(b" ".join(known)), packed(np.fromiter(known.values(), np.int64, len(known)))
        return pa.Table.from_batches([batch_of([(table["chunk"][0].as_py(), part, *row)])])

    slots = chunks
    while True:
        slots = math.ceil(slots / FAN)
        level = rows.withColumn("chunk", F.pmod(F.xxhash64("chunk"), F.lit(slots)))
        rows = level.groupBy("part", "chunk").applyInArrow(fold, ROWS)
        if slots <= 1:
            return written(rows)


def shared_cells(model: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Cells of order SUFFIX - 1 with their counts; training tokens, and distinct ones."""

    def low(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, key, val in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if part < parts:
                    cells = np.unique(natural(unpacked(key)) & _mask(SUFFIX))
                    cells, counts = shorter(cells, SUFFIX - 1)
                    out = cells.astype(np.int64), counts, np.zeros(len(cells), np.int64)
                else:
                    counts = unpacked(val)
                    out = np.array([-1]), np.array([counts.sum()]), np.array([len(counts)])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["cell", "n", "kinds"])

    sums = model.select("part", "keys", "vals").mapInArrow(low, "cell long, n long, kinds long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    cell, n, kinds = (sums[c].to_numpy() for c in ("cell", "n", "kinds"))
    order = np.argsort(cell)
    cell, n, kinds = cell[order], n[order], kinds[order]
    words = cell < 0
    return cell[~words].astype(np.uint64), n[~words], int(n[words].sum()), int(kinds[words].sum())


def score_documents(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.coalesce(held_out, F.lit(False)).alias("held")
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = min(MAX_PARTS, max(1, math.ceil(size / PART_BYTES)))
    rows = chunked(docs, held, id_col, text_col, chunk_bytes, parts)
    chunks = rows.where(F.col("part") == TEXTS).count()
    asked = rows.where(F.col("part") != TEXTS)
    model = learned(asked, chunks, parts)
    low_cells, low_counts, n, distinct = shared_cells(model, parts)

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        out: list[Row] = []
        if asks.num_rows:
            part = asks["part"][0].as_py()
            own = (known["keys"][0].as_py(), known["vals"][0].as_py()) if known.num_rows else None
            if part < parts:
                cells = (unpacked(own[0]), unpacked(own[1])) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                ppm = PpmModel(*summed(natural(cells[0]), cells[1]), low_cells, low_counts)
                grams = [unpacked(k) for k in asks["keys"].to_pylist()]
                every = counted(np.concatenate(grams))[0]
                code = ppm.code(natural(every)).astype(np.float32)
                found = [(None, packed(code[np.searchsorted(every, g)])) for g in grams]
            else:
                total = word_counts([own[0]], [own[1]]) if own else Counter()
                found = [(k, packed(np.fromiter((total[w] for w in unpacked_words(k)), np.int64))) for k in asks["keys"].to_pylist()]
            out = [(c, part, *x) for c, x in zip(asks["chunk"].to_pylist(), found, strict=True)]
        return pa.Table.from_batches([batch_of(out)])

    salts = math.ceil(max(1, chunks) / FAN)
    salted = asked.select("chunk", "part", "keys").withColumn("salt", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int")).groupBy("part", "salt")
    copies = model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("part", "salt")
    answers = salted.cogroup(copies).applyInArrow(answer, ROWS)

    def score(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        at = int(np.flatnonzero(part == TEXTS)[0])
        about = pa.ipc.open_stream(table["vals"][at].as_py()).read_all()
        text = unpacked_bytes(table["keys"][at].as_py())
        buf = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero(buf == END) + 1
        starts = np.concatenate([[0], ends[:-1]])
        grams, _ = gram_counts(buf)
        told, counts = {}, {}
        for k in np.flatnonzero(part != TEXTS).tolist():
            val = unpacked(table["vals"][k].as_py())
            if part[k] < parts:
                told[int(part[k])] = val
            else:
                counts |= zip(unpacked_words(table["keys"][k].as_py()), val.tolist(), strict=True)
        code = np.zeros(len(grams), np.float32)
        for p, own in dealt(grams, parts):
            code[own] = told.pop(p)
        places = Places(grams)
        out = np.zeros((4, len(ends)))
        for lo, hi, symbol, own in gram_blocks(buf):
            codes = np.zeros(hi - lo)
            codes[symbol] = code[places.find(own)]
            docs_here = np.arange(np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi))
            out[3, docs_here] += np.add.reduceat(codes, np.maximum(starts[docs_here], lo) - lo)
        for d, (lo, hi) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            words = text[lo + ORDER : hi - 1].split()
            words.append(END_WORD)
            c = np.fromiter(map(counts.__getitem__, words), np.float64, len(words))
            out[:3, d] = len(words), np.count_nonzero(c), np.log10((c + 0.1) / (n + 0.1 * (distinct + 1))).sum()
        longs = out[:2].astype(np.int64)
        return pa.table(
            {
                "id": about["id"], "held_out": about["held"], "n_tokens": longs[0], "n_known": longs[1],
                "train_tokens": np.full(len(ends), n, np.int64), "base_score": out[2], "score": out[3],
            }
        )

    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = answers.unionByName(rows.where(F.col("part") == TEXTS)).groupBy("chunk").applyInArrow(score, schema)
    return scored.withColumnRenamed("id", id_col)


def held_out_fold(id_col: str = "doc_id"):
    return doc_bucket(id_col, 10) == 0


def adaptive_code_length(text: str | None, order: int = ORDER) -> float:
    """Bits that PPM needs for a text's UTF-8 bytes and end, learning from it alone as it goes."""
    data = [*(text or "").encode(), END]
    trie: dict[tuple[int, ...], dict[int, int]] = {}
    bits = 0.0
    for i, symbol in enumerate(data):
        excluded: set[int] = set()
        found = -1
        for k in range(min(order, i), -1, -1):
            node = trie.get(tuple(data[i - k : i]))
            left = {s: c for s, c in node.items() if s not in excluded} if node else {}
            if not left:
                continue
            total = sum(left.values())
            if symbol in left:
                bits -= math.log2((2 * left[symbol] - 1) / (2 * total))
                found = k
                break
            bits -= math.log2(len(left) / (2 * total))
            excluded |= left.keys()
        else:
            bits += math.log2(255 - len(excluded))
        for k in range(max(found, 0), min(order, i) + 1):  # update exclusion
            node = trie.setdefault(tuple(data[i - k : i]), {})
            node[symbol] = node.get(symbol, 0) + 1
    return bits


def adaptive_scores(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Add ``code_bits``, the adaptive code length of each text by itself."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([adaptive_code_length(t.as_py(), order) for t in texts], pa.float64())

    return docs.withColumn("code_bits", run(F.col(text_col)))
