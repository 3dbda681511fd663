"""SimHash near-duplicates by fuzzy hashing with a binary Golay code.

A document's fingerprint has a bit for each of 64 positions: 1 if over half of
its shingles' hashes have it. Fingerprints that differ in at most four bits
link, and a document's component is what it can reach over links.

Candidates: a fingerprint is cut into three segments (22, 21 and 21 bits). With
at most four differing bits either one segment is equal (three keys: the
segments), or every segment differs and two of them differ in exactly one bit.
For the latter, segments are read as words of the perfect (23, 12) Golay code.
A word decodes to the one codeword within distance 3; a neighbour at distance 1
decodes to a codeword within distance 4, of which there are one or six. So of
two such fingerprints one files the pair of decoded codeword indices, and the
other looks under all pairs of nearby indices; as one differing bit turns the
parity of a segment, parity tells which does which. That gives about 47 keys a
fingerprint.

Copies are folded first (one row for each distinct fingerprint), buckets are
verified by counting bits, and each bucket gives the links of a spanning forest
only: no link between components is lost, and a bucket of n rows gives at most
n - 1 links. A bucket holds distinct fingerprints that share 21 bits or more;
beyond ``DENSE`` of them it is searched through exact sub-buckets.

``first_of_each`` is the same for shingle sets that overlap by four fifths or
more, whose fingerprints differ in some 15 % of their bits: see there.

Defined results: texts without a word (null too) have fingerprint zero and link
like any other; rows of equal id count as one document when links are followed;
a null id keeps its fingerprint, takes no part in links and has a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .components import connected_components

SHINGLE = 4
MAX_DISTANCE = 4
SEED = 42
#: (shift, bits) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the Golay code.
GENERATOR = 0b101011100011
#: Rows of a bucket that are compared directly; more are dealt to sub-buckets first.
DENSE = 20_000
_SMALL = 48


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hash of each run of ``shingle`` words; a shorter text is one run, a text without words has none."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 1 << 16):
        part = hashes[lo : lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, fp long")


def _syndrome(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GENERATOR << (k - 11)
    return word


@functools.cache
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; error patterns of each syndrome; their number (1 or 6).

    The first pattern is the coset's leader (weight 3 at most); with a leader
    of weight 3 the other five have weight 4.
    """
    low = np.array([_syndrome(v) for v in range(1 << 12)], np.int32)
    high = np.array([_syndrome(v << 12) for v in range(1 << 11)], np.int32)
    patterns, number = np.zeros((2048, 6), np.int32), np.zeros(2048, np.int32)
    leader = {}
    for weight in range(5):
        for bits in itertools.combinations(range(23), weight):
            word = sum(1 << b for b in bits)
            s = int(low[word & 0xFFF] ^ high[word >> 12])
            leader.setdefault(s, weight)
            if weight <= 3 or leader[s] == 3:
                patterns[s, number[s]] = word
                number[s] += 1
    return low, high, patterns, number


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 6) indices of the codewords near each 23-bit word, the decoded one first, and how many hold."""
    low, high, patterns, number = golay_tables()
    s = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ patterns[s]) >> 11, number[s]


def candidate_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each key) for an array of fingerprints (uint64)."""
    segs = [((fp >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    every = np.arange(len(fp))
    keys, rows = [(np.int64(t) << 40) | seg for t, seg in enumerate(segs)], [every] * 3
    near = [codeword_indices(seg) for seg in segs]
    parity = [np.bitwise_count(seg).astype(np.int64) & 1 for seg in segs]
    for t, (p, q) in enumerate(((0, 1), (0, 2), (1, 2)), 3):
        files = np.flatnonzero(parity[p] == 1)
        keys.append((np.int64(t) << 40) | (near[p][0][files, 0].astype(np.int64) << 13) | (near[q][0][files, 0].astype(np.int64) << 1) | parity[q][files])
        rows.append(files)
        looks = parity[p] == 0
        for i, j in itertools.product(range(6), range(6)):
            own = np.flatnonzero(looks & (near[p][1] > i) & (near[q][1] > j))
            keys.append((np.int64(t) << 40) | (near[p][0][own, i].astype(np.int64) << 13) | (near[q][0][own, j].astype(np.int64) << 1) | (1 - parity[q][own]))
            rows.append(own)
    return np.concatenate(keys), np.concatenate(rows)


def _forest(fp: np.ndarray, at: np.ndarray, distance: int = MAX_DISTANCE) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a spanning forest among the fingerprints ``at``: each link found takes a row out of the search."""
    left, right = [], []
    rest = at
    while len(rest) > 1:
        queue, rest = [rest[:1]], rest[1:]
        while queue and len(rest):
            for u in queue.pop():
                hit = np.bitwise_count(fp[rest] ^ fp[u]) <= distance
                if hit.any():
                    found = rest[hit]
                    left.append(np.full(len(found), u))
                    right.append(found)
                    queue.append(found)
                    rest = rest[~hit]
    return left, right


def _dense(fp: np.ndarray, at: np.ndarray, depth: int = 0) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of a large bucket: of five groups of the bits that vary, at least one is equal in a linked pair."""
    spread = np.bitwise_or.reduce(fp[at] ^ fp[at[0]])
    bits = [b for b in range(64) if int(spread) >> b & 1]
    if len(at) <= DENSE or depth == 4 or len(bits) < 10:
        return _forest(fp, at)
    left, right = [], []
    for part in np.array_split(bits, MAX_DISTANCE + 1):
        mask = np.uint64(sum(1 << int(b) for b in part))
        value = fp[at] & mask
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for own in np.split(at[order], cuts):
            if len(own) > 1:
                a, b = _dense(fp, own, depth + 1)
                left += a
                right += b
    return left, right


def bucket_links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of linked pairs in buckets of equal keys (sorted)."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    small = np.repeat(size <= _SMALL, size)
    left, right = [], []
    pos = np.flatnonzero(small)
    for d in range(1, _SMALL):
        pos = pos[pos + d < len(key)]
        pos = pos[key[pos] == key[pos + d]]
        if not len(pos):
            break
        near = pos[np.bitwise_count(fp[pos] ^ fp[pos + d]) <= MAX_DISTANCE]
        left.append(near)
        right.append(near + d)
    for s, n in zip(start[size > _SMALL], size[size > _SMALL], strict=True):
        a, b = _dense(fp, np.arange(s, s + n))
        left += a
        right += b
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return _spanning(np.concatenate(left), np.concatenate(right))


def _spanning(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    kept = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[ra] = rb
            kept.append(k)
    return left[kept], right[kept]


def whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of runs of rows sorted by the first column; rows of equal key are in one run."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        own = [np.asarray(c) for c in batch.columns]
        if held and own[0][0] == own[0][-1] == held[-1][0][-1]:
            held.append(own)  # all of it belongs to the open bucket
            continue
        cut = int(np.searchsorted(own[0], own[0][-1]))
        whole = [*held, [x[:cut] for x in own]]
        if sum(len(x[0]) for x in whole):
            yield [np.concatenate(x) for x in zip(*whole, strict=True)]
        held = [[x[cut:] for x in own]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def links(fps: DataFrame) -> DataFrame:
    """(a, b) representatives of linked fingerprints, from (fp, rep) with distinct fp."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            rep = np.asarray(batch.column(1))
            key, row = candidate_keys(fp)
            for lo in range(0, len(key), 1 << 17):
                own = row[lo : lo + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(key[lo : lo + (1 << 17)]), pa.array(fp[own].view(np.int64)), pa.array(rep[own])], ["key", "fp", "rep"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp, rep in whole_buckets(batches):
            a, b = bucket_links(key, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(rep[a]), pa.array(rep[b])], ["a", "b"])

    keyed = fps.select("fp", "rep").mapInArrow(expand, "key long, fp long, rep long")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(``id_col``, fingerprint, component_id) for each row of ``docs``."""
    fps = saved(fingerprints(docs, id_col, text_col, shingle))
    distinct = saved(fps.where("id is not null").groupBy("fp").agg(F.min("id").alias("rep")))
    # Rows of equal id are one document: its fingerprints' representatives link too.
    same = fps.where("id is not null").groupBy("id").agg(F.min("fp").alias("f0"), F.max("fp").alias("f1"), F.count_distinct("fp").alias("n")).where("n > 1").select("id")
    tied = fps.join(same, "id", "left_semi").join(distinct, "fp").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = connected_components(links(distinct).unionByName(tied))
    component = distinct.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = fps.join(component, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


# --- near-duplicates by the overlap of shingle sets

#: Words of a shingle, and 64-bit words of a wide fingerprint.
WIDE_SHINGLE = 5
WIDE = 8
#: Bits that linked wide fingerprints differ in at most: 77.9 expected at a similarity of 0.8, with a deviation of 8.1.
WIDE_DISTANCE = 88
#: The same for the one word that candidates are compared by: 9.7 expected, with a deviation of 2.9.
CHECK_DISTANCE = 18
#: Sets of so many shingles at most are compared themselves, as fingerprints tell little of a few.
SMALL_SET = 64
#: Pairs of segments that keys are made of; a word has two segments of 23 bits.
BANDS = 5
#: Most rows that are sent to all tasks.
BROADCAST_ROWS = 500_000
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, WIDE_SHINGLE))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE words: bit b is 1 if over half of the distinct shingles' b-th hash bits are; the least shingle's decides at half."""
    ones = np.zeros(64 * WIDE, np.int64)
    step = np.arange(1, WIDE + 1, dtype=np.uint64) * _MIX[0]
    for lo in range(0, len(hashes), 2048):
        z = hashes[lo : lo + 2048, None] + step  # the finaliser of splitmix64
        z = (z ^ (z >> np.uint64(30))) * _MIX[1]
        z = (z ^ (z >> np.uint64(27))) * _MIX[2]
        z ^= z >> np.uint64(31)
        bits = np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):
            ones += np.add.reduce(bits[k : k + 255], 0, dtype=np.uint8)
        if not lo:
            least = bits[0].astype(np.int64)
    return np.packbits(2 * ones + least > len(hashes), bitorder="little").view(np.uint64) if len(hashes) else np.zeros(WIDE, np.uint64)


def wide_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, row of each key) for wide fingerprints: band and the pair of nearby codeword indices of its two segments."""
    keys, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    every = np.arange(len(fps))
    for band in range(BANDS):
        word = fps[:, band]
        (p, np_), (q, nq) = (codeword_indices(((word >> np.uint64(s)) & np.uint64((1 << 23) - 1)).astype(np.int64)) for s in (0, 23))
        for i, j in itertools.product(range(6), range(6)):
            own = every[(np_ > i) & (nq > j)]
            keys.append((np.int64(band) << 24) | (p[own, i].astype(np.int64) << 12) | q[own, j].astype(np.int64))
            rows.append(own)
    return np.concatenate(keys), np.concatenate(rows)


def wide_links(nodes: DataFrame) -> DataFrame:
    """(a, b) linked nodes, a < b, from (node, fp, size, few): wide fingerprint, shingles, and a small set itself.

    In a bucket, rows are taken out of the search when a link to a row before
    them is found. Four orders are in use, by key, so a node meets several
    others; the pairs are then verified on all bits.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                node = np.asarray(part.column(0))
                fps = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, WIDE)
                key, row = wide_keys(fps)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[row]), pa.array(fps[row, WIDE - 1].view(np.int64))], ["key", "node", "bits"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, bits in whole_buckets(batches):
            bits = bits.view(np.uint64)
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            two = start[size == 2]
            near = two[np.bitwise_count(bits[two] ^ bits[two + 1]) <= CHECK_DISTANCE]
            left.append(near)
            right.append(near + 1)
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                mixed = (node[s : s + n].view(np.uint64) + np.uint64(key[s] & 3) + np.uint64(1)) * _MIX[2]
                a, b = _forest(bits, s + np.argsort(mixed ^ (mixed >> np.uint64(29))), CHECK_DISTANCE)
                left += a
                right += b
            a, b = node[np.concatenate(left)], node[np.concatenate(right)]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint64).reshape(-1, WIDE) for k in (2, 3))
            n, m = np.asarray(batch.column(4)), np.asarray(batch.column(5))
            near = (np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= WIDE_DISTANCE) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
            for k in np.flatnonzero(np.maximum(n, m) <= SMALL_SET).tolist():
                u, v = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (6, 7))
                near[k] = 9 * len(np.intersect1d(u, v, assume_unique=True)) >= 4 * (n[k] + m[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    keyed = nodes.select("node", "fp").mapInArrow(expand, "key long, node long, bits long")
    pairs = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(join, "a long, b long").distinct()
    left, right = (nodes.select(F.col("node").alias(c), *[F.col(f).alias(f + c) for f in ("fp", "size", "few")]) for c in "ab")
    both = [f + c for f in ("fp", "size", "few") for c in "ab"]
    return pairs.join(left, "a").join(right, "b").select("a", "b", *both).mapInArrow(verify, "a long, b long")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, with the columns of ``docs``.

    Documents link if the Jaccard similarity of their sets of five-word
    shingles is 0.8 or more. Sets of ``SMALL_SET`` shingles or fewer are compared
    themselves; of others fingerprints of 512 bits tell: at similarity J bits differ with the probability acos(2 J / (1 + J)) / pi.
    Candidates: of ten segments of 23 bits, read as Golay words with the
    codewords within distance 4 (one or six), two of a pair share a codeword
    each. A pair at 0.8 is a candidate with probability 0.89 and verified with
    0.90, at 0.85 with 0.96 and 0.99, at 0.9 with 0.99 and 1; links of other
    members make up for some that are lost. At 0.7 one in eight is verified, at
    0.6 one in a thousand.

    Texts don't move: rows are told by two digests, and those that go are sent
    to all tasks if they are ``BROADCAST_ROWS`` at most; else a join deals rows
    by digest.

    Of a group the smallest doc_id stays, a null one only where
    there is no other; of rows of equal id the one with the smallest digest of
    all its columns; equal rows count once. Texts without a word are equal to
    each other. Names that begin with ``__`` are reserved.
    """

    @F.arrow_udf("fp binary, size int, few binary")
    def wide(texts: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py()) for t in texts]
        fps = pa.array([wide_fingerprint(x).tobytes() for x in sets], pa.binary())
        few = pa.array([x.tobytes() if len(x) <= SMALL_SET else b"" for x in sets], pa.binary())
        return pa.StructArray.from_arrays([fps, pa.array([len(x) for x in sets], pa.int32()), few], ["fp", "size", "few"])

    flags = [F.col(c).isNull() for c in docs.columns]
    told = docs.withColumns({"__h": F.xxhash64(*docs.columns, *flags), "__k": F.xxhash64(F.lit(1), *docs.columns, *flags)})
    rows = saved(told.select(F.col(id_col).cast("long").alias("id"), "__h", "__k", wide(text_col).alias("w")).select("id", "__h", "__k", "w.*"))
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("__h").alias("h"), F.col("__k").alias("k"))
    # Equal sets are one node; large ones are equal if their fingerprints and sizes are.
    nodes = saved(rows.groupBy("fp", "size", "few").agg(F.min(order).alias("o")).withColumn("node", F.xxhash64("fp", "size", "few")))
    roots = connected_components(wide_links(nodes))
    first = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("o").alias("o"))
    stays = first.select(F.col("o.h").alias("__h"), F.col("o.k").alias("__k"), F.lit(True).alias("stays"))
    counts = rows.groupBy("__h", "__k").count().join(stays, ["__h", "__k"], "left")
    moved = saved(counts.where("stays is null or count > 1").select("__h", "__k", F.col("stays").isNotNull().alias("stays")))
    some = moved.count()
    sent = F.broadcast if some <= BROADCAST_ROWS else lambda df: df
    out = told.join(sent(moved), ["__h", "__k"], "left_anti").select(docs.columns)
    again = moved.where("stays")
    if not again.isEmpty():
        row = F.min(F.struct(*docs.columns)).alias("row")
        out = out.unionByName(told.join(sent(again), ["__h", "__k"], "left_semi").groupBy("__h", "__k").agg(row).select("row.*"))
    return out
