"""Periodic runs of words, and texts without their repetitions.

A run is a stretch of consecutive words with smallest period q whose words q
apart are identical, at least ``MIN_WORDS`` and ``MIN_PERIODS`` * q words long,
that no neighbouring word extends. Runs are found from a suffix automaton of
the word sequence: states are visited from the longest strings up the suffix
links, and the ordered sets of end positions of a state's children are merged
into the largest of them. Where a merge makes two ends neighbours whose
distance d is no more than the state's length, the string stands twice in a
row: a square of period d, which is extended in both directions to its run.
Every run is met, as its string without the last period has two neighbouring
ends q apart, and d is the smallest period there, since a smaller one would put
another end between the two.

Before that, words that can't be in any run are left out: each of a run's
4-word windows stands again in it within q words, and q is no more than a
quarter of the stretch that holds the run. Dropping windows whose nearest equal
is farther away splits a text into stretches, again and again until nothing
changes; an automaton is built for each stretch that is left. Equality of
windows goes by 64-bit hashes there; a collision only leaves more in.

All is done where a text is read: nothing is shuffled, and memory is one text
and the automaton of one stretch (transitions of states with one follower stand
in flat arrays, ordered sets in blocks).

Defined results: null and empty texts have no words, no runs and the digests of
nothing; repeated rows have a row each; null ids are kept; an empty table gives
no rows; other columns than the id are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

MIN_WORDS = 6
MIN_PERIODS = 4
#: Words of the windows that are looked for again; stretches that hold a run have equal ones within a period.
WINDOW = 4
#: Ends in a block of an ordered set.
BLOCK = 1024
#: How often a text is cut into stretches at most, so that cutting takes a bounded number of passes.
ROUNDS = 16

Run = tuple[int, int, int]  # start, length, period


class Automaton:
    """Suffix automaton over word numbers; states' lengths, suffix links and first ends."""

    def __init__(self, words: list[int]) -> None:
        self.length, self.link, self.end = array("i", [0]), array("i", [-1]), array("i", [-1])
        self.symbol, self.follower = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        last = 0
        for place, word in enumerate(words):
            last = self._extend(last, word, place)

    def _state(self, length: int, end: int) -> int:
        for column, value in ((self.length, length), (self.link, 0), (self.end, end), (self.symbol, -1), (self.follower, -1)):
            column.append(value)
        return len(self.length) - 1

    def _next(self, state: int, word: int) -> int:
        if self.symbol[state] == word:
            return self.follower[state]
        more = self.more.get(state)
        return -1 if more is None else more.get(word, -1)

    def _put(self, state: int, word: int, to: int) -> None:
        if self.symbol[state] in (word, -1):
            self.symbol[state], self.follower[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _extend(self, last: int, word: int, place: int) -> int:
        length, link = self.length, self.link
        new = self._state(length[last] + 1, place)
        state = last
        while state >= 0 and self._next(state, word) < 0:
            self._put(state, word, new)
            state = link[state]
        if state < 0:
            return new
        to = self._next(state, word)
        if length[to] == length[state] + 1:
            link[new] = to
            return new
        copy = self._state(length[state] + 1, -1)  # a copy ends nowhere by itself
        self.symbol[copy], self.follower[copy] = self.symbol[to], self.follower[to]
        if to in self.more:
            self.more[copy] = dict(self.more[to])
        link[copy] = link[to]
        link[to] = link[new] = copy
        while state >= 0 and self._next(state, word) == to:
            self._put(state, word, copy)
            state = link[state]
        return new


class Ends:
    """An ordered set of end positions in blocks, so that putting one in moves few others."""

    __slots__ = ("blocks", "size")

    def __init__(self, first: int) -> None:
        self.blocks, self.size = [[first]], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def _block(self, end: int) -> int:
        lo, hi = 0, len(self.blocks) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.blocks[mid][0] <= end:
                lo = mid
            else:
                hi = mid - 1
        return lo

    def add(self, end: int) -> None:
        at = self._block(end) if len(self.blocks) > 1 else 0
        block = self.blocks[at]
        block.insert(bisect_left(block, end), end)
        self.size += 1
        if len(block) > BLOCK:
            self.blocks[at : at + 1] = [block[: BLOCK // 2], block[BLOCK // 2 :]]

    def neighbours(self, end: int) -> tuple[int | None, int | None]:
        """The ends before and after one that is in the set."""
        at = self._block(end) if len(self.blocks) > 1 else 0
        block = self.blocks[at]
        k = bisect_left(block, end)
        before = block[k - 1] if k else (self.blocks[at - 1][-1] if at else None)
        after = block[k + 1] if k + 1 < len(block) else (self.blocks[at + 1][0] if at + 1 < len(self.blocks) else None)
        return before, after


def same_reach(words: np.ndarray, left: int, right: int, step: int) -> int:
    """How many words in a row are equal from two places on, to the right (step 1) or to the left (-1); compared in doubling blocks."""
    most = len(words) - right if step > 0 else left + 1
    done, size = 0, 16
    while done < most:
        n = min(size, most - done)
        if step > 0:
            same = words[left + done : left + done + n] == words[right + done : right + done + n]
        else:
            a, b = left - done, right - done
            same = (words[a - n + 1 : a + 1] == words[b - n + 1 : b + 1])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done += n
        size *= 2
    return done


class Found:
    """Runs by period, in order of start, to tell whether a square lies in one that is known."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.by_period: dict[int, tuple[list[int], list[int]]] = {}

    def square(self, first: int, second: int) -> None:
        """Ends of two equal strings in a row."""
        period = second - first
        starts, stops = self.by_period.setdefault(period, ([], []))
        at = bisect_right(starts, first - period + 1) - 1
        if at >= 0 and stops[at] > second:
            return
        start = first - same_reach(self.words, first, second, -1) + 1
        stop = second + same_reach(self.words, first, second, 1)
        at = bisect_left(starts, start)
        starts.insert(at, start)
        stops.insert(at, stop)

    def runs(self) -> Iterator[Run]:
        for period, (starts, stops) in self.by_period.items():
            for start, stop in zip(starts, stops, strict=True):
                if stop - start >= max(MIN_WORDS, MIN_PERIODS * period):
                    yield start, stop - start, period


def stretch_runs(words: np.ndarray) -> list[Run]:
    """All runs of one stretch, from neighbouring ends in its suffix automaton."""
    own = Automaton(words.tolist())
    found = Found(words)
    length = np.frombuffer(own.length, np.int32)
    sets: dict[int, Ends] = {}
    waiting: dict[int, list[int]] = {}
    for state in np.argsort(-length, kind="stable").tolist():
        children = waiting.pop(state, [])
        if not state:
            break
        parts = [sets.pop(c) for c in children]
        if own.end[state] >= 0:
            parts.append(Ends(own.end[state]))
        into = max(parts, key=lambda s: s.size)
        fresh = [end for part in parts if part is not into for end in part]
        for end in fresh:
            into.add(end)
        reach = own.length[state]
        for end in fresh:
            before, after = into.neighbours(end)
            if before is not None and end - before <= reach:
                found.square(before, end)
            if after is not None and after - end <= reach:
                found.square(end, after)
        sets[state] = into
        waiting.setdefault(own.link[state], []).append(state)
    return list(found.runs())


def _mixed(words: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each window of WINDOW words."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(words) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            total = (total ^ words[k : k + len(total)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
    return total


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the parts of a text that can hold runs; after ``ROUNDS`` cuts a part stays as it is."""
    todo, out = [(0, len(words), 0)], []
    while todo:
        start, stop, cuts = todo.pop()
        n = stop - start
        if n < MIN_WORDS:
            continue
        window = _mixed(words[start:stop])
        order = np.argsort(window, kind="stable")
        gap = np.where(window[order][1:] == window[order][:-1], np.diff(order), n)
        near = np.full(len(window), n, np.int64)
        near[order[1:]] = gap
        near[order[:-1]] = np.minimum(near[order[:-1]], gap)
        good = near <= n // MIN_PERIODS
        covered = np.zeros(n + 1, np.int64)
        covered[: len(good)] += good
        covered[WINDOW : WINDOW + len(good)] -= good
        inside = np.concatenate([[False], np.cumsum(covered[:-1]) > 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        parts = [(start + a, start + b, cuts + 1) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        if cuts == ROUNDS or [p[:2] for p in parts] == [(start, stop)]:
            out.append((start, stop))
        else:
            todo += parts
    return sorted(out)


def find_runs(words: list) -> list[Run]:
    """(start, length, period) of all runs, by start, then period."""
    if len(words) < MIN_WORDS:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if len(number) > len(words) - 5:  # a run holds five words or more that it had before
        return []
    coded = np.fromiter(map(number.__getitem__, words), np.int32, len(words))
    return sorted((start + s, n, p) for start, stop in stretches(coded) for s, n, p in stretch_runs(coded[start:stop]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without those that any run repeats: what follows its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[k] for k in np.flatnonzero(keep).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length / period, compared exactly; ties go to the smaller start, then the smaller period."""
    best = None
    for run in runs:
        if best is None:
            best = run
            continue
        mine, other = run[1] * best[2], best[1] * run[2]
        if mine > other or (mine == other and (run[0], run[2]) < (best[0], best[2])):
            best = run
    return best


OWN = StructType().add("n_words", "long").add("n_runs", "long").add("start", "long").add("length", "long").add("period", "long").add("exponent_milli", "long")


def _results(batches, out: StructType, prepare, with_text: bool, with_runs: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = (text.as_py() or b"").split()  # bytes part at space and tab to carriage return alone
            if prepare is not None:
                words = prepare(doc, words)
            runs = find_runs(words)
            left = b" ".join(collapsed(words, runs))
            best = strongest(runs)
            told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            row = [len(words), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
            if with_runs:
                row.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            if with_text:
                row.append(left.decode())
            rows.append(row)
        columns = list(zip(*rows, strict=True)) if rows else [()] * (len(out) - 1)
        types = [pa.int64()] * 6 + [pa.string()] * 2
        if with_runs:
            types.append(pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])))
        if with_text:
            types.append(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names=out.names)


def detect_runs(
    docs: DataFrame,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
    with_text: bool = True,
    with_runs: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_runs, the strongest run, digests, and if wanted all runs and the collapsed text.

    ``prepare`` may change a text's words before they are searched.
    """
    out = StructType([docs.schema[id_col]])
    for f in OWN:
        out = out.add(f)
    out = out.add("runs_sha256", "string").add("collapsed_sha256", "string")
    if with_runs:
        out = out.add("runs", _runs_type())
    if with_text:
        out = out.add("text", "string")
    texts = docs.select(id_col, docs[text_col].cast("binary"))
    return texts.mapInArrow(lambda batches: _results(batches, out, prepare, with_text, with_runs), out)


def _runs_type():
    from pyspark.sql.types import ArrayType, LongType

    return ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))
