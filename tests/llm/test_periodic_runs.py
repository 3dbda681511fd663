"""Runs of words against a search over all periods and places."""

import hashlib
import random
import re
import time
import zlib

import pytest

from spoorline.llm import periodic_runs, registry


def brute_runs(words):
    """Every period by itself: maximal stretches of equal words q apart, without those of a smaller period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(6, 4 * q):
                seen = words[start : start + length]
                if not any(all(seen[k] == seen[k + d] for k in range(length - d)) for d in range(1, q)):
                    found.append((start, length, q))
            i = j
    return sorted(found)


def test_runs_against_brute_force():
    rng = random.Random(3)
    for trial in range(1500):
        kind = trial % 3
        n = rng.randrange(0, 60)
        if kind == 0:
            words = [rng.choice("ab") for _ in range(n)]
        elif kind == 1:
            words = [rng.choice("abcd") for _ in range(n)]
        else:
            words = []
            while len(words) < n:
                unit = [rng.choice("abc") for _ in range(rng.randrange(1, 6))]
                words += unit * rng.randrange(1, 7)
        assert periodic_runs.find_runs(words) == brute_runs(words), words
        whole = [r for r in periodic_runs.stretch_runs(periodic_runs.np.array([ord(w) for w in words], "int32"))] if words else []
        assert sorted(whole) == brute_runs(words), words


def test_runs_in_long_texts_with_far_repeats():
    rng = random.Random(9)
    prose = [f"w{rng.randrange(300)}" for _ in range(900)]
    words = prose[:300] + ["x", "y", "z"] * 5 + prose + ["p"] * 30 + prose[:200] + prose[100:140] * 6 + prose[5:9]
    assert periodic_runs.find_runs(words) == brute_runs(words)


def test_stretches_lose_no_run():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.randrange(6) for _ in range(rng.randrange(6, 120))]
        coded = periodic_runs.np.array(words, "int32")
        parts = periodic_runs.stretches(coded)
        for start, length, _ in brute_runs(words):
            assert any(a <= start and start + length <= b for a, b in parts)


def test_long_runs_take_little_time():
    start = time.time()
    assert periodic_runs.find_runs(["a"] * 60_000) == [(0, 60_000, 1)]
    unit = [f"w{k}" for k in range(5_000)]
    assert periodic_runs.find_runs(unit * 8) == [(0, 40_000, 5_000)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 30_000:
        fib.append(fib[-1] + fib[-2])
    assert all(length >= 4 * period for _, length, period in periodic_runs.find_runs(list(fib[-1])))
    assert time.time() - start < 60


def test_strongest_run_is_exact():
    assert periodic_runs.strongest([(9, 9, 2), (0, 12, 3), (4, 9, 2), (4, 18, 4)]) == (4, 9, 2)
    assert periodic_runs.strongest([]) is None


def brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{length},{p}\n" for s, length, p in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("one two three four five six".split(" ")) for _ in range(rng.randrange(70)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " \t\r\n"), (203, "ha " * 40), (204, "a\x0bb\x0ca b a b a b a b"), (205, "no no no no no"), (203, "ha " * 40)]
    spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, length int").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.select(*COLUMNS).collect()) == sorted(map(str, [brute_row(*r) for r in rows]))


def test_operator_gives_texts_and_spans(spark):
    docs = spark.createDataFrame([("x", "so " * 8 + "it goes"), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in periodic_runs.detect_runs(docs).collect()}
    assert got["x"].text == "so it goes" and [tuple(r) for r in got["x"].runs] == [(0, 8, 1)] and got["x"].exponent_milli == 8000
    assert got[None].text == "" and got[None].n_runs == 0 and got[None].start is None
    assert periodic_runs.detect_runs(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 5])
def test_short_texts_have_no_runs(n):
    assert periodic_runs.find_runs(["a"] * n) == []
