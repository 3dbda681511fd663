"""Each operator against a plain version on small fixtures, with nulls, empties, ties, repeats and odd columns."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash

from spoorline.llm import html_extract, importance, langid, line_rules, maxscore, mixing, packing, ppm, simhash, url_filter
from spoorline.llm.components import connected_components
from pyspark.sql import functions as F

WORDS = "the of and river mountain light garden window stone paper quiet morning letter ocean winter copper silver market bridge valley".split()


def prose(rng, n):
    out = []
    for k in range(n):
        w = rng.choice(WORDS)
        out.append(w.capitalize() if k % 9 == 0 else w + ("." if k % 9 == 8 else ""))
    return " ".join(out) + "."


def docs_frame(spark, rows, extra="clash string"):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"doc_id long, text string, {extra}")


# --- 1 html


PAGE = """<!doctype html><html><head><title>Site</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Header words</p></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy this</div>
<article><h1>The  title &amp; more</h1><p>First&nbsp;paragraph <b>bold
text.<p>Second one.<div class="share-buttons">Tweet</div><form><label>Mail</label></form><p>Third.<aside>Side</aside></article>
<section id="comments"><p>A reader says hello</p></section><div class="cookie-notice">We use cookies</div><footer>&copy; us</footer></body></html>"""


def test_html_article():
    assert html_extract.extract(PAGE)[0] == "The title & more\nFirst paragraph bold text.\nSecond one.\nThird."


def test_html_without_article_keeps_the_dense_region():
    text = "A long sentence about rivers and mountains that goes on for quite a while. " * 4
    page = f"<body><div><a href=1>a</a><a href=2>b</a></div><div><p>{text}</p><p>{text}</p></div><div><a href=3>c</a> | <a href=4>d</a></div></body>"
    assert html_extract.extract(page)[0] == "\n".join([text.strip()] * 2)


def plain_choice(lines, parent, sigma=1.0):
    """The same choice with a line at a time and no shared steps."""
    body = [x for x in lines if not x.marked]
    own = lambda xs: sum(max(0, len(x.text) - x.links) for x in xs)
    inside = lambda x: True
    for test in (lambda x: x.articles > 0, lambda x: x.main):
        if own(filter(test, body)) * 2 >= max(1, own(body)):
            inside = test
            break
    first, every = own(x for x in body if x.articles == 1), own(x for x in body if x.articles)
    weak = [x.marked or not inside(x) or (x.articles > 1 and 4 * first >= every > 0) for x in lines]
    r = [0 if w else max(0, len(x.text) - x.links) / max(1, x.tags) for x, w in zip(lines, weak)]
    v = []
    for i in range(len(r)):
        near = [j for j in range(len(r)) if abs(i - j) <= math.ceil(2 * sigma)]
        k = [math.exp(-((i - j) ** 2) / (2 * sigma * sigma)) for j in near]
        v.append(min(r[i], sum(a * r[j] for a, j in zip(k, near)) / sum(k)))
    low, high, cut = min(v), max(v), 0
    if high > 3 * low:
        for _ in range(20):
            a, b = [x for x in v if x <= (low + high) / 2], [x for x in v if x > (low + high) / 2]
            if not a or not b:
                break
            low, high = sum(a) / len(a), sum(b) / len(b)
        cut = (low + high) / 2

    def reached(region):
        mine = [x for x in lines if x.region == region]
        if any(y >= cut for x, y in zip(lines, v) if x.region == region) or (not mine and cut <= 0):
            return True
        return region in parent and reached(parent[region]) and 2 * own(mine) >= sum(len(x.text) for x in mine)

    return [x.text for x, w in zip(lines, weak) if reached(x.region) and not (w and cut > 0)]


def test_html_choice_against_a_plain_version():
    rng = random.Random(5)
    tags = ["div", "article", "section", "p", "ul", "li", "a", "b", "main", "table", "td", "aside", "h2"]
    for _ in range(300):
        html, depth = "", []
        for _ in range(rng.randint(1, 60)):
            if depth and rng.random() < 0.4:
                html += f"</{depth.pop()}>"
            else:
                depth.append(rng.choice(tags))
                mark = rng.choice(["", "", "", ' class="ad"', ' id="comments"'])
                html += f"<{depth[-1]}{mark}>" + " ".join(rng.choices(WORDS, k=rng.choice([0, 0, 1, 9, 30])))
        lines, parent = html_extract.read_lines(html)
        if lines:
            assert [x.text for x in html_extract.chosen(lines, parent)] == plain_choice(lines, parent)


def test_html_threshold_decides_without_telling_names(monkeypatch):
    text = "A long sentence about rivers and mountains that goes on for quite a while. " * 4
    links = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in WORDS)
    page = f"<body><div><ul>{links}</ul></div><div><p>{text}</p><p>Short one.</p><p>{text}</p><ul><li>stone</li><li>paper</li></ul></div><div>Copper <a href=/x>silver market</a></div></body>"
    want = "\n".join([text.strip(), "Short one.", text.strip(), "stone", "paper"])
    assert html_extract.extract(page)[0] == want
    within = f"<article><h1>Title words</h1><p>{text}</p><ul>{links}</ul><table><tr><td>a<td>b</tr></table><p>{text}</p></article><div>{text[:40]}</div>"
    assert html_extract.extract(within)[0] == "\n".join(["Title words", text.strip(), "a b", text.strip()])
    monkeypatch.setattr(html_extract, "two_cluster_threshold", lambda values: 0.0)
    assert html_extract.extract(page)[0] != want
    assert "Buy this" in html_extract.extract(PAGE)[0]  # marks alone remove nothing


def test_html_teaser_article_beside_the_text():
    text = "A long sentence about rivers and mountains that goes on for quite a while. " * 6
    page = f"<body><div><article><a href=1>Other story</a> in brief</article></div><div><p>{text}</p><p>{text}</p></div></body>"
    assert html_extract.extract(page)[0] == "\n".join([text.strip()] * 2)


@pytest.mark.parametrize("mark", ['id="social-impact"', 'class="post ad-free"', 'class="layout sidebar-left"', 'class="related-work"', 'id="content"'])
def test_html_names_that_only_hold_a_listed_word(mark):
    page = f"<div {mark}><h2 id='comments'>On comments</h2><p>Rivers and mountains go on for quite a while here.</p></div><div class='cookie-notice'>We use cookies</div>"
    assert html_extract.extract(page)[0] == "On comments\nRivers and mountains go on for quite a while here."


def test_html_bad_references_and_large_pages():
    page = "<p>a&#" + "9" * 5000 + ";b &#" + "0" * 5000 + "65; &#x" + "f" * 6000 + ";c &#65; &#0000000065;"
    assert html_extract.extract(page)[0] == "a\ufffdb A \ufffdc A A"
    began = time.time()
    assert html_extract.extract("<div>" * 100_000 + "x" + "</span>" * 100_000 + "</div>" * 50_000)[0] == "x"
    big = "<article>" + "<p>some text of a paragraph that goes on <b>and on</b></p>" * 180_000 + "</article>"
    assert html_extract.extract(big)[1] == 180_000
    assert time.time() - began < 60


def test_html_frame(spark):
    pages = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<p>x</p>", "old"), (3, "<p>x</p>", "old"), (4, "<![if bad <p>y", "o")], "page_id long, html string, text string")
    rows = html_extract.extract_main_text(pages).select("page_id", "text", "n_chars").collect()
    assert sorted((r[0], r[1], r[2]) for r in rows)[:4] == [(1, "", 0), (2, "", 0), (3, "x", 1), (3, "x", 1)]
    assert html_extract.extract_main_text(pages.limit(0)).count() == 0


# --- 2 line rules


def brute_lines(text):
    text = text or ""
    words = re.findall(r"[^ \t-\r]+", text)
    seen, covered = {}, set()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    for i, g in enumerate(grams):
        if n[g] > 1:
            covered |= set(range(i, i + 8))
    dup = 0
    for line in text.split("\n"):
        if re.search(r"[^ \t-\r]", line):
            dup += line in seen
            seen[line] = 1
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_line_rules(spark):
    rng = random.Random(1)
    a = prose(rng, 60)
    texts = [None, "", " \n\t ", a, a + "\n" + a, a + "\n" + a[:200], "word### " * 30, "LOUD!! NOISE!! " * 30, "one | two | three | four | five | six " * 9, "go go go go go go go ham ham ham ham ham ham ham " * 3, "x", "a\x0bb\x1cc " * 9]
    docs = docs_frame(spark, list(enumerate(texts)), "kept string")
    rows = {r["doc_id"]: r for r in line_rules.clean_lines(docs).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_lines(t), t
    assert [rows[i]["kept"] for i in (3, 6, 7, 8)] == [True, False, False, False]
    assert rows[3]["clean_text"] == a
    assert line_rules.clean_lines(docs.limit(0)).count() == 0


# --- 3 mixing


def test_mixing_reaches_targets(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 20), rng.choice(["a", "a", "a", "b"]), rng.choice(["en", "fr"]), rng.choice(["t1", "t2"])) for i in range(400)]
    rows += [(None, "null id words", None, None, None), (7, None, "c", "en", "t1"), (7, "", "c", "en", "t1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"a": 0.5, "b": 0.5, "": 0.0}, "lang": {"en": 0.5, "fr": 0.5}, "topic": {"t1": 0.3, "t2": 0.7}}
    own = mixing.with_cells(docs)
    own = own.select(*[F.col(f"__{c}").alias(c) for c in mixing.DIMS], "__tokens")
    cells = own.groupBy(*mixing.DIMS).agg(F.sum("__tokens").alias("tokens"))
    w = mixing.raked(cells, targets, sweeps=10).toPandas()
    for dim, want in targets.items():
        got = w.groupby(dim)["w"].sum()
        for k, v in want.items():
            assert abs(got.get(k, 0.0) - v) <= mixing.TOLERANCE
    p = mixing.probabilities(mixing.raked(cells, targets, sweeps=10), 0.4).toPandas()
    spent = own.groupBy(*mixing.DIMS).agg(F.sum("__tokens").alias("t")).toPandas().merge(p)
    assert abs((spent["t"] * spent["p"]).sum() - 0.4 * spent["t"].sum()) < 1
    out = mixing.mix(docs, targets, 0.4).toPandas()
    assert len(out) == len(rows) and out[out["text"].isna()]["kept"].all()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_with_odd_columns_repeats_and_salts(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, prose(rng, 20), rng.choice(["a", "b", None]), rng.choice(["en", "fr"]), 0.25, "yes", "n", 7, "w") for i in range(200)]
    rows += rows[:20] + [(500, "word " * 50_000, "a", "en", 0.1, None, None, None, None), (501, "", "b", "fr", None, "", "", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p double, kept string, tokens string, n_tokens int, w string")
    kept = mixing.draw(docs)
    assert kept.columns == docs.columns
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == {*docs.columns, "topic"} and mixed.count() == len(rows)
    got = sorted(map(repr, (tuple(r) for r in kept.collect())))
    every = [tuple(r) for r in docs.collect()]
    assert Counter(got) <= Counter(map(repr, every))
    by_id = {r["doc_id"]: r["kept"] for r in mixed.collect()}
    assert sorted(repr(r) for r in every if by_id[r[0]]) == got  # rows of equal id are drawn alike
    monkeypatch.setattr(mixing, "BROADCAST_CELLS", 0)
    assert sorted(map(repr, (tuple(r) for r in mixing.draw(docs).collect()))) == got


# --- 4 urls


def test_url_filter(spark):
    urls = [None, "", "no scheme/en/", "http://com/", "http://WWW.Example.com/en/x?q", "http://m.example.com/en/x", "https://a.net/fr/", "https://a.net", "http://x.org/free-bets/", "http://x.org/free-free", "http://x.org/casino?x", "http://x.org/casinova", "http://e.org/a://b"]
    docs = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    rows = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(docs).collect()}
    assert rows[0] == ("", "", None, "allow") and rows[2] == ("", "", None, "allow")
    assert rows[3] == ("com", "/", "com/", "allow")
    assert rows[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert rows[5][2:] == ("example.com/en/", "block") and rows[6][2:] == ("net/fr/", "block")
    assert rows[7] == ("a.net", "", None, "allow")
    assert [rows[i][3] for i in (8, 9, 10, 11)] == ["block", "allow", "block", "allow"]
    assert rows[12][:2] == ("e.org", "/a://b")


# --- 5 packing


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    rng = random.Random(3)
    texts = [None, "", " ", "a  b\n\n c ", "naïve\u00a0 space\ttabs 's it's", prose(rng, 3000), *[prose(rng, rng.randint(1, 400)) for _ in range(60)]]
    rows = list(enumerate(texts)) + [(None, "null id")]
    out = packing.pack(docs_frame(spark, rows)).toPandas()
    for i, t in rows[:-1]:
        want = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], np.uint32)
        own = out[out["doc_id"] == i].sort_values("start")
        assert np.concatenate(own["ids"].to_numpy()).tolist() == want.tolist()
        assert (own["doc_tokens"] == len(want)).all() and own["start"].tolist() == np.concatenate([[0], np.cumsum(own["length"])[:-1]]).tolist()
        assert own["ids_crc32"].tolist() == [zlib.crc32(want[s : s + n].tobytes()) for s, n in zip(own["start"], own["length"])]
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]]
        total = g["length"].sum()
        assert total == 1024 or total & (total - 1) == 0
    assert packing.pack(docs_frame(spark, rows).limit(0)).count() == 0


def test_packing_reads_special_strings_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    tokenizer, coder = Tokenizer.from_file(path), packing.TextEncoder(path, "tiktoken")
    rng = random.Random(8)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "\n", "a", " the", "\u00e9", "  ", "<|"]
    for _ in range(500):
        text = "".join(rng.choices(bits, k=rng.randint(1, 12)))
        assert np.frombuffer(coder.ids(text), np.uint32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(coder.ids("x" * 1_000_000 + " end")) and max(map(len, coder.later)) <= packing.CACHED_CHARS


def test_best_fill_is_optimal():
    rng = random.Random(4)
    for _ in range(60):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(5)}
        room = rng.randint(1, 60)
        got = packing.best_fill(sorted(counts, reverse=True), counts, room)
        assert all(0 < n <= counts[k] for k, n in got.items())
        sums = {sum(k * n for k, n in zip(counts, pick)) for pick in itertools.product(*[range(c + 1) for c in counts.values()])}
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)


# --- 6 importance resampling


def test_resampling_keeps_good_and_drops_bad(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, 80)) for i in range(120)] + [(1000 + i, "w### x&&& y$$$ z*** " * 20) for i in range(30)] + [(2000 + i, " ".join(w for w in rng.choices(WORDS, k=12) for _ in range(7))) for i in range(20)]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i % 2], "doc_id long, quality int")
    out = importance.resample(docs_frame(spark, rows + [(None, None), (5000, None), (5001, "")]), labels).toPandas()
    assert len(out) == len(rows) + 3
    own = out.dropna(subset=["doc_id"]).set_index("doc_id")
    assert own.loc[[i for i, _ in rows if i < 1000], "kept"].all()
    assert not own.loc[[i for i, _ in rows if 1000 <= i < 5000], "kept"].any()
    assert own.loc[5000, "log_weight"] == 0
    again = importance.resample(docs_frame(spark, rows), labels).toPandas().set_index("doc_id")
    assert again["kept"].sum() == 120
    none = importance.resample(docs_frame(spark, rows), labels.limit(0)).toPandas()
    assert none["kept"].all()
    assert importance.resample(docs_frame(spark, rows).limit(0), labels).count() == 0


def gram_bucket(gram):
    key = len(gram)
    for b in gram:
        key = (key << 8 | b) & (1 << 64) - 1
    return (key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - importance.BITS


def plain_log_weights(rows, labels):
    """Sum over a text's n-grams of the log ratio of the two models, straight from the definition."""
    grams = lambda t: [gram_bucket(t[i : i + n]) for n in importance.ORDERS for i in range(len(t) - n + 1)]
    texts = [(i, grams((t or "").encode())) for i, t in rows]
    raw, good = Counter(), Counter()
    for i, g in texts:
        raw.update(g)
        if labels.get(i) == 1:
            good.update(g)
    size, n, m = 1 << importance.BITS, sum(raw.values()), sum(good.values())
    prior = lambda b: (raw[b] + 1) / (n + size)
    return [sum(math.log((good[b] + size * prior(b)) / (m + size) / prior(b)) for b in g) for _, g in texts]


def test_resampling_against_the_definition(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 30)) if i % 3 else " ".join(rng.choices(["x&&&", "y$$$", "the"], k=9))) for i in range(60)]
    rows += [(5, "another text under one id"), (7, rows[7][1]), (None, "no id at all"), (None, None), (99, ""), (98, "word " * 60_000)]
    marks = {i: int(i % 3 > 0) for i in range(0, 60, 2)}
    docs = spark.createDataFrame([(i, t, 1, 2, "n") for i, t in rows], "doc_id long, text string, key int, log_weight int, noise string")
    labels = spark.createDataFrame([*marks.items(), (None, 1), (1, None)], "doc_id long, quality int")
    out = importance.resample(docs, labels, k=40).toPandas()
    want = sorted(plain_log_weights(rows, marks))
    assert sorted(out["log_weight"]) == pytest.approx(want, rel=1e-6, abs=1e-6)
    assert out["kept"].sum() == 40 and out.loc[out["kept"], "key"].min() >= out.loc[~out["kept"], "key"].max()
    noise = (out["key"] - out["log_weight"]).groupby(out["doc_id"]).nunique()
    assert noise.loc[7] == 1
    kept = importance.keep(docs, labels, k=40)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(None if pd.isna(i) else int(i) for i in out.loc[out["kept"], "doc_id"])
    assert importance.resample(docs, labels, k=0).where("kept").count() == 0
    same = docs_frame(spark, [(3, "one text")] * 5)  # ties at the k-th place are all kept
    assert importance.resample(same, labels, k=2).where("kept").count() == 5


def test_resampling_draws_by_weight(spark):
    rows = [(i, "light river stone" if i % 2 else "light river stonx") for i in range(400)]
    docs = docs_frame(spark, rows)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 60, 2)], "doc_id long, quality int")
    out = [importance.resample(docs, labels, k=80, seed=s).toPandas() for s in (1, 2, 3)]
    weight = out[0].groupby(out[0]["doc_id"] % 2)["log_weight"].first()
    assert 0.5 < weight[1] - weight[0] < 5
    share = [x.loc[x["kept"], "doc_id"].mod(2).mean() for x in out]
    odds = math.exp(weight[1] - weight[0])
    # The first draws follow the odds; later ones less so, as the drawn leave the pool.
    assert 0.5 < min(share) and max(share) <= 1 and abs(sum(share) / 3 - odds / (1 + odds)) < 0.12
    assert set(out[0].loc[out[0]["kept"], "doc_id"]) != set(out[1].loc[out[1]["kept"], "doc_id"])


def test_gram_sums_match_a_plain_count():
    rng = np.random.default_rng(6)
    texts = [bytes(rng.integers(97, 101, n, dtype=np.uint8)) for n in (0, 1, 2, 3, 4, 5, 6, 40, 0, 9)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    weights = rng.normal(size=(1 << importance.BITS) + 1)
    weights[importance.NONE :] = 0
    total = importance.document_sums(data, offsets, weights)

    for t, got in zip(texts, total):
        assert got == pytest.approx(sum(weights[gram_bucket(t[i : i + n])] for n in importance.ORDERS for i in range(len(t) - n + 1)))


def test_kth_largest(spark):
    rng = random.Random(7)
    values = [rng.gauss(0, 1) for _ in range(300)] + [0.5] * 40
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 17, 100, 339):
        assert importance.kth_largest(df, "x", k, len(values)) == sorted(values, reverse=True)[k - 1]


# --- 7 simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_against_all_pairs(spark):
    rng = random.Random(8)
    texts = [prose(rng, 150) for _ in range(60)]
    for t in texts[:20]:
        words = t.split()
        for _ in range(3):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    texts += [None, "", "Ä b", "one two three", texts[0], texts[0]]
    out = simhash.near_duplicates(docs_frame(spark, list(enumerate(texts)))).toPandas().sort_values("doc_id")
    fps = [brute_fingerprint(t) for t in texts]
    assert out["fingerprint"].tolist() == ["%016x" % f for f in fps]
    assert out["component_id"].tolist() == brute_components(fps)
    nulls = simhash.near_duplicates(spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "c d e f g h")], "doc_id long, text string")).toPandas()
    assert nulls["component_id"].dropna().tolist() == [3, 3]
    assert simhash.near_duplicates(docs_frame(spark, []).limit(0)).count() == 0


def test_simhash_links_dense_clusters(spark, monkeypatch):
    rng = np.random.default_rng(9)
    fps = set()
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(80):
            x = base
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame(pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "rep": np.arange(len(fps))}))
    got = connected_components(simhash.links(frame)).toPandas()
    roots = dict(zip(got["node"], got["root"]))
    assert [roots.get(i, i) for i in range(len(fps))] == brute_components(fps)
    monkeypatch.setattr(simhash, "DENSE", 16)
    a = np.array(fps[:300], np.uint64)
    left, right = simhash._dense(a, np.arange(len(a)))
    parent = list(range(len(a)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in zip(np.concatenate(left).tolist(), np.concatenate(right).tolist()):
        p, q = find(x), find(y)
        parent[max(p, q)] = min(p, q)
    assert [find(i) for i in range(len(a))] == brute_components(fps[:300])


def test_golay_code_is_perfect():
    low, high, patterns, number = simhash.golay_tables()
    assert Counter(number.tolist()) == {1: 277, 6: 1771}
    rng = np.random.default_rng(10)
    x = rng.integers(0, 1 << 23, 2000)
    near, count = simhash.codeword_indices(x)
    for _ in range(5):
        y = x ^ (1 << rng.integers(0, 23, len(x)))
        decoded = simhash.codeword_indices(y)[0][:, 0]
        assert all(d in n[:c] for d, n, c in zip(decoded, near, count))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 500: 500, 501: 500}


# --- 8 ppm


class PlainPpm:
    """PPM with escape method D, symbol exclusion and update exclusion, learning text after text."""

    def __init__(self, order):
        self.order, self.trie = order, {}

    def contexts(self, data, i):
        return [(k, data[i - k : i]) for k in range(self.order, -1, -1)]

    def spell(self, text):
        return ppm.spelled(ppm.tokens_of(text))

    def learn(self, text):
        data = self.spell(text)
        for i in range(self.order, len(data)):
            for _, context in self.contexts(data, i):
                node = self.trie.setdefault(context, Counter())
                node[data[i]] += 1
                if node[data[i]] > 1:
                    break

    def log10(self, text):
        data, total = self.spell(text), 0.0
        for i in range(self.order, len(data)):
            excluded = {ppm.START}
            for _, context in self.contexts(data, i):
                left = {s: c for s, c in self.trie.get(context, {}).items() if s not in excluded}
                if not left:
                    continue
                n = 2 * sum(left.values())
                if data[i] in left:
                    total += math.log10((2 * left[data[i]] - 1) / n)
                    break
                total += math.log10(len(left) / n)
                excluded |= set(left)
            else:
                total -= math.log10(256 - len(excluded))
        return total


def test_ppm_against_the_definition(spark):
    rng = random.Random(11)
    texts = [None, "", "zzz quokka", "\n\t ", "été Été", *[prose(rng, rng.randint(1, 60)) for _ in range(60)]]
    rows = [*enumerate(texts), (7, texts[7]), (None, "river of null ids"), (40, "another text under one id")]
    docs = docs_frame(spark, rows, "score string")
    out = ppm.score_documents(docs.repartition(3), ppm.held_out_fold(), chunk_bytes=2000).toPandas()
    train, model, want = Counter(), PlainPpm(ppm.ORDER), []
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 10:
            train.update([*ppm.tokens_of(t), ppm.END_WORD])
            model.learn(t)
    n, v = sum(train.values()), len(train)
    for i, t in rows:
        tokens = [*ppm.tokens_of(t), ppm.END_WORD]
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        held = i is not None and zlib.crc32(str(i).encode()) % 10 == 0
        want.append((-1 if i is None else i, held, len(tokens), sum(train[w] > 0 for w in tokens), n, base, model.log10(t)))
    got = sorted(out.fillna({"doc_id": -1}).itertuples(index=False, name=None))
    assert len(got) == len(rows)
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-5)
    assert ppm.score_documents(docs.limit(0), ppm.held_out_fold()).count() == 0


def test_ppm_without_training_documents_is_uniform(spark):
    rows = ppm.score_documents(docs_frame(spark, [(1, "ab"), (2, None)]), F.lit(True)).orderBy("doc_id").collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in rows] == [(2, 0, 0), (1, 0, 0)]
    assert [r["score"] for r in rows] == pytest.approx([-3 * math.log10(255), -math.log10(255)], rel=1e-5)


def test_ppm_predicts_across_words(spark):
    rows = [(i, "the river of copper and the garden of stone " * 3) for i in range(1, 40)]
    ids = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 10 == 0][:2]
    ordered, shuffled = "the river of copper and the garden of stone", "stone of of the and copper garden river the"
    docs = docs_frame(spark, [*rows, (ids[0], ordered), (ids[1], shuffled)])
    score = {r["doc_id"]: r["score"] for r in ppm.score_documents(docs, ppm.held_out_fold()).where("held_out").collect()}
    assert score[ids[0]] > score[ids[1]] + 2


def test_ppm_levels_of_many_chunks(spark, monkeypatch):
    rng = random.Random(3)
    docs = docs_frame(spark, [(i, prose(rng, 40)) for i in range(40)]).repartition(4)
    whole = ppm.score_documents(docs, ppm.held_out_fold()).orderBy("doc_id").toPandas()
    monkeypatch.setattr(ppm, "FAN", 3)
    monkeypatch.setattr(ppm, "PART_BYTES", 1000)
    dealt = ppm.score_documents(docs, ppm.held_out_fold(), chunk_bytes=300).orderBy("doc_id").toPandas()
    pd.testing.assert_frame_equal(whole, dealt)


def test_gram_blocks_may_end_within_texts(monkeypatch):
    buf = ppm.joined([ppm.spelled(ppm.tokens_of(prose(random.Random(k), 30))) for k in range(9)])
    whole = ppm.gram_counts(buf)
    monkeypatch.setattr(ppm, "_BLOCK", 50)
    assert all((a == b).all() for a, b in zip(whole, ppm.gram_counts(buf), strict=True))
    assert whole[1].sum() == (buf != ppm.START).sum()


def test_places_and_packing_of_arrays():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    assert (ppm.Places(keys).find(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    for values in (keys, np.zeros(0, np.uint64), np.array([3, 1, 2]), rng.random(9).astype(np.float32)):
        assert (ppm.unpacked(ppm.packed(values)) == values).all()


def test_adaptive_code_learns():
    assert ppm.adaptive_code_length("") == pytest.approx(math.log2(255))
    assert ppm.adaptive_code_length("abc" * 50) < 0.3 * ppm.adaptive_code_length("".join(random.Random(12).choices("abcdefghij", k=150)))


# --- 9 maxscore


def test_maxscore_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(13)
    vecs = [(i, (rng.normal(size=8) * (i % 3)).tolist()) for i in range(230)]
    vecs += [(300 + i, [0.25] * 8) for i in range(30)] + [(400, None), (500, [0.1, None]), (600, [float("nan")] * 8), (700, [float("inf")] * 8), (800, []), (900, [1.0, 2.0]), (None, [0.0] * 8)]
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 60)
    monkeypatch.setattr(maxscore, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(maxscore, "STRIDE", 16)
    frame = spark.createDataFrame([(i, v, "c") for i, v in vecs], "vec_id long, embedding array<double>, score string")
    got = maxscore.exact_top_k(frame, F.col("vec_id") % 100 == 0).toPandas()
    good = {i: np.floor(1024 * np.array(v + [0.0] * (8 - len(v)))).astype(int) for i, v in vecs if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in good if i % 100 == 0]:
        want = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert list(zip(-own["score"], own["vec_id"])) == want and own["rank"].tolist() == list(range(1, 11))
    assert maxscore.exact_top_k(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# --- 10 language


def test_language_id(spark):
    rng = random.Random(14)
    de = "der die und nicht ein zu haben ist straße größe über mehr wieder auch nach bei".split()
    rows = [(i, " ".join(rng.choices(de if i % 2 else WORDS, k=rng.randint(8, 60))), "de" if i % 2 else "en", "src") for i in range(300)]
    odd = [(1000, None, "en", "s"), (1001, "", None, "s"), (1002, "123 !!", "de", "s"), (None, "the river and the garden of stone", None, "s")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, lang_pred string")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = langid.fit(docs, ~held)
    out = langid.identify(docs, model).select("doc_id", "lang", "lang_pred", "score").toPandas()
    known = out[out["doc_id"] < 1000]
    assert (known["lang"] == known["lang_pred"]).mean() > 0.97
    assert out[out["doc_id"] >= 1000]["lang_pred"].tolist() == ["und"] * 3
    assert ((out["score"] >= 0) & (out["score"] <= 1)).all()
    nothing = langid.identify(docs, langid.fit(docs.limit(0), ~held)).toPandas()
    assert (nothing["lang_pred"] == "und").all() and (nothing["score"] == 0).all()


def test_language_sample_is_bounded_and_takes_every_language(spark):
    rows = [(i, prose(random.Random(i), 12), f"l{i % 1100}") for i in range(2200)] + [(9, "one row many times", "l9")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, y, langs = langid.training_windows(docs, F.lit(True), "doc_id", "text", "lang", 1)
    assert len(langs) == 1100 == len(set(y.tolist())) and len(x) <= 1100 * langid.WINDOWS_PER_DOC
    again = langid.training_windows(docs.repartition(3), F.lit(True), "doc_id", "text", "lang", 1)
    assert (again[0] == x).all() and (again[1] == y).all()


def test_network_against_a_plain_convolution_and_numeric_gradients():
    rng = np.random.default_rng(3)
    model = langid.ByteCnn.new(["a", "b", "c"])
    x, y = rng.integers(0, langid.CLASSES, (5, 20)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def plain(net):
        hidden = [[max(0.0, max(float(sum(f[j, r[i + j], k] for j in range(w)) + net.bias[w][k]) for i in range(20 - w + 1))) for w, f in net.filters.items() for k in range(langid.FILTERS)] + [1.0] for r in x]
        z = np.array(hidden) @ net.out
        return np.exp(z) / np.exp(z).sum(1, keepdims=True)

    assert np.allclose(model.probabilities(x), plain(model), atol=1e-5)
    before = -np.log(plain(model)[np.arange(5), y]).mean()
    parts = {"out": model.out, "f2": model.filters[2], "f4": model.filters[4], "b3": model.bias[3]}
    kept = {k: v.copy() for k, v in parts.items()}
    model.train(x, y, epochs=1, rate=1e-3, batch=5)
    for name, v in parts.items():
        at = np.unravel_index(np.argmax(np.abs(v - kept[name])), v.shape)
        gradient = (kept[name][at] - v[at]) / 1e-3
        probe = langid.ByteCnn.new(["a", "b", "c"])
        target = {"out": probe.out, "f2": probe.filters[2], "f4": probe.filters[4], "b3": probe.bias[3]}[name]
        target[at] += 1e-3
        after = -np.log(plain(probe)[np.arange(5), y]).mean()
        assert gradient == pytest.approx((after - before) / 1e-3, rel=0.05, abs=2e-3)


def test_windows_cover_whole_texts():
    data, offsets = np.frombuffer(b"a" * 300 + b"b", np.uint8), np.array([0, 0, 300, 301])
    x, counts = langid.windows_of(data, offsets)
    assert counts.tolist() == [1, 3, 1] and (x == 5).sum() == 300 and (x == 6).sum() == 1
    capital, small = (langid.fold(np.frombuffer(t.encode(), np.uint8)).tolist() for t in ("ÉÀ", "éà"))
    assert capital == small


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(15)
    rows = [(i, prose(rng, 90), "en", f"s{i % 3}", 1) for i in range(90)]
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)] + [(200 + i, "w### x&&& y$$$ " * 20, "en", "s1", 1) for i in range(20)] + [(300, None, None, None, None), (301, "12 34", "en", "s1", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200)) for i, *_ in rows if i % 3 == 0 and i < 300], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    one = cp.quality(spark, docs, str(tmp_path))
    assert one.columns == names
    ids = {r[0] for r in one.select("doc_id").collect()}
    assert ids >= set(range(110)) - set(range(90, 100)) and not ids & set(range(200, 220))
    two = cp.language(spark, one, str(tmp_path))
    assert two.columns == names and {r[0] for r in two.select("doc_id").collect()} == ids - {300, 301}
    three = cp.near_duplicates(spark, two, str(tmp_path))
    left = {r[0] for r in three.select("doc_id").collect()}
    assert three.columns == names and not left & set(range(100, 110)) and left
    four = cp.mix(spark, three, str(tmp_path))
    assert four.columns == names and {r[0] for r in four.select("doc_id").collect()} <= left
    five = cp.pack(spark, four, str(tmp_path)).toPandas()
    assert set(five["doc_id"]) == {r[0] for r in four.select("doc_id").collect()}
    assert set(cp.run(spark, str(tmp_path)).toPandas()["doc_id"]) == set(five["doc_id"])


def grams5(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_pipeline_drops_near_copies_from_jaccard_four_fifths(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(16)
    line = " ".join(f"common{k}" for k in range(12))
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 160))) + (" " + line if i % 2 else "") for i in range(120)]
    for t in texts[:80]:
        for _ in range(2):
            words = t.split()
            for at in rng.sample(range(len(words)), min(len(words), rng.randint(0, 5))):
                words[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    hub = [f"h{k}" for k in range(300)]
    texts += [" ".join([*hub[:k], "edit", str(k), *hub[k + 1 :]]) for k in range(300)]  # one large group, all different
    texts += ["a b c", "A  b c", "", None, " "]
    sets = [grams5(t) for t in texts]
    best, groups = [0.0] * len(texts), list(range(len(texts)))

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        like = 1.0 if sets[i] == sets[j] else len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        best[i], best[j] = max(best[i], like), max(best[j], like)
        if like >= 0.8:
            a, b = find(i), find(j)
            groups[max(a, b)] = min(a, b)
    rows = [(i, t, "en", "x", 1) for i, t in enumerate(texts)]
    more = [(None, "one row without an id stays", "en", "x", 1), (0, "another text under a used id stays", "en", "x", 1), rows[3], rows[3]]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, fp string, node int")
    left = cp.near_duplicates(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    got = Counter(r["doc_id"] for r in left.collect())
    assert got[None] == 1 and got[0] == 2 and got[3] == 1
    copies = [i for i in range(len(texts)) if find(i) != i]
    assert len(copies) > 350 and sum(i not in got for i in copies) >= 0.9 * len(copies)
    assert all(i in got for i in range(len(texts)) if find(i) == i and best[i] < 0.7)
    for group in {find(i) for i in range(len(texts))}:  # something of each group stays
        assert group in got or best[group] >= 0.7
    assert cp.near_duplicates(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_wide_fingerprints_tell_the_similarity():
    rng = random.Random(20)
    for like in (0.95, 0.8, 0.5, 0.0):
        apart = []
        for _ in range(30):
            both = [f"a{rng.randrange(10**9)}" for _ in range(200)]
            own = round(200 * (1 - like) / max(like, 1e-9) / 2) if like else 200
            x, y = ([f"{c}{rng.randrange(10**9)}" for _ in range(own)] for c in "bc")
            texts = (" ".join(both * bool(like) + z) for z in (x, y))
            sets = [grams5(t) for t in (" ".join(both * bool(like) + x), " ".join(both * bool(like) + y))]
            true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
            fps = [simhash.wide_fingerprint(simhash.shingle_set(t)) for t in texts]
            apart.append(int(np.bitwise_count(fps[0] ^ fps[1]).sum()) - 64 * simhash.WIDE * math.acos(2 * true / (1 + true)) / math.pi)
        assert abs(sum(apart) / 30) < 6


def test_wide_keys_are_shared_codewords():
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, (40, simhash.WIDE)).astype(np.uint64)
    fps[20:] = fps[:20] ^ (np.uint64(1) << rng.integers(0, 46, (20, simhash.WIDE)).astype(np.uint64))
    key, row = simhash.wide_keys(fps)
    held = [set(key[row == i].tolist()) for i in range(40)]
    _, _, patterns, number = simhash.golay_tables()

    def near(word):
        return {c >> 11 for c in (word ^ int(p) for s in [int(simhash._syndrome(word))] for p in patterns[s][: number[s]])}

    for i in range(40):
        want = {band << 24 | p << 12 | q for band in range(simhash.BANDS) for p in near(int(fps[i, band]) & (1 << 23) - 1) for q in near(int(fps[i, band]) >> 23 & (1 << 23) - 1)}
        assert held[i] == want
    assert all(held[i] & held[20 + i] for i in range(20))
