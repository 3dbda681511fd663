"""Token counts by resynchronised chunks against the libraries on whole texts."""

import random

import pytest

from spoorline.llm import token_counts
from spoorline.llm.packing import default_vocabulary

PARTS = ["river", " the", "  ", "\n\n", "'re", "'", "'ll", " 1234", "日本語", "é", "<|endoftext|>", "<|end", "oftext|>", "!?", "\t ", " ", "a" * 40, " ", "🙂", "…"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_vocabulary())


def brute(tokenizer, text):
    return len(tokenizer.encode(text or "", add_special_tokens=False).ids)


def test_counts_against_whole_texts(spark, tokenizer):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(900))) for _ in range(60)]
    texts += [None, "", " ", "'", "x" * 5000, " " * 3000, "word " * 3000, "\n" * 2000 + "end", "<|endoftext|>" * 300, "'re" * 1000, "日" * 2000]
    rows = [(k, t, k) for k, t in enumerate(texts)] + [(3, texts[3], 0), (None, texts[5], 1), (None, None, 2), (70, texts[70], 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")  # a column of the result's name
    for step, overlap in ((50, 20), (200, 30), (64, 64)):
        got = token_counts.count_tokens(docs, limit=100, step=step, overlap=overlap).collect()
        want = [(i, len((t or "").encode()), n := brute(tokenizer, t), n > 100) for i, t, _ in rows]
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_a_word_longer_than_overlaps_takes_more_rounds(spark, tokenizer, monkeypatch):
    rounds = []
    spliced = token_counts._spliced
    monkeypatch.setattr(token_counts, "_spliced", lambda docs, path, step, overlap: rounds.append((step, overlap)) or spliced(docs, path, step, overlap))
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(700))
    docs = spark.createDataFrame([(1, f"one two {long} three {long} four"), (2, "plain words here " * 40)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, step=100, overlap=10).collect()}
    assert got == {r.doc_id: brute(tokenizer, r.text) for r in docs.collect()}
    assert rounds[0] == (100, 10) and len(rounds) > 1


def test_splices_are_used_and_huge_texts_spread(spark, tokenizer):
    text = "A sentence about rivers, and 42 more.\n" * 3000
    docs = spark.createDataFrame([(7, text)], "doc_id long, text string")
    assert token_counts.count_tokens(docs).first().n_tokens == brute(tokenizer, text)
    assert docs.where("length(text) > 16384").count() == 1


def test_boundaries_do_not_change_with_what_follows(tokenizer):
    own = token_counts.vocabulary_of(default_vocabulary())
    assert own.proven and own.reach == len("<|endoftext|>") + 2
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choice(PARTS) for _ in range(40))
        cut = rng.randrange(len(text) + 1)
        whole, before, _ = own.bounds(text)
        part, n, _ = own.bounds(text[:cut])
        true = dict(zip(whole.tolist(), before.tolist()))
        assert all(true.get(a) == b for a, b in zip(part.tolist(), n.tolist()) if a <= cut - own.reach)


def test_other_vocabularies_read_whole_texts(spark):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    texts = ["Hello there  world", None, "x" * 3000, "Zwei Wörter " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for path, count in (("piece_bpe_32k.model", lambda t: len(piece.encode(t))), ("word_bpe_49k.json", lambda t: len(words.encode(t, add_special_tokens=False).ids))):
        got = token_counts.count_tokens(docs, public_tokenizers.path(path), step=100, overlap=10).collect()
        assert {r.doc_id: r.n_tokens for r in got} == {k: count(t or "") for k, t in enumerate(texts)}


def test_empty_table_and_other_ids(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert token_counts.count_tokens(none).collect() == []
    one = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    assert token_counts.count_tokens(one).first().doc_id == "a"
    with pytest.raises(ValueError):
        token_counts.count_tokens(one, step=10, overlap=20)
