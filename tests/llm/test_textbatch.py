"""Structured texts that polynomials modulo a power of two can't tell apart, through every operator that hashes words."""

import hashlib

import numpy as np
import public_tokenizers
import pytest

from lumenframe.llm.ngram_join import op2_ngram_jaccard
from lumenframe.llm.quality_rules import repeated_words
from lumenframe.llm.substring_dedup import op3_substring_dedup
from lumenframe.llm.textbatch import NOT_SPACE, PRIME, Grams, _product, span_hashes, words
from lumenframe.llm.tokens import ChunkedTokenizer
from tests.llm.test_tokens import packed

LINE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = LINE.translate(str.maketrans("ab", "ba"))


def hashed(text):
    data, offsets = packed([text])
    starts, ends, _ = words(data, offsets, NOT_SPACE)
    return span_hashes(data, starts, ends)


def test_words_and_runs():
    a, b = hashed(f"{LINE} {OTHER}")
    assert a != b
    # runs of 1024 words of two kinds
    grams = Grams(hashed(" ".join(LINE + OTHER))).all(1024)
    assert grams[0] != grams[1024]
    # equal runs are equal wherever they stand, and any two others differ
    rng = np.random.default_rng(1)
    text = [str(x) for x in rng.integers(0, 3, 400)] + ["é" * int(n) for n in rng.integers(1, 60, 40)]
    grams, seen = Grams(hashed(" ".join(text))), {}
    for k in (1, 2, 7, 33):
        for i, h in enumerate(grams.all(k).tolist()):
            assert h == int(grams.of(np.array([i]), np.array([i + k]))[0])
            assert seen.setdefault(h, tuple(text[i : i + k])) == tuple(text[i : i + k])


def test_spans_of_all_sizes():
    rng = np.random.default_rng(2)
    raw = rng.integers(0, 256, 5000, np.uint8)
    for size in (*range(1, 40), 200):
        at = np.arange(0, 4000, 7)
        got = span_hashes(raw, at, at + size)
        again = span_hashes(np.concatenate((raw[3:4100], raw)), at + 4097, at + 4097 + size)
        assert (got == again).all()
        assert len(set(got.tolist())) == len({raw[i : i + size].tobytes() for i in at.tolist()})


def test_products():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, int(PRIME), (2, 2000), np.uint64)
    a[:2] = b[1:3] = PRIME - np.uint64(1)
    assert _product(a, b).tolist() == [x * y % int(PRIME) for x, y in zip(a.tolist(), b.tolist(), strict=True)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens(name):
    machine = ChunkedTokenizer(public_tokenizers.path(name))
    for text in (LINE, OTHER, f"{OTHER} {LINE}"):
        assert machine.encode(*packed([text]))[0].tolist() == machine.library.encode(text, add_special_tokens=False).ids


def test_chunks_with_one_key(monkeypatch):
    """With a key that tells nothing, bytes still do."""
    monkeypatch.setattr("lumenframe.llm.tokens.span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    machine, text = ChunkedTokenizer(public_tokenizers.path("byte_bpe_50k.json")), "some words, and some more words. Again some words"
    for _ in range(3):
        assert machine.encode(*packed([text, LINE]))[0].tolist() == [i for t in (text, LINE) for i in machine.library.encode(t, add_special_tokens=False).ids]


def test_queries(spark, tmp_path):
    same = " ".join(f"w{i}" for i in range(34))
    spark.createDataFrame([(1, LINE), (2, OTHER), (3, f"{same} {LINE}"), (4, f"{same} {OTHER}")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    linked = {r.doc_id: r.component_id for r in op2_ngram_jaccard(spark, str(tmp_path)).collect()}
    assert (linked[1], linked[2]) == (1, 2)
    kept = {r.doc_id: (r.n_removed, r.kept_sha256) for r in op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert kept[3] == (0, hashlib.sha256(f"{same} {LINE}".encode()).hexdigest()) and kept[4][0] == 0


def test_repeats():
    data, offsets = packed([f"{LINE} p q {OTHER} p q"])
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    assert repeated_words(span_hashes(data, starts, ends), bounds).tolist() == [0]
