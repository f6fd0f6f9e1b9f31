"""Chunked encoding against the library on whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest

from lumenframe.llm.tokens import ChunkedTokenizer

SIGNS = [" ", "  ", "\n", "\t", "\r\n", " ", " ", "́", "e", "É", "İ", "ß", "Σ", "ς", "'s", "'LL", "123", "!?", ",", ".", "<", "=", "̸", "你", "😀", "ﬁ", "a", " word", " Word.", "\x0b", "\x1c", "\x85", "×", "÷", "ͅ", "ᄀ", "ᅡ", "​"]


def packed(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("more", [[], ["<|endoftext|>", "<|startoftext|>", "<|"]])
def test_whole_texts(name, more):
    machine, rng = ChunkedTokenizer(public_tokenizers.path(name)), random.Random(5)
    for _ in range(3):
        texts = ["".join(rng.choice(SIGNS + more) for _ in range(rng.randrange(25))) for _ in range(1500)] + ["", "plain words and, signs. " * 50]
        ids, bounds = machine.encode(*packed(texts))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == machine.library.encode(t, add_special_tokens=False).ids
    assert [len(x) for x in machine.encode(*packed([]))] == [0, 1]
