"""Token ids of whole texts by the tokenizers library, encoding each distinct chunk once.

A text is cut before white space that follows a character known not to be white space, and
before ASCII punctuation that follows a letter. Both byte-level and word-end vocabularies split
there themselves, and their normalisers (NFC, runs of white space, lower case) never act across
such a cut, so the ids of the chunks laid end to end are those of the whole text. Where a
special token's string may occur, texts are cut at white space only.

Each worker process keeps the ids of chunks, up to a bounded number, in flat arrays: a chunk is
found by a 64-bit hash and confirmed by its bytes. New chunks that begin with white space are
encoded many at a time, as one text, and told apart by their tokens.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from .textbatch import LOWER, span_hashes

CACHE_CHUNKS = 1_000_000
TOKEN_SLICE = 4 << 20
#: Chunks that one call of the library encodes.
TOGETHER = 4096

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_MARK = _SOLID & ~_LETTER
_MARK[0x30:0x3A] = False
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 13]] = True
#: Lower case and one kind of white space: what a lower-casing vocabulary that drops white space can't tell apart.
_FOLD = LOWER.copy()
_FOLD[[9, 10, 13]] = 0x20


def _latin(data: np.ndarray) -> np.ndarray:
    """The bytes that end a character of U+00C0 to U+00FF: 0x80 to 0xBF after 0xC3, all letters but U+00D7 and U+00F7."""
    out = np.zeros(len(data), bool)
    np.logical_and(data[:-1] == 0xC3, (data[1:] & 0xC0) == 0x80, out=out[1:])
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the chunks; every text begins one."""
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        latin = _latin(data)[:-1]
        before, after = data[:-1], data[1:]
        solid = _SOLID[before] | latin
        cut[1:-1] = solid & _BLANK[after]
        if data.tobytes().find(b"<|") < 0:
            letter = _LETTER[before] | (latin & (before != 0x97) & (before != 0xB7))
            cut[1:-1] |= letter & _MARK[after]
    cut[offsets] = True
    return np.flatnonzero(cut)


@lru_cache(4)
def tokenizer(path: str, cache_chunks: int = CACHE_CHUNKS) -> "ChunkedTokenizer":
    """The process's tokenizer with what it has learnt so far, of about cache_chunks chunks."""
    return ChunkedTokenizer(path, cache_chunks)


class ChunkedTokenizer:
    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        self.cache_chunks = cache_chunks
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        parts, vocab = json.loads(self.library.to_str()), self.library.get_vocab()
        size = max(vocab.values()) + 1
        steps = {x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])}
        suffix = parts["model"].get("end_of_word_suffix")
        first = ((parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        #: For a vocabulary of bytes, the bytes of each token; for one of words, which tokens end a word.
        self.sizes: np.ndarray | None = None
        self.word_end: np.ndarray | None = None
        if parts["normalizer"] is None and (parts["pre_tokenizer"] or {}).get("type") == "ByteLevel":
            # a token of such a vocabulary is written with one character for each byte
            self.sizes = np.zeros(size, np.int64)
            for token, i in vocab.items():
                self.sizes[i] = len(token)
        elif suffix and "Lowercase" in steps and first.get("type") == "Split" and first.get("invert") and r"[\p{L}]+" in first.get("pattern", {}).get("Regex", ""):
            self.word_end = np.zeros(size, bool)
            for token, i in vocab.items():
                self.word_end[i] = token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        #: The kept chunks' bytes, end to end by slot.
        self.bytes, self.ends = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def _joinable(self, data: np.ndarray, where: np.ndarray) -> np.ndarray:
        """The chunks that may be encoded as one text: white space first, and for words one space and then letters only."""
        latin = _latin(data)
        first, last = where[:-1], where[1:] - 1
        if self.sizes is not None:
            return _BLANK[data[first]] & (_SOLID[data[last]] | (latin[last] & (last > first)))
        if self.word_end is None:
            return np.zeros(len(first), bool)
        lead = np.append((data[:-1] == 0xC3) & latin[1:] & (data[1:] != 0x97) & (data[1:] != 0xB7), False)
        letter = _LETTER[data] | lead
        letter[1:] |= lead[:-1]
        count = np.concatenate(([0], np.cumsum(letter)))
        return (data[first] == 0x20) & (last > first) & (count[where[1:]] - count[first] == last - first)

    def _together(self, data: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their numbers for joinable chunks, encoded as one text."""
        ids = np.array(self.library.encode_batch_fast([data[where[0] : where[-1]].tobytes().decode()], add_special_tokens=False)[0].ids, np.uint32)
        if self.sizes is not None:
            ends, wanted = np.cumsum(self.sizes[ids]), where[1:] - where[0]
            at = np.searchsorted(ends, wanted)
            whole = len(ends) and at[-1] == len(ends) - 1 and np.array_equal(ends[at], wanted)
        else:
            at = np.flatnonzero(self.word_end[ids])
            whole = len(at) == len(where) - 1 and at[-1] == len(ids) - 1
        if not whole:
            raise ValueError("a token crosses a chunk's end")
        return ids, np.diff(np.concatenate(([0], at + 1)))

    def _learn(self, new: pa.LargeStringArray, keys: np.ndarray) -> np.ndarray:
        """Encodes and keeps the chunks, told by ascending keys; the slot of each."""
        data, where = _flat(new)
        joined = self._joinable(data, where)
        order = np.concatenate((np.flatnonzero(joined), np.flatnonzero(~joined)))
        many = int(joined.sum())
        taken = new.take(pa.array(order))
        held, bounds = _flat(taken)
        self.bytes, self.ends = np.concatenate((self.bytes, held)), np.concatenate((self.ends, self.ends[-1] + bounds[1:]))
        data, where = _flat(taken.slice(0, many))
        parts, lengths = [], []
        for i in range(0, many, TOGETHER):
            ids, length = self._together(data, where[i : i + TOGETHER + 1])
            parts.append(ids)
            lengths.append(length)
        rest = taken.slice(many).to_pylist()
        # the library's encodings take far more room than their ids, so only so many live at once
        for i in range(0, len(rest), TOGETHER):
            each = [e.ids for e in self.library.encode_batch_fast(rest[i : i + TOGETHER], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, each), np.int64, len(each)))
            parts.append(np.fromiter(chain.from_iterable(each), np.uint32, int(lengths[-1].sum())))
        length = np.concatenate(lengths)
        slots = np.empty(len(new), np.int32)
        slots[order] = len(self.start) + np.arange(len(new))
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length.astype(np.int32)))
        self.pool = np.concatenate((self.pool, *parts))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, slots)
        return slots

    def _same(self, data: np.ndarray, where: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Which chunks are, byte for byte, those of the slots."""
        sizes = np.diff(where)
        same = sizes == self.ends[slots + 1] - self.ends[slots]
        some = np.flatnonzero(same)
        sizes = sizes[some]
        firsts = np.cumsum(sizes) - sizes
        run = np.arange(sizes.sum()) - np.repeat(firsts, sizes)
        differ = data[run + np.repeat(where[some], sizes)] != self.bytes[run + np.repeat(self.ends[slots[some]], sizes)]
        # a chunk is never empty
        same[some] = ~np.logical_or.reduceat(differ, firsts) if len(some) else same[some]
        return same

    def _found(self, distinct: pa.LargeStringArray) -> np.ndarray:
        """The slots of distinct chunks, learnt where they are new; of chunks with one key, all but the first are learnt each time."""
        data, where = _flat(distinct)
        keys = span_hashes(data, where[:-1], where[1:])
        slots, new = np.zeros(len(keys), np.int32), np.ones(len(keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            slots = self.slots[at]
            new = (self.keys[at] != keys) | ~self._same(data, where, slots)
        if new.any():
            order = np.flatnonzero(new)
            order = order[np.argsort(keys[order])]
            slots[order] = self._learn(distinct.take(pa.array(order)), keys[order])
        return slots

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, and each text's bounds among them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if len(self.start) > self.cache_chunks or len(self.pool) > 8 * self.cache_chunks or len(self.bytes) > 32 * self.cache_chunks:
            self._forget()
        cuts = chunks(data, offsets)
        if self.word_end is not None:
            data = _FOLD[data]
        column = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = column.dictionary_encode()
        slots = self._found(coded.dictionary)[coded.indices.to_numpy()]
        length = self.length[slots].astype(np.int64)
        ends = np.cumsum(length)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[slots] - ends + length, length)]
        bounds = np.concatenate(([0], ends))[np.searchsorted(cuts, offsets)]
        return ids, bounds


def _flat(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes and offsets."""
    _, where, data = texts.buffers()
    where = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[where[0] : where[-1]], where - where[0]
