"""Vectorised text helpers for Arrow batches: word spans, word hashes, n-gram hashes.

All helpers work on slices of a batch: whole texts laid end to end in one byte buffer with
the offsets of each text. A slice holds a few MB of text, or one longer text, so memory
follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15
GRAM_BASE = 0xD6E8FEB86659FD93
#: Bytes up to which a span is hashed in steps of eight.
SHORT = 32
#: 2**61 - 1, and a point below it, drawn once.
PRIME = np.uint64((1 << 61) - 1)
POINT = 0x1A3C9F27D5B86E41
_HALF, _LOW = np.uint64(31), np.uint64((1 << 31) - 1)
#: Masks of the first 0 to 8 bytes of a little-endian word.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = ~_SPACE
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`: digits, a-z and all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of pieces of the batch; null texts are empty."""
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's bounds among them."""
    inside = kind[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = BASE) -> np.ndarray:
    """A 64-bit hash of each span's bytes, another one for another seed.

    Spans of up to SHORT bytes are mixed eight bytes at a time, each step a bijection that is not
    linear; longer ones are hashed by XXH3.
    """
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    out = mix(sizes.astype(np.uint64) * np.uint64(GRAM_BASE) ^ np.uint64(seed))
    at, where, left = None, starts, sizes
    for done in range(0, SHORT, 8):
        if done:
            some = np.flatnonzero(left > 8)
            if not len(some):
                return out
            at = some if at is None else at[some]
            where, left = where[some] + 8, left[some] - 8
        part = eights[where] & _FIRST_BYTES[np.minimum(left, 8)]
        if at is None:
            out = mix(out ^ part)
        else:
            out[at] = mix(out[at] ^ part)
    long = np.flatnonzero(sizes > SHORT)
    if len(long):
        raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        out[long] = [digest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**64."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, for a and b below it: in halves of 31 bits, as 2**61 is 1."""
    high_a, low_a, high_b, low_b = a >> _HALF, a & _LOW, b >> _HALF, b & _LOW
    middle = low_a * high_b + high_a * low_b
    return _reduced(high_a * high_b * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & (_LOW >> np.uint64(1))) << _HALF) + low_a * low_b)


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base**i modulo PRIME for i < n."""
    have = _powers.get(base)
    if have is None:
        have = _powers[base] = np.ones(1, np.uint64)
    while len(have) < n:
        have = _powers[base] = np.concatenate((have, _product(have, np.uint64(pow(base, len(have), int(PRIME))))))
    return have


class Grams:
    """Hashes of any runs of consecutive words, each in constant time: polynomials of the words' hashes modulo a prime."""

    def __init__(self, hashes: np.ndarray):
        n = len(hashes)
        terms = _product(_reduced(hashes), _power_table(POINT, n)[:n])
        self.back = _power_table(pow(POINT, -1, int(PRIME)), n + 1)
        high, low = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
        # sums of halves stay below 2**64
        np.cumsum(terms >> _HALF, out=high[1:])
        np.cumsum(terms & _LOW, out=low[1:])
        self.sums = _reduced(((high & (_LOW >> np.uint64(1))) << _HALF) + (high >> np.uint64(30)) + low)

    def _of(self, first: np.ndarray, last: np.ndarray, back: np.ndarray) -> np.ndarray:
        return mix(_product(_reduced(last + PRIME - first), back))

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self._of(self.sums[starts], self.sums[ends], self.back[starts])

    def all(self, k: int) -> np.ndarray:
        """Of each run of k words, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return self._of(self.sums[:n], self.sums[k:], self.back[:n])


def owner(bounds: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def list_array(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines, split at newline bytes, and each text's bounds among them. An empty text is one empty line."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    return starts, ends, np.concatenate(([0], np.cumsum(counts)))


def stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without space at both ends; an empty span at its start where nothing is left."""
    solid = np.flatnonzero(NOT_SPACE[data])
    if not len(solid):
        return starts, starts
    lo, hi = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = hi > lo
    first = np.where(some, solid[np.minimum(lo, len(solid) - 1)], starts)
    return first, np.where(some, solid[hi - 1] + 1, first)


def texts_of(pieces: list[bytes]) -> pa.Array:
    """A string column of UTF-8 pieces."""
    return pa.array(pieces, pa.binary()).cast(pa.string())
