"""Phrases of two to five words that stand together more often than their parts let expect, by language.

Candidates come from sketches. A count-min sketch of hashed words, then of pairs of words that
pass it, then of longer runs of pairs that pass, tells which runs may reach the least count:
cells are summed over all tasks by block, and one bit for each cell says whether it reaches it.
A sketch never counts too little, so no phrase is lost; what it lets through too much falls
away once counted. One more scan counts: a task gathers a chunk of its documents, compiles the
candidates that stand in it into a pyahocorasick automaton, with a space on both sides of each
phrase as a guard, and counts all matches in the stretches of words where pairs pass, overlapping
ones too, in equal stretches once for all; words are told apart by their bytes and counted beside. The sums over all chunks are
exact, and the thresholds are applied to them alone.

Sizes: a sketch has a cell for every 128 bytes of text, up to MOST_CELLS, and goes to the tasks
as bits. What a chunk holds meets at BLOCK_CHARS bytes of candidates or CHUNK_BYTES of text and
counts; it ends there, with the slice at hand, if half of that is left. So the documents are read
as often at any number of candidates, none of which pass the driver.

Defined results: a null or empty text has no words; a null language is `und`, as is that name
itself; each row is one document, also where ids repeat; phrases don't cross the end of a piece
or a document; an empty table, or one without frequent phrases, gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import prepared, released, small_or_shuffled, written
from .textbatch import LOWER, SLICE_BYTES, Grams, mix, owner, slices, span_hashes, words

LONGEST = 5
#: The orders that one sketch counts together; each needs the orders before it.
STEPS = ((1,), (2,), (3, 4, 5))
LEAST_CELLS, MOST_CELLS, DEPTH = 1 << 16, 1 << 28, 2
#: Cells that one row of a sketch's partial counts holds.
BLOCK_CELLS = 1 << 16
#: Codes that a task gathers before it hands out their counts.
CODES = 6_000_000
#: Bytes of the phrases of one automaton, with eight for each (some 50 bytes of memory a character where they share no beginning), and bytes of text and counts that wait for it.
BLOCK_CHARS, CHUNK_BYTES = 6_000_000, 64 << 20
#: Runs of words whose bytes are gathered at once.
RUNS = 50_000
#: Counted phrases up to which their table is broadcast to look up parts.
BROADCAST_PHRASES = 300_000
#: Bytes of text that one task reads, where that leaves two tasks a core and splits are smaller: partial counts then meet before they are shuffled.
TASK_BYTES = 64 << 20

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
#: Bytes of words: neither a break between pieces nor a blank.
_WORD = ~_BREAK
_WORD[[0x20, 9]] = False


class _Slice:
    """A slice of texts as words: their hashes, how many are left in each one's piece, and the languages."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        # a break after each text, so that words and pieces end there
        self.data, self.langs = np.insert(LOWER[data], offsets[1:], 10), langs
        self.starts, self.ends, self.bounds = words(self.data, offsets + np.arange(len(offsets)), _WORD)
        self.n, self.text = len(self.starts), owner(self.bounds)
        broken, new = _BREAK[self.data], np.ones(self.n, bool)
        left, right = self.ends[:-1], self.starts[1:]
        new[1:] = broken[left] | broken[right - 1]
        wide = np.flatnonzero(right - left > 2)
        breaks = np.flatnonzero(broken)
        new[wide + 1] = np.searchsorted(breaks, right[wide]) > np.searchsorted(breaks, left[wide])
        pieces = np.append(np.flatnonzero(new), self.n)
        self.room = np.repeat(pieces[1:], np.diff(pieces)) - np.arange(self.n)

    def hashed(self) -> _Slice:
        self.grams = Grams(span_hashes(self.data, self.starts, self.ends))
        self.lang = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)
        return self

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """A 64-bit hash of language and words of the runs of k words that begin at some words."""
        return self.grams.of(at, at + k) ^ mix(self.lang[self.text[at]] + np.uint64(k))

    def laid_out(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' bytes with one space after each, and where each begins."""
        data, kept = self.data.copy(), _WORD[self.data]
        data[self.ends], kept[self.ends] = 0x20, True
        return data[kept], np.concatenate(([0], np.cumsum(self.ends - self.starts + 1)))


def _read(batch: pa.RecordBatch) -> Iterator[_Slice]:
    langs = batch.column("lang").to_pylist()
    for row, end, data, offsets in slices(batch):
        yield _Slice(data, offsets, langs[row:end])


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each key in each row of a sketch of 2 ** bits cells a row, numbered through."""
    return [(keys & np.uint64((1 << bits) - 1)).astype(np.int64), (keys >> np.uint64(64 - bits)).astype(np.int64) + (1 << bits)]


class _Passing:
    """Which runs of words may be frequent, by the sketches made so far."""

    def __init__(self, bits: int, held: list):
        self.bits, self.held = bits, held

    def __call__(self, part: _Slice, upto: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """k, first words and keys, for each k up to upto."""
        before = np.ones(part.n + 1, bool)
        before[part.n] = False
        for k in range(1, upto + 1):
            here = before[:-1] & (part.room >= k)
            if k > 1:
                here &= before[1:]
            at = np.flatnonzero(here)
            keys = part.keys(at, k)
            step = next(i for i, orders in enumerate(STEPS) if k in orders)
            if step < len(self.held):
                table = self.held[step].value
                ok = np.ones(len(at), bool)
                for cells in _cells(keys, self.bits):
                    ok &= ((table[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).astype(bool)
                at, keys = at[ok], keys[ok]
            before = np.zeros(part.n + 1, bool)
            before[at] = True
            yield k, at, keys


def _partial(codes: list[np.ndarray]) -> pa.RecordBatch:
    """Cells and counts by block."""
    cell, count = np.unique(np.concatenate(codes), return_counts=True)
    block = cell // BLOCK_CELLS
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    low, count = (cell % BLOCK_CELLS).astype(np.uint16), count.astype(np.uint32)
    ends = np.append(cuts[1:], len(cell))
    pairs = list(zip(cuts.tolist(), ends.tolist(), strict=True))
    return pa.RecordBatch.from_arrays([pa.array(block[cuts].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in pairs], pa.binary()), pa.array([count[a:b].tobytes() for a, b in pairs], pa.binary())], ["block", "cells", "counts"])


def _sketch(docs: DataFrame, passing: _Passing, orders: tuple[int, ...], least: int) -> np.ndarray:
    """One bit for each cell: whether its count, over all documents, reaches the least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, n = [], 0
        for batch in batches:
            for part in _read(batch):
                for k, _, keys in passing(part.hashed(), max(orders)):
                    if k in orders and len(keys):
                        codes += [c.astype(np.uint32) for c in _cells(keys, passing.bits)]
                        n += DEPTH * len(keys)
                if n > CODES:
                    yield _partial(codes)
                    codes, n = [], 0
        if codes:
            yield _partial(codes)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = total.setdefault(block, np.zeros(BLOCK_CELLS, np.uint32))
                at = np.frombuffer(cells, np.uint16)
                # kept below the least, so that nothing overflows
                have[at] = np.minimum(have[at].astype(np.uint64) + np.frombuffer(counts, np.uint32), least)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in total.values()], pa.binary())], ["block", "bits"])

    blocks = max(1, (DEPTH << passing.bits) // BLOCK_CELLS)
    # written, as an iterator alone would have its partitions summed one after the other
    parts = written(docs.mapInArrow(released(count), "block int, cells binary, counts binary").repartition(max(1, blocks // 64), "block").mapInArrow(released(summed), "block int, bits binary"), "sketch")
    out = np.zeros((blocks, BLOCK_CELLS // 8), np.uint8)
    # one bit for each cell: 64 MB at most
    for row in parts.toLocalIterator():
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return out.reshape(-1)


def sketches(docs: DataFrame, least: int, cells: int) -> _Passing:
    """Tells every run of one to LONGEST words whose count in a language may reach the least."""
    bits = (min(MOST_CELLS, max(LEAST_CELLS, cells)) - 1).bit_length()
    held: list = []
    for orders in STEPS:
        held.append(docs.sparkSession.sparkContext.broadcast(_sketch(docs, _Passing(bits, list(held)), orders, least)))
    return _Passing(bits, held)


def _lists(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)])


def _pieces(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The bytes of some spans, which may overlap."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return _lists(bounds, data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], sizes)])


def _summed(code: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    code, back = np.unique(code, return_inverse=True)
    return code, np.bincount(back, many, len(code)).astype(np.int64)


class _Tally:
    """Texts, each with the number of a language and a count."""

    def __init__(self):
        self.rows, self.size = [], 0

    def add(self, texts: pa.Array, lang: np.ndarray, many: np.ndarray) -> None:
        self.rows.append((texts, lang, many))
        self.size += texts.nbytes + lang.nbytes + many.nbytes

    def met(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Equal ones once, with their sum."""
        texts, lang, many = zip(*self.rows, strict=True)
        self.rows, self.size = [], 0
        # arrays without rows fall away, the others share one dictionary
        named = pa.chunked_array(texts).dictionary_encode().chunks
        distinct = named[0].dictionary if named else texts[0]
        width = max(1, len(distinct))
        code = np.concatenate(lang) * width + np.concatenate([np.zeros(0, np.int64), *(x.indices.to_numpy() for x in named)])
        del texts, named
        code, many = _summed(code, np.concatenate(many))
        self.add(distinct.take(pa.array(code % width)), code // width, many)
        return self.rows[0]


class _Chunk:
    """Slices of a task's documents: the runs that pass in them, by their text, and the stretches to match them in."""

    def __init__(self, passing: _Passing, block_chars: int):
        self.passing, self.block_chars, self.tongues = passing, block_chars, {}
        self.words, self.stretches, self.phrases, self.chars = _Tally(), _Tally(), [], 0

    def add(self, part: _Slice) -> None:
        flat, begins = part.laid_out()
        lang = np.array([self.tongues.setdefault(x, len(self.tongues)) for x in part.langs], np.int64)[part.text]
        named = _lists(begins, flat).dictionary_encode()
        word, width = named.indices.to_numpy().astype(np.int64), len(named.dictionary)
        run, pair = word, np.zeros(part.n + 1, bool)
        for k, at, _ in self.passing(part.hashed(), LONGEST):
            if k == 1:
                code, many = np.unique(lang[at] * width + word[at], return_counts=True)
                self.words.add(named.dictionary.take(pa.array(code % width)), code // width, many)
                continue
            # a number for each differing run of k words, by those of its first k - 1 and of its last
            _, first, back = np.unique(run[at] * width + word[at + k - 1], return_index=True, return_inverse=True)
            run = np.zeros(part.n, np.int64)
            run[at] = back
            for some in np.split(at[first], range(RUNS, len(first), RUNS)):
                self.phrases.append(_pieces(flat, begins[some], begins[some + k] - begins[some]))
                self.chars += self.phrases[-1].nbytes
            if k == 2:
                pair[at + 1] = True  # a word after its pair's first
        inside = pair[:-1] | pair[1:]
        sizes = np.diff(begins)
        text, sizes, leads = flat[np.repeat(inside, sizes)], sizes[inside], np.flatnonzero(~pair[:-1][inside])
        starts = np.concatenate(([0], np.cumsum(sizes)))[np.append(leads, len(sizes))]
        self.stretches.add(_lists(starts + np.arange(len(starts)), np.insert(text, starts[:-1], 0x20)), lang[inside][leads], np.ones(len(leads), np.int64))

    def full(self) -> bool:
        # what several slices have in common meets first
        if self.chars >= self.block_chars:
            self.phrases = [pa.concat_arrays(self.phrases).unique()]
            self.chars = self.phrases[0].nbytes
            if 2 * self.chars >= self.block_chars:
                return True
        if self.words.size + self.stretches.size < CHUNK_BYTES:
            return False
        self.words.met(), self.stretches.met()
        return 2 * (self.words.size + self.stretches.size) >= CHUNK_BYTES

    def counts(self) -> Iterator[pa.RecordBatch]:
        """lang, phrase, f."""
        if not self.words.rows:
            return
        yield from self._rows(*self.words.met())
        phrases = pa.concat_arrays(self.phrases).unique()
        if not len(phrases):
            return
        # equal stretches are matched once
        stretches, lang, many = self.stretches.met()
        ends, data = np.cumsum(pc.binary_length(stretches).to_numpy()), stretches.buffers()[2]
        machine, codes, counts, row = _Counting(phrases.to_pylist()), [], [], 0
        while row < len(ends):
            done = ends[row - 1] if row else 0
            last = max(row + 1, int(np.searchsorted(ends, done + SLICE_BYTES, "right")))
            end, number = machine.matches(data[done : ends[last - 1]].to_pybytes())
            at = row + np.searchsorted(ends[row:last], done + end, "right")
            some, weights = _summed(lang[at] * len(phrases) + number, many[at])
            codes.append(some)
            counts.append(weights)
            row = last
        code, many = _summed(np.concatenate(codes), np.concatenate(counts))
        yield from self._rows(phrases.take(pa.array(code % len(phrases))), code // len(phrases), many)

    def _rows(self, phrases: pa.Array, lang: np.ndarray, many: np.ndarray) -> Iterator[pa.RecordBatch]:
        tongues = pa.array(list(self.tongues), pa.string())
        for a in range(0, len(phrases), 100_000):
            # without the closing guard
            texts = pc.binary_slice(phrases[a : a + 100_000].cast(pa.binary()), 0, -1).cast(pa.string())
            yield pa.RecordBatch.from_arrays([tongues.take(pa.array(lang[a : a + 100_000])), texts, pa.array(many[a : a + 100_000])], ["lang", "phrase", "f"])


class _Counting:
    """An automaton over guarded phrases."""

    def __init__(self, phrases: list[bytes]):
        self.automaton = ahocorasick.Automaton()
        for number, phrase in enumerate(phrases):
            # one character for each byte, as in the text scanned
            self.automaton.add_word(f" {phrase.decode('latin-1')}", number)
        self.automaton.make_automaton()

    def matches(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where each match ends, and its number."""
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text.decode("latin-1"))), np.int64)
        return found[::2], found[1::2]


def count_phrases(docs: DataFrame, passing: _Passing, least: int, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """lang, phrase, f: how often each phrase of at least so many places stands in each language; with phrase null, the words of the language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, n_words = _Chunk(passing, block_chars), {}
        for batch in batches:
            for part in _read(batch):
                for x, size in zip(part.langs, np.diff(part.bounds).tolist(), strict=True):
                    n_words[x] = n_words.get(x, 0) + size
                if part.n:
                    chunk.add(part)
                if chunk.full():
                    yield from chunk.counts()
                    chunk = _Chunk(passing, block_chars)
        yield from chunk.counts()
        if n_words:
            yield pa.RecordBatch.from_arrays([pa.array(list(n_words), pa.string()), pa.nulls(len(n_words), pa.string()), pa.array(list(n_words.values()), pa.int64())], ["lang", "phrase", "f"])

    counted = docs.mapInArrow(released(count), "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), "phrase-counts")


def _score(a: str, n: str, left: str, right: str):
    """floor(1000 a n / (l r)), exact: decimals of 38 digits, and a quotient that fits a long."""
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    return F.expr(f"cast(1000 as decimal(4, 0)) * ({wide(a)} * {wide(n)}) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, lang: str = "lang", least: int = 100, top: int = 2000, percent: int = 100, block_chars: int = BLOCK_CHARS, cells: int | None = None) -> DataFrame:
    """The top phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase goes where a longer one around it has at least percent / 100 of its count.
    """
    prepared(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    docs = docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // TASK_BYTES))
    counts = count_phrases(docs, sketches(docs, least, size // 128 if cells is None else cells), least, block_chars)
    totals = F.broadcast(counts.where("phrase is null").select("lang", F.col("f").alias("n")))  # a row for each language
    often = counts.where("phrase is not null").withColumn("w", F.split("phrase", " "))
    often = written(often.withColumn("k", F.size("w")), "frequent-phrases")
    parts = small_or_shuffled(often.select("lang", "phrase", "f"), BROADCAST_PHRASES)
    several = often.where("k > 1")

    # shorter phrases inside longer ones
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    covered = several.where("k > 2").select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = several.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("f")))

    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "w", "k", cut)
    cuts = cuts.select("lang", "phrase", "a", "cut", F.array_join(F.slice("w", F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice("w", F.col("cut") + 1, F.col("k")), " ").alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    scored = cuts.join(totals, "lang").withColumn("score", _score("a", "n", "l", "r"))
    least_cut = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")
    least_cut = written(least_cut, "scored-phrases")

    # the first of each part, then of these
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    salts = least_cut.count() // 50_000 + 1
    some = least_cut.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
