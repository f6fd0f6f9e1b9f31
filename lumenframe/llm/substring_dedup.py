"""Substring dedup by relative Lempel-Ziv parsing in anchor-dealt reference blocks.

Each window of W words has one anchor, the run of K words in it with the smallest hash, so equal
windows have their anchors at the same place and meet under the anchors' hash. Consecutive
windows with one anchor are a stretch; a document is a sequence of stretches. Stretches are dealt
by their anchor to blocks: a block is the reference for its own stretches, and no other block can
hold a window of theirs, so parsing against it is parsing against every block.

In a block the stretches' windows, laid end to end, are indexed by a suffix array (ranks of runs
of 1, 2, 4, ... windows). Each stretch is parsed greedily: at a window its longest match anywhere
else in the reference becomes a factor (place, source, length); m windows are m + W - 1 words, so
every factor is long enough to be a duplicate span. The next window, which reaches over the
factor's end, is looked up anew, so no window across a boundary is missed. A stretch whose anchor
reads the same wherever it stands is a factor as a whole. Factors that follow each other in a
document are joined when words are removed.

Anchors are first counted (with partial sums, so copies meet only as counts), and Bloom filters
of bounded size tell the second reading which stretches may be shared; only those are shuffled.
Of an anchor that holds too many rows for a block, whole stretches are known duplicates at once
where they all read the same; otherwise its windows become blocks of their own and are counted:
each differing stretch once, with the number of its copies as weight, so that copies meet before
their windows do. A stretch with copies is a duplicate as a whole, so its copies need only be
told: those of the most frequent stretches, of a bounded number, where they lie, and those that
follow each other in a document leave as one span; the rest by a join. A stretch without copies
is cut into runs of repeated windows.

Windows are told by 64-bit hashes, within their anchor's 64.

Defined results: a null text or one of fewer words than W loses nothing; windows are judged on
the input; the first copy of a passage goes too; repeated rows are copies of each other;
other columns are kept or ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cluster
from .cluster import hot_limit, packed, prepared, released, semi_by_counts, shared_folder, unpacked, written
from .textbatch import NOT_SPACE, Grams, list_array, mix, slices, span_hashes, texts_of, words

WINDOW, ANCHOR = 35, 12
#: Stretches of one anchor that a block indexes; beyond, its windows are blocks of their own.
WIDE = 2000
#: Stretches that are indexed together, if their anchors have no more.
BLOCK_ROWS = 20_000
#: Bits of each Bloom filter: ten for each key, this many (32 MB) at most. A key's bits lie in one piece.
MOST_BITS, PIECE_BITS = 1 << 28, 1 << 19
HASHES = 4
DIRECT, BLOCK, SINGLE = 0, 1, 2


def leftmost_smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values the place of its smallest, the leftmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # as many bits in every slice, so equal windows choose alike
    bits = np.uint64(max(26, int(len(values)).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    held = (values & ~low) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        held = np.minimum(held[:-size], held[size:])
        size *= 2
    if size < width:
        held = np.minimum(held[: len(held) - (width - size)], held[width - size :])
    return (held[:n] & low).astype(np.int64)


class Stretches:
    """The stretches of a slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, k: int):
        self.starts, self.ends, self.bounds = words(data, offsets, NOT_SPACE)
        grams = Grams(span_hashes(data, self.starts, self.ends))
        small = grams.all(k)
        at = leftmost_smallest(small, window - k + 1)
        n = len(at)
        text = np.searchsorted(self.bounds, np.arange(n), "right") - 1
        whole = np.arange(n) + window <= self.bounds[text + 1]
        new = np.ones(n, bool)
        new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1]) | ~whole[:-1]
        cuts = np.flatnonzero(new)
        real = whole[cuts]
        first = cuts[real]
        # windows that run into the next text aren't windows
        ok = np.concatenate(([0], np.cumsum(whole)))
        count = (ok[np.concatenate((cuts[1:], [n]))[real]] - ok[first]) if n else first
        self.text, self.first, self.count = text[first], first, count
        self.key = small[at[first]]
        inside = at[first] - first
        self.content = mix(grams.of(first, first + count + window - 1) ^ mix(inside.astype(np.uint64) + np.uint64(1)))
        self.grams, self.window = grams, window

    def windows(self, some: np.ndarray) -> np.ndarray:
        """Hashes of all windows of some stretches, end to end."""
        count = self.count[some]
        at = np.arange(count.sum()) + np.repeat(self.first[some] - np.cumsum(count) + count, count)
        return self.grams.of(at, at + self.window)


class Bloom:
    """Pieces of cells; a key's piece and its bits there follow from its hash."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    @staticmethod
    def piece(keys: np.ndarray, pieces: int) -> np.ndarray:
        return ((mix(keys) >> np.uint64(32)) * np.uint64(pieces) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def places(keys: np.ndarray, bits: int) -> np.ndarray:
        step = mix(keys) | np.uint64(1)
        return (keys[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) & np.uint64(bits - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        pieces, width = self.cells.shape
        at = self.places(keys, width * 8)
        found = self.cells[self.piece(keys, pieces)[None, :], (at >> np.uint64(3)).astype(np.int64)]
        return ((found >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)


def bloom_of(keys: DataFrame, n: int) -> Bloom:
    """A filter over a column "key" of n distinct keys. Each piece is made by a task of its own; the driver gets bounded pieces."""
    bits = 1 << min(int(math.log2(MOST_BITS)), max(13, math.ceil(math.log2(10 * max(n, 1)))))
    width = min(bits, PIECE_BITS)
    pieces = bits // width

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(Bloom.piece(mine, pieces), pa.int64()), batch.column(0)], ["piece", "key"])

    def fill(table: pa.Table) -> pa.Table:
        cells = np.zeros(width, bool)
        cells[Bloom.places(table.column("key").to_numpy().view(np.uint64), width).ravel().astype(np.int64)] = True
        return pa.table({"piece": table.column("piece").slice(0, 1), "cells": pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())})

    made = keys.select("key").mapInArrow(released(name), "piece long, key long").groupBy("piece").applyInArrow(fill, "piece long, cells binary")
    cells = np.zeros((pieces, width // 8), np.uint8)
    for r in made.toLocalIterator():
        cells[r.piece] = np.frombuffer(r.cells, np.uint8)
    return Bloom(cells)


def _count(window: int, k: int):
    """Of each batch: anchor keys with their number of stretches and the smallest and largest content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                found = Stretches(data, offsets, window, k)
                key, content = found.key.view(np.int64), found.content.view(np.int64)
                order = np.lexsort((content, key))
                key, content = key[order], content[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
                count = np.diff(np.concatenate((first, [len(key)])))
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(count, pa.int64()), pa.array(content[first]), pa.array(content[first + count - 1])], ["key", "n", "low", "high"])

    return run


@dataclass
class Routes:
    """What the second reading knows of anchors: filters, and the exact keys of those with very many rows."""

    same: Bloom
    mixed: Bloom
    wide: Bloom
    hot_same: np.ndarray

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's route, -1 where it can't be shared, and whether its windows are needed. Equal keys go alike."""
        differ = self.mixed.holds(key)
        route = np.where(differ | self.same.holds(key), BLOCK, -1)
        if len(self.hot_same):
            at = np.minimum(np.searchsorted(self.hot_same, key), len(self.hot_same) - 1)
            hot = self.hot_same[at] == key
            route[hot], differ = DIRECT, differ & ~hot
        route[differ & self.wide.holds(key)] = SINGLE
        return route, differ


_SHARED = "doc_id {id}, copy long, key long, content long, first int, count int, windows array<long>, route int"
_SPANS = "doc_id {id}, copy long, first int, count int"


def _share(window: int, k: int, routes):
    """The stretches whose anchor may be shared, with their windows where the anchor's stretches may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in slices(batch):
                found = Stretches(data, offsets, window, k)
                route, differ = routes.value.of(found.key)
                some = np.flatnonzero(route >= 0)
                if not len(some):
                    continue
                differ = differ[some]
                size = np.where(differ, found.count[some], 0)
                hashes = found.windows(some[differ]).view(np.int64)
                text = found.text[some]
                doc = pa.array(row + text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), batch.column("copy").take(doc), pa.array(found.key[some].view(np.int64)), pa.array(found.content[some].view(np.int64)), pa.array(found.first[some] - found.bounds[text], pa.int32()), pa.array(found.count[some], pa.int32()), list_array(pa.array(hashes), size), pa.array(route[some], pa.int32())],
                    ["doc_id", "copy", "key", "content", "first", "count", "windows", "route"],
                )

    return run


class Reference:
    """A block: the windows of its stretches end to end, with a suffix array and the longest match of each window elsewhere.

    Only windows under one anchor (group) can match. ranks[j] names the runs of up to 2**j windows
    from each place to its stretch's end; equal names are equal runs.
    """

    def __init__(self, windows: np.ndarray, bounds: np.ndarray, group: np.ndarray):
        n = len(windows)
        self.bounds = bounds
        size = np.diff(bounds)
        left = np.repeat(bounds[1:], size) - np.arange(n)
        _, names = np.unique(windows, return_inverse=True)
        rank = _named(np.repeat(group, size), names)
        self.ranks, step = [rank], 1
        while step < (int(size.max()) if n else 1):
            after = np.zeros(n, np.int64)
            live = np.flatnonzero(left > step)
            after[live] = rank[live + step] + 1
            rank = _named(rank, after)
            self.ranks.append(rank)
            step *= 2
        #: Suffixes in order; each one's longest match is that with its neighbour before or after.
        self.order = np.argsort(rank, kind="stable")
        shared = self._common(self.order[:-1], self.order[1:], left)
        before, after = np.concatenate(([0], shared)), np.concatenate((shared, [0]))
        self.length, self.source = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if n:
            self.length[self.order] = np.maximum(before, after)
            self.source[self.order] = np.where(before >= after, np.roll(self.order, 1), np.roll(self.order, -1))

    def _common(self, a: np.ndarray, b: np.ndarray, left: np.ndarray) -> np.ndarray:
        """How many windows two suffixes have in common."""
        out = np.zeros(len(a), np.int64)
        a, b = a.copy(), b.copy()
        room = np.minimum(left[a], left[b])
        for j in range(len(self.ranks) - 1, -1, -1):
            live = np.flatnonzero(room - out >= 1 << j)
            live = live[self.ranks[j][a[live]] == self.ranks[j][b[live]]]
            out[live] += 1 << j
            # a pointer at its stretch's end isn't read again, as no room is left
            a[live] += 1 << j
            b[live] += 1 << j
        return out

    def parse(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The factors of all stretches, by greedy longest match: stretch, place in it, source among all windows, windows matched."""
        active = np.arange(len(self.bounds) - 1)
        at = self.bounds[:-1].copy()
        out = [(np.zeros(0, np.int64),) * 4]
        while len(active := active[at[active] < self.bounds[active + 1]]):
            here = at[active]
            length = self.length[here]
            hit = length > 0
            out.append((active[hit], here[hit] - self.bounds[active[hit]], self.source[here[hit]], length[hit]))
            at[active] += np.maximum(length, 1)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers for pairs of numbers, in their order."""
    width = int(b.max()) + 1 if len(b) else 1
    return np.unique(a.astype(np.int64) * width + b, return_inverse=True)[1]


def _parse(kind):
    """Of stretches sorted by anchor: their factors as spans. A block is some anchors with all their stretches."""
    names = ["doc_id", "copy", "first", "count"]

    def spans(rows: pa.Table) -> pa.RecordBatch:
        key = rows.column("key").to_numpy()
        windows = rows.column("windows").combine_chunks()
        bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(windows).to_numpy(zero_copy_only=False)))).astype(np.int64)
        group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        stretch, place, _, length = Reference(windows.flatten().to_numpy(), bounds, group).parse()
        some = rows.take(pa.array(stretch)).combine_chunks()
        first = some.column("first").to_numpy() + place
        return pa.RecordBatch.from_arrays([_one(some.column("doc_id"), kind), _one(some.column("copy"), pa.int64()), pa.array(first, pa.int32()), pa.array(length, pa.int32())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n_held = 0
        last = None  # the last whole stretch, and whether its anchor came before
        for batch in batches:
            rows = pa.table(batch)
            whole = rows.filter(pc.equal(pc.list_value_length(rows.column("windows")), 0))
            if whole.num_rows:
                if last is not None:
                    whole = pa.concat_tables([last[0], whole])
                key = whole.column("key").to_numpy()
                again = np.zeros(len(key), bool)
                again[1:] = key[1:] == key[:-1]
                again[0] = last is not None and last[1]
                before = bool(again[-1])
                again[:-1] |= key[1:] == key[:-1]
                out = whole.filter(pa.array(again[:-1].tolist() + [False])).select(names).combine_chunks()
                last = (whole.slice(len(key) - 1), before)
                yield from out.to_batches()
            rows = rows.filter(pc.greater(pc.list_value_length(rows.column("windows")), 0))
            if not rows.num_rows:
                continue
            held.append(rows)
            n_held += rows.num_rows
            if n_held >= BLOCK_ROWS:
                table = pa.concat_tables(held)
                key = table.column("key").to_numpy()
                # the last anchor may go on in the next batch
                cut = int(np.argmax(key == key[-1]))
                if cut:
                    yield spans(table.slice(0, cut))
                held, n_held = [table.slice(cut)], len(key) - cut
        if last is not None and last[1]:
            yield from last[0].select(names).combine_chunks().to_batches()
        if n_held:
            yield spans(pa.concat_tables(held))

    return run


def _one(column: pa.ChunkedArray, kind) -> pa.Array:
    column = column.combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], kind)


class Pairs:
    """A set of pairs of numbers, told exactly: each pair by the places of its numbers among all."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a, self.b = np.unique(a), np.unique(b)
        self.codes = np.sort(self._codes(a, b))

    def _codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.a, a) * (len(self.b) + 1) + np.searchsorted(self.b, b)

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(a), bool)
        found = np.isin(a, self.a) & np.isin(b, self.b)
        found[found] = np.isin(self._codes(a[found], b[found]), self.codes)
        return found


def _again(pairs):
    """Of stretches that are found in pairs: spans, one for those that follow each other in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = np.flatnonzero(pairs.value.holds(batch.column("key").to_numpy(), batch.column("content").to_numpy()))
            if not len(some):
                continue
            who, copy, first, count = (batch.column(c).to_numpy()[some] for c in ("who", "copy", "first", "count"))
            order = np.lexsort((first, copy, who))
            who, copy, first, end = who[order], copy[order], first[order], (first + count)[order]
            new = np.concatenate(([True], (who[1:] != who[:-1]) | (copy[1:] != copy[:-1]) | (first[1:] != end[:-1])))
            start = np.flatnonzero(new)
            last = np.concatenate((start[1:], [len(new)])) - 1
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some[order[start]])), pa.array(copy[start]), pa.array(first[start], pa.int32()), pa.array(end[last] - first[start], pa.int32())], ["doc_id", "copy", "first", "count"])

    return run


def _wide(placed: DataFrame, least: int) -> DataFrame:
    """doc_id, copy, first, count: runs of repeated windows in stretches of anchors that are too wide for a block."""
    spark, keys = placed.sparkSession, ["key", "content"]
    kind = placed.schema["doc_id"].dataType.simpleString()
    read = written(placed.groupBy(*keys).agg(F.count("*").alias("n"), F.any_value("windows").alias("windows"), F.any_value(F.struct("doc_id", "copy", "first")).alias("place")), "read")
    # a stretch with copies is a duplicate as a whole; at most HOT_KEYS are looked up where they lie: all, or those with the most copies
    total, repeated = read.agg(F.sum("n"), F.count_if(F.col("n") > 1)).first()
    most = 1 if repeated <= cluster.HOT_KEYS else hot_limit(total, 1)
    hot, few = read.where(F.col("n") > most).select(*keys), read.where(F.col("n").between(2, most)).select(*keys)
    names = hot.toArrow()
    pairs = spark.sparkContext.broadcast(Pairs(*(names.column(c).to_numpy() for c in keys)))
    stretches = placed.select("doc_id", "copy", *keys, "first", "count")
    found = stretches.withColumn("who", F.xxhash64("doc_id")).mapInArrow(released(_again(pairs)), _SPANS.format(id=kind))
    if most > 1:
        found = found.unionByName(stretches.join(F.broadcast(hot), keys, "left_anti").join(few, keys, "left_semi").drop(*keys))
    # of one without, its windows tell; it has one place
    each = read.select("key", "n", "place", F.posexplode("windows").alias("i", "w"))
    again = written(each.groupBy("key", "w").agg(F.count_if(F.col("n") == 1).alias("n"), F.sum("n").alias("copies")).where("n > 0 and copies > 1").select("key", "w", "n"), "again")
    places = semi_by_counts(each.where("n = 1").drop("n"), again, ["key", "w"], least).groupBy("place").agg(F.collect_list("i").alias("x"))
    # a stretch has no more windows than lie around one anchor, so x is short
    first = F.array_sort(F.filter("x", lambda i: ~F.array_contains("x", i - 1)))
    last = F.array_sort(F.filter("x", lambda i: ~F.array_contains("x", i + 1)))
    runs = places.select("place.*", F.explode(F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), (b - a + 1).alias("count")))).alias("r"))
    return found.unionByName(runs.select("doc_id", "copy", (F.col("first") + F.col("r.a")).alias("first"), F.col("r.count").alias("count")))


def factors(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, wide: int = WIDE) -> DataFrame:
    """doc_id, copy (hash of the text), spans array<struct<first, count>>: windows found elsewhere too, by first word and number."""
    spark = prepared(docs.sparkSession)
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    kind = rows.schema["doc_id"].dataType
    counts = rows.select("text").mapInArrow(released(_count(window, k)), "key long, n long, low long, high long").groupBy("key").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    anchors = written(counts.where("n > 1").select("key", "n", (F.col("low") != F.col("high")).alias("mixed")), "anchors")
    same, mixed = anchors.where("not mixed"), anchors.where("mixed")
    many = mixed.where(F.col("n") > wide)
    sizes = anchors.agg(F.sum("n"), F.count_if(~F.col("mixed")), F.count_if("mixed"), F.count_if(F.col("mixed") & (F.col("n") > wide))).first()
    hot = hot_limit(sizes[0], wide)
    hot_same = np.array([r.key for r in same.where(F.col("n") > hot).select("key").toLocalIterator()], np.int64)
    routes = spark.sparkContext.broadcast(Routes(bloom_of(same, sizes[1]), bloom_of(mixed, sizes[2]), bloom_of(many, sizes[3]), np.sort(hot_same.view(np.uint64))))
    simple, path = kind.simpleString(), shared_folder(spark, "stretches")
    rows.mapInArrow(released(_share(window, k, routes)), _SHARED.format(id=simple)).write.partitionBy("route").parquet(path)
    placed = spark.read.schema(_SHARED.format(id=simple)).parquet(path)
    whole = placed.where(F.col("route") == DIRECT).select("doc_id", "copy", "first", "count")
    dealt = placed.where(F.col("route") == BLOCK).select("doc_id", "copy", "key", "first", "count", "windows").repartition("key").sortWithinPartitions("key")
    parsed = dealt.mapInArrow(released(_parse(_arrow(kind))), _SPANS.format(id=simple))
    found = whole.unionByName(parsed)
    if sizes[3]:
        found = found.unionByName(_wide(placed.where(F.col("route") == SINGLE), wide))
    return found.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_set(F.struct("first", "count"))).alias("spans"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column("spans")
            for row, end, data, offsets in slices(batch):
                starts, ends, bounds = words(data, offsets, NOT_SPACE)
                delta = np.zeros(len(starts) + 1, np.int32)
                mine = spans.slice(row, end - row)
                flat = mine.flatten()
                if len(flat):
                    size = np.array([0 if x is None else x for x in pc.list_value_length(mine).to_pylist()])
                    first = flat.field("first").to_numpy() + np.repeat(bounds[:-1], size)
                    np.add.at(delta, first, 1)
                    np.add.at(delta, first + flat.field("count").to_numpy() + window - 1, -1)
                gone = np.cumsum(delta[:-1]) > 0
                raw, where = data.tobytes(), bounds.tolist()
                s, e, g = starts.tolist(), ends.tolist(), gone.tolist()
                texts = [b" ".join([raw[s[i] : e[i]] for i in range(a, b) if not g[i]]) for a, b in zip(where, where[1:], strict=False)]
                n_gone = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds])
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rest"), pa.array(np.diff(bounds), pa.int64()), pa.array(n_gone, pa.int64()), texts_of(texts)], ["doc_id", "rest", "n_words", "n_removed", "text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, wide: int = WIDE) -> DataFrame:
    """docs without text, with _n_words, _n_removed and _text (kept words joined by one space), in place of columns of those names."""
    found = factors(docs, window, k, wide).toDF("doc", "same", "spans")
    rows = packed(docs, "doc_id", "text").withColumn("copy", F.xxhash64("text"))
    joined = rows.join(found, rows["doc_id"].eqNullSafe(found["doc"]) & (rows["copy"] == found["same"]), "left").select("doc_id", "text", "rest", "spans")
    schema = joined.select("doc_id", "rest").schema.add("n_words", "long").add("n_removed", "long").add("text", "string")
    out = joined.mapInArrow(released(_cut(window)), schema)
    return unpacked(out, [c for c in docs.columns if c != "text"], ("doc_id",), _n_words=F.col("n_words"), _n_removed=F.col("n_removed"), _text=F.col("text"))


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2("_text", 256).alias("kept_sha256"))
