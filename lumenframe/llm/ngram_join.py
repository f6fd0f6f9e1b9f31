"""Exact Jaccard self-join on word n-grams by universe partition and pigeonhole.

Equal sets are one class; a class is named by a hash of its set. For two linked sets of sizes
s <= r the symmetric difference is at most H = (s + r) * (100 - t) / (100 + t). Sizes are cut
into bands; a pair belongs to the level of its larger set, and a set takes part in its own
level and those of the sizes it may link up to. At a level the universe of hashed n-grams is
cut into segments, and by the pigeonhole principle two linked sets agree in a segment wholly,
or, where a segment is given the weight two, up to one element. A segment of weight one has one
signature (of its content), one of weight two also those of its content less each element.
How many segments get weight two is chosen for each level by cost: signatures against
accidental agreement, which follows the number of documents at the level.

Weights add up to H + 1 + slack. Empty segments, and signatures that more than HEAVY classes
share, are left out by sets that have few enough of them for the slack: the remaining weights
still exceed H. Sets with more of them (copies of one text in large numbers) keep them.

Sets that share a signature are first compared with one of their group, and linked sets joined
into components. Only groups that still span several components are looked at again: all pairs
across components. Pairs whose bit sketches prove a larger difference than H are dropped, all
others compared exactly. So groups of copies cost as much as they have members, and no link
between different components is lost.

Defined results: a null text, an empty one or one of white space has the empty set and is
linked with nothing; a text of fewer words than n is one shingle; a null doc_id never names a
component unless it is alone; repeated rows are equal sets; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cluster import join_by_counts, packed, prepared, released, small_or_shuffled, unpacked, written
from .components import components
from .textbatch import LOWER, NOT_SPACE, Grams, mix, owner, slices, span_hashes, words

RATIO = 1.25
#: Of an accidental agreement, in signatures.
CHANCE_COST = 0.2
HEAVY = 32
SKETCH_BITS = 1024
FEW = 4
BROADCAST_ROWS = 1_000_000
#: Sets that one group compares with one set: so many, and of so many bytes by their largest allowed size.
BUNDLE, BUNDLE_BYTES = 256, 32 << 20
BLOCK = 4096
#: Low bits of a signature that tell its level: bands of sets up to 2**63 elements are fewer than 256.
LEVEL_BITS = 8
LEVEL_MASK = (1 << LEVEL_BITS) - 1
_SALT1, _SALT2 = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


@dataclass(frozen=True)
class Level:
    """Segments of weight two come first."""

    upper: int
    two: int
    one: int
    slack: int

    @property
    def weight(self) -> int:
        return 2 if self.two else 1

    @property
    def empties(self) -> int:
        """Of the slack, for empty segments; the rest is for heavy signatures."""
        return self.slack - self.slack // 3

    @property
    def heavies(self) -> int:
        return self.slack // 3


def bands(most: int) -> list[int]:
    """Upper sizes of the bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


def difference(s: int, r: int, percent: int) -> int:
    return (s + r) * (100 - percent) // (100 + percent)


def plan(sizes: dict[int, int], percent: int) -> tuple[np.ndarray, list[Level | None]]:
    """Upper sizes, and the level of each band (None where only equal sets can link). sizes: documents by set size."""
    uppers = bands(max(sizes, default=1))
    levels: list[Level | None] = []
    for k, upper in enumerate(uppers):
        lower = uppers[k - 1] + 1 if k else 1
        most = difference(upper, upper, percent)
        least = math.ceil(lower * percent / 100)
        n = sum(c for s, c in sizes.items() if least <= s <= upper)
        if most < 1 or n < 2:
            levels.append(None)
            continue
        best = None
        for slack in sorted({0, 1, *(math.ceil(most * x) for x in (0.1, 0.2, 0.35))}):
            need = most + 1 + slack
            for two in sorted({need // 2 * i // 8 for i in range(9)}):
                level = Level(upper, two, need - 2 * two, slack)
                m = level.two + level.one
                # of the smallest sets at the level, which have the most empty segments
                z = least / m
                empty = m * math.exp(-z)
                chance = 0.0 if level.weight * (empty + 2 * empty**0.5) <= level.empties else level.one * math.exp(-2 * z) + two * ((1 + z) * math.exp(-z)) ** 2
                cost = m + two * upper / m + CHANCE_COST * n * chance
                if best is None or cost < best[0]:
                    best = (cost, level)
        levels.append(best[1])
    return np.array(uppers), levels


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes, sorted, end to end, with each text's bounds."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, NOT_SPACE)
    grams = Grams(span_hashes(data, starts, ends))
    full = grams.all(n)
    parts, sizes = [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= n:
            x = np.sort(full[a : b - n + 1])
            x = x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            x = grams.of(np.array([a]), np.array([b]))
        else:
            x = full[:0]
        parts.append(x)
        sizes.append(len(x))
    return np.concatenate(parts) if parts else full[:0], np.concatenate(([0], np.cumsum(sizes)))


def _summed(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def names(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each set."""
    return mix(_summed(mix(sets ^ _SALT1), bounds)).view(np.int64), mix(_summed(mix(sets ^ _SALT2), bounds)).view(np.int64)


def sketches(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set the parities of its elements in cells, about as many as elements: two sketches differ in no more bits than the sets in elements."""
    hashes = mix(sets + _SALT2)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        cells = max(SKETCH_BITS, 1 << (b - a).bit_length())
        odd = np.bincount((hashes[a:b] & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes())
    return out


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch with its cells joined to so many bytes, as 64-bit integers."""
    return np.bitwise_xor.reduce(np.frombuffer(sketch, np.uint64).reshape(-1, size // 8), 0)


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


def signatures(sets: np.ndarray, bounds: np.ndarray, uppers: np.ndarray, levels: list[Level | None], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(signatures, their texts) for each level. The low LEVEL_BITS bits tell the level."""
    size = np.diff(bounds)
    text = owner(bounds)
    own = np.searchsorted(uppers, size)
    last = np.searchsorted(uppers, size * 100 // percent)
    for k, level in enumerate(levels):
        if level is None:
            continue
        docs = np.flatnonzero((own <= k) & (k <= last) & (size > 0))
        if not len(docs):
            continue
        m = level.two + level.one
        place = np.full(len(size), -1)
        place[docs] = np.arange(len(docs))
        at = np.flatnonzero(place[text] >= 0)
        h = sets[at]
        segment = ((mix(h ^ np.uint64(k + 1)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        cell = place[text[at]] * m + segment
        value = mix(h + _SALT1)
        total = np.zeros(len(docs) * m, np.uint64)
        np.add.at(total, cell, value)
        tag = mix(np.arange(m, dtype=np.uint64) + np.uint64(1 + (k << 32)))
        low = np.uint64(LEVEL_MASK)
        # a set leaves its empty segments out as long as the slack for that bears it
        full = np.bincount(cell, minlength=len(docs) * m) > 0
        spare = (m - full.reshape(-1, m).sum(1)) * level.weight <= level.empties
        live = np.flatnonzero(full | ~np.repeat(spare, m))
        yield (mix(total + np.tile(tag, len(docs))) & ~low)[live] | np.uint64(k), np.repeat(docs, m)[live]
        if level.two:
            some = np.flatnonzero(segment < level.two)
            yield (mix(total[cell[some]] - value[some] + tag[segment[some]]) & ~low) | np.uint64(k), text[at[some]]


def _profile(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in slices(batch):
                sets, bounds = shingle_sets(data, offsets, n)
                one, two = names(sets, bounds)
                part = batch.slice(row, end - row)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("copy"), pa.array(np.diff(bounds), pa.int64()), pa.array(one), pa.array(two), pa.array(sketches(sets, bounds), pa.binary())], ["doc_id", "copy", "n_shingles", "node", "check", "sketch"])

    return run


def _sign(n: int, uppers: np.ndarray, levels: list, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                sets, bounds = shingle_sets(data, offsets, n)
                node, _ = names(sets, bounds)
                new = np.array([x not in seen for x in node.tolist()], bool)
                seen.update(node.tolist())
                if len(seen) > 1 << 20:
                    seen = set()
                keep = np.unique(node, return_index=True)[1]
                keep = np.sort(keep[new[keep]])
                sizes = np.diff(bounds)
                live = np.zeros(len(sizes), bool)
                live[keep] = True
                chosen = sets[np.repeat(live, sizes)]
                limits = np.concatenate(([0], np.cumsum(sizes[live])))
                for sig, text in signatures(chosen, limits, uppers, levels, percent):
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[live][text])], ["sig", "node"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by sig and node, each (sig, node) once, where a sig has several nodes; size is 2 for small groups and 3 beyond HEAVY."""
    held: list[tuple[int, int]] = []
    heavy = None

    def out(sig, node, size):
        return pa.RecordBatch.from_arrays([pa.array(sig, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int32())], ["sig", "node", "size"])

    for batch in batches:
        sig, node = batch.column("sig").to_numpy(), batch.column("node").to_numpy()
        if not len(sig):
            continue
        if held:
            sig = np.concatenate(([x for x, _ in held], sig))
            node = np.concatenate(([x for _, x in held], node))
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
        sig, node = sig[new], node[new]
        first = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        counts = np.diff(np.concatenate((first, [len(sig)])))
        big = counts > HEAVY
        if heavy is not None and sig[0] == heavy:
            big[0] = True
        # the last group may go on in the next batch
        tail = int(first[-1])
        if big[-1]:
            heavy = int(sig[-1])
            held = [(int(sig[-1]), int(node[-1]))]
            rest = len(sig) - 1
            counts[-1] -= 1
        else:
            held = list(zip(sig[tail:].tolist(), node[tail:].tolist(), strict=True))
            rest, counts, big = tail, counts[:-1], big[:-1]
        each, each_big = np.repeat(counts, counts), np.repeat(big, counts)
        keep = (each > 1) | each_big
        yield out(sig[:rest][keep], node[:rest][keep], np.where(each_big[keep], 3, 2))
    if held:
        alone = heavy is not None and held[0][0] == heavy
        if alone or len(held) > 1:
            yield out([s for s, _ in held], [x for _, x in held], [3 if alone else 2] * len(held))


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in slices(batch):
                sets, bounds = shingle_sets(data, offsets, n)
                node, _ = names(sets, bounds)
                blobs = [sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(blobs, pa.binary())], ["node", "shingles"])

    return run


def _compare(percent: int):
    """Of a bundle: the set of b (where a is null) against each a's set."""

    def run(table: pa.Table) -> pa.Table:
        a, b = table.column("a").to_pylist(), table.column("b")[0].as_py()
        blobs = table.column("shingles").to_pylist()
        centre = next((np.frombuffer(x, np.uint64) for i, x in zip(a, blobs, strict=True) if i is None), np.zeros(0, np.uint64))
        linked = []
        for i, blob in zip(a, blobs, strict=True):
            if i is not None:
                mine = np.frombuffer(blob, np.uint64)
                at = np.searchsorted(centre, mine)
                both = int((centre[np.minimum(at, len(centre) - 1)] == mine).sum())
                if 100 * both >= percent * (len(centre) + len(mine) - both):
                    linked.append(i)
        return pa.table({"a": pa.array(linked, pa.int64()), "b": pa.array([b] * len(linked), pa.int64())})

    return run


def _pairs_within(group: np.ndarray, component: np.ndarray, node: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Rows (a, b) of nodes of one group and different components that sizes and sketches allow to link. Rows are sorted by group; all groups advance together."""
    found = [np.zeros((0, 2), np.int64)]
    for step in range(1, len(group)):
        at = np.flatnonzero(group[step:] == group[:-step])
        if not len(at):
            break
        to = at + step
        ok = (component[at] != component[to]) & (100 * np.minimum(size[at], size[to]) >= percent * np.maximum(size[at], size[to]))
        at, to = at[ok], to[ok]
        ok = np.bitwise_count(bits[at] ^ bits[to]).sum(1) <= (size[at] + size[to]) * (100 - percent) // (100 + percent)
        at, to = at[ok], to[ok]
        found.append(np.stack((np.maximum(node[at], node[to]), np.minimum(node[at], node[to])), 1))
    return np.unique(np.concatenate(found), axis=0)


def _pairs_between(left: np.ndarray, right: np.ndarray, component: np.ndarray, node: np.ndarray, size: np.ndarray, bits: np.ndarray, percent: int, few: int) -> np.ndarray:
    """The same for two blocks of rows of one group. few: of each row that many at most, the nearest and then any."""
    found = [np.zeros((0, 2), np.int64)]
    for i in left.tolist():
        at = right[(component[right] != component[i]) & (100 * np.minimum(size[right], size[i]) >= percent * np.maximum(size[right], size[i]))]
        away = np.bitwise_count(bits[at] ^ bits[i]).sum(1)
        ok = away <= (size[at] + size[i]) * (100 - percent) // (100 + percent)
        at, away = at[ok], away[ok]
        if few and len(at) > few:
            spread = mix(node[at].view(np.uint64) ^ node[i : i + 1].view(np.uint64))
            at = np.union1d(at[np.argpartition(away, few // 2)[: few // 2]], at[np.argpartition(spread, few // 2)[: few // 2]])
        found.append(np.stack((np.maximum(node[at], node[i]), np.minimum(node[at], node[i])), 1))
    return np.unique(np.concatenate(found), axis=0)


def _across(percent: int, few: int):
    """Pairs across components, from rows sorted by sig, i, j; only one group is held beyond its batch. few: as in _pairs_between, and small groups wait."""

    def pairs(cols: list[np.ndarray]) -> pa.RecordBatch:
        sig, i, j, block, node, component, size, bits = cols
        new = np.concatenate(([True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        group = np.cumsum(new)
        counts = np.bincount(group)[group]
        small = np.flatnonzero(counts <= 2 * HEAVY)
        found = [_pairs_within(*(x[small] for x in (group, component, node, size, bits)), percent)] if not few else [np.zeros((0, 2), np.int64)]
        for g in np.unique(group[counts > 2 * HEAVY]):
            at = np.flatnonzero(group == g)
            left, right = at[block[at] == i[at[0]]], at[block[at] == j[at[0]]]
            found.append(_pairs_between(left, right, component, node, size, bits, percent, few))
        out = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("sig", "i", "j", "block", "node", "component", "n_shingles")]
            cols.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1]) & (cols[2] == cols[2][-1])
            cut = int(np.argmax(last))
            held = [x[cut:] for x in cols]
            if cut:
                yield pairs([x[:cut] for x in cols])
        if held is not None:
            yield pairs(held)

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches brought to the same small size."""
    for batch in batches:
        small = [folded(x.as_py(), SKETCH_BITS // 8).tobytes() for x in batch.column("sketch")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n_shingles"), pa.array(small, pa.binary())], ["node", "n_shingles", "sketch"])


def _may_link(percent: int):
    """Of pairs with both sizes and sketches, those that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.column("n").to_numpy(), batch.column("k").to_numpy()
            fits = 100 * np.minimum(n, k) >= percent * np.maximum(n, k)
            most = (n + k) * (100 - percent) // (100 + percent)
            x, y = batch.column("x"), batch.column("y")
            at = [i for i in np.flatnonzero(fits).tolist() if apart(x[i].as_py(), y[i].as_py()) <= most[i]]
            yield batch.select(["a", "b", "k"]).take(pa.array(at, pa.int64()))

    return run


class _Join:
    """One run over a table of documents."""

    def __init__(self, docs: DataFrame, n: int, percent: int):
        prepared(docs.sparkSession)
        self.n, self.percent = n, percent
        self.docs = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.profile = written(self.docs.mapInArrow(released(_profile(n)), f"doc_id {kind}, copy long, n_shingles long, node long, check long, sketch binary"), "profiles")

    def shared(self) -> DataFrame:
        """sig, node of all signatures that several classes share and that both need."""
        sizes = {r.n_shingles: r["count"] for r in self.profile.where("n_shingles > 0").groupBy("n_shingles").count().toLocalIterator()}
        uppers, levels = plan(sizes, self.percent)
        signed = self.docs.select("text").mapInArrow(released(_sign(self.n, uppers, levels, self.percent)), "sig long, node long")
        rows = written(signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(released(_shared), "sig long, node long, size int"), "shared")
        level = F.col("sig").bitwiseAND(LEVEL_MASK)
        slack = F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(levels) for x in (k, v.heavies if v else 0)]), level.cast("int"))
        weight = F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(levels) for x in (k, v.weight if v else 1)]), level.cast("int"))
        heavy = rows.where("size = 3")
        # a set has a bounded number of signatures at a level
        own = F.count("*").over(Window.partitionBy("node", level))
        kept = heavy.withColumn("n", own).where(F.col("n") * weight > slack).select("sig", "node")
        return written(rows.where("size = 2").select("sig", "node").unionByName(kept), "groups")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, k) of nodes whose sets link, by their sets."""
        pairs = written(pairs, "pairs")
        # a node with many partners goes in bundles, its own set with each; no partner is larger than k * 100 / percent
        size = F.col("n") * F.col("k") * (8 * 100 / self.percent)
        counts = pairs.groupBy("b").agg(F.count("*").alias("n"), F.first("k").alias("k")).select("b", "n", F.ceil(F.greatest(F.col("n") / BUNDLE, size / BUNDLE_BYTES)).alias("bundles"))
        dealt = written(join_by_counts(pairs, counts, ["b"]).select("a", "b", F.pmod(F.xxhash64("a"), "bundles").alias("bundle")), "bundles")
        none = F.lit(None).cast("long").alias("a")
        roles = dealt.select(F.col("a").alias("node"), "a", "b", "bundle").unionByName(dealt.select(F.col("b").alias("node"), none, "b", "bundle").distinct())
        wanted = roles.select("node").distinct()
        first = self.profile.join(wanted, "node").groupBy("node", "check").agg(F.min(F.struct("doc_id", "copy")).alias("r"))
        some = small_or_shuffled(written(first.select(F.col("r.doc_id").alias("doc_id"), F.col("r.copy").alias("copy")), "wanted"), BROADCAST_ROWS)
        held = self.docs.join(some, self.docs["doc_id"].eqNullSafe(some["doc_id"]) & (self.docs["copy"] == some["copy"]), "left_semi")
        sets = held.select("text").mapInArrow(released(_sets(self.n)), "node long, shingles binary")
        placed = sets.join(small_or_shuffled(written(roles, "roles"), BROADCAST_ROWS), "node").select("a", "b", "bundle", "shingles")
        return written(placed.groupBy("b", "bundle").applyInArrow(_compare(self.percent), "a long, b long").distinct(), "links")

    def _allowed(self, pairs: DataFrame, sized: DataFrame) -> DataFrame:
        """The pairs that sizes and whole sketches allow to link, with b's size as k."""
        x = sized.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("x"))
        y = sized.select(F.col("node").alias("b"), F.col("n_shingles").alias("k"), F.col("sketch").alias("y"))
        return pairs.join(x, "a").join(y, "b").mapInArrow(released(_may_link(self.percent)), "a long, b long, k long")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Links between classes that join all components, and the component of each linked class."""
        groups = self.shared()
        sized = self.profile.groupBy("node").agg(F.min("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"))
        sized = written(sized.join(groups.select("node").distinct(), "node"), "sized")
        ends = written(groups.groupBy("sig").agg(F.min("node").alias("end"), F.count("*").alias("n")), "ends")
        stars = join_by_counts(groups, ends, ["sig"]).where("node <> end").select(F.col("node").alias("a"), F.col("end").alias("b")).distinct()
        stars = written(stars, "stars")
        links = self.verified(self._allowed(stars, sized))
        found = components(links)
        small = written(sized.mapInArrow(released(_fold), "node long, n_shingles long, sketch binary"), "sketches")
        # in large groups a few partners of each set join most components; only what is left is paired in full
        for few in (FEW, 0):
            members = groups.join(found, "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"))
            several = members.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x <> y and n > 2").select("sig", "n")
            rows = members.join(several.where(F.col("n") > 2 * HEAVY) if few else several, "sig")
            if few:
                rows = written(rows, "large")
                if not rows.limit(1).count():
                    continue
                place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("sig"), "sig"))
                rows = rows.withColumn("place", place).where(F.col("place") <= few).drop("place")
            blocks = F.ceil(F.col("n") / BLOCK).cast("int")
            spread = rows.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
            spread = spread.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component").join(small, "node")
            dealt = spread.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
            more = dealt.mapInArrow(released(_across(self.percent, few)), "a long, b long").distinct().join(stars, ["a", "b"], "left_anti")
            more = written(more, "across")
            rest = self.verified(self._allowed(more, sized))
            stars = stars.unionByName(more)
            if rest.limit(1).count():
                links = links.unionByName(rest)
                found = components(links)
        return links, found


def _grouped(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, copy, n_shingles, group (null for empty sets) and first, the group's first row as (none, doc_id, copy)."""
    join = _Join(docs, n, percent)
    _, found = join.run()
    # one row of each class, then of each group, before anything is joined: copies meet as counts only
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")
    classes = join.profile.where("n_shingles > 0").groupBy("node").agg(F.count("*").alias("copies"), F.min(order).alias("first"))
    classes = written(classes.join(found, "node", "left").select("node", "copies", "first", F.coalesce("component", "node").alias("group")), "classes")
    groups = written(classes.groupBy("group").agg(F.min("first").alias("first"), F.count("*").alias("n")), "group-firsts")
    named = written(join_by_counts(classes.drop("first"), groups, ["group"]).select("node", F.col("copies").alias("n"), "group", "first"), "named")
    rows = join_by_counts(join.profile.where("n_shingles > 0").select("node", "doc_id", "copy", "n_shingles"), named, ["node"]).select("doc_id", "copy", "n_shingles", "group", "first")
    none = join.profile.where("n_shingles = 0").select("doc_id", "copy", "n_shingles", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("group", "first")])
    return rows.unionByName(none)


def jaccard_groups(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    rows = _grouped(docs, n, percent)
    return rows.select("doc_id", "n_shingles", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"))


def keep_first(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """docs with one row of each group, that with the smallest id; rows with empty sets all stay, and so do all columns, whatever their names."""
    groups = written(_grouped(docs, n, percent), "first-rows").where(F.col("group").isNotNull())
    rows = packed(docs, "doc_id", "text").withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("copy")))
    key = F.struct("doc_id", "copy").alias("row")
    gone = groups.where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy")))).select(key).distinct()
    left = rows.join(small_or_shuffled(gone, BROADCAST_ROWS), "row", "left_anti")
    repeated = groups.groupBy("doc_id", "copy").agg(F.count("*").alias("n")).where("n > 1").select(key)
    if repeated.limit(1).count():
        repeated = small_or_shuffled(repeated, BROADCAST_ROWS)
        left = left.join(repeated, "row", "left_anti").unionByName(left.join(repeated, "row", "left_semi").dropDuplicates(["row"]))
    return unpacked(left, docs.columns, ("doc_id", "text"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
