"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items, lower-cased and cut into words, make one automaton per block of a bounded size.
A document's words stream through it; the longest match that ends at each word tells which
windows of the items occur there. Blocks of a larger benchmark are streamed one after the
other and their findings joined by document, so no automaton outgrows a task.

Defined results: a null or empty text has no words and no hits; an item without words is
ignored; items of fewer words than a window count as one window; repeated item rows with one
item_id are one item; a null item_id counts as the string "null"; repeated document rows give
repeated results; other columns of either table are ignored.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import packed, prepared, released, unpacked
from .textbatch import ALNUM, LOWER, Grams, slices, span_hashes, words

BLOCK_BYTES = 8 << 20
PROBE = 4


def item_words(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


class Automaton:
    """Generalised suffix automaton over words. State 0 is the empty match.

    Words are numbers. A state's first edge lies in two flat arrays and only further ones in a
    dictionary, as nearly all states have one edge; owners of windows are numbers likewise.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.word, self.to, self.more = array("i", [-1]), array("i", [-1]), {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        items = [(name, w) for name, w in items if w]
        for _, w in items:
            last = 0
            for word in w:
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
        #: States above which a match holds a whole window, and the item that owns it; several owners are a set.
        self.names: list[str] = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        self.owner, self.owners = array("i", [-1]) * len(self.link), {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        by_length = sorted(range(1, len(self.link)), key=self.length.__getitem__)
        self._at_window = self._lifted(by_length)
        for name, w in items:
            state, mine = 0, number[name]
            for i, word in enumerate(w):
                state = self.step(state, self.ids[word])
                if i + 1 >= window:
                    at = self._at_window[state]
                    if self.owner[at] < 0:
                        self.owner[at] = mine
                    elif self.owner[at] != mine:
                        self.owners.setdefault(at, {self.owner[at]}).add(mine)
            if len(w) < window:
                self.short.setdefault(state, []).append((len(w), name))
        self._short_link = self._chain(by_length)
        self._grams(items)

    def step(self, state: int, word: int) -> int:
        """The state that the word leads to, -1 if none."""
        if self.word[state] == word:
            return self.to[state]
        further = self.more.get(state)
        return further.get(word, -1) if further else -1

    def _put(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _new(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, word: int) -> int:
        link, length = self.link, self.length
        q = self.step(last, word)
        if q >= 0:
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        made = self._new(length[last] + 1, 0)
        p = last
        while p >= 0 and self.step(p, word) < 0:
            self._put(p, word, made)
            p = link[p]
        if p >= 0:
            q = self.step(p, word)
            link[made] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return made

    def _clone(self, p: int, word: int, q: int) -> int:
        made = self._new(self.length[p] + 1, self.link[q])
        self.word[made], self.to[made] = self.word[q], self.to[q]
        if q in self.more:
            self.more[made] = dict(self.more[q])
        self.link[q] = made
        while p >= 0 and self.step(p, word) == q:
            self._put(p, word, made)
            p = self.link[p]
        return made

    def _lifted(self, by_length: list[int]) -> array:
        """For each state the ancestor whose strings include those of exactly one window, or 0."""
        at = array("i", [0]) * len(self.link)
        for s in by_length:
            if self.length[s] >= self.window:
                at[s] = s if self.length[self.link[s]] < self.window else at[self.link[s]]
        return at

    def _chain(self, by_length: list[int]) -> array:
        """The nearest state, itself included, that ends a short item; 0 if none does."""
        near = array("i", [0]) * len(self.link)
        for s in by_length:
            near[s] = s if s in self.short else near[self.link[s]]
        return near

    def _grams(self, items: list[tuple[str, list[bytes]]]) -> None:
        """Hashes of the runs of words without which no window can occur, by their length."""
        found: dict[int, list[np.ndarray]] = {}
        for _, w in items:
            ends = np.cumsum([len(x) for x in w])
            hashes = Grams(span_hashes(np.frombuffer(b"".join(w), np.uint8), np.concatenate(([0], ends[:-1])), ends))
            k = min(PROBE, len(w))
            found.setdefault(k, []).append(hashes.all(k))
        self.grams = {}
        for k, parts in found.items():
            keys = np.unique(np.concatenate(parts))
            bits = max(16, int(math.log2(len(keys))) + 5)
            table = np.zeros(1 << bits, bool)
            table[keys >> np.uint64(64 - bits)] = True
            self.grams[k] = (keys, table, np.uint64(64 - bits))

    def live(self, hashes: Grams, n: int, bounds: np.ndarray) -> np.ndarray:
        """Bounds of the runs of words, none across two texts, that may hold a window."""
        delta = np.zeros(n + 1, np.int32)
        for k, (keys, table, shift) in self.grams.items():
            grams = hashes.all(k)
            at = np.flatnonzero(table[grams >> shift])
            at = at[keys[np.minimum(np.searchsorted(keys, grams[at]), len(keys) - 1)] == grams[at]]
            text = np.searchsorted(bounds, at, "right") - 1
            at = at[at + k <= bounds[text + 1]]
            np.add.at(delta, at, 1)
            np.add.at(delta, at + k, -1)
        on = np.cumsum(delta[:n]) > 0
        edge = np.diff(np.concatenate(([0], on.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        cuts = bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        cuts = cuts[on[cuts] & on[cuts - 1]] if len(cuts) else cuts
        return np.stack((np.sort(np.concatenate((starts, cuts))), np.sort(np.concatenate((ends, cuts)))), 1)

    def stream(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans of words inside windows, and the items that own them."""
        link, length, window, step, ids = self.link, self.length, self.window, self.step, self.ids
        spans: list[tuple[int, int]] = []
        names: set[str] = set()
        state = matched = 0
        for i, token in enumerate(tokens, 1):
            word = ids.get(token)
            if word is None:
                state = matched = 0
                continue
            to = step(state, word)
            while state and to < 0:
                state = link[state]
                matched = length[state]
                to = step(state, word)
            if to < 0:
                state = matched = 0
                continue
            state = to
            matched += 1
            longest = 0
            if matched >= window:
                longest = window
                at = self._at_window[state]
                if at in self.owners:
                    names.update(self.names[k] for k in self.owners[at])
                elif self.owner[at] >= 0:
                    names.add(self.names[self.owner[at]])
            at = self._short_link[state]
            while at:
                for k, name in self.short[at]:
                    if k <= matched:
                        longest = max(longest, k)
                        names.add(name)
                at = self._short_link[link[at]]
            if longest:
                start = i - longest
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i))
        return spans, names


FOUND = "doc_id {id}, copy long, n_words long, spans array<struct<s: long, e: long>>, items array<string>"


def _matches(machine: Automaton, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, list[list], list[set]]]:
    """First row, end row, word counts, spans and items of each slice of a batch."""
    for row, end, data, offsets in slices(batch):
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets, ALNUM)
        runs = machine.live(Grams(span_hashes(data, starts, ends)), len(starts), bounds)
        spans: list[list] = [[] for _ in range(end - row)]
        items: list[set] = [set() for _ in range(end - row)]
        text = np.searchsorted(bounds, runs[:, 0], "right") - 1
        raw = data.tobytes() if len(runs) else b""
        for d, (a, b) in zip(text.tolist(), runs.tolist(), strict=True):
            tokens = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            hit, names = machine.stream(tokens)
            shift = a - int(bounds[d])
            spans[d] += [(s + shift, e + shift) for s, e in hit]
            items[d] |= names
        yield row, end, np.diff(bounds), spans, items


def _scan(automaton, only_hits: bool):
    """Rows of FOUND for each document of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, n_words, spans, items in _matches(automaton.value, batch):
                at = np.flatnonzero([bool(x) for x in spans]) if only_hits else np.arange(end - row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, end - row).take(pa.array(at)),
                        batch.column("copy").slice(row, end - row).take(pa.array(at)),
                        pa.array(n_words[at], pa.int64()),
                        pa.array([[{"s": s, "e": e} for s, e in spans[i]] for i in at], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))),
                        pa.array([sorted(items[i]) for i in at], pa.list_(pa.string())),
                    ],
                    ["doc_id", "copy", "n_words", "spans", "items"],
                )

    return run


def _filter(automaton, coverage: int):
    """The rows of a batch that aren't contaminated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, n_words, spans, _ in _matches(automaton.value, batch):
                n_hit = np.array([sum(e - s for s, e in x) for x in spans])
                yield batch.slice(row, end - row).filter(pa.array((n_hit == 0) | (coverage * n_hit < n_words)))

    return run


def _blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator:
    """A broadcast automaton for each block of about block_bytes of items."""
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        mine = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        items = [(r.item_id, item_words(r.text)) for r in mine.toLocalIterator()]
        yield benchmark.sparkSession.sparkContext.broadcast(Automaton(items, window))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, spans (word ranges inside item windows), items (their ids), n_hit.

    The benchmark is read to the driver in blocks of about block_bytes, never whole. With one
    block nothing is shuffled; with more, only documents that have hits are.
    """
    prepared(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"), "text")
    machines = _blocks(benchmark, window, block_bytes)
    found = [rows.mapInArrow(released(_scan(machine, b > 0)), FOUND.format(id=kind)) for b, machine in enumerate(machines)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    if len(found) > 1:
        first = found[0].groupBy("doc_id", "copy", "n_words").agg(F.count("*").alias("rows"))
        hits = out.where(F.size("spans") > 0).groupBy("doc_id", "copy").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        same = first["doc_id"].eqNullSafe(hits["doc_id"]) & (first["copy"] == hits["copy"])
        out = first.join(hits, same, "left").select(first["doc_id"], "n_words", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_"), F.coalesce("spans", F.array().cast("array<struct<s: long, e: long>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).drop("_")
    hit = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")),
        lambda a: a["n"],
    )
    return out.select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"), hit.alias("n_hit"))


def contaminated(coverage: int = 20):
    """A document is contaminated if hits cover at least one word in so many."""
    return (F.col("n_hit") > 0) & (F.lit(coverage) * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the contaminated ones; all columns and all other rows stay as they are.

    With one block of items each task filters its own rows. With more, a document's hits are
    known only after all blocks, so its id and text hash are joined back.
    """
    prepared(docs.sparkSession)
    machines = list(_blocks(benchmark, window, block_bytes))
    if len(machines) == 1:
        return docs.mapInArrow(released(_filter(machines[0], coverage)), docs.schema)
    marked = packed(docs, "doc_id", "text").withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("copy")))
    judged = find_contamination(marked.select(F.col("row").alias("doc_id"), "text"), benchmark, window, block_bytes)
    bad = judged.where(contaminated(coverage)).select(F.col("doc_id").alias("row")).distinct()
    return unpacked(marked.join(bad, "row", "left_anti"), docs.columns, ("doc_id", "text"))


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs, bench)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))
