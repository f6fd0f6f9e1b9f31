"""Incremental line dedup: exact reference counts per line key, with sharded cuckoo filters before them.

The table of reference counts holds, for each key, in how many documents it is found; it is the
truth, and adding or removing documents adds or subtracts counts, so every step can be undone.
Cuckoo filters over the keys at or above the limit, one per shard of the key space, are looked
up first for each line; what they let through is checked against the table. Crossing the limit
inserts a key into its shard's filter or deletes it.

A line's key is the line without space at both ends, A-Z lower-cased, held as a 128-bit hash.
Defined results: a null or empty text is one empty line; keys of fewer code points than
min_chars are never dropped; each row is one document, also where ids repeat; a document that
loses all its lines has an empty text; other columns are kept or ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import packed, prepared, released, semi_by_counts, unpacked, written
from .textbatch import LOWER, lines, slices, stripped, texts_of

SLOTS = 4
SHARD_KEYS = 1 << 16
#: Keys at the limit up to which they and their filters go to every task (16 bytes each, and 2 to 5 of filter).
BROADCAST_KEYS = 1_000_000
#: Keys at the limit up to which the filters alone go to every task: at most 128 MB.
FILTER_KEYS = 25_000_000


def _pairs(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)


def shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return (pairs[:, 0] >> np.uint64(33)).astype(np.int64) % shards


class CuckooFilter:
    """Fingerprints of 16 bits, four to a bucket, each in one of two buckets."""

    def __init__(self, keys: int = 0, table: np.ndarray | None = None):
        size = 1
        while size * SLOTS * 0.85 < keys:
            size *= 2
        self.table = np.zeros((size, SLOTS), np.uint16) if table is None else table

    @classmethod
    def of(cls, pairs: np.ndarray) -> CuckooFilter:
        room = len(pairs)
        while True:
            made = cls(room)
            if all(made.insert(i, p) for i, p in zip(*(x.tolist() for x in made._first(pairs)), strict=True)):
                return made
            room = int(max(room, 4) * 1.5)

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(table=np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _first(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = (pairs[:, 1] & np.uint64(0xFFFF)).astype(np.int64)
        prints[prints == 0] = 1
        return (pairs[:, 0] & np.uint64(len(self.table) - 1)).astype(np.int64), prints

    def _other(self, bucket, prints):
        return bucket ^ ((prints * 0x5BD1E995) & (len(self.table) - 1))

    def insert(self, bucket: int, fingerprint: int) -> bool:
        for at in (bucket, self._other(bucket, fingerprint)):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fingerprint
                return True
        for step in range(500):
            slot = (fingerprint + step) % SLOTS
            fingerprint, self.table[at, slot] = int(self.table[at, slot]), fingerprint
            at = self._other(at, fingerprint)
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = fingerprint
                return True
        return False

    def delete(self, bucket: int, fingerprint: int) -> bool:
        for at in (bucket, self._other(bucket, fingerprint)):
            held = np.flatnonzero(self.table[at] == fingerprint)
            if len(held):
                self.table[at, held[0]] = 0
                return True
        return False

    def contains(self, pairs: np.ndarray) -> np.ndarray:
        bucket, prints = self._first(pairs)
        want = prints[:, None].astype(np.uint16)
        return (self.table[bucket] == want).any(1) | (self.table[self._other(bucket, prints)] == want).any(1)


def _keyed(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Line starts, ends and bounds, and the key of each line (None where it is too short)."""
    starts, ends, bounds = lines(data, offsets)
    first, last = stripped(data, starts, ends)
    raw = LOWER[data].tobytes()
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80))) if min_chars > 1 else None
    long = last > first if points is None else points[last] - points[first] >= min_chars
    digest = xxhash.xxh3_128_digest
    keys = [digest(raw[s:e]) if ok else None for s, e, ok in zip(first.tolist(), last.tolist(), long.tolist(), strict=True)]
    return starts, ends, bounds, keys


def count_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The reference counts: key binary(16), n_docs long."""
    prepared(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for _, _, data, offsets in slices(batch):
                _, _, bounds, keys = _keyed(data, offsets, min_chars)
                at = bounds.tolist()
                for a, b in zip(at, at[1:], strict=False):
                    found.update(set(keys[a:b]))
            found.pop(None, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["key", "n_docs"])

    return docs.select("text").mapInArrow(released(count), "key binary, n_docs long").groupBy("key").agg(F.sum("n_docs").alias("n_docs"))


def changed(table: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, min_chars: int = 1) -> DataFrame:
    """The reference counts after documents came or went; keys that no document holds are gone."""
    parts = table.select("key", "n_docs")
    if added is not None:
        parts = parts.unionByName(count_lines(added, min_chars))
    if removed is not None:
        parts = parts.unionByName(count_lines(removed, min_chars).withColumn("n_docs", -F.col("n_docs")))
    return parts.groupBy("key").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


def _shard(shards: int):
    """shard_of as a column: from bytes 5 to 8 of the key, the high half of its first little-endian integer."""
    high = F.concat(*[F.hex(F.substring("key", i, 1)) for i in (8, 7, 6, 5)])
    return (F.shiftright(F.conv(high, 16, 10).cast("long"), 1) % shards).cast("int")


def build_filters(table: DataFrame, min_docs: int = 10, shards: int = 1) -> DataFrame:
    """shard int, cuckoo binary: a filter over the keys of each shard that reach the limit."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        pairs = _pairs(rows["key"])
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "cuckoo": [CuckooFilter.of(pairs).dump()]})

    return table.where(F.col("n_docs") >= min_docs).select("key", _shard(shards).alias("shard")).groupBy("shard").applyInPandas(build, "shard int, cuckoo binary")


def update_filters(filters: DataFrame, before: DataFrame, after: DataFrame, min_docs: int = 10, shards: int = 1) -> DataFrame:
    """The filters after keys crossed the limit: those that rose to it are inserted, those that fell below are deleted. A filter that gets full is built anew from the counts."""
    old = before.where(F.col("n_docs") >= min_docs).select("key")
    new = after.where(F.col("n_docs") >= min_docs).select("key")
    moves = new.join(old, "key", "left_anti").withColumn("come", F.lit(True)).unionByName(old.join(new, "key", "left_anti").withColumn("come", F.lit(False)))
    moves = moves.withColumn("shard", _shard(shards))

    def update(have: pd.DataFrame, move: pd.DataFrame) -> pd.DataFrame:
        shard = int((have if len(have) else move)["shard"].iloc[0])
        held = CuckooFilter.load(have["cuckoo"].iloc[0]) if len(have) else CuckooFilter(len(move))
        # deletions first, as they make room
        for key, come in sorted(zip(move["key"], move["come"], strict=True), key=lambda x: x[1]):
            bucket, prints = (int(x[0]) for x in held._first(_pairs([key])))
            if not come:
                held.delete(bucket, prints)
            elif not held.insert(bucket, prints):
                return pd.DataFrame({"shard": [shard], "cuckoo": [None]})
        return pd.DataFrame({"shard": [shard], "cuckoo": [held.dump()]})

    made = written(filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(update, "shard int, cuckoo binary"), "filters")
    full = made.where("cuckoo is null").select("shard")
    if not full.limit(1).count():
        return made
    again = after.withColumn("shard", _shard(shards)).join(F.broadcast(full), "shard", "left_semi")  # a row for each shard
    return made.where("cuckoo is not null").unionByName(build_filters(again, min_docs, shards))


class LineStore:
    """Reference counts and filters of a collection that documents join and leave."""

    def __init__(self, docs: DataFrame, min_docs: int = 10, min_chars: int = 1):
        self.min_docs, self.min_chars = min_docs, min_chars
        self.table = written(count_lines(docs, min_chars), "line-counts")
        self.shards = max(1, self.often().count() // SHARD_KEYS)
        self.filters = written(build_filters(self.table, min_docs, self.shards), "filters")

    def often(self) -> DataFrame:
        return self.table.where(F.col("n_docs") >= self.min_docs)

    def change(self, added: DataFrame | None = None, removed: DataFrame | None = None) -> None:
        """Documents come and go; the counts and filters are then those of the collection as it is."""
        after = written(changed(self.table, added, removed, self.min_chars), "line-counts")
        self.filters = update_filters(self.filters, self.table, after, self.min_docs, self.shards)
        self.table = after


def _through(pairs: np.ndarray, filters: dict[int, CuckooFilter], shards: int) -> np.ndarray:
    shard = shard_of(pairs, shards)
    out = np.zeros(len(pairs), bool)
    for s in np.unique(shard):
        if int(s) in filters:
            at = np.flatnonzero(shard == s)
            out[at] = filters[int(s)].contains(pairs[at])
    return out


def _dropped(keys: list, filters: dict[int, CuckooFilter], shards: int, table: set[bytes]) -> np.ndarray:
    """Which lines go: the filter's yes, confirmed by the table."""
    some = np.flatnonzero([k is not None for k in keys])
    out = np.zeros(len(keys), bool)
    if len(some) and filters:
        maybe = some[_through(_pairs([keys[i] for i in some]), filters, shards)]
        out[maybe] = [keys[i] in table for i in maybe]
    return out


def _kept(batch: pa.RecordBatch, drop) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """First row, end row, line counts, dropped counts, kept texts. drop(keys, bounds, row) tells which lines go."""
    for row, end, data, offsets in slices(batch):
        starts, ends, bounds, keys = _keyed(data, offsets, drop.min_chars)
        gone = drop(keys, bounds, row)
        n_dropped = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds])
        raw, where, at = data.tobytes(), offsets.tolist(), bounds.tolist()
        texts = []
        for d in range(end - row):
            if n_dropped[d]:
                texts.append(b"\n".join([raw[starts[i] : ends[i]] for i in range(at[d], at[d + 1]) if not gone[i]]))
            else:
                texts.append(raw[where[d] : where[d + 1]])
        yield row, end, np.diff(bounds), n_dropped, texts


class _ByTable:
    """Drops by filters and table that every task holds."""

    def __init__(self, held, min_chars: int):
        self.held, self.min_chars, self.ready = held, min_chars, None

    def __call__(self, keys, bounds, row):
        if self.ready is None:
            filters, shards, table = self.held.value
            self.ready = {s: CuckooFilter.load(x) for s, x in filters.items()}, shards, table
        return _dropped(keys, *self.ready)


class _ByMarks:
    """Drops the keys that a column lists for each document."""

    def __init__(self, marks: list, min_chars: int):
        self.marks, self.min_chars = marks, min_chars

    def __call__(self, keys, bounds, row):
        out = np.zeros(len(keys), bool)
        for d in range(len(bounds) - 1):
            if self.marks[row + d]:
                table = set(self.marks[row + d])
                out[bounds[d] : bounds[d + 1]] = [k in table for k in keys[bounds[d] : bounds[d + 1]]]
        return out


def _results(batch: pa.RecordBatch, drop) -> Iterator[pa.RecordBatch]:
    for row, end, n_lines, n_dropped, texts in _kept(batch, drop):
        part = batch.slice(row, end - row)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("rest"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), texts_of(texts)], ["doc_id", "rest", "n_lines", "n_dropped", "kept"])


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, store: LineStore | None = None, broadcast_keys: int = BROADCAST_KEYS, filter_keys: int = FILTER_KEYS) -> DataFrame:
    """docs without text, with _n_lines, _n_dropped and _text (what is left), in place of columns of those names.

    store: counts and filters to use instead of those of docs. Up to broadcast_keys keys at the
    limit go to the tasks with their filters, and texts aren't shuffled. Up to filter_keys the
    filters alone go to the tasks, the lines that pass are joined with the table, and the marks
    with the documents. Beyond that all lines are joined with the table.
    """
    spark = prepared(docs.sparkSession)
    store = store or LineStore(docs, min_docs, min_chars)
    min_docs, min_chars, shards = store.min_docs, store.min_chars, store.shards
    often = written(store.often(), "frequent-lines")
    n = often.count()
    columns = [c for c in docs.columns if c != "text"]
    docs = packed(docs, "doc_id", "text")
    schema = docs.select("doc_id", "rest").schema.add("n_lines", "long").add("n_dropped", "long").add("kept", "string")
    named = lambda out: unpacked(out, columns, ("doc_id",), _n_lines=F.col("n_lines"), _n_dropped=F.col("n_dropped"), _text=F.col("kept"))
    filters = None
    if n <= max(broadcast_keys, filter_keys):
        # 2 to 5 bytes for each key, with a bound on keys
        filters = {r.shard: bytes(r.cuckoo) for r in store.filters.toLocalIterator()}
    if n <= broadcast_keys:
        held = spark.sparkContext.broadcast((filters, shards, {bytes(r.key) for r in often.select("key").toLocalIterator()}))
        drop = _ByTable(held, min_chars)
        return named(docs.mapInArrow(released(lambda batches: (out for batch in batches for out in _results(batch, drop))), schema))
    held = spark.sparkContext.broadcast(filters)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = None if held.value is None else {s: CuckooFilter.load(x) for s, x in held.value.items()}
        for batch in batches:
            for row, end, data, offsets in slices(batch):
                _, _, bounds, keys = _keyed(data, offsets, min_chars)
                found = sorted({(d, k) for d in range(end - row) for k in keys[bounds[d] : bounds[d + 1]] if k is not None})
                if ready is not None and found:
                    may = _through(_pairs([k for _, k in found]), ready, shards)
                    found = [x for x, ok in zip(found, may, strict=True) if ok]
                yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array([row + d for d, _ in found], pa.int64())), pa.array([k for _, k in found], pa.binary())], ["row", "key"])

    rows = docs.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("copy")))
    found = written(rows.select("row", "text").mapInArrow(released(keys_of), f"row {rows.schema['row'].dataType.simpleString()}, key binary"), "found-lines")
    confirmed = semi_by_counts(found, often.select("key", F.col("n_docs").alias("n")), ["key"])
    marks = confirmed.groupBy("row").agg(F.collect_set("key").alias("marks"))
    joined = rows.join(marks, "row", "left").drop("row")
    return named(joined.mapInArrow(released(lambda batches: (out for batch in batches for out in _results(batch, _ByMarks(batch.column("marks").to_pylist(), min_chars)))), schema))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """The collection arrives in two deliveries, the second of which takes a quarter of the first back and delivers it anew: counts and filters see insertions and deletions, and all documents are in at the end."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    quarter = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(4)), F.lit(0))
    store = LineStore(docs.where(quarter < 3))
    store.change(removed=docs.where(quarter == 2))
    store.change(added=docs.where(quarter >= 2))
    out = dedup_lines(docs, store=store)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_text", 256).alias("kept_sha256"))
