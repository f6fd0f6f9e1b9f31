"""Content-addressed store of token ids.

A document's ids, with an end id, are cut where a rolling hash of the last ids has its low bits
clear, so equal passages give equal chunks wherever they stand. The store has two tables:

    chunks   digest binary(32), n int, data binary     little-endian ids, 2 bytes each (4 where the vocabulary needs it)
    recipes  doc_id, row, part, start, n_tokens, width, root binary(32), digests array<binary>

Each distinct chunk is stored once, under the SHA-256 of its data. A recipe lists the digests of
a document's chunks in order, with the root of their Merkle tree; recipes are written in
ascending order of doc_id (part by part), and start counts the ids of all documents before. The
manifest holds a Merkle root over the documents' roots of each part. Reading back holds the
recipes against the manifest, hashes every chunk anew and compares the documents' roots. A chunk
that many documents share is joined by a broadcast (`join_by_counts`).

Defined results: a null or empty text is the end id alone; a null doc_id comes first; rows with
one doc_id are ordered by their place in the input; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import join_by_counts, prepared, released, shared_folder, written
from .textbatch import Grams, mix, slices
from .tokens import TOKEN_SLICE, tokenizer

ROLL, MASK, LEAST, MOST = 16, 0x1FF, 64, 4096
SEEN_DIGESTS = 1 << 20


def chunk_ends(ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
    """For each document the ends of its chunks, as places among all ids."""
    at = np.flatnonzero((Grams(mix(ids.astype(np.uint64) + np.uint64(1))).all(ROLL) & np.uint64(MASK)) == 0) + ROLL
    first = np.searchsorted(at, bounds[:-1] + ROLL)
    last = np.searchsorted(at, bounds[1:])
    cuts, out = at.tolist(), []
    for start, end, a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), first.tolist(), last.tolist(), strict=True):
        ends = []
        for cut in [*cuts[a:b], end]:
            while cut - start > MOST:
                start += MOST
                ends.append(start)
            if cut - start >= LEAST or cut == end > start:
                ends.append(cut)
                start = cut
        out.append(ends)
    return out


def with_end(ids: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with an end id after each document."""
    n = len(bounds) - 1
    out = np.insert(ids, bounds[1:], np.uint32(end)) if n else ids
    return out, bounds + np.arange(n + 1)


def merkle_root(digests: list[bytes]) -> bytes:
    level = list(digests) or [b""]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() for i in range(0, len(level), 2)]
    return level[0]


def _reversed_times(a: int, b: int) -> int:
    """Product of polynomials modulo that of CRC-32, bits reversed."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return out


@lru_cache(1 << 14)
def _shift(n_bytes: int) -> int:
    out, power, n = 1 << 31, 1 << 30, n_bytes * 8
    while n:
        if n & 1:
            out = _reversed_times(power, out)
        power = _reversed_times(power, power)
        n >>= 1
    return out


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of data laid end to end, from each part's CRC-32 and number of bytes."""
    out = 0
    for crc, n in parts:
        out = _reversed_times(_shift(n), out) ^ crc
    return out


def _cut(path: str, end: int, width: int):
    """A row for each chunk of each document. data is there only for chunks that are new to the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, seen = tokenizer(path), set()
        for batch in batches:
            for row, stop, data, offsets in slices(batch, limit=TOKEN_SLICE):
                ids, bounds = with_end(*machine.encode(data, offsets), end)
                if len(ids) and int(ids.max()) >> (8 * width):
                    raise OverflowError(f"id {ids.max()} doesn't fit into {width} bytes")
                ends = chunk_ends(ids, bounds)
                raw = ids.astype(f"<u{width}").tobytes()
                digests, sizes, blobs = [], [], []
                for start, cuts in zip(bounds.tolist(), ends, strict=False):
                    for cut in cuts:
                        blob = raw[start * width : cut * width]
                        digest = hashlib.sha256(blob).digest()
                        blobs.append(None if digest in seen else blob)
                        seen.add(digest)
                        digests.append(digest)
                        sizes.append(cut - start)
                        start = cut
                if len(seen) > SEEN_DIGESTS:
                    seen = set()
                counts = np.array([len(x) for x in ends])
                doc = pa.array(np.repeat(np.arange(row, stop), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), batch.column("row").take(doc), pa.array([i for n in counts for i in range(n)], pa.int32()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(blobs, pa.binary())],
                    ["doc_id", "row", "seq", "digest", "n", "data"],
                )

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunk rows of a partition, each digest's data once, and the reference rows without data."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, data = batch.column("digest").to_pylist(), batch.column("data")
        new = []
        for i, has in enumerate(data.is_valid().to_pylist()):
            if has and digests[i] not in seen:
                seen.add(digests[i])
                new.append(i)
        at = pa.array(new, pa.int64())
        blank = lambda n, kind: pa.nulls(n, kind)
        refs = [batch.column(c) for c in ("doc_id", "row", "seq", "digest", "n")] + [blank(len(digests), pa.binary()), pa.array(["refs"] * len(digests))]
        kept = [blank(len(new), batch.column("doc_id").type), blank(len(new), pa.int64()), blank(len(new), pa.int32()), batch.column("digest").take(at), batch.column("n").take(at), data.take(at), pa.array(["chunks"] * len(new))]
        names = ["doc_id", "row", "seq", "digest", "n", "data", "kind"]
        yield pa.RecordBatch.from_arrays(refs, names)
        yield pa.RecordBatch.from_arrays(kept, names)


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots = [merkle_root(x) for x in batch.column("digests").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], [*batch.schema.names, "root"])


def width_for(tokenizer_path: str, end: int) -> int:
    """Bytes of an id: 2 where all ids of the vocabulary and the end id fit, else 4."""
    most = max(end, *tokenizer(tokenizer_path).library.get_vocab().values())
    return 2 if most < 1 << 16 else 4


def manifest_of(recipes: DataFrame) -> DataFrame:
    """part, n_docs, root: the Merkle root of the documents' roots in each part of the recipes."""
    parts = recipes.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("start", "row", "root"))).alias("x")).select("part", F.size("x").cast("long").alias("n_docs"), F.col("x.root").alias("digests"))
    return parts.mapInArrow(released(_rooted), "part int, n_docs long, digests array<binary>, root binary").drop("digests")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end: int = 0, width: int | None = None) -> None:
    """Writes path/blocks (chunks and references), path/recipes and path/manifest. width: bytes of an id, by default those the vocabulary needs."""
    spark = prepared(docs.sparkSession)
    width = width or width_for(tokenizer_path, end)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    cut = rows.mapInArrow(released(_cut(tokenizer_path, end, width)), f"doc_id {kind}, row long, seq int, digest binary, n int, data binary")
    # data goes by its digest; references, of which one chunk may have any number, go anywhere
    spread = cut.repartition(F.when(F.col("data").isNull(), F.xxhash64("row", "seq")).otherwise(F.xxhash64("digest")))
    once = spread.mapInArrow(released(_once), f"doc_id {kind}, row long, seq int, digest binary, n int, data binary, kind string")
    once.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/blocks")
    refs = spark.read.schema(f"doc_id {kind}, row long, seq int, digest binary, n int, kind string").parquet(f"{path}/blocks").where("kind = 'refs'")
    recipes = refs.groupBy("doc_id", "row").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("seq", "digest"))).alias("x"))
    recipes = recipes.select("doc_id", "row", "n_tokens", F.lit(width).alias("width"), F.col("x.digest").alias("digests"))
    ordered = recipes.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(released(_rooted), T.StructType([*ordered.schema.fields, T.StructField("root", T.BinaryType())])).write.parquet(f"{path}/ordered")
    held = spark.read.parquet(f"{path}/ordered")
    totals = held.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    # one row for each partition, so never large
    held.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("start", F.col("inside") + F.col("before")).drop("inside", "before").write.parquet(f"{path}/recipes")
    manifest_of(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _summed(width: int):
    """Each chunk's digest, taken from its data, and the CRC-32 of its ids as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, crcs, sizes = [], [], []
            for blob in batch.column("data").to_pylist():
                ids = np.frombuffer(blob, f"<u{width}").astype("<u4")
                digests.append(hashlib.sha256(blob).digest())
                crcs.append(zlib.crc32(ids.tobytes()))
                sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, sizes = [], []
        for root, parts in zip(batch.column("root").to_pylist(), batch.column("parts").to_pylist(), strict=True):
            if any(p["n"] is None for p in parts) or merkle_root([p["digest"] for p in parts]) != root:
                raise ValueError("a document's chunks don't match its Merkle root")
            crcs.append(crc_joined([(p["crc"], 4 * p["n"]) for p in parts]))
            sizes.append(sum(p["n"] for p in parts))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _recipes(spark, path: str) -> tuple[DataFrame, int]:
    """The recipes, held against the manifest, and the bytes of an id."""
    recipes = spark.read.parquet(f"{path}/recipes")
    held = spark.read.parquet(f"{path}/manifest").select("part", F.struct("n_docs", "root").alias("held"))
    found = manifest_of(recipes).select("part", F.struct("n_docs", "root").alias("found"))
    if found.join(held, "part", "full").where(~F.col("found").eqNullSafe(F.col("held"))).limit(1).count():
        raise ValueError("the recipes don't match the manifest")
    first = recipes.select("width").first()
    return recipes, first.width if first else 2


def read_store(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, all from the files; a chunk or recipe that is missing or changed is an error."""
    recipes, width = _recipes(spark, path)
    kind = recipes.schema["doc_id"].dataType.simpleString()
    chunks = spark.read.schema("digest binary, n int, data binary, kind string").parquet(f"{path}/blocks").where("kind = 'chunks'")
    sums = chunks.select("data").mapInArrow(released(_summed(width)), "digest binary, n int, crc long").withColumnRenamed("n", "size")
    refs = recipes.select("doc_id", "row", "start", "root", F.posexplode("digests").alias("seq", "digest"))
    used = written(refs.groupBy("digest").agg(F.count("*").alias("n")).join(sums, "digest", "left"), "chunk-sums")
    joined = join_by_counts(refs, used, ["digest"]).groupBy("doc_id", "row", "start", "root").agg(F.array_sort(F.collect_list(F.struct("seq", "digest", F.col("size").alias("n"), "crc"))).alias("parts"))
    return joined.select("doc_id", "start", "root", "parts").mapInArrow(released(_verified), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def read_ids(spark, path: str) -> DataFrame:
    """doc_id, start, ids array<int>: the documents put together again from their chunks."""
    recipes, width = _recipes(spark, path)
    kind = recipes.schema["doc_id"].dataType.simpleString()
    chunks = spark.read.schema("digest binary, data binary, kind string").parquet(f"{path}/blocks").where("kind = 'chunks'")
    refs = recipes.select("doc_id", "row", "start", F.posexplode("digests").alias("seq", "digest"))
    used = refs.groupBy("digest").agg(F.count("*").alias("n")).join(chunks.select("digest", "data"), "digest")
    joined = join_by_counts(refs, written(used, "used-chunks"), ["digest"]).groupBy("doc_id", "row", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("x"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), f"<u{width}").astype(np.int32) for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return joined.select("doc_id", "start", F.col("x.data").alias("data")).mapInArrow(released(join), f"doc_id {kind}, start long, ids array<int>")


def op5_token_store(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    path = shared_folder(spark, "token-store")
    write_store(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path, tokenizer_path)
    return read_store(spark, path)
