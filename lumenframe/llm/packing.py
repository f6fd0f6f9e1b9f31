"""Best-fit packing of token pieces into sequences by a grouping genetic algorithm.

Pieces are dealt by a hash to shards of a bounded number of pieces. Fewer bins are better, and of
as many bins those filled most unevenly, as their room then lies in few bins and the next level can
use it. A shard whose best fit leaves room in one bin only is done, as no packing is better. Every
other shard is evolved on several islands at once, each a task of its own: the first starts from
best fit, the others from best fit of their own random orders. After an epoch every island receives
its neighbour's elite (its best packing) and goes on, and the shard keeps the best. Islands breed
longer while bins can be saved (GENERATIONS) than for the room's sake alone (ROOM_GENERATIONS).
A packing is a partition of the pieces into bins. Crossover injects well-filled bins of one
parent whole into the other, drops the bins that hold a piece twice, and puts the displaced
pieces back by best fit. `packing_report` tells each shard's bins and room
before and after evolution, and its crossovers.

The least filled bins of each shard, a bounded number of pieces, are then packed again together
with those of other shards, level by level, so unfilled room doesn't add up with the shards.

Defined results: a null or empty text is the end id alone; documents longer than the capacity
are cut into pieces of the capacity, the last may be shorter; each row is one document, also
where ids repeat; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import prepared, released, written
from .textbatch import slices
from .token_store import with_end
from .tokens import tokenizer

CAPACITY = 4096
SHARD_PIECES = 4096
ISLANDS, EPOCHS, GENERATIONS, ROOM_GENERATIONS, POPULATION = 2, 2, 40, 6, 4
#: Of each shard, pieces of its least filled bins that are packed again with those of so many other shards.
LEFT_PIECES, MERGED = 64, 64
#: Chunks whose ids a worker keeps.
CACHE_CHUNKS = 1_000_000


def _cut(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = tokenizer(path, CACHE_CHUNKS)
        for batch in batches:
            for row, stop, data, offsets in slices(batch):
                ids, bounds = with_end(*machine.encode(data, offsets), end)
                raw = ids.astype("<u4").tobytes()
                size = np.diff(bounds)
                counts = -(-size // capacity)
                piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                start = piece * capacity
                length = np.minimum(np.repeat(size, counts) - start, capacity)
                at = (np.repeat(bounds[:-1], counts) + start).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at, length.tolist(), strict=True)]
                doc = pa.array(np.repeat(np.arange(row, stop), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(doc), batch.column("row").take(doc), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "row", "piece", "start", "length", "ids_crc32"],
                )

    return run


def pieces_of(docs: DataFrame, tokenizer_path: str, end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, row (any number for each document), piece, start, length, ids_crc32."""
    prepared(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(released(_cut(tokenizer_path, end, capacity)), f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: list[list[int]] | None = None) -> list[list[int]]:
    """bins, with the pieces of order each put where the least room is left, or in a new bin."""
    bins = [list(b) for b in bins or []]
    room = sorted((capacity - sum(sizes[i] for i in b), k) for k, b in enumerate(bins))
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left - sizes[i]:
            insort(room, (left - sizes[i], k))
    return bins


def _fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins filled as unevenly as can be."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Well-filled bins of a are injected whole into b; what they displace goes back by best fit."""
    fill = np.array([sum(sizes[i] for i in x) for x in a])
    ranked = np.argsort(-fill, kind="stable")[: max(1, len(a) * 3 // 4)]
    injected = [a[k] for k in rng.permutation(ranked)[: max(1, len(ranked) // 2)]]
    held = {i for x in injected for i in x}
    rest, loose = [], []
    for x in b:
        if held.isdisjoint(x):
            rest.append(x)
        else:
            loose += [i for i in x if i not in held]
    # the least filled of the remaining bins are opened too, so that room meets pieces again
    rest.sort(key=lambda x: -sum(sizes[i] for i in x))
    opened = max(1, len(rest) // 20)
    loose += [i for x in rest[len(rest) - opened :] for i in x] if rest else []
    return best_fit(sizes, sorted(loose, key=lambda i: -sizes[i]), capacity, injected + rest[: len(rest) - opened])


def _ideal(sizes: list[int], capacity: int) -> tuple[int, float]:
    """The fitness that no packing can pass: full bins, and the rest in one."""
    full, rest = divmod(sum(sizes), capacity)
    return full + (rest > 0), -(full + (rest / capacity) ** 2)


def bred(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION, room_generations: int = ROOM_GENERATIONS) -> tuple[list[list[int]], int]:
    """The best packing that the island finds, from the elites and best fit of noisy orders, and its number of crossovers."""
    least, best = _ideal(sizes, capacity)
    rng = np.random.default_rng(seed)
    score = lambda x: _fitness(x[1], sizes, capacity)
    # the first number keeps equal packings apart
    people = sorted(enumerate(elites), key=score)
    ideal = lambda: people and score(people[0]) <= (least, best + 1e-9)
    while len(people) < population and not ideal():
        noise = np.array(sizes) * rng.uniform(0.8, 1.2, len(sizes))
        people.append((len(people), best_fit(sizes, np.argsort(-noise, kind="stable").tolist(), capacity)))
        people.sort(key=score)
    crossed = 0
    while crossed < generations and not ideal() and (len(people[0][1]) > least or crossed < room_generations):
        a, b = sorted(rng.choice(len(people), 2, replace=False).tolist())
        crossed += 1
        people.append((population + crossed, crossover(people[a][1], people[b][1], sizes, capacity, rng)))
        people = sorted(people, key=score)[:population]
    return people[0][1], crossed


def evolve(sizes: list[int], capacity: int, seed: int, elites: list[list[list[int]]], generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    return bred(sizes, capacity, seed, elites, generations, population)[0]


def _first(capacity: int):
    """A shard by best fit decreasing, the bins that its lengths ask for at least, and whether no packing is better."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece"], kind="stable").reset_index(drop=True)
        sizes = rows["length"].tolist()
        bins = best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), capacity)
        where = np.zeros(len(rows), np.int64)
        for k, x in enumerate(bins):
            where[x] = k
        least, most = _ideal(sizes, capacity)
        n, uneven = _fitness(bins, sizes, capacity)
        return rows.assign(bin=where, n_bins=n, least=least, done=n <= least and uneven <= most + 1e-9)

    return run


def _island(capacity: int, epoch: int):
    """One epoch of one island: its pieces once for each elite that came to it. Only the first island begins with one."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["row", "piece", "origin"], kind="stable")
        own = rows.drop_duplicates(["row", "piece"])
        own = own[["shard", "island", "row", "piece", "length"]].reset_index(drop=True)
        sizes, elites = own["length"].tolist(), []
        if epoch or int(own["island"].iloc[0]) == 0:
            for _, part in rows.groupby("origin", sort=True):
                # every elite lists the same pieces, in the same order
                elites.append([list(x) for x in part.reset_index(drop=True).groupby("bin", sort=True).indices.values()])
        seed = (int(own["shard"].iloc[0]) * 1009 + int(own["island"].iloc[0])) * 31 + epoch
        bins, crossed = bred(sizes, capacity, seed, elites)
        where = np.zeros(len(own), np.int64)
        for k, x in enumerate(bins):
            where[x] = k
        n, uneven = _fitness(bins, sizes, capacity)
        return own.assign(bin=where, n_bins=n, uneven=uneven, crossed=int(rows["crossed"].max()) + crossed)

    return run


_FIRST = "shard long, row long, piece int, length long, bin long, n_bins long, least long, done boolean"
_ISLAND = "shard long, island int, row long, piece int, length long, bin long, n_bins long, uneven double, crossed long"


def _evolved(pieces: DataFrame, capacity: int) -> DataFrame:
    """shard, row, piece, length, bin, crossed: the best packing of each shard of (shard, row, piece, length), and the most crossovers on a line to it."""
    names = ["shard", "row", "piece", "length", "bin", "crossed"]
    first = written(pieces.groupBy("shard").applyInPandas(_first(capacity), _FIRST).withColumn("crossed", F.lit(0).cast("long")), "best-fit")
    left, done = first.where("not done"), first.where("done").select(names)
    if not left.limit(1).count():
        return done
    islands = F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island")
    state = left.select("shard", islands, "row", "piece", "length", F.lit(0).alias("origin"), "bin", "crossed")
    for epoch in range(EPOCHS):
        state = written(state.groupBy("shard", "island").applyInPandas(_island(capacity, epoch), _ISLAND), "islands")
        if epoch + 1 < EPOCHS:
            stay = state.select("shard", "island", "row", "piece", "length", F.lit(0).alias("origin"), "bin", "crossed")
            move = state.select("shard", ((F.col("island") + 1) % ISLANDS).cast("int").alias("island"), "row", "piece", "length", F.lit(1).alias("origin"), "bin", "crossed")
            state = stay.unionByName(move)
    best = state.groupBy("shard").agg(F.min(F.struct("n_bins", "uneven", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
    # one row for each shard that evolved
    return done.unionByName(state.join(best, ["shard", "island"]).select(names))


def packing_report(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """For each shard of the first level of pieces (row, piece, length): least (bins that its lengths ask for), best_fit and evolved (bins),
    open_before and open_after (bins with room), crossed (crossovers on a line to its packing)."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = written(pieces.select(F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"), "row", "piece", "length"), "dealt")
    first = dealt.groupBy("shard").applyInPandas(_first(capacity), _FIRST)
    bins = lambda df, *more: df.groupBy("shard", "bin").agg(F.sum("length").alias("fill"), *more)
    before = bins(first, F.max("least").alias("least")).groupBy("shard").agg(F.max("least").alias("least"), F.count("*").alias("best_fit"), F.count_if(F.col("fill") < capacity).alias("open_before"))
    after = bins(_evolved(dealt, capacity), F.max("crossed").alias("crossed")).groupBy("shard").agg(F.count("*").alias("evolved"), F.count_if(F.col("fill") < capacity).alias("open_after"), F.max("crossed").alias("crossed"))
    return before.join(after, "shard")


def _split_left(capacity: int):
    """Marks the pieces of a shard's least filled bins, up to LEFT_PIECES of them."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        by = rows.groupby("bin").agg(fill=("length", "sum"), n=("row", "size")).sort_values(["fill", "n"])
        some = by[(by["n"].cumsum() <= LEFT_PIECES) & (by["fill"] < 0.995 * capacity)].index
        return rows.assign(left=rows["bin"].isin(some))

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """row, piece, sequence_id, offset for pieces (row, piece, length)."""
    n = pieces.count()
    shards = max(1, -(-n // shard_pieces))
    level, todo, done = 0, pieces.select(F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"), "row", "piece", "length"), []
    while True:
        packed = _evolved(todo, capacity).drop("crossed")
        last = shards == 1
        if last:
            split = written(packed.withColumn("left", F.lit(False)), "packed")
        else:
            split = written(packed.groupBy("shard").applyInPandas(_split_left(capacity), "shard long, row long, piece int, length long, bin long, left boolean"), "packed")
        done.append(split.where("not left").withColumn("level", F.lit(level)))
        if last:
            break
        shards = -(-shards // MERGED)
        todo = split.where("left").select((F.col("shard") % shards).alias("shard"), "row", "piece", "length")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    # a bin has at most capacity pieces
    cells = out.groupBy("level", "shard", "bin").agg(F.array_sort(F.collect_list(F.struct("row", "piece", "length"))).alias("x"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all"))
    offsets = F.aggregate("x", zero, lambda a, p: F.struct((a["at"] + p["length"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    name = (F.col("level").cast("long") * (1 << 58)) + F.col("shard") * (1 << 20) + F.col("bin")
    return cells.select(name.alias("sequence_id"), F.explode(F.arrays_zip(F.col("x"), offsets.alias("offset"))).alias("y")).select("y.x.row", "y.x.piece", "sequence_id", "y.offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end: int = 1, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(pieces_of(docs, tokenizer_path, end, capacity), "pieces")
    places = pack(pieces.select("row", "piece", "length"), capacity, shard_pieces)
    return pieces.join(places, ["row", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_best_fit_packing(spark, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path or word_tokenizer())
