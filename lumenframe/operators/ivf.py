"""An inverted-list index for approximate nearest neighbours by cosine distance.

Centres are fitted on a bounded sample (`SAMPLE` vectors at most, those whose keys' hashes come
first); every row that has a vector goes to the list of its nearest centre, and lists are the
partitions of a stored table. A search reads the lists of its queries' nearest centres only, and
compares a row with the queries that probe its list. `knn.nearest_of_each` is the exact way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .knn import AT_ONCE, QUERY_BLOCK, _Nearest, ann_width, batch_type
from .kept import new_path

#: Vectors that the centres are fitted on, and lists at most.
SAMPLE, MOST_LISTS = 20_000, 4096


def list_count(rows: int) -> int:
    """The square root of the rows, within bounds."""
    return max(1, min(MOST_LISTS, math.isqrt(rows)))


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1.0)


def _vectors(column: pa.Array) -> np.ndarray:
    return _unit(np.stack(column.to_numpy(zero_copy_only=False)).astype(float))


def fit_centres(corpus: DataFrame, lists: int, rounds: int = 8, key: str = "photo", vector: str = "vector") -> np.ndarray:
    """Unit vectors: the first of the sample, moved to the mean direction of what is nearest to them in each round."""
    order = F.sha2(F.col(key).cast("string"), 256), F.col(key)
    held = corpus.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v")).orderBy(*order).limit(max(SAMPLE, lists) if rounds else lists)
    sample = [r.v for r in held.collect()]  # bounded by SAMPLE and MOST_LISTS
    if not sample:
        return np.zeros((0, 0))
    sample = _unit(np.array(sample, float))
    centres = sample[:lists].copy()
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        found = np.linalg.norm(sums, axis=1) > 0
        centres[found] = _unit(sums[found])
    return centres


@dataclass
class Index:
    """A stored index: its centres, and the table of key, v (unit vectors) and list, which the table is partitioned by."""

    centres: np.ndarray
    table: DataFrame
    key: str

    def probed(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The lists nearest to each vector, ties by number."""
        return np.argsort(-(vectors @ self.centres.T), axis=1, kind="stable")[:, :probes]


def build(corpus: DataFrame, lists: int | None = None, rounds: int = 8, key: str = "photo", vector: str = "vector", path: str | None = None) -> Index:
    """The index over all rows with a vector, written under path (a new folder of spark.checkpoint.dir without one)."""
    spark = corpus.sparkSession
    rows = corpus.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("v"))
    centres = fit_centres(corpus, lists or list_count(rows.count()), rounds, key, vector)
    held = spark.sparkContext.broadcast(centres)
    kind = rows.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _vectors(batch.column(1))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array((v @ held.value.T).argmax(1).astype(np.int32))], [key, "v", "list"])

    path = path or new_path(spark, "index")
    # rebalanced: small lists share tasks, and a list with many rows is split over several
    rows.mapInArrow(assign, f"{key} {kind}, v array<double>, list int").hint("rebalance", "list").write.partitionBy("list").parquet(path)
    table = spark.read.schema(f"{key} {kind}, v array<double>, list int").parquet(path)
    return Index(centres, table, key)


def search(index: Index, queries: DataFrame, k: int, probes: int, query_key: str = "query", vector: str = "vector", itself: bool = False) -> DataFrame:
    """query_key, key, distance, place (1 to k) for every row of queries.

    ann_width(k) candidates of each query are found first. The row whose key is the query's is
    removed from these, not from the search, so that the same lists are read either way.
    """
    key, spark = index.key, index.table.sparkSession
    kind, query_kind = index.table.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    schema, width = f"{query_key} {query_kind}, {key} {kind}, distance double", ann_width(k)

    def block(rows: list) -> DataFrame:
        vectors = _unit(np.array([r[1] for r in rows], float))
        lists = index.probed(vectors, probes)
        held = spark.sparkContext.broadcast(([r[0] for r in rows], vectors, lists))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, vectors, lists = held.value
            best: dict[int, list[tuple[np.ndarray, _Nearest]]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                of, v = batch.column(2).to_numpy(), np.stack(batch.column(1).to_numpy(zero_copy_only=False))
                for number in np.unique(of).tolist():
                    if number not in best:
                        mine = np.flatnonzero((lists == number).any(1))
                        best[number] = [(mine[i : i + AT_ONCE], _Nearest(vectors[mine[i : i + AT_ONCE]], width)) for i in range(0, len(mine), AT_ONCE)]
                    at = np.flatnonzero(of == number)
                    for _, part in best[number]:
                        part.add(batch.column(0).take(pa.array(at)), v[at], [])
            for parts in best.values():
                for mine, part in parts:
                    if part.keys is not None:
                        found = pa.array([names[i] for i in mine[part.query].tolist()], batch_type(query_kind))
                        yield pa.RecordBatch.from_arrays([found, part.keys, pa.array(part.distance)], [query_key, key, "distance"])

        some = index.table.where(F.col("list").isin(np.unique(lists).tolist()))
        return some.select(key, "v", "list").mapInArrow(run, schema)

    found, rows = None, []
    for r in queries.select(query_key, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            found, rows = block(rows) if found is None else found.unionByName(block(rows)), []
    if rows and index.centres.size:
        found = block(rows) if found is None else found.unionByName(block(rows))
    if found is None:
        return spark.createDataFrame([], f"{schema}, place int")
    order = Window.partitionBy(query_key).orderBy("distance", key)
    wide = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= width)
    if not itself:
        wide = wide.where(~F.col(key).eqNullSafe(F.col(query_key)))
    return wide.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def recall(found: DataFrame, exact: DataFrame, key: str = "photo", query_key: str = "query") -> DataFrame:
    """query_key, recall: the share of the exact neighbours that were found."""
    hit = found.select(query_key, key).distinct().withColumn("hit", F.lit(1))
    return exact.select(query_key, key).join(hit, [query_key, key], "left").groupBy(query_key).agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
