"""Exact nearest neighbours by cosine distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.vectors import dot_with, norm

#: Query vectors that one scan of the corpus answers (32 MB at 512 numbers), and those that are multiplied at once.
QUERY_BLOCK, AT_ONCE = 8192, 512


def nearest(corpus: DataFrame, query: list[float], k: int, exclude: list, key: str = "photo", vector: str = "vector") -> DataFrame:
    """The k rows nearest to one literal vector: key, distance. Ties go by key; rows whose key is null stay candidates.

    exclude has no default: leaving a held-out photo in would let it find itself.
    """
    q = np.array(query, float)
    size = float(np.linalg.norm(q))
    q = (q / size if size > 0 else q).tolist()
    rows = corpus.where(F.col(vector).isNotNull())
    if exclude:
        rows = rows.where(~F.coalesce(F.col(key).isin(exclude), F.lit(False)))
    v = F.col(vector).cast("array<double>")
    length = norm(v)
    distance = F.lit(1.0) - F.when(length > 0, dot_with(v, q) / length).otherwise(0.0)
    return rows.select(key, distance.alias("distance")).orderBy("distance", key).limit(max(0, k))


def nearest_of_each(corpus: DataFrame, queries: DataFrame, k: int, key: str = "photo", vector: str = "vector", query_key: str = "query", itself: bool = False) -> DataFrame:
    """query_key, key, distance, place (1 to k) for every row of queries (query_key, vector).

    Queries pass in blocks of QUERY_BLOCK; each task multiplies its rows with a block and holds
    the k nearest of each query so far, so what is shuffled is k rows for each query and task, not
    all pairs. itself: keep the row whose key is the query's.
    """
    spark = corpus.sparkSession
    kind, query_kind = corpus.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    parts: list[DataFrame] = []
    block: list[tuple] = []

    def search(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = held.value
            best = [_Nearest(q[i : i + AT_ONCE], k) for i in range(0, len(q), AT_ONCE)]
            own = {name: j for j, name in enumerate(names)}
            for batch in batches:
                if not batch.num_rows:
                    continue
                v = np.stack(batch.column(1).to_numpy(zero_copy_only=False)).astype(float)
                size = np.linalg.norm(v, axis=1, keepdims=True)
                v /= np.where(size > 0, size, 1.0)
                skip = [] if itself else [(i, own[x]) for i, x in enumerate(batch.column(0).to_pylist()) if x in own]
                for j, part in enumerate(best):
                    part.add(batch.column(0), v, [(i, n - j * AT_ONCE) for i, n in skip if 0 <= n - j * AT_ONCE < AT_ONCE])
            for j, part in enumerate(best):
                if part.keys is not None:
                    queries = pa.array([names[j * AT_ONCE + i] for i in part.query.tolist()], batch_type(query_kind))
                    yield pa.RecordBatch.from_arrays([queries, part.keys, pa.array(part.distance)], [query_key, key, "distance"])

        return corpus.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"{query_key} {query_kind}, {key} {kind}, distance double")

    def flush() -> None:
        q = np.array([x[1] for x in block], float)
        size = np.linalg.norm(q, axis=1, keepdims=True)
        parts.append(search(spark.sparkContext.broadcast(([x[0] for x in block], q / np.where(size > 0, size, 1.0)))))
        block.clear()

    for r in queries.select(query_key, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull()).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == QUERY_BLOCK:
            flush()
    if block or not parts:
        if not block:
            return spark.createDataFrame([], f"{query_key} {query_kind}, {key} {kind}, distance double, place int")
        flush()
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    place = F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key))
    return found.withColumn("place", place).where(F.col("place") <= k)


class _Nearest:
    """The k nearest rows so far of each of some unit query vectors, ties by key, null keys first."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.bound = np.full(len(queries), np.inf)
        self.query, self.distance, self.keys = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, keys: pa.Array, rows: np.ndarray, skip: list[tuple[int, int]]) -> None:
        """rows: unit vectors; skip: (row, query) pairs that don't count."""
        distance = 1.0 - rows @ self.queries.T
        for row, query in skip:
            distance[row, query] = np.inf
        # no farther than the k-th so far, nor than the k-th of these rows
        limit = self.bound
        if 0 < self.k < len(distance):
            limit = np.minimum(limit, np.partition(distance, self.k - 1, axis=0)[self.k - 1])
        row, query = np.nonzero((distance <= limit) & np.isfinite(distance))
        held = [keys.take(pa.array(row))] if self.keys is None else [self.keys, keys.take(pa.array(row))]
        keys, query = pa.concat_arrays(held), np.concatenate((self.query, query))
        distance = np.concatenate((self.distance, distance[row, query[len(self.query) :]]))
        order = pc.sort_indices(pa.table({"query": query, "distance": distance, "known": pc.is_valid(keys), "key": keys}), [(c, "ascending") for c in ("query", "distance", "known", "key")]).to_numpy()
        query = query[order]
        first = np.searchsorted(query, np.arange(len(self.queries)))
        place = np.arange(len(query)) - first[query]
        last = place == self.k - 1
        self.bound[query[last]] = distance[order][last]
        order, query = order[place < self.k], query[place < self.k]
        self.query, self.distance, self.keys = query, distance[order], keys.take(pa.array(order))


def batch_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def ann_width(k: int) -> int:
    """How many candidates an approximate index must keep to return k."""
    return max(2 * k, 40)
