"""Connected components over an edge table, by smallest labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import hot_limit, join_by_counts, released, written

#: Edges that one task joins before the rounds begin.
LOCAL_EDGES = 500_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the smallest node of each of their components, so rounds start from short paths."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars() -> pa.RecordBatch:
        pairs = [(x, r) for x in up if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        if len(up) > 2 * LOCAL_EDGES:
            yield stars()
            up.clear()
    yield stars()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component for edges (a long, b long): the smallest node that links reach.

    Each round takes the smallest label among neighbours and then the label of that label, so
    long chains shrink by half; every round is a table in the shared folder.
    """
    edges = edges.select("a", "b").where("a <> b")
    stars = edges.coalesce(-(-edges.count() // LOCAL_EDGES) or 1).mapInArrow(released(_contract), "a long, b long")
    both = written(stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")), "labels")
    # edges go by their far end, of which stars' centres may have any number
    degrees = both.groupBy("b").agg(F.count("*").alias("n"))
    degrees = written(degrees.where(F.col("n") > hot_limit(both.count())), "centres")
    centres = bool(degrees.limit(1).count())
    for _ in range(rounds):
        ends = labels.withColumnRenamed("node", "b")
        if centres:
            ends = ends.join(F.broadcast(degrees), "b", "left").withColumn("n", F.coalesce("n", F.lit(1)))
            met = join_by_counts(both, written(ends, "ends"), ["b"])
        else:
            met = both.join(ends, "b")
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        hop = written(labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "hops")
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        # one row for each component meets its own label; then it goes back to its nodes
        ups = written(hop.groupBy("component").agg(F.count("*").alias("n")).join(up, "component", "left"), "ups")
        new = written(join_by_counts(hop, ups, ["component"]).select("node", "old", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        labels = new.drop("old")
        if not new.where("component <> old").limit(1).count():
            return labels
    raise RuntimeError("labels didn't settle")
