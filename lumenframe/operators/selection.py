"""Strategies that choose a few candidates from each query's pool.

A pool is rows (query, photo, edit, distance, fit_error, fingerprint). Every strategy returns
(query, edit, place), never repeats a candidate, may return fewer than asked, and is
deterministic; the base order is (distance, edit).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_OUT = "query long, edit long, place int"


def top(pool: DataFrame, n: int = 3, one_per_photo: bool = False, best_fit: bool = False) -> DataFrame:
    """The nearest; a missing fit error counts as none, so it comes first among equals."""
    order = [F.col("distance"), *([F.coalesce("fit_error", F.lit(0.0))] if best_fit else []), F.col("edit")]
    if one_per_photo:
        pool = pool.withColumn("_r", F.row_number().over(Window.partitionBy("query", "photo").orderBy(*order))).where("_r = 1").drop("_r")
    return pool.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= n).select("query", "edit", "place")


def _per_query(pool: DataFrame, choose: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """choose gets a query's pool in base order and returns places of the chosen rows; a pool is a few hundred rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["distance", "edit"], kind="stable").reset_index(drop=True)
        at = choose(rows)
        return pd.DataFrame({"query": rows["query"].to_numpy()[at], "edit": rows["edit"].to_numpy()[at], "place": np.arange(1, len(at) + 1)})

    return pool.groupBy("query").applyInPandas(run, _OUT)


def random_choice(pool: DataFrame, n: int = 3, seed: int = 0) -> DataFrame:
    """The first n in the order of a seeded hash, so a query always gets the same; each task passes on n rows of a query."""
    order = [F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("query").cast("string"), F.col("edit").cast("string")), 256), F.col("edit")]
    return pool.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("place") <= n).select("query", "edit", "place")


def _scaled(values: np.ndarray) -> np.ndarray:
    span = values.max() - values.min() if values.size else 0.0
    return (values - values.min()) / span if span > 0 else np.zeros_like(values)


def _distances(vectors: np.ndarray) -> np.ndarray:
    square = (vectors**2).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * vectors @ vectors.T, 0))


def marginal_relevance(pool: DataFrame, n: int = 3, weight: float = 0.5) -> DataFrame:
    """Greedy: weight * relevance - (1 - weight) * likeness to what is chosen; the earliest of equals."""
    if not 0 <= weight <= 1:
        raise ValueError("weight must lie in 0..1")

    def choose(rows: pd.DataFrame) -> list[int]:
        relevance = 1 - _scaled(rows["distance"].to_numpy(float))
        alike = 1 - _scaled(_distances(np.stack(rows["fingerprint"].to_numpy()).astype(float)))
        chosen = [int(np.argmax(relevance))][: max(n, 0)]
        while len(chosen) < min(n, len(rows)):
            gain = weight * relevance - (1 - weight) * alike[:, chosen].max(1)
            gain[chosen] = -np.inf
            chosen.append(int(np.argmax(gain)))
        return chosen

    return _per_query(pool, choose)


def kmeans_labels(points: np.ndarray, k: int, seed: int, rounds: int = 50) -> np.ndarray:
    """k-means++ start, Lloyd rounds; a group that runs empty starts anew at the worst placed point."""
    n = len(points)
    if n <= k:
        return np.arange(n)
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(n)]]
    for _ in range(k - 1):
        away = np.min([((points - c) ** 2).sum(1) for c in centres], axis=0)
        centres.append(points[rng.choice(n, p=away / away.sum())] if away.sum() > 0 else points[rng.integers(n)])
    centre, labels = np.array(centres), np.full(n, -1)
    for _ in range(rounds):
        away = ((points[:, None] - centre[None]) ** 2).sum(2)
        new = away.argmin(1)
        for j in range(k):
            if not (new == j).any():
                new[away[np.arange(n), new].argmax()] = j
        if (new == labels).all():
            break
        labels = new
        centre = np.array([points[labels == j].mean(0) if (labels == j).any() else centre[j] for j in range(k)])
    return labels


def grouped(pool: DataFrame, n: int = 3, seed: int = 20260913) -> DataFrame:
    """The best member of each of n groups by fingerprint, in base order."""

    def choose(rows: pd.DataFrame) -> list[int]:
        if n <= 0:
            return []
        labels = kmeans_labels(np.stack(rows["fingerprint"].to_numpy()).astype(float), n, seed)
        return sorted({int(np.flatnonzero(labels == j)[0]) for j in set(labels.tolist())})[:n]

    return _per_query(pool, choose)


def farthest_first(finalists: DataFrame, pairs: DataFrame, n: int = 3) -> DataFrame:
    """Of finalists (query, edit, place): the first, and then again and again the one whose smallest difference from the chosen is largest. pairs: query, a, b, difference for both orders."""
    both = finalists.select("query", F.col("edit").alias("a"), "place").join(pairs, ["query", "a"], "left").groupBy("query", "a", "place").agg(F.collect_list(F.struct("b", "difference")).alias("near"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable").reset_index(drop=True)
        away = [{x["b"]: x["difference"] for x in near} for near in rows["near"]]
        ids = rows["a"].tolist()
        chosen = list(range(len(ids))) if len(ids) <= n else [0]
        while len(chosen) < min(n, len(ids)):
            rest = [i for i in range(len(ids)) if i not in chosen]
            chosen.append(max(rest, key=lambda i: (min(away[i].get(ids[c], 0.0) for c in chosen), -i)))
        return pd.DataFrame({"query": rows["query"].to_numpy()[chosen], "edit": [ids[i] for i in chosen], "place": np.arange(1, len(chosen) + 1)})

    return both.groupBy("query").applyInPandas(run, _OUT)


def always(queries: DataFrame, edit: int, n: int = 3) -> DataFrame:
    """One fixed candidate for every query; none if none is asked for."""
    return queries.select("query", F.lit(edit).cast("long").alias("edit"), F.lit(1).alias("place")).where(F.lit(n > 0))
