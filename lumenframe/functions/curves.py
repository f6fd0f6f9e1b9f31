"""Edits of a tone curve's points as column expressions over array<struct<x: double, y: double>>.

Every edit of a valid curve gives a valid one: the ends keep their places 0 and 1, values stay in
0..1, and no point comes closer to its neighbour than GAP.

Defined results: an index that the curve doesn't have, a null edit, the removal of an end, and an
insertion where there is no room leave the curve as it is; a null curve stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.recipes import LEAST_GAP

#: What an editor keeps between points: twice the least that a recipe may have.
GAP = 2 * LEAST_GAP
POINTS = "array<struct<x: double, y: double>>"


def _held(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, x))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), _held(y, F.lit(0.0), F.lit(1.0)).alias("y"))


def moved(points: Column, index: Column, x: Column, y: Column) -> Column:
    """The point at index goes to (x, y), as far as its neighbours let it; an end moves only up and down."""
    last = F.size(points) - 1
    before, after = F.get(points, index - 1)["x"] + GAP, F.get(points, index + 1)["x"] - GAP
    end = (index == 0) | (index == last)
    there = F.when(end, F.get(points, index)["x"]).otherwise(_held(x, before, after))
    possible = index.between(0, last) & x.isNotNull() & y.isNotNull()
    return F.when(possible, F.transform(points, lambda p, i: F.when(i == index, _point(there, y)).otherwise(p))).otherwise(points)


def inserted(points: Column, x: Column, y: Column) -> Column:
    """A new point before the first that lies beyond x, or before the last one; none where its neighbours leave no room for two gaps."""
    beyond = F.size(F.filter(points, lambda p: p["x"] <= x))
    at = F.when(beyond >= F.size(points), F.size(points) - 1).otherwise(F.greatest(beyond, F.lit(1)))
    low, high = F.get(points, at - 1)["x"], F.get(points, at)["x"]
    room = (high - low >= 2 * GAP) & x.isNotNull() & y.isNotNull()
    whole = F.concat(F.slice(points, F.lit(1), at), F.array(_point(_held(x, low + GAP, high - GAP), y)), F.slice(points, at + 1, F.size(points)))
    return F.when(room, whole).otherwise(points)


def removed(points: Column, index: Column) -> Column:
    """The curve without an inner point."""
    inner = (index > 0) & (index < F.size(points) - 1)
    return F.when(inner, F.filter(points, lambda p, i: i != index)).otherwise(points)


def edited(points: Column, kind: Column, index: Column, x: Column, y: Column) -> Column:
    """One edit: move, insert or remove; any other kind changes nothing."""
    return F.when(kind == "move", moved(points, index, x, y)).when(kind == "insert", inserted(points, x, y)).when(kind == "remove", removed(points, index)).otherwise(points)


def step(points: list[tuple[float, float]], kind: str | None, index: float | None, x: float | None, y: float | None) -> list[tuple[float, float]]:
    """One edit of a curve in a running fold; says the same as `edited`, which tests hold it against."""
    last = len(points) - 1
    if any(v is None or v != v for v in ((index,) if kind == "remove" else (x, y) if kind == "insert" else (index, x, y))):
        return points
    held = lambda v, low, high: max(low, min(high, v))
    if kind == "move" and 0 <= index <= last:
        i = int(index)
        to = points[i][0] if i in (0, last) else held(x, points[i - 1][0] + GAP, points[i + 1][0] - GAP)
        return [*points[:i], (to, held(y, 0.0, 1.0)), *points[i + 1 :]]
    if kind == "insert":
        beyond = sum(p[0] <= x for p in points)
        i = last if beyond > last else max(beyond, 1)
        if points[i][0] - points[i - 1][0] >= 2 * GAP:
            return [*points[:i], (held(x, points[i - 1][0] + GAP, points[i][0] - GAP), held(y, 0.0, 1.0)), *points[i:]]
    if kind == "remove" and 0 < index < last:
        return [p for i, p in enumerate(points) if i != int(index)]
    return points


def replayed(events: DataFrame, key: str, order: list[str], start: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 1.0))) -> DataFrame:
    """key, edits, points: every curve after all its edits (kind, index, x, y), one after the other in their order.

    Each edit needs the curve that the one before left, so a curve's edits are one sequence: they are
    sorted in their partition, where a sort spills, and stream past a task that holds one curve and one
    Arrow batch, however many edits a key has.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, points, n = None, [], 0
        # a null key is a key of its own
        result = lambda: pd.DataFrame({key: pd.Series([now[0]], dtype="Int64"), "edits": [n], "points": [[{"x": a, "y": b} for a, b in points]]})
        for batch in batches:
            out = []
            for k, kind, index, x, y in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                if now is None or k != now[0]:
                    if now is not None:
                        out.append(result())
                    now, points, n = (k,), list(start), 0
                points, n = step(points, kind, index, x, y), n + 1
            if out:
                yield pd.concat(out)
        if now is not None:
            yield result()

    rows = events.repartition(key).sortWithinPartitions(key, *order).select(F.col(key).cast("long"), "kind", F.col("index").cast("double"), F.col("x").cast("double"), F.col("y").cast("double"))
    return rows.mapInPandas(fold, f"`{key}` long, edits long, points {POINTS}")
