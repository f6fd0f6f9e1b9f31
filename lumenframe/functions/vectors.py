"""Vector algebra as column expressions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: str | Column) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def dot_with(v: Column, q: list[float]) -> Column:
    """Inner product with a literal vector of any width: one literal array, as unrolled sums outgrow generated code."""
    return dot(v, F.array(*[F.lit(float(x)) for x in q]))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """Unit length; the zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


def cosine_distance(a: Column, b: Column) -> Column:
    """0 to 2; a zero vector is at distance 1 from everything."""
    return F.lit(1.0) - dot(normalised(a), normalised(b))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def weighted_blocks(*blocks: tuple[Column, float]) -> Column:
    """Blocks laid end to end, each of unit length times its weight; a zero block stays zero."""

    def scaled(v: Column, w: float) -> Column:
        return F.transform(normalised(v), lambda x: x * w)

    return F.concat(*[scaled(v, w) for v, w in blocks])


def standardised(v: Column, mean: Column, deviation: Column) -> Column:
    return F.transform(v, lambda x, i: (x - F.get(mean, i)) / F.get(deviation, i))


def restored(v: Column, mean: Column, deviation: Column) -> Column:
    return F.transform(v, lambda x, i: x * F.get(deviation, i) + F.get(mean, i))
