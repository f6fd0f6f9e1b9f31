"""Columns that follow from one other: worked out once for each of its values where these are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kept import kept

#: Values up to which their table is broadcast; beyond, columns are worked out row by row, and no row is moved either way.
MOST_VALUES = 1 << 16


def by_distinct(rows: DataFrame, column: str, new: dict[str, Column]) -> DataFrame:
    """rows with new columns, expressions over column alone; a null is a value."""
    values = rows.select(column).distinct()
    if values.limit(MOST_VALUES + 1).count() > MOST_VALUES:
        return rows.withColumns(new)
    known = kept(values.withColumns(new), "distinct").withColumnRenamed(column, "_value")
    return rows.join(F.broadcast(known), F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value")
