"""Writes of a mutable store as snapshots: the new table is a query over the old one and the changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of new whose key old holds change the update columns only; others are added. Rows of a null key are always added."""
    mark = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    joined = old.withColumn("_here", F.lit(True)).alias("o").join(new.withColumn("_here", F.lit(True)).alias("n"), mark, "full_outer")
    had, came = F.col("o._here").isNotNull(), F.col("n._here").isNotNull()
    return joined.select(*[F.when(~had | (came if c in update else F.lit(False)), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in old.columns])


def improved(old: DataFrame, new: DataFrame, key: str, error: str) -> DataFrame:
    """A row is replaced only by one of smaller error; the stored row wins ties, and new keys aren't added."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.join(old.select(key), key, "left_semi").withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col(error).asc_nulls_last(), "_new")
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_new")


def latest(rows: DataFrame, key: str | list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in order."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pending(candidates: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    return candidates.join(done, key, "left_anti")


def deleted(rows: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    return rows.join(gone, key, "left_anti")
