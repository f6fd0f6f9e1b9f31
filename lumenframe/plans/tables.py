"""The stand-in tables: photos, their edits, pixels, jobs and projects over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, vector array<double>, category."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("photo"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").alias("category"))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, expert, edit (an id), fit_error, excluded, and a 4-number fingerprint."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("photo"),
        F.col("l_linenumber").alias("expert"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edit"),
        F.col("l_extendedprice").alias("fit_error"),
        (F.col("l_returnflag") == "R").alias("excluded"),
        F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") / 0.08, F.col("l_extendedprice") / 100000).alias("fingerprint"),
    )


EDITS_SQL = """edits AS (
  SELECT l_partkey AS photo, l_linenumber AS expert, l_orderkey * 10 + l_linenumber AS edit, l_extendedprice AS fit_error, l_returnflag = 'R' AS excluded,
    [l_quantity / 50, l_discount * 10, l_tax / 0.08, l_extendedprice / 100000] AS fingerprint FROM lineitem)"""

PHOTOS_SQL = "photos AS (SELECT vec_id AS photo, CAST(embedding AS DOUBLE[]) AS vector, label AS category FROM embeddings)"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image, place, r, g, b in 0..1, and a second rendition r2, g2, b2."""
    r, g, b = F.col("l_discount") * 10, F.col("l_tax") / 0.08, (F.col("l_quantity") - 1) / 49
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("image"), F.col("l_orderkey").alias("place"), clip(r).alias("r"), clip(g).alias("g"), clip(b).alias("b"),
        clip(b).alias("r2"), clip(r * 0.9).alias("g2"), clip(g).alias("b2"),
    )


_CLIP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"
PIXELS_SQL = f"""pixels AS (
  SELECT l_suppkey AS image, l_orderkey AS place, {_CLIP.format('l_discount * 10')} AS r, {_CLIP.format('l_tax / 0.08')} AS g, {_CLIP.format('(l_quantity - 1) / 49')} AS b,
    {_CLIP.format('(l_quantity - 1) / 49')} AS r2, {_CLIP.format('l_discount * 10 * 0.9')} AS g2, {_CLIP.format('l_tax / 0.08')} AS b2 FROM lineitem)"""
