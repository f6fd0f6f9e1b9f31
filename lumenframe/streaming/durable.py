"""Results and their marks as one commit, for batches and streams that may be cut off at any point.

A commit is a number. Its rows are written first, one folder for each table, and its mark last;
readers see a commit only if it is marked. A commit that was cut off, or is written again (a
stream repeats its last batch after a crash, under the same number), replaces what it left, so
no row is lost, doubled or half there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ERROR_CHARS = 2000


class Ledger:
    """Tables under a root in a folder that the driver and all executors share."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, number: int, tables: dict[str, DataFrame]) -> None:
        """The rows of a commit, not yet visible."""
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{self.root}/{name}/commit={number}")

    def mark(self, spark: SparkSession, number: int, tables: list[str]) -> None:
        """Makes a commit visible; its counts are those of what was written."""
        counts = None
        for name in tables:
            one = spark.read.parquet(f"{self.root}/{name}/commit={number}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
            counts = one if counts is None else counts.unionAll(one)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/marks/commit={number}")

    def commit(self, number: int, tables: dict[str, DataFrame]) -> None:
        spark = next(iter(tables.values())).sparkSession
        self.write(number, tables)
        self.mark(spark, number, list(tables))

    def marks(self, spark: SparkSession) -> DataFrame:
        """name, n, commit: a row for each table of each visible commit."""
        return spark.read.schema("name string, n long, commit long").parquet(f"{self.root}/marks")

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        """The visible rows of a table, with their commit."""
        seen = self.marks(spark).where(F.col("name") == name).select("commit")
        # a row for each commit
        return spark.read.parquet(f"{self.root}/{name}").withColumn("commit", F.col("commit").cast("long")).join(F.broadcast(seen), "commit", "left_semi")


def outcomes(rows: DataFrame, error: str = "error") -> DataFrame:
    """rows with status, Failed where there is an error (cut to ERROR_CHARS characters), else Done."""
    return rows.withColumn("status", F.when(F.col(error).isNull(), "Done").otherwise("Failed")).withColumn(error, F.substring(error, 1, ERROR_CHARS))


def sink(ledger: Ledger, work: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that commits what work makes of each micro-batch under the batch's number."""

    def run(batch: DataFrame, number: int) -> None:
        ledger.commit(number, work(batch))

    return run
