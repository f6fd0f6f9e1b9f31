"""Session helpers that the operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 1000
#: Keys above their share of 1 / HOT_KEYS of all rows (and above LEAST_HOT rows) are hot; fewer than HOT_KEYS can be.
HOT_KEYS, LEAST_HOT = 200_000, 20_000


def prepared(spark: SparkSession) -> SparkSession:
    """Arrow batches of a bounded number of rows, and a folder for checkpoints.

    The shared folder is the session's spark.checkpoint.dir. Where none is set, a temporary one is
    taken on one machine (tests); on a cluster that is an error, as executors and driver wouldn't
    see each other's files.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lumenframe-"))
    return spark


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    prepared(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df marked for a broadcast if it has at most so many rows, else as it is. df should be cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def hot_limit(total: int | None, least: int = LEAST_HOT) -> int:
    """Fewer than HOT_KEYS keys can have more rows than this, of so many rows in all."""
    return max(least, (total or 0) // HOT_KEYS)


def join_by_counts(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", least: int = LEAST_HOT) -> DataFrame:
    """rows joined with a table of one row for each key, which says in n how many rows have the key.

    Hot keys, of which there are always fewer than HOT_KEYS, are joined by a broadcast, so none
    of them meets in one task; the rest is shuffled. rows is read twice, so it should be a table.
    """
    most = hot_limit(table.agg(F.sum("n")).first()[0], least)
    hot, rest = table.where(F.col("n") > most), table.where(F.col("n") <= most)
    if not hot.limit(1).count():
        return rows.join(table.drop("n"), keys, how)
    names = F.broadcast(hot.select(*keys))
    return rows.join(F.broadcast(hot.drop("n")), keys, "left_semi" if how == "left_semi" else "inner").unionByName(rows.join(names, keys, "left_anti").join(rest.drop("n"), keys, how))


def semi_by_counts(rows: DataFrame, table: DataFrame, keys: list[str], least: int = LEAST_HOT) -> DataFrame:
    return join_by_counts(rows, table, keys, "left_semi", least)


def _give_back() -> None:
    """Returns freed memory, which Arrow and the C library keep for later, to the machine."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, giving freed memory back at a task's end: workers live on, idle, beside those of later stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return task


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns and all others in one struct, rest, so that none can clash with what an operator adds."""
    others = [F.col(_quoted(c)) for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*(others or [F.lit(None).cast("int").alias("none")])).alias("rest"))


def unpacked(df: DataFrame, columns: list[str], needed: tuple[str, ...], **new: Column) -> DataFrame:
    """columns as they were before packed(), but new ones by name in place of or after them."""
    same = [new.pop(c).alias(c) if c in new else F.col(c) if c in needed else F.col("rest").getField(c).alias(c) for c in columns]
    return df.select(*same, *[x.alias(c) for c, x in new.items()])
