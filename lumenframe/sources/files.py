"""Readers and writers: rows in JSON lines, text indexes, documents, vectors, catalogues over JDBC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Blank lines are skipped; a missing path is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, *order: str) -> None:
    df.orderBy(*order).write.option("ignoreNullFields", "false").json(path)


def read_index(spark: SparkSession, *paths: str) -> DataFrame:
    """name, file of text indexes: stripped, blanks dropped. A name in two files is an error when read."""
    rows = spark.read.text(list(paths)).select(F.trim("value").alias("name"), F.input_file_name().alias("file")).where("name <> ''")
    names = rows.groupBy("name").agg(F.min("file").alias("file"), F.max("file").alias("other"))
    clash = F.raise_error(F.concat(F.lit("in two indexes: "), F.col("name")))
    return names.select("name", F.when(F.col("file") == F.col("other"), F.col("file")).otherwise(clash).alias("file"))


def read_names(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths)).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def read_document(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON document that spans lines, as one row."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """id, vector; a vector of another width is an error when read."""
    wrong = F.raise_error(F.concat(F.lit("a vector of another width: "), F.col("id").cast("string")))
    return spark.read.parquet(path).select("id", F.when(F.size("vector") == width, F.col("vector")).otherwise(wrong).alias("vector"))


def read_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """key, content and length of stored objects."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("key"), "content", "length")


def read_catalogue(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a catalogue database over JDBC; its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_stats(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """name and number of columns of each table of a database."""
    rows = [(t.name, len(spark.catalog.listColumns(f"{database}.{t.name}" if database else t.name))) for t in spark.catalog.listTables(database)]
    return spark.createDataFrame(rows, "name string, columns int")
