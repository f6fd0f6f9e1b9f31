"""Places and exact percentiles over range partitions: no task holds a whole group, nor all rows of one value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kept import kept

#: Groups up to which their table (one short row each) is broadcast.
BROADCAST_GROUPS = 10_000


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with i, their 0-based place by key: ranges, places inside each, and the counts before it."""
    # written once, with each row's place in its sorted range (the low 33 bits), so that rows are shuffled once
    sorted_ = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("_m", F.monotonically_increasing_id())
    parts = kept(sorted_, "ranges").withColumn("_p", F.shiftright("_m", 33))
    inside = parts.withColumn("_i", F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m")
    counts = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.min(key).alias("_lo"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_lo")) - F.col("_n")).alias("_b"))
    # one row for each range
    return inside.join(F.broadcast(before), "_p").withColumn("i", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def _few(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else groups


def placed(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with i, their 0-based place by value in their group, and n, its rows: places over all rows by (group, value), less the group's first, so no task holds a whole group."""
    every = numbered(rows.withColumn("_gv", F.struct(group, value)), "_gv").drop("_gv")
    groups = every.groupBy(F.col(group).alias("_g")).agg(F.min("i").alias("_first"), F.count("*").alias("n"))
    return every.join(_few(groups), F.col(group).eqNullSafe(F.col("_g"))).withColumn("i", F.col("i") - F.col("_first")).drop("_g", "_first")


def value_places(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, value, c (rows of that value), i (the 0-based place of the first of them in the group) and n (rows of the group): values are counted before they are ranked, so equal ones are one row."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c")).withColumn("_gv", F.struct(group, value))
    parts = kept(counts.repartitionByRange("_gv").withColumn("_p", F.spark_partition_id()), "ranges")
    inside = parts.withColumn("_to", F.sum("c").over(Window.partitionBy("_p").orderBy("_gv").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    sizes = parts.groupBy("_p").agg(F.sum("c").alias("_n"), F.min("_gv").alias("_lo"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_lo")) - F.col("_n")).alias("_b"))
    every = inside.join(F.broadcast(before), "_p").select(group, value, "c", (F.col("_to") - F.col("c") + F.col("_b")).alias("i"))
    groups = every.groupBy(F.col(group).alias("_g")).agg(F.min("i").alias("_first"), F.sum("c").alias("n"))
    return every.join(_few(groups), F.col(group).eqNullSafe(F.col("_g"))).withColumn("i", F.col("i") - F.col("_first")).drop("_g", "_first")


def quantiles(rows: DataFrame, group: str, value: str, cuts: dict[str, float]) -> DataFrame:
    """One row of each group: the interpolated quantiles of value (nulls don't count) under the names of cuts."""
    r = value_places(rows.where(F.col(value).isNotNull()).select(group, value), group, value)
    spots = {name: (F.col("n") - 1) * F.lit(q) for name, q in cuts.items()}
    at = lambda spot: F.max(F.when((F.col("i") <= spot) & (spot < F.col("i") + F.col("c")), F.col(value)))
    out = r.groupBy(group, "n").agg(*[at(f(s)).alias(f"{side}_{name}") for name, s in spots.items() for side, f in (("lo", F.floor), ("hi", F.ceil))])
    between = lambda name, s: F.col(f"lo_{name}") + (F.col(f"hi_{name}") - F.col(f"lo_{name}")) * (s - F.floor(s))
    return out.select(group, *[between(name, s).alias(name) for name, s in spots.items()])


def distributions(rows: DataFrame, group: str, measures: dict[str, Column], digits: int = 6) -> DataFrame:
    """group, measure, count, p10, median, mean, p90 of several measures, all ranked in one pass; a measure without values has no row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), c.cast("double").alias("value")) for name, c in measures.items()]))
    long = rows.select(F.col(group).alias("_group"), pairs.alias("x")).select(F.struct("_group", "x.measure").alias("g"), "x.value").where(F.col("value").isNotNull())
    means = long.groupBy("g").agg(F.count("*").alias("count"), F.avg("value").alias("mean"))
    ranks = quantiles(long, "g", "value", {"p10": 0.1, "median": 0.5, "p90": 0.9})
    cut = lambda name: F.round(name, digits).alias(name)
    return means.join(ranks, "g").select(F.col("g._group").alias(group), "g.measure", "count", cut("p10"), cut("median"), cut("mean"), cut("p90"))
