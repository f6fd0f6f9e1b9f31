"""How far the constants of a scaling that saw held-out rows moved what is compared by it.

Stored vectors are brought back to their raw values, constants are fitted anew on the rows that may
be seen, and both scalings are compared by the distances of the same random pairs.

Defined results: pairs are drawn with repetition from places by a seeded digest, so they don't depend
on partitions; a pair of one place with itself is dropped; a pair at distance 0 counts in the mean
distances and has no relative change; a component that doesn't vary is divided by 1; rows with a
null vector don't count; fewer than two rows give no pairs, and null figures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.vectors import euclidean, restored, standardised

from .kept import kept
from .ranking import numbered, quantiles

#: Pairs that are drawn, and the median change in percent below which a leak is called negligible.
PAIRS, NEGLIGIBLE = 200_000, 1.0
#: Digits of a digest that make a number: 60 bits, so that a remainder is even to one part in 2^60 / rows.
DIGITS = 15


def draw(seed: str, *parts: Column) -> Column:
    """A number in 0..2^60 from a seed and what is numbered by it."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), *[p.cast("string") for p in parts]), 256), 1, DIGITS), 16, 10).cast("long")


def random_pairs(df: DataFrame, rows: int, pairs: int = PAIRS, seed: str = "pairs") -> DataFrame:
    """pair, left, right: two different places below rows; df gives the session."""
    numbers = df.sparkSession.range(pairs).select(F.col("id").alias("pair"))
    if rows < 2:
        return numbers.select("pair", F.col("pair").alias("left"), F.col("pair").alias("right")).where("false")
    sides = {side: draw(seed, F.lit(side), F.col("pair")) % F.lit(rows) for side in ("left", "right")}
    return numbers.select("pair", *[c.alias(side) for side, c in sides.items()]).where("left <> right")


def paired(pairs: DataFrame, places: DataFrame, values: list[str]) -> DataFrame:
    """pair, and of every value {value}_left and {value}_right: both sides are looked up by one join, so the many rows are read once and not moved."""
    ends = pairs.select("pair", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("i")) for s in ("left", "right")])).alias("x")).select("pair", "x.*")
    # as many rows as pairs were asked for, twice: places stay where they are
    found = places.select("i", *values).join(F.broadcast(ends), "i")
    return found.groupBy("pair").agg(*[F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in ("left", "right")])


def constants(rows: DataFrame, vector: str) -> DataFrame:
    """component, mean, deviation (of the whole population; 1 where nothing varies)."""
    long = rows.select(F.posexplode(vector).alias("component", "x"))
    c = long.groupBy("component").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    return c.withColumn("deviation", F.when(F.col("deviation") == 0, 1.0).otherwise(F.col("deviation")))


def one_row(c: DataFrame, prefix: str) -> DataFrame:
    """The constants as one row of two arrays."""
    row = c.agg(F.array_sort(F.collect_list(F.struct("component", "mean", "deviation"))).alias("c"))
    return row.select(F.col("c.mean").alias(f"{prefix}_mean"), F.col("c.deviation").alias(f"{prefix}_deviation"))


def restated(stored: DataFrame, committed: DataFrame, build: Column, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """Rows with `vector` as stored and `rebuilt`, scaled by constants of the rows of `build` alone; and these constants."""
    # a row of constants on each side
    raw = stored.where(F.col(vector).isNotNull()).crossJoin(F.broadcast(one_row(committed, "old")))
    raw = raw.withColumn("_raw", restored(F.col(vector), F.col("old_mean"), F.col("old_deviation"))).drop("old_mean", "old_deviation")
    fitted = kept(constants(raw.where(build), "_raw"), "constants")
    new = raw.crossJoin(F.broadcast(one_row(fitted, "new")))
    return new.withColumn("rebuilt", standardised(F.col("_raw"), F.col("new_mean"), F.col("new_deviation"))).drop("_raw", "new_mean", "new_deviation"), fitted


def moved_distances(rows: DataFrame, key: str, pairs: int = PAIRS, seed: str = "pairs") -> DataFrame:
    """pair, before, after, change (percent; null at distance 0) of random pairs of rows (key, vector, rebuilt), by their places in the order of key."""
    # numbered() has written the rows: they needn't be written again
    places = numbered(rows.select(key, "vector", "rebuilt"), key)
    both = paired(random_pairs(rows, places.count(), pairs, seed), places, ["vector", "rebuilt"])
    away = both.select("pair", euclidean(F.col("vector_left"), F.col("vector_right")).alias("before"), euclidean(F.col("rebuilt_left"), F.col("rebuilt_right")).alias("after"))
    return away.withColumn("change", F.abs(F.col("after") - F.col("before")) / F.nullif("before", F.lit(0.0)) * 100)


def report(moved: DataFrame) -> DataFrame:
    """One row: pairs, median, p90, p99 and worst change in percent, mean distances, and whether the leak is negligible."""
    one = moved.withColumn("g", F.lit(1))
    cuts = quantiles(one, "g", "change", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    sums = one.groupBy("g").agg(F.count("*").alias("pairs"), F.max("change").alias("worst"), F.avg("before").alias("mean_before"), F.avg("after").alias("mean_after"))
    return sums.join(cuts, "g", "left").drop("g").withColumn("negligible", F.col("median") < NEGLIGIBLE)


def drift(old: DataFrame, new: DataFrame) -> DataFrame:
    """component, ratio of deviations, shift of the mean in old deviations, and worst: whether its ratio is the farthest from 1 (the first of equals)."""
    both = old.toDF("component", "_m", "_d").join(new, "component")
    out = both.select("component", (F.col("deviation") / F.col("_d")).alias("ratio"), (F.abs(F.col("mean") - F.col("_m")) / F.col("_d")).alias("shift"))
    worst = out.agg(F.min_by("component", F.struct(-F.abs(F.col("ratio") - 1), "component")).alias("_w"))
    # a row for each component of a vector
    return out.crossJoin(F.broadcast(worst)).select("component", "ratio", "shift", (F.col("component") == F.col("_w")).alias("worst"))


def control_sample(rows: DataFrame, key: str, size: int, seed: str) -> DataFrame:
    """size rows without replacement, all of them where there are fewer: those first by a seeded digest of the key, by places over ranges, so no task holds a whole sample."""
    order = rows.withColumn("_order", F.struct(draw(seed, F.col(key)).alias("d"), F.col(key).alias("k")))
    return numbered(order, "_order").where(F.col("i") < size).drop("_order", "i")
