"""Scores of an arm: rows become distributions, curves, slices and paired comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.statistics import sign_test, student_quantile

from .ranking import quantiles

CURVE_STEP, CURVE_STEPS = 0.5, 40


def ratio(value: Column, scale: Column) -> Column:
    """value over scale; null where either is null or the scale isn't positive."""
    return F.when(scale > 0, value / scale)


def aggregate_arm(rows: DataFrame, value: str = "value", hit: str = "hit") -> DataFrame:
    """One row: rows, rate of hits among the decided, and the distribution of value: count, p10, median, mean, p90, min and max, percentiles interpolated."""
    one = rows.withColumn("whole", F.lit(0))
    plain = one.groupBy("whole").agg(F.count("*").alias("rows"), F.round(F.avg(F.col(hit).cast("double")), 6).alias("hit_rate"), F.count(value).alias("value_count"), *[F.round(f(value), 6).alias(f"value_{n}") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    cuts = quantiles(one, "whole", value, {"value_p10": 0.1, "value_median": 0.5, "value_p90": 0.9})
    return plain.join(cuts.select("whole", *[F.round(c, 6).alias(c) for c in cuts.columns[1:]]), "whole", "left").drop("whole")


def hit_curve(rows: DataFrame, value: str = "value") -> DataFrame:
    """threshold, rate of values strictly below it, for forty thresholds. Rows are counted per step once; the running sum is over forty rows."""
    # the first threshold above the value; beyond the last there is none
    step = F.floor(F.col(value) / CURVE_STEP) + 1
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.least(step, F.lit(CURVE_STEPS + 1)).alias("step")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    steps = rows.sparkSession.range(1, CURVE_STEPS + 1).withColumnRenamed("id", "at")
    # both sides have at most forty-one rows
    below = steps.join(F.broadcast(counts), F.col("step") <= F.col("at"), "left").groupBy("at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return below.join(F.broadcast(total)).select((F.col("at") * CURVE_STEP).alias("threshold"), F.round(F.col("n") / F.col("total"), 6).alias("rate"))


def slices(rows: DataFrame, label: str, value: str, least: int = 30) -> DataFrame:
    """label, n, median and mean of value; small slices are marked, rows without a label dropped."""
    known = rows.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), value)
    plain = known.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), (F.count("*") < least).alias("indicative_only"))
    medians = quantiles(known, "label", value, {"median": 0.5}).select("label", F.round("median", 6).alias("median"))
    return plain.join(medians, "label", "left")


def compare_arms(left: DataFrame, right: DataFrame, key: str, value: str) -> dict:
    """Medians, signs, exact two-sided p and the 95 % interval of the mean paired difference; one small row reaches the driver."""
    both = left.select(key, F.col(value).alias("x")).join(right.select(key, F.col(value).alias("y")), key).withColumn("d", F.col("x") - F.col("y"))
    r = both.agg(F.count("d").alias("n"), F.count_if(F.col("d") < 0).alias("less"), F.count_if(F.col("d") > 0).alias("more"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("sd")).first().asDict()
    for side, c in (("left", "x"), ("right", "y")):
        median = quantiles(both.withColumn("g", F.lit(0)), "g", c, {"m": 0.5}).first()
        r[f"{side}_median"] = median.m if median else None
    r["ties"] = r["n"] - r["less"] - r["more"]
    r["p"] = sign_test(r["less"], r["more"])
    half = student_quantile(0.975, r["n"] - 1) * r["sd"] / math.sqrt(r["n"]) if r["n"] > 1 and r["sd"] is not None else None
    r["interval"] = None if half is None else (r["mean"] - half, r["mean"] + half)
    return r


def scaling_drift(one: DataFrame, two: DataFrame) -> DataFrame:
    """Of two tables of constants (i, mean, deviation): ratio of deviations, shift of means in deviations, for each component."""
    j = one.alias("a").join(two.alias("b"), "i")
    return j.select("i", (F.col("b.deviation") / F.col("a.deviation")).alias("ratio"), ((F.col("b.mean") - F.col("a.mean")) / F.col("a.deviation")).alias("shift"))
