"""How far experts are apart on the same photo, on three scales: their own renditions, those that recipes can reach, and fingerprints.

Defined results: a scale of a photo with fewer than two experts is null and the photo is counted as
incomplete; pixels that only one expert has count in no pair; the median is over pairs, whose differences
are means over pixels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.colour import with_ciede2000
from lumenframe.functions.vectors import euclidean

SCALES = ("human", "reachable", "fingerprint")


def _met(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and e, the few experts of a group with their values, met by one shuffle instead of a join."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("expert", F.col(value).alias("v")))).alias("e"))


def _pairs(met: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, x, y of every two experts of e."""
    two = F.flatten(F.transform("e", lambda one: F.transform(F.filter("e", lambda two: two["expert"] > one["expert"]), lambda two: F.struct(one.alias("one"), two.alias("two")))))
    return met.select(*keys, F.explode(two).alias("p")).select(*keys, F.col("p.one.expert").alias("a"), F.col("p.two.expert").alias("b"), F.col("p.one.v").alias("x"), F.col("p.two.v").alias("y"))


def colour_pairs(renditions: DataFrame) -> DataFrame:
    """photo, a, b, away: the mean CIEDE2000 difference of two experts' renditions; renditions: photo, expert, place, lab (a struct of L, a and b)."""
    return met_colour_pairs(_met(renditions, ["photo", "place"], "lab"))


def met_colour_pairs(pixels: DataFrame) -> DataFrame:
    """colour_pairs of rows that hold a pixel's experts already: photo and e, an array of structs of expert and v, its lab. Nothing but means is shuffled."""
    both = _pairs(pixels, ["photo"])
    wide = both.select("photo", "a", "b", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("L", "a", "b")])
    return with_ciede2000(wide, "x", "y", "de").groupBy("photo", "a", "b").agg(F.avg("de").alias("away"))


def fingerprint_pairs(edits: DataFrame) -> DataFrame:
    """photo, a, b, away: the distance of two experts' fingerprints; edits: photo, expert, fingerprint, one of each expert."""
    return _pairs(_met(edits, ["photo"], "fingerprint"), ["photo"]).select("photo", "a", "b", euclidean(F.col("x"), F.col("y")).alias("away"))


def scales(photos: DataFrame, human: DataFrame, reachable: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """photo and the mean and median of its pairs on each scale, null where there is no pair; the others: photo, a, b, away."""
    out = photos.select("photo").distinct()
    for name, pairs in zip(SCALES, (human, reachable, fingerprints), strict=True):
        # a photo has a handful of pairs
        each = pairs.groupBy("photo").agg(F.avg("away").alias(f"{name}_mean"), F.percentile("away", F.lit(0.5)).alias(f"{name}_median"))
        out = out.join(each, "photo", "left")
    return out


def incomplete(scaled: DataFrame, group: str) -> DataFrame:
    """group, photos, and of each scale how many photos have none."""
    return scaled.groupBy(group).agg(F.count("*").alias("photos"), *[F.count_if(F.col(f"{s}_mean").isNull()).alias(f"{s}_incomplete") for s in SCALES])
