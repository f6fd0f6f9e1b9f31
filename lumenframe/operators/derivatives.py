"""Smaller renditions of images that are rows of pixels: conversion to linear light once, then area means at several sizes.

A pixel is a row (image, x, y, width, height, three channels), so an image of any size spreads
over tasks; each pixel counts in one cell of each size, and partial means meet before the
shuffle, which is by image and cell.

Defined results: an image is never enlarged, and no side falls below one pixel; means are over
the pixels that are there, so missing rows leave gaps and no zeros; null channels don't count.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.colour import decode, encode, out_of_gamut
from lumenframe.functions.text import fitted_size

#: Fixed values of ROMM RGB (ProPhoto): its transfer function, its primaries under D50, the Bradford adaptation to D65, and XYZ to linear sRGB.
ROMM_SLOPE, ROMM_FROM, ROMM_GAMMA = 16.0, 1 / 512, 1.8
ROMM_TO_XYZ = ((0.7976749, 0.1351917, 0.0313534), (0.2880402, 0.7118741, 0.0000857), (0.0, 0.0, 0.8252100))
D50_TO_D65 = ((0.9555766, -0.0230393, 0.0631636), (-0.0282895, 1.0099416, 0.0210077), (0.0122982, -0.0204830, 1.3299098))
XYZ_TO_RGB = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
ROMM_TO_RGB = (np.array(XYZ_TO_RGB) @ np.array(D50_TO_D65) @ np.array(ROMM_TO_XYZ)).tolist()
SIZES = (512, 2048)


def romm_decode(x: Column) -> Column:
    """ROMM RGB to linear light, one channel."""
    return F.when(x < ROMM_SLOPE * ROMM_FROM, x / ROMM_SLOPE).otherwise(F.pow(x, F.lit(ROMM_GAMMA)))


def linear(pixels: DataFrame, prophoto: bool, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """pixels with linear sRGB channels, not clipped, and `outside`: whether sRGB can't show the colour."""
    if not prophoto:
        return pixels.withColumns({n: decode(F.col(n)) for n in names}).withColumn("outside", F.lit(False))
    light = pixels.withColumns({f"_{n}": romm_decode(F.col(n)) for n in names})
    mixed = {n: sum((k * F.col(f"_{c}") for k, c in zip(row, names, strict=True)), F.lit(0.0)) for n, row in zip(names, ROMM_TO_RGB, strict=True)}
    out = light.withColumns(mixed).drop(*[f"_{n}" for n in names])
    return out.withColumn("outside", out_of_gamut(tuple(F.col(n) for n in names)))


def cell(place: Column, size: Column, target: Column) -> Column:
    """The target cell of a pixel: cells begin at whole pixels, floor(i * size / target)."""
    return F.floor(((place + 1) * target - 1) / size)


def derivatives(light: DataFrame, sizes: tuple[int, ...] = SIZES, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """image, longest, x, y and encoded sRGB channels in 0..1 of every size, from one pass over linear pixels."""

    def at(longest: int) -> Column:
        s = fitted_size(F.col("width"), F.col("height"), longest)
        return F.struct(F.lit(longest).alias("longest"), cell(F.col("x"), F.col("width"), s["width"]).alias("x"), cell(F.col("y"), F.col("height"), s["height"]).alias("y"))

    each = light.select("image", F.explode(F.array(*map(at, sizes))).alias("c"), *names)
    means = each.groupBy("image", "c").agg(*[F.avg(n).alias(n) for n in names])
    clip = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return means.select("image", "c.longest", "c.x", "c.y", *[clip(encode(F.col(n))).alias(n) for n in names])


def gamut_share(light: DataFrame) -> DataFrame:
    """image, outside: the share of its pixels that sRGB can't show."""
    return light.groupBy("image").agg(F.avg(F.col("outside").cast("double")).alias("outside"))
