"""Full-size renditions as bytes, a band of rows at a time.

Every step of a rendition reads one pixel and writes it, so pixels are rendered where they are, and only
a band's bytes (rows * width * 3) ever meet in one task: an image of any height spreads over tasks.

Defined results: the bytes of an image's bands, one after the other, are the same for any number of rows
in a band; a missing pixel has no bytes; a null channel is written as 0; no image gives no band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import colour

ROWS = 256


def eight_bit(x: Column) -> Column:
    """0..1 as 0..255, halves upwards."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))) * 255 + 0.5).cast("int")


def rendered_bands(pixels: DataFrame, recipe: dict, rows: int = ROWS, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """image, band, top, height, data: 8-bit sRGB of each band, row by row; pixels: image, x, y and three channels of 0..255."""
    if rows < 1:
        raise ValueError(f"a band has at least one row, not {rows}")
    unit = pixels.select("image", "x", "y", *[(F.col(n) / 255).alias(n) for n in names])
    done = colour.render(unit, recipe, names)
    three = F.concat(*[F.lpad(F.hex(eight_bit(F.col(n)).cast("long")), 2, "0") for n in names])
    each = done.select("image", F.floor(F.col("y") / rows).alias("band"), F.struct("y", "x", three.alias("bytes")).alias("p"))
    bands = each.groupBy("image", "band").agg(F.array_sort(F.collect_list("p")).alias("p"))
    data = F.unhex(F.array_join(F.col("p.bytes"), ""))
    return bands.select("image", "band", (F.col("band") * rows).alias("top"), (F.element_at("p.y", -1) - F.col("band") * rows + 1).alias("height"), data.alias("data"))
