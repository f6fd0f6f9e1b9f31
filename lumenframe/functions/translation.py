"""One catalogue edit as a recipe, by translation alone.

Defined results: a setting that is missing, not a number or marked as unset is neutral; a missing
baseline gives no shift of white balance for its part; every slider is held within its limits.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.text import number, unquoted

#: The default white point, mired at full temperature, tint's and brightness's scales, and the lift's limit.
KELVIN, FULL_MIRED, TINT_SCALE, MIDTONE_SCALE, MOST_LIFT = 5500.0, 100.0, 100 / 150, 0.5 / 150, 0.45
#: The points of the two named curves.
STRAIGHT = ((0.0, 0.0), (0.5, 0.5), (1.0, 1.0))
MEDIUM = ((0.0, 0.0), (32 / 255, 22 / 255), (64 / 255, 56 / 255), (128 / 255, 128 / 255), (192 / 255, 196 / 255), (1.0, 1.0))
MEDIUM_NAME = "Medium Contrast"


def setting(settings: Column, key: str, default: float | Column = 0.0) -> Column:
    """A setting of a parsed text as a number."""
    raw = unquoted(F.try_element_at(settings, F.lit(key)))
    if isinstance(default, Column):
        found = number(raw, float("nan"))
        return F.when(F.isnan(found), default).otherwise(found)
    return F.coalesce(number(raw, default), F.lit(default))


def held(x: Column, limit: float = 100.0) -> Column:
    return F.greatest(F.lit(-limit), F.least(F.lit(limit), x))


def lifted(points: Column, lift: Column) -> Column:
    """Inner points raised by a tent that is highest at one half; the ends stay, and values stay in 0..1."""
    tent = lambda x: 1 - F.abs(2 * x - 1)
    up = lambda p: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(p, F.lit(1)) + lift * tent(F.get(p, F.lit(0)))))
    inner = lambda p: (F.get(p, F.lit(0)) > 0) & (F.get(p, F.lit(0)) < 1)
    return F.transform(points, lambda p: F.when(inner(p), F.array(F.get(p, F.lit(0)), up(p))).otherwise(p))


def curve(settings: Column) -> Column:
    """The named curve with the brightness as a lift of its middle."""
    of = lambda points: F.array(*[F.array(F.lit(x), F.lit(y)) for x, y in points])
    named = F.when(unquoted(F.try_element_at(settings, F.lit("ToneCurveName"))) == MEDIUM_NAME, of(MEDIUM)).otherwise(of(STRAIGHT))
    return lifted(named, held(setting(settings, "Brightness") * MIDTONE_SCALE, MOST_LIFT))


def translated(expert: Column, baseline: Column) -> Column:
    """A recipe (a struct in the order of its schema) from two parsed texts: the expert's, and the same photo's as shot."""
    kelvin = setting(expert, "Temperature", KELVIN)
    kelvin = F.when(kelvin == 0, KELVIN).otherwise(kelvin)
    shot = setting(baseline, "Temperature", kelvin)
    shot = F.when(shot == 0, kelvin).otherwise(shot)
    contrast = setting(expert, "Contrast")
    slider = lambda name, key, sign=1: held(sign * setting(expert, key)).alias(name)
    return F.struct(
        F.lit(1).alias("schema"),
        F.struct(
            # warmer is positive: the shift of mired, turned round
            held((1e6 / shot - 1e6 / kelvin) / FULL_MIRED * 100).alias("temperature"),
            held((setting(expert, "Tint") - setting(baseline, "Tint")) * TINT_SCALE).alias("tint"),
        ).alias("white_balance"),
        F.struct(
            held(setting(expert, "Exposure"), 5.0).alias("exposure"),
            # its range is -50 to 100, so the halves scale differently
            held(F.when(contrast >= 0, contrast).otherwise(contrast * 2)).alias("contrast"),
            slider("highlights", "HighlightRecovery", -1), slider("shadows", "FillLight"), F.lit(0.0).alias("whites"),
            # more of the catalogue's Shadows is a deeper black
            slider("blacks", "Shadows", -1),
        ).alias("tone"),
        F.struct(slider("saturation", "Saturation"), slider("vibrance", "Vibrance")).alias("color"),
        F.struct(curve(expert).alias("points")).alias("tone_curve"),
    )
