"""Colour algebra on rows: every step is per pixel, so a pixel is a row.

Single steps are column expressions over three channel columns. Chains (render, with_lab,
with_ciede2000) add a projection for each step, as one nested expression would repeat its inputs
over and over. Nothing is clipped before the last step of render(), so exposure may carry values
beyond white and back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of sRGB, Rec. 709 luma, D65 and CIELAB.
DECODE_AT, ENCODE_AT, SLOPE, OFFSET, SCALE, GAMMA = 0.04045, 0.0031308, 12.92, 0.055, 1.055, 2.4
LUMA = (0.2126, 0.7152, 0.0722)
RGB_TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
LAB_DELTA = 6 / 29
WARMTH, REGION = 1.5, 0.25
BLACKS_END, SHADOWS_END, HIGHLIGHTS_FROM, WHITES_FROM = 0.25, 0.60, 0.40, 0.75
TABLE = 1024


Channels = tuple[Column, Column, Column]


def channels(*names: str) -> Channels:
    return tuple(F.col(n).cast("double") for n in names)


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def decode(x: Column) -> Column:
    """sRGB to linear light, one channel."""
    return F.when(x <= DECODE_AT, x / SLOPE).otherwise(F.pow((x + OFFSET) / SCALE, F.lit(GAMMA)))


def encode(x: Column) -> Column:
    """Linear light to sRGB, one channel, not clipped."""
    return F.when(x <= ENCODE_AT, x * SLOPE).otherwise(SCALE * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / GAMMA)) - OFFSET)


def luma(c: Channels) -> Column:
    return c[0] * LUMA[0] + c[1] * LUMA[1] + c[2] * LUMA[2]


def white_balance_factors(temperature: float, tint: float) -> tuple[float, float, float]:
    """Channel factors in linear light that leave the luminance of grey as it is; both inputs -100 to 100."""
    t, u = temperature / 100, tint / 100
    raw = (2 ** (WARMTH * t), 2 ** (-WARMTH * u), 2 ** (-WARMTH * t))
    weight = sum(k * m for k, m in zip(LUMA, raw, strict=True))
    return tuple(m / weight for m in raw)


def white_balance(c: Channels, temperature: float, tint: float) -> Channels:
    return tuple(x * k for x, k in zip(c, white_balance_factors(temperature, tint), strict=True))


def exposure(c: Channels, stops: float) -> Channels:
    return tuple(x * (2.0**stops) for x in c)


def smoothstep(x: Column, lo: float, hi: float) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))
    return t * t * (3 - 2 * t)


def region_masks(y: Column) -> dict[str, Column]:
    """How far a luma belongs to each tonal region."""
    return {
        "blacks": 1 - smoothstep(y, 0.0, BLACKS_END),
        "shadows": smoothstep(y, 0.0, BLACKS_END) * (1 - smoothstep(y, BLACKS_END, SHADOWS_END)),
        "highlights": smoothstep(y, HIGHLIGHTS_FROM, WHITES_FROM) * (1 - smoothstep(y, WHITES_FROM, 1.0)),
        "whites": smoothstep(y, WHITES_FROM, 1.0),
    }


def contrast(c: Channels, amount: float) -> Channels:
    """Blend with x*x*(3-2x) inside 0..1; what lies outside is carried along."""
    k = amount / 100
    return tuple(x + k * (_unit(x) * _unit(x) * (3 - 2 * _unit(x)) - _unit(x)) for x in c)


def saturation_gain(c: Channels, saturation: float, vibrance: float) -> Column:
    """One gain for both sliders, never below -1; vibrance acts where colour is weak."""
    most, least = F.greatest(*c), F.least(*c)
    weak = 1 - _unit((most - least) / F.greatest(most, F.lit(1e-6)))
    return F.greatest(F.lit(-1.0), saturation / 100 + vibrance / 100 * weak)


def scaled_about(c: Channels, centre: Column, gain: Column) -> Channels:
    return tuple(centre + (x - centre) * (1 + gain) for x in c)


def lookup(x: Column, table: Sequence[float]) -> Column:
    """Linear interpolation in a table over 0..1; the index alone is clipped."""
    values = F.array(*[F.lit(float(v)) for v in table])
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * (len(table) - 1)
    low = F.least(F.floor(at), F.lit(len(table) - 2)).cast("int")
    return F.get(values, low) + (at - low) * (F.get(values, low + 1) - F.get(values, low))


def curve_tangents(points: Sequence[Sequence[float]]) -> np.ndarray:
    """Monotone cubic tangents: mean secants, then limited so that no segment overshoots."""
    x, y = np.array(points, float).T
    d = np.diff(y) / np.diff(x)
    m = np.concatenate((d[:1], (d[:-1] + d[1:]) / 2, d[-1:]))
    for i, s in enumerate(d):
        if s == 0:
            m[i] = m[i + 1] = 0.0
        else:
            size = math.hypot(m[i] / s, m[i + 1] / s)
            if size > 3:
                m[i] *= 3 / size
                m[i + 1] *= 3 / size
    return m


def curve_table(points: Sequence[Sequence[float]], size: int = TABLE) -> np.ndarray:
    """The tone curve through the points, sampled evenly."""
    return curve_at(points, np.linspace(0, 1, size))


def curve_at(points: Sequence[Sequence[float]], at: np.ndarray) -> np.ndarray:
    """The tone curve's values at some places."""
    x, y = np.array(points, float).T
    m = curve_tangents(points)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (at - x[i]) / h
    return y[i] * (1 + 2 * t) * (1 - t) ** 2 + h * m[i] * t * (1 - t) ** 2 + y[i + 1] * t * t * (3 - 2 * t) + h * m[i + 1] * t * t * (t - 1)


@cache
def _region_weights(size: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Even places over 0..1, and how far each belongs to each region."""
    y = np.linspace(0, 1, size)

    def step(lo, hi):
        t = np.clip((y - lo) / (hi - lo), 0, 1)
        return t * t * (3 - 2 * t)

    dark, bright = step(0, BLACKS_END), step(WHITES_FROM, 1)
    return y, {"blacks": 1 - dark, "shadows": dark * (1 - step(BLACKS_END, SHADOWS_END)), "highlights": step(HIGHLIGHTS_FROM, WHITES_FROM) * (1 - bright), "whites": bright}


def region_table(sliders: dict[str, float], size: int = TABLE) -> np.ndarray:
    """Shift of luma by the four regional sliders; luma plus shift never falls."""
    y, masks = _region_weights(size)
    shift = REGION * sum(masks[k] * v / 100 for k, v in sliders.items())
    return np.maximum.accumulate(y + shift) - y


def render(df: DataFrame, recipe: dict, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """All steps of a recipe in their order on three columns; a neutral step is left out, so a neutral recipe is the identity."""
    wb, tone, colour = recipe.get("white_balance", {}), recipe.get("tone", {}), recipe.get("color", {})
    points = recipe.get("tone_curve", {}).get("points", [[0, 0], [1, 1]])
    c = channels(*names)
    start = df

    def put(df: DataFrame, values: Channels) -> DataFrame:
        return df.withColumns(dict(zip(names, values, strict=True)))

    linear = any(wb.values()) or tone.get("exposure")
    if linear:
        df = put(df, tuple(map(decode, c)))
    if any(wb.values()):
        df = put(df, white_balance(c, wb.get("temperature", 0), wb.get("tint", 0)))
    if tone.get("exposure"):
        df = put(df, exposure(c, tone["exposure"]))
    if linear:
        df = put(df, tuple(map(encode, c)))
    regions = {k: tone[k] for k in ("highlights", "shadows", "whites", "blacks") if tone.get(k)}
    if regions:
        df = df.withColumn("_y", luma(c))
        df = df.withColumn("_shift", lookup(F.col("_y"), region_table(regions)))
        df = put(df, tuple(x + F.col("_shift") for x in c)).drop("_y", "_shift")
    if tone.get("contrast"):
        df = put(df, contrast(c, tone["contrast"]))
    if [[float(v) for v in p] for p in points] != [[0.0, 0.0], [1.0, 1.0]]:
        table = curve_table(points)
        df = put(df, tuple(lookup(x, table) for x in c))
    if any(colour.values()):
        df = df.withColumn("_y", luma(c)).withColumn("_gain", saturation_gain(c, colour.get("saturation", 0), colour.get("vibrance", 0)))
        df = put(df, scaled_about(c, F.col("_y"), F.col("_gain"))).drop("_y", "_gain")
    return put(df, tuple(map(_unit, c))) if df is not start else df


def with_lab(df: DataFrame, names: tuple[str, str, str], out: str) -> DataFrame:
    """df with {out}_L, {out}_a and {out}_b: CIELAB, D65, of sRGB columns."""
    lin, xyz, f = ([f"_{out}_{k}{i}" for i in range(3)] for k in ("lin", "xyz", "f"))
    df = df.withColumns({n: decode(x) for n, x in zip(lin, channels(*names), strict=True)})
    df = df.withColumns({n: sum((k * F.col(x) for k, x in zip(row, lin, strict=True)), F.lit(0.0)) / w for n, row, w in zip(xyz, RGB_TO_XYZ, WHITE, strict=True)})
    df = df.withColumns({n: F.when(F.col(t) > LAB_DELTA**3, F.cbrt(F.col(t))).otherwise(F.col(t) / (3 * LAB_DELTA**2) + 4 / 29) for n, t in zip(f, xyz, strict=True)})
    x, y, z = map(F.col, f)
    return df.withColumns({f"{out}_L": 116 * y - 16, f"{out}_a": 500 * (x - y), f"{out}_b": 200 * (y - z)}).drop(*lin, *xyz, *f)


def with_ciede2000(df: DataFrame, one: str, two: str, out: str) -> DataFrame:
    """df with the perceptual difference of the colours {one}_L, _a, _b and {two}_L, _a, _b."""
    before = df.columns
    (l1, a1, b1), (l2, a2, b2) = ([F.col(f"{n}_{k}") for k in "Lab"] for n in (one, two))
    t = lambda name: F.col(f"_{out}_{name}")

    def add(df: DataFrame, **cols: Column) -> DataFrame:
        return df.withColumns({f"_{out}_{n}": c for n, c in cols.items()})

    far, seven = 25.0**7, F.lit(7.0)
    df = add(df, cm=F.pow((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2, seven))
    df = add(df, stretch=1.5 - 0.5 * F.sqrt(t("cm") / (t("cm") + far)))
    df = add(df, p1=a1 * t("stretch"), p2=a2 * t("stretch"))
    hue = lambda b, a: F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0))
    df = add(df, c1=F.hypot(t("p1"), b1), c2=F.hypot(t("p2"), b2), h1=hue(b1, t("p1")), h2=hue(b2, t("p2")))
    df = add(df, grey=t("c1") * t("c2") == 0, step=t("h2") - t("h1"), total=t("h1") + t("h2"), off=(l1 + l2) / 2 - 50, chroma=(t("c1") + t("c2")) / 2)
    # hue differences wrap before the mean is taken, and a grey colour has no hue: the sum stands for the mean
    df = add(
        df,
        turn=F.when(t("grey"), 0.0).when(t("step") > 180, t("step") - 360).when(t("step") < -180, t("step") + 360).otherwise(t("step")),
        hue=F.when(t("grey"), t("total")).when(F.abs(t("step")) <= 180, t("total") / 2).when(t("total") < 360, (t("total") + 360) / 2).otherwise((t("total") - 360) / 2),
        c7=F.pow(t("chroma"), seven),
    )
    cosine = lambda k, shift: F.cos(F.radians(k * t("hue") + shift))
    df = add(df, t=1 - 0.17 * cosine(1, -30) + 0.24 * cosine(2, 0) + 0.32 * cosine(3, 6) - 0.20 * cosine(4, -63), bend=60 * F.exp(-F.pow((t("hue") - 275) / 25, F.lit(2.0))))
    df = add(
        df,
        dl=(l2 - l1) / (1 + 0.015 * t("off") * t("off") / F.sqrt(20 + t("off") * t("off"))),
        dc=(t("c2") - t("c1")) / (1 + 0.045 * t("chroma")),
        dh=2 * F.sqrt(t("c1") * t("c2")) * F.sin(F.radians(t("turn")) / 2) / (1 + 0.015 * t("chroma") * t("t")),
        twist=-F.sin(F.radians(t("bend"))) * 2 * F.sqrt(t("c7") / (t("c7") + far)),
    )
    return df.withColumn(out, F.sqrt(t("dl") * t("dl") + t("dc") * t("dc") + t("dh") * t("dh") + t("twist") * t("dc") * t("dh"))).select(*before, out)


def out_of_gamut(c: Channels, slack: float = 1e-6) -> Column:
    return (F.least(*c) < -slack) | (F.greatest(*c) > 1 + slack)


def area_bin(place: Column, size: int, target: int) -> Column:
    """The target cell of a source pixel: cells begin at floor(i * size / target)."""
    return F.floor(((place + 1) * target - 1) / size)
