"""The colour algebra on arrays of pixels, for tasks that try many recipes on the same pixels.

It says the same as the column expressions of `colour`; tests hold the two against each other.
A recipe is a vector here: the ten sliders over their limits, in the order of SLIDERS, and where
the curve is fitted too, three fractions of the room that is left above each point.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np

from lumenframe.functions.colour import DECODE_AT, ENCODE_AT, GAMMA, LAB_DELTA, LUMA, OFFSET, RGB_TO_XYZ, SCALE, SLOPE, TABLE, WHITE, curve_table, curve_tangents, region_table, white_balance_factors

#: Group, name and limit of each slider, and the curve's inner places with the fractions of a straight line.
SLIDERS = (
    ("white_balance", "temperature", 100.0),
    ("white_balance", "tint", 100.0),
    ("tone", "exposure", 5.0),
    ("tone", "contrast", 100.0),
    ("tone", "highlights", 100.0),
    ("tone", "shadows", 100.0),
    ("tone", "whites", 100.0),
    ("tone", "blacks", 100.0),
    ("color", "saturation", 100.0),
    ("color", "vibrance", 100.0),
)
CURVE_X = (0.25, 0.5, 0.75)
STRAIGHT = (0.25, 1 / 3, 0.5)
_GRID = np.linspace(0, 1, TABLE)


def curve_points(fractions: np.ndarray) -> list[tuple[float, float]]:
    """Points that never fall: each lies the given fraction of the room left above the one before it."""
    y = 1 - np.cumprod(1 - np.clip(fractions, 0, 1))
    return [(0.0, 0.0), *zip(CURVE_X, y.tolist(), strict=True), (1.0, 1.0)]


def decode(x: np.ndarray) -> np.ndarray:
    return np.where(x <= DECODE_AT, x / SLOPE, ((np.maximum(x, 0) + OFFSET) / SCALE) ** GAMMA)


def encode(x: np.ndarray) -> np.ndarray:
    return np.where(x <= ENCODE_AT, x * SLOPE, SCALE * np.maximum(x, 0) ** (1 / GAMMA) - OFFSET)


def render(pixels: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """(n, 3) sRGB values after all steps of the recipe."""
    temperature, tint, stops, contrast, highlights, shadows, whites, blacks, saturation, vibrance = (v * limit for v, (_, _, limit) in zip(vector, SLIDERS, strict=False))
    x = encode(decode(pixels) * (np.array(white_balance_factors(temperature, tint)) * 2.0**stops))
    y = np.clip(x @ LUMA, 0, 1)
    x = x + np.interp(y, _GRID, region_table({"highlights": highlights, "shadows": shadows, "whites": whites, "blacks": blacks}))[:, None]
    inside = np.clip(x, 0, 1)
    x = x + contrast / 100 * (inside * inside * (3 - 2 * inside) - inside)
    if len(vector) > len(SLIDERS):
        x = np.interp(np.clip(x, 0, 1), _GRID, curve_table(curve_points(vector[len(SLIDERS) :])))
    y, most, least = x @ LUMA, x.max(1), x.min(1)
    weak = 1 - np.clip((most - least) / np.maximum(most, 1e-6), 0, 1)
    gain = np.maximum(-1.0, saturation / 100 + vibrance / 100 * weak)
    return np.clip(y[:, None] + (x - y[:, None]) * (1 + gain)[:, None], 0, 1)


def lab(pixels: np.ndarray) -> np.ndarray:
    """CIELAB, D65, of (n, 3) sRGB values."""
    t = decode(pixels) @ np.array(RGB_TO_XYZ).T / WHITE
    x, y, z = np.where(t > LAB_DELTA**3, np.cbrt(t), t / (3 * LAB_DELTA**2) + 4 / 29).T
    return np.stack((116 * y - 16, 500 * (x - y), 200 * (y - z)), 1)


def ciede2000(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The perceptual difference of (n, 3) CIELAB colours."""
    return _away(*one.T, *two.T)


def _seventh(x: np.ndarray) -> np.ndarray:
    cube = x * x * x
    return cube * cube * x


def _hue(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    h = np.degrees(np.arctan2(b, a))
    return np.where(h < 0, h + 360, h)


def _away(l1: np.ndarray, a1: np.ndarray, b1: np.ndarray, l2: np.ndarray, a2: np.ndarray, b2: np.ndarray) -> np.ndarray:
    far = 25.0**7
    s1, s2 = b1 * b1, b2 * b2
    mean7 = _seventh((np.sqrt(a1 * a1 + s1) + np.sqrt(a2 * a2 + s2)) / 2)
    stretch = 1.5 - 0.5 * np.sqrt(mean7 / (mean7 + far))
    p1, p2 = a1 * stretch, a2 * stretch
    c1, c2 = np.sqrt(p1 * p1 + s1), np.sqrt(p2 * p2 + s2)
    h1, h2 = _hue(b1, p1), _hue(b2, p2)
    product = c1 * c2
    grey, step, total = product == 0, h2 - h1, h1 + h2
    # the mean and the difference go the short way round
    wide = np.abs(step) > 180
    turn = np.where(grey, 0.0, np.where(wide, step - np.copysign(360.0, step), step))
    hue = np.where(grey, total, np.where(wide, (total + np.where(total < 360, 360.0, -360.0)) / 2, total / 2))
    off, chroma = np.square((l1 + l2) / 2 - 50), (c1 + c2) / 2
    angle = np.radians(hue)
    # cosines of multiples of the hue, from one cosine and one sine
    k1, j1 = np.cos(angle), np.sin(angle)
    k2, j2 = 2 * k1 * k1 - 1, 2 * k1 * j1
    k3, j3 = k2 * k1 - j2 * j1, j2 * k1 + k2 * j1
    k4, j4 = 2 * k2 * k2 - 1, 2 * k2 * j2
    turned = lambda k, j, degrees: k * math.cos(math.radians(degrees)) - j * math.sin(math.radians(degrees))
    t = 1 - 0.17 * turned(k1, j1, -30) + 0.24 * k2 + 0.32 * turned(k3, j3, 6) - 0.20 * turned(k4, j4, -63)
    bend = math.radians(60) * np.exp(-np.square((hue - 275) / 25))
    dl = (l2 - l1) / (1 + 0.015 * off / np.sqrt(20 + off))
    dc = (c2 - c1) / (1 + 0.045 * chroma)
    dh = 2 * np.sqrt(product) * np.sin(np.radians(turn) / 2) / (1 + 0.015 * chroma * t)
    chroma7 = _seventh(chroma)
    twist = -2 * np.sin(bend) * np.sqrt(chroma7 / (chroma7 + far))
    return np.sqrt(np.maximum(dl * dl + dc * dc + dh * dh + twist * dc * dh, 0))


class Pixels:
    """(n, 3) sRGB values beside their targets in CIELAB, for recipes that are tried one after the other.

    The first step of a recipe works on each channel alone, so it is computed for its distinct values.
    """

    def __init__(self, pixels: np.ndarray, target: np.ndarray):
        found = [np.unique(c, return_inverse=True) for c in pixels.T]
        self.linear, self.at = [decode(v) for v, _ in found], [i for _, i in found]
        self.target = target.T

    def differences(self, vector: np.ndarray, moves: np.ndarray | None = None) -> np.ndarray:
        """CIEDE2000 differences of the rendition by vector, one row; with moves, only those with each number of the vector moved in turn, a row for each.

        A number acts in one step, so the steps before it are computed once for all of them.
        """
        moved = [vector] if moves is None else [vector, *(vector + np.diag(moves))]
        of = lambda *numbers: [] if moves is None else [moved[1 + i] for i in numbers]
        gains = np.array([np.array(white_balance_factors(v[0] * 100, v[1] * 100)) * 2.0 ** (v[2] * 5) for v in [vector, *of(0, 1, 2)]])
        x = np.stack([encode(v * gains[:, i, None])[:, at] for i, (v, at) in enumerate(zip(self.linear, self.at, strict=True))])
        tables = np.array([region_table(dict(zip(("highlights", "shadows", "whites", "blacks"), v[4:8] * 100, strict=True))) for v in [vector, *of(4, 5, 6, 7)]])
        x = _extended(x, lambda x, table: x + _looked_up(np.clip(_luma(x), 0, 1), table), tables)
        x = _extended(x, _contrasted, [v[3] for v in [vector, *of(3)]])
        if len(vector) > len(SLIDERS):
            x = _extended(x, lambda x, table: _looked_up(np.clip(x, 0, 1), table), _curve_tables([v[len(SLIDERS) :] for v in [vector, *of(10, 11, 12)]]))
        x = _extended(x, _saturated, [v[8:10] for v in [vector, *of(8, 9)]])
        if moves is not None:
            order = [0, 1, 2, 4, 5, 6, 7, 3, *range(10, len(vector)), 8, 9]
            x = x[:, 1 + np.argsort(order)]
        # divided last, as in lab(): white is exactly without hue
        t = np.array(RGB_TO_XYZ) @ decode(x).reshape(3, -1) / np.array(WHITE)[:, None]
        fx, fy, fz = np.where(t > LAB_DELTA**3, np.cbrt(t), t / (3 * LAB_DELTA**2) + 4 / 29).reshape(x.shape)
        return _away(116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz), *self.target)


def _extended(x: np.ndarray, step, values) -> np.ndarray:
    """A step on all renditions (channel, rendition, pixel) by its first value, then on the first one by each of the others."""
    return np.concatenate([step(x, values[0]), *[step(x[:, :1], v) for v in values[1:]]], 1)


def _luma(x: np.ndarray) -> np.ndarray:
    return x[0] * LUMA[0] + x[1] * LUMA[1] + x[2] * LUMA[2]


def _looked_up(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Linear interpolation in a table over 0..1."""
    at = x * (TABLE - 1)
    low = np.minimum(at.astype(np.int64), TABLE - 2)
    return table[low] + (at - low) * np.diff(table)[low]


def _contrasted(x: np.ndarray, amount: float) -> np.ndarray:
    inside = np.clip(x, 0, 1)
    return x + amount * (inside * inside * (3 - 2 * inside) - inside)


def _saturated(x: np.ndarray, amounts: np.ndarray) -> np.ndarray:
    y, most, least = _luma(x), x.max(0), x.min(0)
    weak = 1 - np.clip((most - least) / np.maximum(most, 1e-6), 0, 1)
    return np.clip(y + (x - y) * (1 + np.maximum(-1.0, amounts[0] + amounts[1] * weak)), 0, 1)


@cache
def _curve_parts() -> np.ndarray:
    """What the height and the tangent at each point of a curve add to its table: its places don't change."""
    x = np.array((0.0, *CURVE_X, 1.0))
    i = np.clip(np.searchsorted(x, _GRID, "right") - 1, 0, len(x) - 2)
    h = np.diff(x)[i]
    t, at = (_GRID - x[i]) / h, np.arange(TABLE)
    out = np.zeros((2 * len(x), TABLE))
    out[i, at], out[i + 1, at] = (1 + 2 * t) * (1 - t) ** 2, t * t * (3 - 2 * t)
    out[len(x) + i, at], out[len(x) + i + 1, at] = h * t * (1 - t) ** 2, h * t * t * (t - 1)
    return out


def _curve_tables(fractions: list[np.ndarray]) -> np.ndarray:
    points = [curve_points(f) for f in fractions]
    return np.array([np.concatenate(([y for _, y in p], curve_tangents(p))) for p in points]) @ _curve_parts()
