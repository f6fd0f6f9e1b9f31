"""Colour expressions against published pairs and a NumPy restatement."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import colour
from lumenframe.plans.pixels import RECIPE

# Some of the published CIEDE2000 test pairs of Sharma, Wu and Dalal.
PAIRS = [
    (50.0, 2.6772, -79.7751, 50.0, 0.0, -82.7485, 2.0425),
    (50.0, 3.1571, -77.2803, 50.0, 0.0, -82.7485, 2.8615),
    (50.0, -1.3802, -84.2814, 50.0, 0.0, -82.7485, 1.0),
    (50.0, 0.0, 0.0, 50.0, -1.0, 2.0, 2.3669),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0009, 7.1792),
    (50.0, 2.49, -0.001, 50.0, -2.49, 0.0011, 7.2195),
    (50.0, -0.001, 2.49, 50.0, 0.0009, -2.49, 4.8045),
    (50.0, 2.5, 0.0, 50.0, 0.0, -2.5, 4.3065),
    (50.0, 2.5, 0.0, 73.0, 25.0, -18.0, 27.1492),
    (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644),
    (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373),
    (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082),
]


def test_published_pairs(spark):
    df = spark.createDataFrame(PAIRS, "x_L double, x_a double, x_b double, y_L double, y_a double, y_b double, want double")
    for one, two in (("x", "y"), ("y", "x")):
        assert all(abs(r.de - r.want) < 1e-4 for r in colour.with_ciede2000(df, one, two, "de").collect())


def numpy_render(p, recipe):
    wb, tone, col = recipe["white_balance"], recipe["tone"], recipe["color"]
    x = np.where(p <= 0.04045, p / 12.92, ((p + 0.055) / 1.055) ** 2.4)
    x = x * np.array(colour.white_balance_factors(wb["temperature"], wb["tint"])) * 2 ** tone["exposure"]
    x = np.where(x <= 0.0031308, x * 12.92, 1.055 * np.maximum(x, 0) ** (1 / 2.4) - 0.055)
    at = np.linspace(0, 1, 1024)
    y = x @ np.array(colour.LUMA)
    x = x + np.interp(np.clip(y, 0, 1), at, colour.region_table({k: tone[k] for k in ("highlights", "shadows", "whites", "blacks")}))[:, None]
    i = np.clip(x, 0, 1)
    x = x + tone["contrast"] / 100 * (i * i * (3 - 2 * i) - i)
    x = np.interp(np.clip(x, 0, 1), at, colour.curve_table(recipe["tone_curve"]["points"]))
    y = (x @ np.array(colour.LUMA))[:, None]
    p_ = np.clip((x.max(1) - x.min(1)) / np.maximum(x.max(1), 1e-6), 0, 1)
    gain = np.maximum(col["saturation"] / 100 + col["vibrance"] / 100 * (1 - p_), -1)[:, None]
    return np.clip(y + (x - y) * (1 + gain), 0, 1)


def test_render(spark):
    p = np.random.default_rng(4).random((300, 3))
    df = spark.createDataFrame([tuple(map(float, x)) for x in p], "r double, g double, b double").coalesce(1)
    got = np.array([tuple(r) for r in colour.render(df, RECIPE).collect()])
    assert np.abs(got - numpy_render(p, RECIPE)).max() < 1e-9
    assert colour.render(df, {}) is df
    pushed = colour.render(df, {"tone": {"exposure": 2.0, "contrast": 100}}).collect()
    assert all(0 <= v <= 1 for r in pushed for v in r)


def test_tables():
    flat = colour.curve_table([[0, 0], [1, 1]])
    assert np.abs(flat - np.linspace(0, 1, 1024)).max() < 1e-12
    steep = colour.curve_table([[0, 0], [0.1, 0.8], [0.2, 0.81], [1, 1]])
    assert (np.diff(steep) >= -1e-12).all()
    shift = colour.region_table({"highlights": -100, "whites": -100, "shadows": 100, "blacks": 100})
    assert (np.diff(np.linspace(0, 1, 1024) + shift) >= -1e-12).all()
    grey = np.array(colour.white_balance_factors(70, -30)) @ np.array(colour.LUMA)
    assert math.isclose(grey, 1)


@pytest.mark.parametrize(("size", "target"), [(50, 7), (7, 7), (89, 13), (10, 1)])
def test_area_bins(spark, size, target):
    got = [r[0] for r in spark.range(size).select(colour.area_bin(F.col("id"), size, target)).orderBy("id").collect()]
    edges = [i * size // target for i in range(target + 1)]
    assert got == [next(k for k in range(target) if edges[k] <= x < edges[k + 1]) for x in range(size)]
