"""Whole fits: arrays against column expressions, known recipes found again, second passes, odd inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import colour, colour_arrays
from lumenframe.functions.recipes import valid
from lumenframe.operators import pieces, recipe_fit

RNG = np.random.default_rng(5)
SCHEMA = "image long, r double, g double, b double, r2 double, g2 double, b2 double"


def rows(image, pixels, vector):
    return [(image, *map(float, p), *map(float, q)) for p, q in zip(pixels, colour_arrays.render(pixels, np.array(vector)), strict=True)]


def test_arrays_say_the_same_as_columns(spark):
    vector = np.array([0.2, -0.3, 0.1, 0.4, -0.5, 0.3, 0.2, -0.4, 0.3, -0.6, 0.3, 0.4, 0.45])
    pixels = np.concatenate((RNG.random((300, 3)), [[0, 0, 0], [1, 1, 1], [0.5, 0.5, 0.5]]))
    recipe = json.loads(spark.range(1).select(recipe_fit.recipe_of(F.array(*map(F.lit, vector.tolist())))).first()[0])
    df = spark.createDataFrame([(i, *map(float, p), *map(float, p)) for i, p in enumerate(pixels)], "i long, r double, g double, b double, r1 double, g1 double, b1 double")
    df = colour.render(df, recipe)
    df = colour.with_ciede2000(colour.with_lab(colour.with_lab(df, ("r", "g", "b"), "one"), ("r1", "g1", "b1"), "two"), "one", "two", "away")
    got = np.array([tuple(r) for r in df.orderBy("i").select("r", "g", "b", "away").collect()])
    want = colour_arrays.render(pixels, vector)
    np.testing.assert_allclose(got[:, :3], want, atol=1e-9)
    np.testing.assert_allclose(got[:, 3], colour_arrays.ciede2000(colour_arrays.lab(want), colour_arrays.lab(pixels)), atol=1e-7)


def test_vectors_and_recipes(spark):
    df = spark.createDataFrame([([0.5] * 10,), ([2.0] * 10 + [0.0, 1.0, 0.5],), (None,)], "v array<double>").select(recipe_fit.recipe_of(F.col("v")).alias("j"), recipe_fit.at_bounds(F.col("v")).alias("at"))
    a, b, c = df.select("j", "at", valid(F.col("j")).alias("ok")).collect()
    assert json.loads(a.j)["tone"]["exposure"] == 2.5 and a.at == [] and a.ok
    np.testing.assert_allclose(json.loads(a.j)["tone_curve"]["points"], [[0, 0], [0.25, 0.25], [0.5, 0.5], [0.75, 0.75], [1, 1]])
    assert json.loads(b.j)["color"]["vibrance"] == 100 and len(b.at) == 10 and b.ok
    assert [p[1] for p in json.loads(b.j)["tone_curve"]["points"]] == [0, 0, 1, 1, 1]
    assert c.j is None


@pytest.fixture(scope="module")
def fits(spark):
    """Image 1: sliders; image 2: a curve too, over several pieces; 3: neutral; 4: lacks a channel; null: an image."""
    recipes = {1: [0.1, -0.1, 0.15, 0.3, 0, 0, 0, 0, 0.2, 0], 2: [0, 0, -0.1, 0, 0, 0, 0, 0, 0, 0.3, 0.2, 0.3, 0.6], 3: [0] * 10, None: [0, 0, 0.1, 0, 0, 0, 0, 0, 0, 0]}
    data = [r for image, v in recipes.items() for r in rows(image, RNG.random((5000 if image == 2 else 400, 3)), v)]
    df = spark.createDataFrame([*data, (4, 0.1, 0.2, None, 0.1, 0.2, 0.3), (4, *[0.5] * 6)], SCHEMA).repartition(3)
    return df, recipe_fit.fit(df, rounds=14)


def test_known_recipes_are_found(fits):
    _, found = fits
    got = {r.image: r for r in found.collect()}
    assert set(got) == {1, 2, 3, 4, None}
    assert all(got[i].error < 0.5 for i in (1, 2, 3, None))
    assert abs(got[1].vector[2] - 0.15) < 0.05 and (got[2].pixels, got[None].pixels) == (5000, 400)
    assert got[4].vector is None and got[4].message == "1 pixels lack a channel"


def test_error_is_over_every_pixel(fits):
    df, found = fits
    v = np.array(found.where("image = 2").first().vector)
    data = np.array([tuple(r)[1:] for r in df.where("image = 2").collect()])
    away = colour_arrays.ciede2000(colour_arrays.lab(colour_arrays.render(data[:, :3], v)), colour_arrays.lab(data[:, 3:]))
    assert found.where("image = 2").first().error == pytest.approx(away.mean(), abs=1e-6)


def test_second_pass(spark, fits):
    """Only chosen images are searched anew, and only a better fit replaces the first."""
    df, found = fits
    poor = found.withColumn("error", F.when(F.col("image") == 1, 9.0).otherwise(F.col("error") * 0)).where("image in (1, 3)")
    got = {r.image: r for r in recipe_fit.refit_worst(df, poor, spark.createDataFrame([(1,), (3,)], "image long"), starts=(0.05,), curve=False, rounds=12).collect()}
    assert got[1].replaced and got[1].error < 1 and got[3].searched and not got[3].replaced and got[3].error == 0
    assert recipe_fit.fit(df.limit(0)).count() == 0


def _tasks_of(monkeypatch, rows):
    monkeypatch.setattr(pieces, "TASK_ROWS", rows)


def test_whole_images_take_no_rounds(spark, monkeypatch):
    """Images inside a task are searched there, with what the rounds over pieces find; only those at its ends take rounds."""
    vectors = {i: [0.02 * i, -0.01 * i, 0.03 * i, 0.1, 0, 0, 0, 0, 0.1, 0] for i in range(7)}
    data = [r for i, v in vectors.items() for r in rows(i, RNG.random((60, 3)), v)]
    df = spark.createDataFrame([*data, (8, 0.1, 0.2, None, 0.1, 0.2, 0.3), (9, *[0.5] * 6)], SCHEMA).repartition(3)
    joined = []
    beside = recipe_fit._measured
    monkeypatch.setattr(recipe_fit, "_measured", lambda width: joined.append(width) or beside(width))
    one = {r.image: r for r in recipe_fit.fit(df, rounds=5).collect()}
    assert len(joined) == 5 and one[8].message == "1 pixels lack a channel" and len(one) == 9
    # at so few rows an image, or a task, none is whole
    monkeypatch.setattr(pieces, "PIECE", 20)
    many = {r.image: r for r in recipe_fit.fit(df, rounds=5).collect()}
    for i, r in one.items():
        assert (r.pixels, r.message) == (many[i].pixels, many[i].message)
        if r.vector:
            np.testing.assert_allclose(r.vector, many[i].vector, atol=1e-5)


def test_work_is_dealt_over_tasks(spark, monkeypatch):
    """The number of tasks goes by rows: small rows that take long aren't gathered in one."""
    df = spark.createDataFrame(rows(1, RNG.random((400, 3)), [0] * 10), SCHEMA)
    assert pieces.dealt(df).rdd.getNumPartitions() == 1
    _tasks_of(monkeypatch, 100)
    assert pieces.dealt(df).rdd.getNumPartitions() == 4


def test_moved_renditions_say_the_same(spark):
    """Renditions with each number moved in turn, from shared steps, are those that each vector has on its own."""
    pixels = np.concatenate((RNG.random((200, 3)), [[0, 0, 0], [1, 1, 1], [0.5, 0.5, 0.5]]))
    target = colour_arrays.lab(RNG.random((203, 3)))
    of = lambda v: colour_arrays.ciede2000(colour_arrays.lab(colour_arrays.render(pixels, v)), target)
    for width in (10, 13):
        at = np.concatenate((RNG.uniform(-0.6, 0.6, 10), RNG.random(3)))[:width]
        moves = np.where(np.arange(width) % 2, 3e-3, -3e-3)
        ready = colour_arrays.Pixels(pixels, target)
        np.testing.assert_allclose(ready.differences(at)[0], of(at), atol=1e-8)
        np.testing.assert_allclose(ready.differences(at, moves), [of(at + d) for d in np.diag(moves)], atol=1e-8)
