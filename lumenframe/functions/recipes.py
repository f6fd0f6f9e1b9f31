"""Edit recipes: their schema, strict validation, canonical form and vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.colour import curve_at
from lumenframe.functions.vectors import euclidean

SCHEMA = "schema int, white_balance struct<temperature: double, tint: double>, tone struct<exposure: double, contrast: double, highlights: double, shadows: double, whites: double, blacks: double>, color struct<saturation: double, vibrance: double>, tone_curve struct<points: array<array<double>>>"
#: The keys of each group and the limit of each slider.
GROUPS = {"white_balance": ("temperature", "tint"), "tone": ("exposure", "contrast", "highlights", "shadows", "whites", "blacks"), "color": ("saturation", "vibrance"), "tone_curve": ("points",)}
LIMITS = {"exposure": 5.0}
LEAST_GAP = 1 / 1023
CURVE_AT = np.array([0.25, 0.5, 0.75])


def parsed(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


def _with_parsed(json: Column, of) -> Column:
    """of(recipe), with the recipe bound as a lambda's argument, so that a text is parsed once and not for each field."""
    return F.get(F.transform(F.array(parsed(json)), of), F.lit(0))


def slider(recipe: Column, group: str, key: str) -> Column:
    """A missing group or slider is neutral."""
    return F.coalesce(recipe[group][key], F.lit(0.0))


def sliders(recipe: Column) -> list[tuple[str, Column]]:
    return [(k, slider(recipe, g, k)) for g, keys in GROUPS.items() if g != "tone_curve" for k in keys]


def valid(json: Column) -> Column:
    """The whole contract: version 1 and present, no unknown key, sliders in range, a curve from 0 to 1 that strictly rises in x."""
    known = F.coalesce(F.size(F.array_except(F.json_object_keys(json), F.array(*map(F.lit, ("schema", *GROUPS))))) == 0, F.lit(False))
    for group, keys in GROUPS.items():
        inner = F.json_object_keys(F.get_json_object(json, f"$.{group}"))
        known = known & F.coalesce(F.size(F.array_except(inner, F.array(*map(F.lit, keys)))) == 0, F.lit(True))
    return known & _with_parsed(json, _in_range)


def _in_range(recipe: Column) -> Column:
    """Version 1, sliders in range, and the curve."""
    in_range = F.lit(True)
    for name, value in sliders(recipe):
        in_range = in_range & (F.abs(value) <= LIMITS.get(name, 100.0))
    points = recipe["tone_curve"]["points"]
    xs = F.transform(points, lambda p: F.get(p, F.lit(0)))
    gaps = F.zip_with(F.slice(xs, 2, F.size(xs)), F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a)
    curve = (F.size(points) >= 2) & (F.element_at(xs, 1) == 0) & (F.element_at(xs, -1) == 1) & F.forall(gaps, lambda g: g >= LEAST_GAP)
    return F.coalesce(recipe["schema"] == 1, F.lit(False)) & in_range & F.when(points.isNull(), True).otherwise(F.coalesce(curve, F.lit(False)))


def canonical(json: Column) -> Column:
    """Every key written, in the order of the schema."""
    return F.to_json(_with_parsed(json, _every_key))


def _every_key(recipe: Column) -> Column:
    group = lambda g: F.struct(*[slider(recipe, g, k).alias(k) for k in GROUPS[g]]).alias(g)
    straight = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))
    curve = F.struct(F.coalesce(recipe["tone_curve"]["points"], straight).alias("points")).alias("tone_curve")
    return F.struct(recipe["schema"].alias("schema"), group("white_balance"), group("tone"), group("color"), curve)


def neutral(json: Column) -> Column:
    recipe = parsed(json)
    out = F.lit(True)
    for _, value in sliders(recipe):
        out = out & (value == 0)
    points = recipe["tone_curve"]["points"]
    return out & (points.isNull() | (points == F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))))


def components(json: Column) -> Column:
    """Thirteen numbers: the ten sliders over their limits, and how far the curve, held in 0..1, lies off the diagonal at CURVE_AT. Null where points don't rise."""
    both = _with_parsed(json, lambda recipe: F.struct(F.array(*[v / LIMITS.get(k, 100.0) for k, v in sliders(recipe)]).alias("ten"), recipe["tone_curve"]["points"].alias("points")))
    points = both["points"]
    return F.concat(both["ten"], F.when(points.isNull(), F.array(*[F.lit(0.0)] * len(CURVE_AT))).otherwise(_off_diagonal(points)))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _off_diagonal(points: pd.Series) -> pd.Series:
    """A curve's tangents depend on each other one after the other, so this is computed in Arrow batches, once for each distinct curve of a batch."""
    known: dict = {None: None}
    keys = [None if p is None else tuple(tuple(map(float, x)) for x in p) for p in points]
    for key in set(keys) - {None}:
        x = [p[0] for p in key]
        rises = len(x) > 1 and all(b > a for a, b in zip(x, x[1:], strict=False))
        known[key] = (np.clip(curve_at(key, CURVE_AT), 0, 1) - CURVE_AT).tolist() if rises else None
    return pd.Series([known[k] for k in keys])


def recipe_distance(one: Column, two: Column) -> Column:
    """Euclidean distance over the thirteen numbers of two recipes."""
    return euclidean(components(one), components(two))
