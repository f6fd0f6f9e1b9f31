"""Whole fits of the stand-in images, their second pass, and vectors as recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import colour_arrays
from lumenframe.functions.recipes import components
from lumenframe.operators import recipe_fit
from lumenframe.operators.distinct import by_distinct
from lumenframe.operators.kept import kept
from lumenframe.plans.registry import query
from lumenframe.operators.ranking import numbered
from lumenframe.plans.tables import pixels, table

#: Rounds of the registered fits: enough for the order of the errors; recipe_fit.fit has more by default.
ROUNDS = 8


@query()
def o1_fit_whole_recipe(spark, d):
    """Ten sliders and the curve of every image, on the perceptual difference of all its pixels."""
    found = recipe_fit.fit(pixels(spark, d), rounds=ROUNDS)
    return found.select("image", F.round("error", 3).alias("error"), "pixels", F.size(recipe_fit.at_bounds(F.col("vector"))).alias("at_bounds"), "message")


def worst(fits, fraction: float = 0.05, above: float | None = None):
    """The images with the largest errors: those above a bound, or a fraction of all (one at least), by places over ranges."""
    known = fits.where(F.col("error").isNotNull()).select("image", "error")
    if above is not None:
        return known.where(F.col("error") > above)
    placed = numbered(known.withColumn("order", F.struct((-F.col("error")).alias("e"), "image")), "order")
    return placed.where(F.col("i") < max(1, int(known.count() * fraction))).select("image", "error")


@query()
def o4_refit_worst(spark, d):
    """The worst twentieth of the fits is searched again from six starts; the better fit stays."""
    p = pixels(spark, d)
    first = recipe_fit.fit(p, rounds=ROUNDS)
    chosen = kept(worst(first), "worst")
    out = recipe_fit.refit_worst(p, first, chosen, rounds=ROUNDS)
    return out.where("searched").select("image", F.round("error", 3).alias("error"), "pixels", "replaced")


_VECTOR_SQL = "v AS (SELECT p_partkey AS id, list_transform(range(13), lambda i: ((p_partkey * (i + 3)) % 241 - 120) / 100.0::DOUBLE) AS v FROM part)"


@query(f"""WITH {_VECTOR_SQL}, c AS (SELECT id, list_transform(v[1:10], lambda x: greatest(-1.0, least(1.0, x))) AS sliders, list_transform(v[11:13], lambda x: 1 - greatest(0.0, least(1.0, x))) AS room FROM v)
SELECT id, list_transform(sliders, lambda x: round(x, 6) + 0) AS sliders,
  [round(1 - room[1], 6), round(1 - room[1] * room[2], 6), round(1 - room[1] * room[2] * room[3], 6)] AS points FROM c""")
def o2_vectors_as_recipes(spark, d):
    """Vectors of sliders and curve fractions become recipes; sliders and curve points are read back from these."""
    n = len(colour_arrays.SLIDERS) + len(colour_arrays.CURVE_X)
    v = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col("p_partkey") * (i + 3) % 241 - 120) / F.lit(100.0))
    vectors = table(spark, d, "part").select(F.col("p_partkey").alias("id"), v.alias("v"))
    points = F.from_json(F.get_json_object("recipe", "$.tone_curve.points"), "array<array<double>>")
    back = F.transform(F.slice(components(F.col("recipe")), 1, len(colour_arrays.SLIDERS)), lambda x: F.round(x, 6) + 0)
    read = {"sliders": back, "points": F.transform(F.slice(points, 2, len(colour_arrays.CURVE_X)), lambda p: F.round(p[1], 6))}
    return by_distinct(by_distinct(vectors, "v", {"recipe": recipe_fit.recipe_of(F.col("v"))}), "recipe", read).select("id", *read)
