"""Pixel queries: a pixel is a row."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.functions import colour
from lumenframe.plans.registry import query
from lumenframe.plans.tables import PIXELS_SQL, pixels


def _dec(x):
    return f"CASE WHEN {x} <= 0.04045 THEN {x} / 12.92 ELSE pow(({x} + 0.055) / 1.055, 2.4) END"


def _enc(x):
    return f"CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92 ELSE 1.055 * pow({x}, 1 / 2.4) - 0.055 END"


def _luma(r, g, b):
    return f"(0.2126 * {r} + 0.7152 * {g} + 0.0722 * {b})"


def _lab_sql(s, n):
    """CTE s_lab with L{n}, a{n}, b{n} columns from r, g, b of s."""
    return f"""lin{n} AS (SELECT *, {_dec('r' + n)} AS lr{n}, {_dec('g' + n)} AS lg{n}, {_dec('b' + n)} AS lb{n} FROM {s}),
xyz{n} AS (SELECT *, (0.4124564 * lr{n} + 0.3575761 * lg{n} + 0.1804375 * lb{n}) / 0.95047 AS x{n}, 0.2126729 * lr{n} + 0.7151522 * lg{n} + 0.0721750 * lb{n} AS y{n}, (0.0193339 * lr{n} + 0.1191920 * lg{n} + 0.9503041 * lb{n}) / 1.08883 AS z{n} FROM lin{n}),
f{n} AS (SELECT *, {', '.join(f"CASE WHEN {c}{n} > pow(6.0 / 29, 3) THEN cbrt({c}{n}) ELSE {c}{n} / (3 * pow(6.0 / 29, 2)) + 4.0 / 29 END AS f{c}{n}" for c in 'xyz')} FROM xyz{n}),
lab{n} AS (SELECT *, 116 * fy{n} - 16 AS la{n}, 500 * (fx{n} - fy{n}) AS aa{n}, 200 * (fy{n} - fz{n}) AS bb{n} FROM f{n})"""


_ROUND = "round({}, 6)"


def _channels():
    return colour.channels("r", "g", "b")


def _rgb(df, c=None):
    c = c or _channels()
    return df.select("image", "place", *[F.round(x, 6).alias(n) for x, n in zip(c, "rgb", strict=True)])


def _base(spark, sf_dir):
    return pixels(spark, sf_dir).select("image", "place", "r", "g", "b")


@query(f"WITH {PIXELS_SQL} SELECT image, place, " + ", ".join(f"round({_dec(c)}, 6) AS {c}" for c in "rgb") + " FROM pixels")
def p1_srgb_decode(spark, sf_dir):
    return _rgb(_base(spark, sf_dir), tuple(map(colour.decode, _channels())))


@query(f"WITH {PIXELS_SQL} SELECT image, place, " + ", ".join(f"round({_enc(c)}, 6) AS {c}" for c in "rgb") + " FROM pixels")
def p1_srgb_encode(spark, sf_dir):
    return _rgb(_base(spark, sf_dir), tuple(map(colour.encode, _channels())))


@query(f"WITH {PIXELS_SQL} SELECT image, place, round({_luma('r', 'g', 'b')}, 6) AS luma FROM pixels")
def p2_luma(spark, sf_dir):
    return _base(spark, sf_dir).select("image", "place", F.round(colour.luma(_channels()), 6).alias("luma"))


_WB = [f"pow(2.0, {e})" for e in ("1.5 * 0.4", "-1.5 * -0.2", "-1.5 * 0.4")]


@query(f"WITH {PIXELS_SQL}, k AS (SELECT {_luma(*_WB)} AS w) SELECT image, place, " + ", ".join(f"round({c} * {m} / w, 6) AS {c}" for c, m in zip("rgb", _WB, strict=True)) + " FROM pixels, k")
def p3_white_balance(spark, sf_dir):
    return _rgb(_base(spark, sf_dir), colour.white_balance(_channels(), 40, -20))


@query(f"WITH {PIXELS_SQL} SELECT image, place, " + ", ".join(f"round({c} * pow(2.0, 1.3), 6) AS {c}" for c in "rgb") + " FROM pixels")
def p4_exposure(spark, sf_dir):
    return _rgb(_base(spark, sf_dir), colour.exposure(_channels(), 1.3))


def _step(x, lo, hi):
    t = f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({x} - {lo}) / ({hi} - {lo})))"
    return f"({t} * {t} * (3 - 2 * {t}))"


@query(
    f"WITH {PIXELS_SQL}, y AS (SELECT image, place, {_luma('r', 'g', 'b')} AS y FROM pixels) SELECT image, place, round(1 - {_step('y', '0.0', '0.25')}, 6) AS blacks, round({_step('y', '0.0', '0.25')} * (1 - {_step('y', '0.25', '0.6')}), 6) AS shadows, "
    f"round({_step('y', '0.4', '0.75')} * (1 - {_step('y', '0.75', '1.0')}), 6) AS highlights, round({_step('y', '0.75', '1.0')}, 6) AS whites FROM y"
)
def p5_region_masks(spark, sf_dir):
    d = _base(spark, sf_dir).withColumn("y", colour.luma(_channels()))
    return d.select("image", "place", *[F.round(m, 6).alias(n) for n, m in colour.region_masks(F.col("y")).items()])


@query(
    f"""WITH y AS (SELECT i, i / 1023.0::DOUBLE AS y FROM range(1024) t(i)),
s AS (SELECT i, y, y + 0.25 * (-0.9 * {_step('y', '0.4', '0.75')} * (1 - {_step('y', '0.75', '1.0')}) + 1.0 * {_step('y', '0.0', '0.25')} * (1 - {_step('y', '0.25', '0.6')}) + -1.0 * {_step('y', '0.75', '1.0')} + 0.5 * (1 - {_step('y', '0.0', '0.25')})) AS v FROM y)
SELECT CAST(i AS INTEGER) AS i, round(max(v) OVER (ORDER BY i) - y, 6) AS shift FROM s"""
)
def p6_region_table(spark, sf_dir):
    """One table for a recipe, of fixed size; the running maximum keeps luma plus shift from falling."""
    table = colour.region_table({"highlights": -90, "shadows": 100, "whites": -100, "blacks": 50})
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(table)], "i int, v double").select("i", F.round("v", 6).alias("shift"))


@query(f"WITH {PIXELS_SQL} SELECT image, place, " + ", ".join(f"round({c} + 0.6 * ({c} * {c} * (3 - 2 * {c}) - {c}), 6) AS {c}" for c in "rgb") + " FROM pixels")
def p8_contrast(spark, sf_dir):
    return _rgb(_base(spark, sf_dir), colour.contrast(_channels(), 60))


@query(
    f"WITH {PIXELS_SQL}, y AS (SELECT *, {_luma('r', 'g', 'b')} AS y, greatest(-1.0::DOUBLE, 0.3 + -0.5 * (1 - (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b, 1e-6))) AS k FROM pixels) SELECT image, place, " + ", ".join(f"round(y + ({c} - y) * (1 + k), 6) AS {c}" for c in "rgb") + " FROM y"
)
def p10_saturation(spark, sf_dir):
    d = _base(spark, sf_dir).withColumn("y", colour.luma(_channels())).withColumn("k", colour.saturation_gain(_channels(), 30, -50))
    return _rgb(d, colour.scaled_about(_channels(), F.col("y"), F.col("k")))


RECIPE = {
    "white_balance": {"temperature": 20, "tint": -10},
    "tone": {"exposure": 0.5, "contrast": 25, "highlights": -40, "shadows": 30, "whites": 10, "blacks": -15},
    "color": {"saturation": 10, "vibrance": 20},
    "tone_curve": {"points": [[0, 0], [0.25, 0.2], [0.75, 0.82], [1, 1]]},
}


@query()
def p11_render(spark, sf_dir):
    """A whole recipe, a projection for each step; tests restate it in NumPy."""
    return _rgb(colour.render(_base(spark, sf_dir), RECIPE))


@query(f"WITH {PIXELS_SQL} SELECT image, place, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM pixels")
def p11_render_neutral(spark, sf_dir):
    return _rgb(colour.render(_base(spark, sf_dir), {}))


@query()
def p9_tone_curve(spark, sf_dir):
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(colour.curve_table(RECIPE["tone_curve"]["points"]))], "i int, value double")


@query(f"WITH {PIXELS_SQL}, {_lab_sql('pixels', '')} SELECT image, place, round(la, 5) AS l, round(aa, 5) AS a, round(bb, 5) AS b FROM lab")
def p12_lab(spark, sf_dir):
    d = colour.with_lab(_base(spark, sf_dir), ("r", "g", "b"), "x")
    return d.select("image", "place", F.round("x_L", 5).alias("l"), F.round("x_a", 5).alias("a"), F.round("x_b", 5).alias("b"))


def pair_sql(source, name="pixels"):
    """CTEs up to de (image, place, de), from the last table of source."""
    return f"""{source}, {_lab_sql(name, '')}, {_lab_sql('lab', '2')},
d0 AS (SELECT *, (sqrt(aa * aa + bb * bb) + sqrt(aa2 * aa2 + bb2 * bb2)) / 2 AS cm FROM lab2),
d1 AS (SELECT *, 1 + 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25.0, 7)))) AS g1 FROM d0),
d2 AS (SELECT *, sqrt(pow(aa * g1, 2) + bb * bb) AS c1, sqrt(pow(aa2 * g1, 2) + bb2 * bb2) AS c2, degrees(atan2(bb, aa * g1)) AS t1, degrees(atan2(bb2, aa2 * g1)) AS t2 FROM d1),
d3 AS (SELECT *, CASE WHEN t1 < 0 THEN t1 + 360 ELSE t1 END AS h1, CASE WHEN t2 < 0 THEN t2 + 360 ELSE t2 END AS h2, c1 * c2 = 0 AS grey FROM d2),
d4 AS (SELECT *, CASE WHEN grey THEN 0 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 WHEN h2 - h1 < -180 THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN grey THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm, (la + la2) / 2 AS lm, (c1 + c2) / 2 AS c3 FROM d3),
d5 AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) AS t,
  -sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * 2 * sqrt(pow(c3, 7) / (pow(c3, 7) + pow(25.0, 7))) AS rt FROM d4),
d6 AS (SELECT *, (la2 - la) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS u, (c2 - c1) / (1 + 0.045 * c3) AS v, 2 * sqrt(c1 * c2) * sin(radians(dh) / 2) / (1 + 0.015 * c3 * t) AS w FROM d5),
de AS (SELECT image, place, sqrt(u * u + v * v + w * w + rt * v * w) AS de FROM d6)"""


_PAIR = pair_sql(PIXELS_SQL)


def _pairs(spark, sf_dir):
    d = colour.with_lab(colour.with_lab(pixels(spark, sf_dir), ("r", "g", "b"), "x"), ("r2", "g2", "b2"), "y")
    return colour.with_ciede2000(d, "x", "y", "de").select("image", "place", "de")


@query(f"WITH {_PAIR} SELECT image, place, round(de, 4) AS de FROM de")
def p13_ciede2000(spark, sf_dir):
    return _pairs(spark, sf_dir).select("image", "place", F.round("de", 4).alias("de"))


@query(f"WITH {_PAIR} SELECT image, round(avg(de), 4) AS mean, round(quantile_cont(de, 0.5), 4) AS median, round(max(de), 4) AS worst, round(avg(CASE WHEN de > 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS beyond_1, round(avg(CASE WHEN de > 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS beyond_3 FROM de GROUP BY image")
def a36_image_difference(spark, sf_dir):
    share = lambda t: F.round(F.avg((F.col("de") > t).cast("double")), 6)
    return _pairs(spark, sf_dir).groupBy("image").agg(F.round(F.avg("de"), 4).alias("mean"), F.round(F.percentile("de", F.lit(0.5)), 4).alias("median"), F.round(F.max("de"), 4).alias("worst"), share(1).alias("beyond_1"), share(3).alias("beyond_3"))


_CUTS = (1, 10, 25, 50, 75, 90, 99)


@query(
    f"""WITH {PIXELS_SQL}, {_lab_sql('pixels', '')}, lim AS (SELECT image, quantile_cont(la, 0.25) AS lo, quantile_cont(la, 0.75) AS hi FROM lab GROUP BY image)
SELECT image, {', '.join(f"round(quantile_cont(la, {q / 100}), 4) AS p{q}" for q in _CUTS)}, round(avg(la), 4) AS l_mean, round(stddev_pop(la), 4) AS l_std, round(avg(aa), 4) AS a_mean, round(avg(bb), 4) AS b_mean,
  round(avg(sqrt(aa * aa + bb * bb)), 4) AS chroma_mean, round(quantile_cont(sqrt(aa * aa + bb * bb), 0.9), 4) AS chroma_p90,
  round(coalesce(avg(aa) FILTER (la <= lo), avg(aa)), 4) AS shadow_a, round(coalesce(avg(bb) FILTER (la <= lo), avg(bb)), 4) AS shadow_b,
  round(coalesce(avg(aa) FILTER (la >= hi), avg(aa)), 4) AS highlight_a, round(coalesce(avg(bb) FILTER (la >= hi), avg(bb)), 4) AS highlight_b FROM lab JOIN lim USING (image) GROUP BY image"""
)
def a37_colour_statistics(spark, sf_dir):
    d = colour.with_lab(_base(spark, sf_dir), ("r", "g", "b"), "x").select("image", F.col("x_L").alias("l"), F.col("x_a").alias("a"), F.col("x_b").alias("b"))
    lim = d.groupBy("image").agg(F.percentile("l", F.lit(0.25)).alias("lo"), F.percentile("l", F.lit(0.75)).alias("hi"))
    chroma = F.hypot("a", "b")
    part = lambda c, where: F.round(F.coalesce(F.avg(F.when(where, F.col(c))), F.avg(c)), 4)
    dark, bright = F.col("l") <= F.col("lo"), F.col("l") >= F.col("hi")
    return d.join(lim, "image").groupBy("image").agg(
        *[F.round(F.percentile("l", F.lit(q / 100)), 4).alias(f"p{q}") for q in _CUTS], F.round(F.avg("l"), 4).alias("l_mean"), F.round(F.stddev_pop("l"), 4).alias("l_std"), F.round(F.avg("a"), 4).alias("a_mean"), F.round(F.avg("b"), 4).alias("b_mean"),
        F.round(F.avg(chroma), 4).alias("chroma_mean"), F.round(F.percentile(chroma, F.lit(0.9)), 4).alias("chroma_p90"), part("a", dark).alias("shadow_a"), part("b", dark).alias("shadow_b"), part("a", bright).alias("highlight_a"), part("b", bright).alias("highlight_b"),
    )


@query(f"WITH {PIXELS_SQL} SELECT image, round(avg(CASE WHEN least(r * 1.2 - 0.05, g, b * 1.2) < -1e-6 OR greatest(r * 1.2 - 0.05, g, b * 1.2) > 1 + 1e-6 THEN 1.0::DOUBLE ELSE 0 END), 6) AS outside FROM pixels GROUP BY image")
def a39_out_of_gamut(spark, sf_dir):
    c = (F.col("r") * 1.2 - 0.05, F.col("g"), F.col("b") * 1.2)
    return pixels(spark, sf_dir).groupBy("image").agg(F.round(F.avg(colour.out_of_gamut(c).cast("double")), 6).alias("outside"))


@query(f"""WITH {PIXELS_SQL}, xy AS (SELECT image, place % 50 AS x, r, g, b FROM pixels)
SELECT image, CAST(((x + 1) * 7 - 1) // 50 AS BIGINT) AS cell, round(avg(r), 9) AS r, round(avg(g), 9) AS g, round(avg(b), 9) AS b FROM xy GROUP BY ALL""")
def p15_area_resample(spark, sf_dir):
    """Rows of 50 source pixels to 7 cells; every pixel counts in one cell, so partial means combine before the shuffle."""
    cell = colour.area_bin(F.col("place") % 50, 50, 7).alias("cell")
    return pixels(spark, sf_dir).groupBy("image", cell).agg(*[F.round(F.avg(c), 9).alias(c) for c in "rgb"])


@query(f"WITH {PIXELS_SQL} SELECT image, place, " + ", ".join(f"CAST(floor({c} * 255 + 0.5) AS INTEGER) AS {c}" for c in "rgb") + " FROM pixels")
def m5_quantise(spark, sf_dir):
    return pixels(spark, sf_dir).select("image", "place", *[F.floor(F.col(c) * 255 + 0.5).cast("int").alias(c) for c in "rgb"])


@query(f"WITH {_PAIR} SELECT image, place, round(least(1.0::DOUBLE, de / 10), 5) AS heat FROM de")
def p18_heat_map(spark, sf_dir):
    return _pairs(spark, sf_dir).select("image", "place", F.round(F.least(F.lit(1.0), F.col("de") / 10), 5).alias("heat"))


@query(f"WITH {PIXELS_SQL} SELECT image, place, round((r2 - r) / 2 + 0.5, 6) AS r, round((g2 - g) / 2 + 0.5, 6) AS g, round((b2 - b) / 2 + 0.5, 6) AS b FROM pixels")
def v11_difference_image(spark, sf_dir):
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return pixels(spark, sf_dir).select("image", "place", *[F.round(clip((F.col(f"{c}2") - F.col(c)) / 2 + 0.5), 6).alias(c) for c in "rgb"])
