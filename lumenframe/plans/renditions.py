"""Renditions of stand-in images at several sizes, colours of a wide gamut, and commits of several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import derivatives
from lumenframe.operators.kept import new_path
from lumenframe.operators.ranking import placed
from lumenframe.plans.registry import query
from lumenframe.plans.tables import PIXELS_SQL, pixels, table
from lumenframe.streaming.durable import Ledger, outcomes

#: Width of the stand-in images, and their smaller sizes.
WIDTH, SIZES = 24, (7, 16)


def image_rows(spark, d):
    """Pixels of an image in the order of their places, row by row; the last row may be short."""
    p = pixels(spark, d).select("image", "r", "g", "b", F.struct("place", "r", "g", "b").alias("order"))
    rows = placed(p, "image", "order")
    return rows.select("image", (F.col("i") % WIDTH).cast("int").alias("x"), F.expr(f"cast(i div {WIDTH} as int)").alias("y"), F.lit(WIDTH).alias("width"), F.expr(f"cast((n + {WIDTH - 1}) div {WIDTH} as int)").alias("height"), "r", "g", "b")


ROWS_SQL = f"""{PIXELS_SQL},
placed AS (SELECT image, r, g, b, row_number() OVER (PARTITION BY image ORDER BY place, r, g, b) - 1 AS i, count(*) OVER (PARTITION BY image) AS n FROM pixels),
rows AS (SELECT image, i % {WIDTH} AS x, i // {WIDTH} AS y, {WIDTH} AS width, (n + {WIDTH - 1}) // {WIDTH} AS height, r, g, b FROM placed)"""
_DECODE = "CASE WHEN {0} <= 0.04045 THEN {0} / 12.92 ELSE pow(({0} + 0.055) / 1.055, 2.4) END"
_ENCODE = "round(greatest(0.0, least(1.0, CASE WHEN {0} <= 0.0031308 THEN {0} * 12.92 ELSE 1.055 * pow({0}, 1 / 2.4::DOUBLE) - 0.055 END)), 6)"
_FIT = "CASE WHEN longest >= greatest(width, height) THEN {0} ELSE greatest(1, CAST(round_even({0} * (longest::DOUBLE / greatest(width, height)), 0) AS BIGINT)) END"


@query(f"""WITH {ROWS_SQL}, light AS (SELECT image, x, y, width, height, {", ".join(f"{_DECODE.format(c)} AS {c}" for c in "rgb")} FROM rows),
sized AS (SELECT *, {_FIT.format("width")} AS w, {_FIT.format("height")} AS h FROM light, (SELECT unnest({list(SIZES)}) AS longest)),
cells AS (SELECT image, longest, ((x + 1) * w - 1) // width AS x, ((y + 1) * h - 1) // height AS y, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM sized GROUP BY image, longest, 3, 4)
SELECT image, longest, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, {", ".join(f"{_ENCODE.format(c)} AS {c}" for c in "rgb")} FROM cells""")
def p16_two_sizes(spark, d):
    """Both smaller sizes of every image, by area means along both axes in linear light, from one pass."""
    out = derivatives.derivatives(derivatives.linear(image_rows(spark, d), prophoto=False), SIZES)
    return out.select("image", "longest", "x", "y", *[F.round(c, 6).alias(c) for c in "rgb"])


_ROMM = "CASE WHEN {0} < 1.0::DOUBLE / 32 THEN {0} / 16 ELSE pow({0}, 1.8) END"
_MIXED = ", ".join(f"{' + '.join(f'({k!r}::DOUBLE) * l{c}' for k, c in zip(row, 'rgb', strict=True))} AS {n}" for n, row in zip("rgb", derivatives.ROMM_TO_RGB, strict=True))


@query(f"""WITH {PIXELS_SQL}, l AS (SELECT image, {", ".join(f"{_ROMM.format(c)} AS l{c}" for c in "rgb")} FROM pixels), m AS (SELECT image, {_MIXED} FROM l)
SELECT image, round(avg(r), 7) AS r, round(avg(g), 7) AS g, round(avg(b), 7) AS b, round(avg((least(r, g, b) < -1e-6 OR greatest(r, g, b) > 1 + 1e-6)::INT::DOUBLE), 7) AS outside FROM m GROUP BY image""")
def p14_prophoto_means(spark, d):
    """Mean linear sRGB of ProPhoto pixels, and the share of them that sRGB can't show."""
    light = derivatives.linear(pixels(spark, d).select("image", "r", "g", "b"), prophoto=True)
    return light.groupBy("image").agg(*[F.round(F.avg(c), 7).alias(c) for c in "rgb"], F.round(F.avg(F.col("outside").cast("double")), 7).alias("outside"))


_JOBS_SQL = "jobs AS (SELECT event_id, user_id, value, event_id % 4 AS delivery, CASE WHEN event_type = 'signup' THEN 'no result for ' || event_id END AS error FROM events)"


@query(f"""WITH {_JOBS_SQL} SELECT delivery AS commit, CASE WHEN error IS NULL THEN 'Done' ELSE 'Failed' END AS status, count(*) AS marks, count(*) FILTER (error IS NULL) AS results, round(coalesce(sum(value) FILTER (error IS NULL), 0), 4) AS total
FROM jobs WHERE delivery < 3 GROUP BY ALL""")
def z5_committed_results(spark, d):
    """Four deliveries of jobs are committed, results and marks together: the second twice, the fourth cut off before its mark. What readers see is each marked one once."""
    e = table(spark, d, "events")
    error = F.when(F.col("event_type") == "signup", F.concat(F.lit("no result for "), F.col("event_id").cast("string")))
    jobs = outcomes(e.select("event_id", "user_id", "value", (F.col("event_id") % 4).alias("delivery"), error.alias("error")))
    ledger = Ledger(new_path(spark, "ledger"))
    for number in (0, 1, 1, 2, 3):
        mine = jobs.where(F.col("delivery") == number)
        parts = {"results": mine.where("error is null").select("event_id", "value"), "states": mine.select("event_id", "status", "error")}
        ledger.write(number, parts)
        if number < 3:
            ledger.mark(spark, number, list(parts))
    states, results = ledger.read(spark, "states"), ledger.read(spark, "results")
    both = states.join(results.drop("commit"), "event_id", "left")
    return both.groupBy("commit", "status").agg(F.count("*").alias("marks"), F.count("value").alias("results"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))
