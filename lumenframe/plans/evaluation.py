"""Scores, distributions, curves, slices, comparisons, sampling, fits and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import evaluation, fitting
from lumenframe.operators.ranking import quantiles
from lumenframe.plans.registry import query
from lumenframe.plans.tables import pixels, table
from lumenframe.streaming.jobs import STATES

_SCORES_SQL = "scores AS (SELECT c_custkey AS reference, c_mktsegment AS label, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE abs(c_acctbal) / 500 END AS value, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal < 4000 END AS hit FROM customer)"


def scores(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("reference"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 11 != 0, F.abs("c_acctbal") / 500).alias("value"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal") < 4000).alias("hit")
    )


@query(f"""WITH {_SCORES_SQL} SELECT count(*) AS rows, round(avg(hit::INT::DOUBLE), 6) AS hit_rate, count(value) AS value_count, round(quantile_cont(value, 0.1), 6) AS value_p10, round(quantile_cont(value, 0.5), 6) AS value_median,
  round(avg(value), 6) AS value_mean, round(quantile_cont(value, 0.9), 6) AS value_p90, round(min(value), 6) AS value_min, round(max(value), 6) AS value_max FROM scores""")
def a13_arm_aggregate(spark, d):
    return evaluation.aggregate_arm(scores(spark, d))


@query(f"WITH {_SCORES_SQL} SELECT i * 0.5::DOUBLE AS threshold, round(avg((value < i * 0.5)::INT::DOUBLE), 6) AS rate FROM scores, range(1, 41) t(i) WHERE value IS NOT NULL GROUP BY i")
def a15_hit_curve(spark, d):
    return evaluation.hit_curve(scores(spark, d))


@query(f"WITH {_SCORES_SQL} SELECT label, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, count(*) < 30 AS indicative_only FROM scores WHERE label IS NOT NULL GROUP BY label")
def a16_score_slices(spark, d):
    return evaluation.slices(scores(spark, d), "label", "value")


@query(f"WITH {_SCORES_SQL} SELECT label, round(quantile_cont(CASE WHEN value > 0 THEN reference / value END - value, 0.5), 4) AS gap FROM scores GROUP BY label")
def a14_gap(spark, d):
    gap = evaluation.ratio(F.col("reference").cast("double"), F.col("value")) - F.col("value")
    rows = scores(spark, d).select("label", gap.alias("gap"))
    medians = quantiles(rows, "label", "gap", {"gap": 0.5}).select("label", F.round("gap", 4).alias("gap"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).join(medians, "label", "left").select("label", "gap")


_PAIRS_SQL = "p AS (SELECT o_orderkey AS reference, o_totalprice / 1000 AS x, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 1000 ELSE 150 + (o_custkey % 100) END AS y FROM orders)"


def _arms(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("reference"), (F.col("o_totalprice") / 1000).alias("x"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") / 1000).otherwise(150 + F.col("o_custkey") % 100).alias("y"))
    return o.select("reference", F.col("x").alias("value")), o.select("reference", F.col("y").alias("value"))


@query(f"""WITH {_PAIRS_SQL} SELECT count(*) AS n, count(*) FILTER (x < y) AS less, count(*) FILTER (x > y) AS more, count(*) FILTER (x = y) AS ties, round(avg(x - y), 6) AS mean, round(quantile_cont(x, 0.5), 6) AS left_median,
  (SELECT round(least(1.0::DOUBLE, 2 * sum(exp(lgamma(s.n + 1) - lgamma(i + 1) - lgamma(s.n - i + 1) - s.n * ln(2)))), 6)
   FROM (SELECT count(*) FILTER (x <> y) AS n, least(count(*) FILTER (x < y), count(*) FILTER (x > y)) AS k FROM p) s, range(0, 2000000) t(i) WHERE i <= s.k) AS p FROM p""")
def o5_paired_comparison(spark, d):
    r = evaluation.compare_arms(*_arms(spark, d), "reference", "value")
    return spark.createDataFrame([(r["n"], r["less"], r["more"], r["ties"], round(r["mean"], 6), round(r["left_median"], 6), round(r["p"], 6))], "n long, less long, more long, ties long, mean double, left_median double, p double")


#: Student's t for so many pairs, from the normal quantile by the series in 1 / df.
_T_SQL = "(z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2))"


@query(f"""WITH {_PAIRS_SQL}, s AS (SELECT avg(x - y) AS mean, stddev_samp(x - y) AS sd, count(*) AS n, CAST(count(*) - 1 AS DOUBLE) AS df, 1.959963984540054::DOUBLE AS z FROM p)
SELECT round(mean - {_T_SQL} * sd / sqrt(n), 5) AS lower, round(mean + {_T_SQL} * sd / sqrt(n), 5) AS upper FROM s""")
def o6_paired_interval(spark, d):
    r = evaluation.compare_arms(*_arms(spark, d), "reference", "value")
    return spark.createDataFrame([tuple(round(x, 5) for x in r["interval"])], "lower double, upper double")


@query("""WITH c AS (SELECT vec_id % 2 AS half, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
m AS (SELECT half, i, avg(x) AS mean, stddev_pop(x) AS deviation FROM c GROUP BY ALL)
SELECT CAST(a.i AS INTEGER) AS i, round(b.deviation / a.deviation, 5) AS ratio, round((b.mean - a.mean) / a.deviation, 5) AS shift FROM m a JOIN m b ON a.i = b.i AND a.half = 0 AND b.half = 1""")
def v12_scaling_drift(spark, d):
    x = table(spark, d, "embeddings").select((F.col("vec_id") % 2).alias("half"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    m = x.groupBy("half", "i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"))
    drift = evaluation.scaling_drift(m.where("half = 0"), m.where("half = 1"))
    return drift.select("i", F.round("ratio", 5).alias("ratio"), F.round("shift", 5).alias("shift"))


@query("""WITH e AS (SELECT l_orderkey AS g, l_linenumber AS k, l_discount AS x, l_tax AS y, l_quantity AS q, l_extendedprice AS p FROM lineitem)
SELECT a.g, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS mean, round(quantile_cont(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 0.5), 6) AS median
FROM e a JOIN e b ON a.g = b.g AND (a.k, a.q, a.p) < (b.k, b.q, b.p) GROUP BY a.g""")
def a26_pairwise_spread(spark, d):
    """An order has a handful of lines, so pairs inside it stay few."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("g"), F.struct("l_linenumber", "l_quantity", "l_extendedprice").alias("k"), F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    a, b = e.toDF("g", "k1", "x1", "y1"), e.toDF("g", "k2", "x2", "y2")
    away = F.sqrt((F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2")) + (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")))
    return a.join(b, "g").where("k1 < k2").withColumn("away", away).groupBy("g").agg(F.round(F.avg("away"), 6).alias("mean"), F.round(F.percentile("away", F.lit(0.5)), 6).alias("median"))


@query("""SELECT o_orderkey AS reference, round(min(abs(l_extendedprice - o_totalprice)), 4) AS closeness FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def a28_closeness(spark, d):
    j = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy(F.col("o_orderkey").alias("reference")).agg(F.round(F.min(F.abs(F.col("l_extendedprice") - F.col("o_totalprice"))), 4).alias("closeness"))


@query("SELECT o_orderkey AS reference, round(CASE WHEN o_totalprice - 200000 > 0 THEN o_custkey / (o_totalprice - 200000) END, 8) AS ratio FROM orders")
def a29_guarded_ratio(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("reference"), F.round(evaluation.ratio(F.col("o_custkey"), F.col("o_totalprice") - 200000), 8).alias("ratio"))


@query()
def o1_fit_recipe(spark, d):
    return fitting.fit_edits(pixels(spark, d)).select("image", F.round("exposure", 3).alias("exposure"), F.round("contrast", 1).alias("contrast"), F.round("error", 4).alias("error"), "message")


@query("""WITH s AS (SELECT event_id, user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 10 MINUTE THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 10 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, g""")
def z7_gesture_sessions(spark, d):
    """The batch form of the streaming query of the same kind (extension)."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    s = e.groupBy("user_id", F.session_window("ts", "10 minutes")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def z1_hourly_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("event_type", F.window("ts", "1 hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("window.start").alias("start"), "n", "total")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'failed' END AS status FROM events")
def st16_status_names(spark, d):
    status = F.lit(None).cast("string")
    for event, state in STATES.items():
        status = F.when(F.col("event_type") == event, state.lower()).otherwise(status)
    return table(spark, d, "events").select("event_id", status.alias("status"))


@query("""WITH e AS (SELECT l_suppkey AS k, l_shipdate AS t, l_extendedprice AS p FROM lineitem), o AS (SELECT l_suppkey AS k, max(l_shipdate) AS t FROM lineitem GROUP BY 1)
SELECT k, round(avg(p), 2) AS mean, count(*) AS n FROM e JOIN o USING (k) WHERE e.t >= o.t - INTERVAL 90 DAY GROUP BY k""")
def x2_recent_window(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("t"), F.col("l_extendedprice").alias("p"))
    last = e.groupBy("k").agg(F.max("t").alias("last"))
    return e.join(last, "k").where(F.col("t") >= F.col("last") - F.expr("INTERVAL 90 DAYS")).groupBy("k").agg(F.round(F.avg("p"), 2).alias("mean"), F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    """An extension: the reference has no grouping sets."""
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
