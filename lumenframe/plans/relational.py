"""Joins, filters, aggregates, windows, top-k, sets and writes over photos, edits, jobs and projects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators.ranking import numbered, placed, quantiles
from lumenframe.operators.upsert import deleted, improved, latest, pending, upserted
from lumenframe.plans.registry import query
from lumenframe.plans.tables import EDITS_SQL, edits, table

_VERSIONS = "versions AS (SELECT o_orderkey AS id, o_custkey AS project, o_orderdate AS created FROM orders)"


def _versions(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderdate").alias("created"))


@query("SELECT e.l_partkey AS photo, p.p_brand AS brand, count(*) AS n FROM lineitem e JOIN part p ON p.p_partkey = e.l_partkey AND e.l_returnflag <> 'R' GROUP BY ALL")
def j2_join_with_filter(spark, d):
    e = table(spark, d, "lineitem").where("l_returnflag <> 'R'")
    return e.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_partkey").alias("photo"), F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS project, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def j4_left_join_count(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("project")).agg(F.count("o_orderkey").alias("n"))


@query("""SELECT r_name AS region, n_name AS nation, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON n_regionkey = r_regionkey
JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def j5_multi_way_join(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("orders"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey AS project FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def j7_exists(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("c_custkey").alias("project"))


@query("SELECT o_orderkey AS id FROM orders a WHERE EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = a.o_custkey AND b.o_orderkey <> a.o_orderkey)")
def j9_shared_by_another(spark, d):
    """Another row of the same key exists: counted per key, where a self-join would emit all pairs of a hot key."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    many = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")).where("lo <> hi").select("o_custkey")
    return o.join(many, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("id"))


@query("SELECT c_custkey AS project FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j11_pending(spark, d):
    return pending(table(spark, d, "customer").select(F.col("c_custkey").alias("project")), _versions(spark, d), "project")


@query("""WITH a AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS k, c_acctbal * 0.9 AS v FROM customer WHERE c_custkey % 5 <> 0)
SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only FROM a FULL JOIN b ON a.k = b.k""")
def j14_paired_arms(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    a, b = c.where("k % 3 <> 0").withColumn("a", F.lit(1)), c.where("k % 5 <> 0").withColumn("b", F.lit(1))
    j = a.join(b, "k", "full_outer")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"))


@query(f"""WITH {EDITS_SQL} SELECT count(*) AS edits, count(*) FILTER (excluded) AS excluded, count(*) FILTER (fit_error > 50000) AS poor, count(DISTINCT photo) AS photos, count(*) FILTER (fit_error IS NULL) AS unfitted FROM edits""")
def a1_gate_counts(spark, d):
    return edits(spark, d).agg(F.count("*").alias("edits"), F.count_if("excluded").alias("excluded"), F.count_if(F.col("fit_error") > 50000).alias("poor"), F.countDistinct("photo").alias("photos"), F.count_if(F.col("fit_error").isNull()).alias("unfitted"))


@query("SELECT o_totalprice > 200000 AS dear, count(*) AS n FROM orders GROUP BY 1")
def a3_group_by_expression(spark, d):
    return table(spark, d, "orders").groupBy((F.col("o_totalprice") > 200000).alias("dear")).agg(F.count("*").alias("n"))


@query(f"""WITH {EDITS_SQL} SELECT p_partkey AS photo, count(edit) AS n, count(edit) FILTER (excluded) AS gone FROM part LEFT JOIN edits ON photo = p_partkey GROUP BY 1
HAVING count(edit) <> 5 OR count(edit) FILTER (excluded) > 2 OR max(fit_error) IS NULL""")
def a4_incomplete_photos(spark, d):
    j = table(spark, d, "part").join(edits(spark, d), F.col("photo") == F.col("p_partkey"), "left")
    g = j.groupBy(F.col("p_partkey").alias("photo")).agg(F.count("edit").alias("n"), F.count(F.when(F.col("excluded"), F.col("edit"))).alias("gone"), F.max("fit_error").alias("worst"))
    return g.where((F.col("n") != 5) | (F.col("gone") > 2) | F.col("worst").isNull()).drop("worst")


@query(f"WITH {EDITS_SQL} SELECT photo, count(*) AS n FROM edits WHERE NOT excluded GROUP BY photo HAVING count(*) >= 20")
def a5_eligible(spark, d):
    return edits(spark, d).where("not excluded").groupBy("photo").agg(F.count("*").alias("n")).where("n >= 20")


@query(f"WITH {EDITS_SQL} SELECT round(avg(fit_error), 2) AS mean, max(fit_error) AS worst, round(quantile_cont(fit_error, 0.5), 4) AS median, round(quantile_cont(fit_error, 0.9), 4) AS p90 FROM edits WHERE NOT excluded")
def a7_fit_error_summary(spark, d):
    """Percentiles interpolate between two places, found by counts over ranges: no task holds all values."""
    e = edits(spark, d).where("not excluded").select(F.lit(0).alias("g"), F.col("fit_error").alias("v"))
    q = quantiles(e, "g", "v", {"median": 0.5, "p90": 0.9})
    m = e.groupBy("g").agg(F.round(F.avg("v"), 2).alias("mean"), F.max("v").alias("worst"))
    return m.join(q, "g").select("mean", "worst", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))


@query(f"""WITH {EDITS_SQL}, r AS (SELECT expert, fit_error, row_number() OVER (PARTITION BY expert ORDER BY fit_error) - 1 AS i, count(*) OVER (PARTITION BY expert) AS n FROM edits)
SELECT expert, max(fit_error) FILTER (i = least(n - 1, floor(n * 0.5))) AS median, max(fit_error) FILTER (i = least(n - 1, floor(n * 0.9))) AS p90 FROM r GROUP BY expert""")
def a11_index_percentile(spark, d):
    """The value at place floor(n * f). Few experts hold all rows, so places come from counts over ranges of (expert, value)."""
    r = placed(edits(spark, d).select("expert", "fit_error"), "expert", "fit_error")
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("fit_error")))
    return r.groupBy("expert").agg(at(0.5).alias("median"), at(0.9).alias("p90"))


@query(f"WITH {EDITS_SQL} SELECT round(avg(fingerprint[1]), 6) AS quantity, round(avg(fingerprint[2]), 6) AS discount, round(avg(fingerprint[3]), 6) AS tax FROM edits WHERE photo % 10 <> 0 AND NOT excluded")
def a18_average_recipe(spark, d):
    e = edits(spark, d).where("photo % 10 <> 0 and not excluded")
    return e.agg(*[F.round(F.avg(F.col("fingerprint")[i]), 6).alias(n) for i, n in enumerate(("quantity", "discount", "tax"))])


@query("""SELECT c_mktsegment AS label, count(*) AS n, round(avg(c_acctbal), 4) AS mean, count(*) < 300 AS indicative_only FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def a16_slices(spark, d):
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isNotNull())
    return c.groupBy(F.col("c_mktsegment").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"), (F.count("*") < 300).alias("indicative_only"))


@query("""SELECT p, round(avg(CASE WHEN abs(v) >= 0.98 * lim THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM (
  SELECT 'quantity' AS p, l_quantity::DOUBLE AS v, 50.0 AS lim FROM lineitem UNION ALL SELECT 'discount', l_discount, 0.1 FROM lineitem UNION ALL SELECT 'tax', l_tax, 0.08 FROM lineitem) GROUP BY p""")
def a23_at_bounds(spark, d):
    long = table(spark, d, "lineitem").select(F.expr("stack(3, 'quantity', cast(l_quantity as double), 50.0D, 'discount', l_discount, 0.1D, 'tax', l_tax, 0.08D) as (p, v, lim)"))
    return long.groupBy("p").agg(F.round(F.avg((F.abs("v") >= F.col("lim") * 0.98).cast("double")), 6).alias("share"))


@query(f"WITH {_VERSIONS} SELECT project, id, printf('V%02d', row_number() OVER (PARTITION BY project ORDER BY created, id)) AS label FROM versions")
def w1_version_labels(spark, d):
    w = Window.partitionBy("project").orderBy("created", "id")
    return _versions(spark, d).select("project", "id", F.format_string("V%02d", F.row_number().over(w)).alias("label"))


@query(f"WITH {_VERSIONS} SELECT project, count(*) + 1 AS next FROM versions GROUP BY project")
def w2_next_position(spark, d):
    return _versions(spark, d).groupBy("project").agg((F.count("*") + 1).alias("next"))


@query(f"WITH {_VERSIONS} SELECT project, id FROM versions QUALIFY row_number() OVER (PARTITION BY project ORDER BY created DESC, id DESC) = 1")
def w3_latest_version(spark, d):
    """One aggregate with partial maxima instead of a window, so a hot project isn't gathered."""
    return _versions(spark, d).groupBy("project").agg(F.max(F.struct("created", "id"))["id"].alias("id"))


@query("""SELECT c_custkey AS project, coalesce(max(o_orderdate), TIMESTAMP '1970-01-01') AS changed, count(o_orderkey) AS versions FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def a31_project_list(spark, d):
    g = _versions(spark, d).groupBy("project").agg(F.max("created").alias("changed"), F.count("*").alias("versions"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project"))
    return c.join(g, "project", "left").select("project", F.coalesce("changed", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))).alias("changed"), F.coalesce("versions", F.lit(0)).alias("versions"))


@query("SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) = 1")
def w4_oldest_pending(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))


@query(f"""WITH {EDITS_SQL}, m AS (SELECT photo, edit, expert, fit_error, min(fit_error) OVER w AS lo, max(fit_error) OVER w AS hi FROM edits WINDOW w AS (PARTITION BY photo))
SELECT photo, edit, expert, round(CASE WHEN hi - lo <= 0 THEN 0.0::DOUBLE ELSE (fit_error - lo) / (hi - lo) END, 6) AS scaled FROM m""")
def w11_min_max_normalise(spark, d):
    e = edits(spark, d)
    lim = e.groupBy("photo").agg(F.min("fit_error").alias("lo"), F.max("fit_error").alias("hi"))
    span = F.col("hi") - F.col("lo")
    return e.join(lim, "photo").select("photo", "edit", "expert", F.round(F.when(span <= 0, 0.0).otherwise((F.col("fit_error") - F.col("lo")) / span), 6).alias("scaled"))


@query("""WITH r AS (SELECT c_mktsegment AS g, c_custkey AS k, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer)
SELECT g, k FROM r WHERE i IN (SELECT CAST(floor(j * n / 10.0) AS BIGINT) FROM range(10) t(j))""")
def w12_stratified_sample(spark, d):
    r = placed(table(spark, d, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("k")), "g", "k")
    # i is a chosen place if some j has floor(j * n / 10) = i
    j = F.ceil(F.col("i") * 10 / F.col("n"))
    return r.where((j < 10) & (F.floor(j * F.col("n") / 10) == F.col("i"))).select("g", "k")


@query("SELECT c_custkey AS k FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer) WHERE i % 7 = 0 ORDER BY i LIMIT 100")
def w13_global_stride(spark, d):
    """Places come from per-partition counts over a range partitioning, not from one global window."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return numbered(c, "k").where("i % 7 = 0 and i < 700").select("k")


@query("""WITH r AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS i, count(*) OVER () AS n FROM customer),
s AS (SELECT n, CASE WHEN n % 2999 = 0 THEN 2971 ELSE 2999 END AS step FROM r LIMIT 1)
SELECT o.i AS place, r.k FROM range((SELECT count(*) FROM customer)) o(i) JOIN s ON o.i < s.n JOIN r ON r.i = (o.i * s.step) % s.n""")
def w14_coprime_reorder(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    n = c.count()
    step = 2971 if n % 2999 == 0 else 2999
    back = pow(step, -1, n) if n > 1 else 0
    return numbered(c, "k").withColumn("place", F.pmod(F.col("i") * back, F.lit(max(n, 1)))).select("place", "k")


@query(f"""WITH {EDITS_SQL} (SELECT 'best' AS side, edit, photo, fit_error FROM edits ORDER BY fit_error, edit, photo LIMIT 10) UNION ALL (SELECT 'worst', edit, photo, fit_error FROM edits ORDER BY fit_error DESC, edit, photo LIMIT 10)""")
def w15_best_and_worst(spark, d):
    e = edits(spark, d).select("edit", "photo", "fit_error")
    best = e.orderBy("fit_error", "edit", "photo").limit(10).select(F.lit("best").alias("side"), "*")
    return best.unionAll(e.orderBy(F.col("fit_error").desc(), "edit", "photo").limit(10).select(F.lit("worst").alias("side"), "*"))


@query(f"WITH {EDITS_SQL} SELECT edit, photo, fit_error FROM edits ORDER BY fit_error, edit, photo LIMIT 1 OFFSET 1")
def t6_limit_offset(spark, d):
    return edits(spark, d).select("edit", "photo", "fit_error").orderBy("fit_error", "edit", "photo").offset(1).limit(1)


@query(f"""WITH {EDITS_SQL}, n AS (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) AS n FROM edits) SELECT edit, photo, fit_error FROM edits QUALIFY row_number() OVER (ORDER BY fit_error DESC, edit, photo) <= (SELECT n FROM n)""")
def f10_worst_fraction(spark, d):
    """By places over ranges, as a share of the table is too much for one task."""
    e = edits(spark, d).select("edit", "photo", "fit_error").withColumn("order", F.struct((-F.col("fit_error")).alias("e"), "edit", "photo"))
    return numbered(e, "order").where(F.col("i") < max(1, int(e.count() * 0.05))).select("edit", "photo", "fit_error")


@query("SELECT count(DISTINCT k) AS n FROM (SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 UNION SELECT o_custkey FROM orders)")
def s1_union_distinct(spark, d):
    a = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return a.union(table(spark, d, "orders").select("o_custkey")).distinct().agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def s3_intersection(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).intersect(table(spark, d, "orders").select("o_custkey"))


@query("SELECT 'left' AS side, k FROM (SELECT p_partkey AS k FROM part EXCEPT SELECT l_suppkey FROM lineitem) UNION ALL SELECT 'right', k FROM (SELECT l_suppkey AS k FROM lineitem EXCEPT SELECT p_partkey FROM part)")
def s4_differences(spark, d):
    a, b = table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k")).distinct()
    return a.join(b, "k", "left_anti").distinct().select(F.lit("left").alias("side"), "k").unionAll(b.join(a, "k", "left_anti").select(F.lit("right").alias("side"), "k"))


@query("""SELECT c_custkey AS k, CASE WHEN u.v IS NOT NULL THEN u.v ELSE c_acctbal END AS v, c_mktsegment AS tag FROM customer LEFT JOIN (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1) u ON u.k = c_custkey
UNION ALL SELECT k, v, 'new' FROM (SELECT o_custkey + 1000000 AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)""")
def snk3_upsert(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("tag"))
    u = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v")).withColumn("tag", F.lit("new"))
    return upserted(old, u.unionByName(u.withColumn("k", F.col("k") + 1000000)), ["k"], ["v"])


@query("SELECT p_partkey AS k, least(p_retailprice, CASE WHEN p_partkey % 2 = 0 THEN 1000.0::DOUBLE ELSE p_retailprice END) AS e, p_partkey % 2 = 0 AND 1000.0 < p_retailprice AS fresh FROM part")
def snk6_keep_better(spark, d):
    old = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("e"), F.lit(False).alias("fresh"))
    new = old.where("k % 2 = 0").select("k", F.lit(1000.0).alias("e"), F.lit(True).alias("fresh"))
    return improved(old, new, "k", "e")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def snk8_paired_delete(spark, d):
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("project"))
    return deleted(_versions(spark, d), gone, "project").select("id")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def a6_status_counts(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def z4_latest_state(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type"))["event_type"].alias("event_type"))


@query("SELECT event_id FROM events WHERE ts < (SELECT max(ts) - INTERVAL 15 MINUTE FROM events) AND event_type = 'click'")
def z3_stale_reclaim(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("last"))
    # one row
    return e.where("event_type = 'click'").join(F.broadcast(last)).where(F.col("ts") < F.col("last") - F.expr("INTERVAL 15 MINUTES")).select("event_id")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def f17_uniqueness_violations(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


@query("""SELECT CASE WHEN l_returnflag = 'R' THEN 'excluded' WHEN l_linestatus = 'F' THEN 'fitted' WHEN l_quantity < 5 THEN 'not downloaded' END AS reason, count(*) AS n FROM lineitem GROUP BY 1""")
def f7_skip_reasons(spark, d):
    reason = F.when(F.col("l_returnflag") == "R", "excluded").when(F.col("l_linestatus") == "F", "fitted").when(F.col("l_quantity") < 5, "not downloaded")
    return table(spark, d, "lineitem").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 = 0 ORDER BY c_custkey LIMIT 25")
def f6_filter_before_limit(spark, d):
    return table(spark, d, "customer").where("c_custkey % 3 = 0").orderBy("c_custkey").limit(25).select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))


@query("""SELECT c_custkey AS project, o_orderkey AS id FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) ON o_custkey = c_custkey""")
def j19_first_of_each(spark, d):
    first = latest(_versions(spark, d), "project", F.col("created"), F.col("id")).select("project", "id")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("project")).join(first, "project", "left")


@query("SELECT width_bucket AS bucket, n FROM (SELECT CAST(least(10, greatest(0, floor(l_extendedprice / 10000))) AS BIGINT) AS width_bucket, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)")
def x24_error_histogram(spark, d):
    bucket = F.least(F.lit(10), F.greatest(F.lit(0), F.floor(F.col("l_extendedprice") / 10000)))
    return table(spark, d, "lineitem").where("l_returnflag <> 'R'").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
