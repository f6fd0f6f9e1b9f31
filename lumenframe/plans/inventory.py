"""Scans, guarded writes, summaries and formats of the inventory that the other modules don't hold."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import recipes
from lumenframe.functions.vectors import cosine_distance, standardised
from lumenframe.operators.kept import kept
from lumenframe.operators.upsert import deleted, improved, latest
from lumenframe.plans.registry import query
from lumenframe.operators.ranking import numbered, placed, quantiles
from lumenframe.plans.retrieval import _BATCH_SQL, neighbours
from lumenframe.plans.tables import EDITS_SQL, PHOTOS_SQL, edits, photos, table
from lumenframe.plans.text import _CURVE_OFF, _recipes

# ---- scans and joins


@query("SELECT c_name AS reference, n_name AS expert, c_mktsegment || ' = ' || c_acctbal::DECIMAL(18,2) AS raw FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = (SELECT max(r_name) FROM region)")
def src2_raw_text_scan(spark, d):
    """The settings' text of one collection, unparsed."""
    wanted = table(spark, d, "region").agg(F.max("r_name").alias("r_name"))
    r = table(spark, d, "region").join(F.broadcast(wanted), "r_name")  # one row
    n = table(spark, d, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_name").alias("reference"), F.col("n_name").alias("expert"), F.concat("c_mktsegment", F.lit(" = "), F.col("c_acctbal").cast("decimal(18,2)").cast("string")).alias("raw"))


@query("SELECT s_name AS reference, n_name AS file, CASE WHEN s_suppkey % 4 IN (1, 3) THEN 'portrait' ELSE 'landscape' END AS orientation FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def src3_orientation_scan(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    s = table(spark, d, "supplier").join(n, F.col("n_nationkey") == F.col("s_nationkey"))
    return s.select(F.col("s_name").alias("reference"), F.col("n_name").alias("file"), F.when((F.col("s_suppkey") % 4).isin(1, 3), "portrait").otherwise("landscape").alias("orientation"))


@query("SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_name LIKE 'Customer%1%' AND starts_with(c_name, 'Customer')")
def f9_prefix_like(spark, d):
    return table(spark, d, "customer").where(F.col("c_name").startswith("Customer") & F.col("c_name").like("Customer%1%")).select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))


@query("""SELECT k, n, name, value FROM (SELECT l_orderkey AS k, l_linenumber AS n, unnest(['discount', 'tax']) AS name, unnest([l_discount, l_tax]) AS value FROM lineitem) WHERE value <> 0""")
def f12_nonzero_readout(spark, d):
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), F.col(c).alias("value")) for name, c in (("discount", "l_discount"), ("tax", "l_tax"))])
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.explode(F.filter(pairs, lambda x: x["value"] != 0)).alias("x")).select("k", "n", "x.name", "x.value")


@query(f"WITH {EDITS_SQL} SELECT photo, expert, edit, fit_error, excluded, round(fingerprint[1] * 2, 6) AS first FROM edits")
def f13_pool_restamp(spark, d):
    """One field of every candidate is replaced, the others stay."""
    return edits(spark, d).withColumn("fingerprint", F.transform("fingerprint", lambda x: x * 2)).select("photo", "expert", "edit", "fit_error", "excluded", F.round(F.get("fingerprint", F.lit(0)), 6).alias("first"))


@query("""SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"project":{"id":' || o_custkey || ',"status":"' || o_orderstatus || '"}}' AS response FROM orders""")
def f15_response_struct(spark, d):
    project = F.struct(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("status")).alias("project")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), project)).alias("response"))


@query("SELECT n_name AS collection, s_name AS file FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 5 = 0")
def j6_left_join_nullable_text(spark, d):
    s = table(spark, d, "supplier").where("s_suppkey % 5 = 0")
    return table(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("n_name").alias("collection"), F.col("s_name").alias("file"))


@query("SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id)")
def j13_scores_with_labels(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", "lang", "quality")


@query("""WITH v AS (SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS version FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1), c AS (SELECT o_custkey AS k, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS choice FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS k, version, choice FROM customer LEFT JOIN v ON v.k = c_custkey LEFT JOIN c ON c.k = c_custkey""")
def j20_latest_version_and_choice(spark, d):
    """One aggregate finds both latest rows of a project."""
    at = F.struct("o_orderdate", "o_orderkey")
    last = lambda cond: F.max_by(F.when(cond, F.col("o_orderkey")), F.when(cond, at))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(last(F.col("o_orderstatus") != "F").alias("version"), last(F.col("o_orderstatus") == "F").alias("choice"))
    return table(spark, d, "customer").join(o, "c_custkey", "left").select(F.col("c_custkey").alias("k"), "version", "choice")


@query(f"WITH {_BATCH_SQL} SELECT DISTINCT near.photo, category FROM near JOIN embeddings ON vec_id = near.photo JOIN (SELECT vec_id AS v, label AS category FROM embeddings) ON v = near.photo")
def s7_probe_union(spark, d):
    """The union of all pools' photos, each once, with its row."""
    wanted = neighbours(spark, d).select("photo").distinct()
    return photos(spark, d).join(wanted, "photo", "left_semi").select("photo", "category")


@query("SELECT vec_id AS photo, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings WHERE label = 3")
def v9_vectors_required(spark, d):
    """A photo without a vector stops the query; it never counts as zeros."""
    p = photos(spark, d)
    wanted = p.where("category = 3").select("photo")
    joined = wanted.join(p.select("photo", "vector"), "photo", "left")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return joined.select("photo", F.when(F.col("vector").isNull(), F.raise_error(F.concat(F.lit("no vector for "), F.col("photo").cast("string"))).cast("double")).otherwise(F.round(total, 5)).alias("total"))


@query(f"""WITH {PHOTOS_SQL}, f AS (SELECT vector AS a, list_transform(vector, lambda x: round(x, 3)) AS b FROM photos),
c AS (SELECT 1 - list_inner_product(a, b) / (sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b))) AS x FROM f) SELECT round(max(x), 9) AS worst, round(avg(x), 9) AS mean FROM c""")
def v14_reencoded_drift(spark, d):
    """Distances of stored vectors to fresh ones."""
    p = photos(spark, d).withColumn("fresh", F.transform("vector", lambda x: F.round(x, 3)))
    x = cosine_distance(F.col("vector"), F.col("fresh"))
    return p.select(x.alias("x")).agg(F.round(F.max("x"), 9).alias("worst"), F.round(F.avg("x"), 9).alias("mean"))


# ---- vectors of recipes and images

_THIRTEEN = f"[(q % 12) / 5.0, q * 3 / 100.0] || CASE WHEN q % 7 = 1 THEN [{', '.join(_CURVE_OFF)}] ELSE [0.0, 0.0, 0.0] END"
_QS = "qs AS (SELECT DISTINCT CAST(trunc(l_quantity) AS INTEGER) AS q FROM lineitem)"


@query(f"""WITH {_QS}, r AS (SELECT q, list_transform({_THIRTEEN}, lambda x: CAST(x AS DOUBLE)) AS v FROM qs WHERE q % 7 NOT IN (0, 2))
SELECT a.q, round(sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2)))), 6) AS distance FROM r a JOIN r b ON b.q = a.q + 1""")
def v8_recipe_distance(spark, d):
    """Distance of each recipe to the next one, over the thirteen numbers."""
    r = _recipes(spark, d).where("q % 7 not in (0, 2)").select("q", "recipe").distinct()
    after = r.select((F.col("q") - 1).alias("q"), F.col("recipe").alias("other"))
    return r.join(after, "q").select("q", F.round(recipes.recipe_distance(F.col("recipe"), F.col("other")), 6).alias("distance"))


@query(f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id AS photo, 30 AS width, round(list_sum(v[1:13]) + list_sum(v[14:30]) - list_sum(v[31:47]), 5) AS total FROM e""")
def v7_raw_fingerprint(spark, d):
    """Thirteen numbers and the difference of seventeen statistics, after less before; another width stops the query (V7, X10, X11)."""
    after, before = F.slice("vector", 14, 17), F.slice("vector", 31, 17)
    p = photos(spark, d).withColumn("raw", F.concat(F.slice("vector", 1, 13), F.zip_with(after, before, lambda a, b: a - b)))
    total = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x)
    return p.select("photo", F.size("raw").alias("width"), F.when(F.size("raw") == 30, F.round(total, 5)).otherwise(F.raise_error(F.lit("expected 30 numbers")).cast("double")).alias("total"))


@query("""WITH c AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS dev FROM c GROUP BY i)
SELECT vec_id AS photo, round(sum((x - mean) / CASE WHEN dev = 0 THEN 1 ELSE dev END), 4) AS total FROM c JOIN m USING (i) GROUP BY vec_id""")
def x12_scaling_applied(spark, d):
    """Each vector standardised by constants of its width; another width stops the query."""
    p = photos(spark, d)
    c = p.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))
    # one row of constants
    one = c.agg(F.array_sort(F.collect_list(F.struct("i", "mean", F.when(F.col("dev") == 0, 1.0).otherwise(F.col("dev")).alias("dev")))).alias("c")).select(F.col("c.mean").alias("mean"), F.col("c.dev").alias("dev"))
    total = F.aggregate(standardised(F.col("vector"), F.col("mean"), F.col("dev")), F.lit(0.0), lambda s, x: s + x)
    return p.join(F.broadcast(one)).select("photo", F.when(F.size("vector") == F.size("mean"), F.round(total, 4)).otherwise(F.raise_error(F.lit("another width than the constants")).cast("double")).alias("total"))


# ---- summaries


@query("SELECT event_type AS stage, round(quantile_cont(value, 0.5), 5) AS median, round(avg(value), 5) AS mean, round(quantile_cont(value, 0.95), 5) AS p95, round(max(value), 5) AS worst FROM events GROUP BY 1")
def a10_latency_summary(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), "value")
    q = quantiles(e, "stage", "value", {"median": 0.5, "p95": 0.95})
    m = e.groupBy("stage").agg(F.round(F.avg("value"), 5).alias("mean"), F.round(F.max("value"), 5).alias("worst"))
    return m.join(q, "stage").select("stage", F.round("median", 5).alias("median"), "mean", F.round("p95", 5).alias("p95"), "worst")


@query("SELECT l_returnflag AS flag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, max(l_extendedprice) AS worst FROM lineitem GROUP BY 1")
def a12_tail_percentiles(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("v"))
    q = quantiles(e, "flag", "v", {"median": 0.5, "p90": 0.9, "p99": 0.99})
    worst = e.groupBy("flag").agg(F.max("v").alias("worst"))
    return worst.join(q, "flag").select("flag", *[F.round(c, 4).alias(c) for c in ("median", "p90", "p99")], "worst")


@query("""WITH s AS (SELECT l_returnflag AS flag, (l_extendedprice - l_extendedprice * (1 - l_discount)) / l_extendedprice AS share FROM lineitem WHERE l_extendedprice > 0),
r AS (SELECT flag, share, row_number() OVER (PARTITION BY flag ORDER BY share) - 1 AS i, count(*) OVER (PARTITION BY flag) AS n FROM s)
SELECT flag, round(avg(share), 6) AS mean, round(max(share) FILTER (i = least(n - 1, floor(n * 0.5))), 6) AS median FROM r GROUP BY flag""")
def a24_curve_share(spark, d):
    """What a curve adds: the share of the error that goes with it, mean and index median."""
    one, two = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    s = table(spark, d, "lineitem").where("l_extendedprice > 0").select(F.col("l_returnflag").alias("flag"), ((one - two) / one).alias("share"))
    middle = F.max(F.when(F.col("i") == F.least(F.col("n") - 1, F.floor(F.col("n") * 0.5)), F.col("share")))
    return placed(s, "flag", "share").groupBy("flag").agg(F.round(F.avg("share"), 6).alias("mean"), F.round(middle, 6).alias("median"))


@query("""WITH s AS (SELECT l_returnflag AS probe, l_discount AS v, l_discount > 0.05 AS curve, 1 - l_discount / 0.1 AS explained FROM lineitem)
SELECT probe, count(*) AS n, round(avg(v), 3) AS mean, round(quantile_cont(v, 0.5), 3) AS median, round(quantile_cont(v, 0.9), 3) AS p90, round(min(v), 3) AS least, round(max(v), 3) AS most, round(avg(explained), 3) AS explained FROM s GROUP BY 1""")
def x22_probe_summary(spark, d):
    s = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("probe"), F.col("l_discount").alias("v"))
    m = s.groupBy("probe").agg(F.count("*").alias("n"), F.round(F.avg("v"), 3).alias("mean"), F.round(F.min("v"), 3).alias("least"), F.round(F.max("v"), 3).alias("most"), F.round(F.avg(1 - F.col("v") / 0.1), 3).alias("explained"))
    q = quantiles(s, "probe", "v", {"median": 0.5, "p90": 0.9})
    return m.join(q, "probe").select("probe", "n", "mean", F.round("median", 3).alias("median"), F.round("p90", 3).alias("p90"), "least", "most", "explained")


@query("SELECT user_id, count(*) AS items, round(epoch(max(ts)) - epoch(min(ts)), 3) AS seconds, round(5000 / (count(*) / greatest(1e-9, epoch(max(ts)) - epoch(min(ts)))), 3) AS projected FROM events GROUP BY user_id")
def x19_projection(spark, d):
    """What a corpus of 5000 would take at the measured rate."""
    at = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    seconds = at(F.max("ts")) - at(F.min("ts"))
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("items"), F.round(seconds, 3).alias("seconds"), F.round(5000 / (F.count("*") / F.greatest(F.lit(1e-9), seconds)), 3).alias("projected"))


@query("""WITH s AS (SELECT l_shipdate, l_linenumber % 5 AS arm, l_extendedprice AS closeness, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_discount > 0.04 END AS hit FROM lineitem)
SELECT arm, count(*) AS rows, round(avg(CAST(hit AS INTEGER)), 6) AS hit_rate, round(avg(closeness), 4) AS mean, round(min(closeness), 4) AS least, round(max(closeness), 4) AS most FROM s GROUP BY arm""")
def o14_reaggregated(spark, d):
    """Scores are stored row by row; the report comes from the stored rows, without another run."""
    hit = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount") > 0.04)
    stored = kept(table(spark, d, "lineitem").select((F.col("l_linenumber") % 5).alias("arm"), F.col("l_extendedprice").alias("closeness"), hit.alias("hit")), "scores")
    return stored.groupBy("arm").agg(F.count("*").alias("rows"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("hit_rate"), *[F.round(f("closeness"), 4).alias(n) for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))])


@query(f"""WITH {EDITS_SQL}, n AS (SELECT greatest(1, CAST(floor(count(*) * 0.05) AS BIGINT)) AS n FROM edits), w AS (SELECT * FROM edits QUALIFY row_number() OVER (ORDER BY fit_error DESC, edit, photo) <= (SELECT n FROM n))
SELECT count(*) AS chosen, count(*) FILTER (expert % 2 = 0) AS replaced, round(sum(CASE WHEN expert % 2 = 0 THEN fit_error * 0.9 ELSE fit_error END), 2) AS total FROM w""")
def o4_second_pass(spark, d):
    """The worst twentieth is fitted anew; the better fit of each stays, the stored one in a tie."""
    e = edits(spark, d).select("edit", "photo", "expert", "fit_error")
    placed = numbered(e.withColumn("order", F.struct((-F.col("fit_error")).alias("e"), "edit", "photo")), "order")
    worst = kept(placed.where(F.col("i") < max(1, int(e.count() * 0.05))).withColumnRenamed("i", "row").drop("order"), "worst")
    again = worst.withColumn("fit_error", F.when(F.col("expert") % 2 == 0, F.col("fit_error") * 0.9).otherwise(F.col("fit_error") * 1.1))
    best = improved(worst, again, "row", "fit_error").withColumnRenamed("fit_error", "best")
    both = worst.join(best.select("row", "best"), "row")
    return both.agg(F.count("*").alias("chosen"), F.count_if(F.col("best") < F.col("fit_error")).alias("replaced"), F.round(F.sum("best"), 2).alias("total"))


# ---- writes with guards, as snapshots


@query("SELECT o_orderkey AS id, EXISTS (FROM lineitem WHERE l_orderkey = o_orderkey) AS done FROM orders")
def snk4_results_and_marks(spark, d):
    """One write holds a job's result and its mark: done is derived from the result being there, so neither is without the other."""
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("done", F.lit(True))
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return kept(jobs.join(results, "id", "left").select("id", F.coalesce("done", F.lit(False)).alias("done")), "results")


@query("SELECT vec_id AS photo, round(CASE WHEN label = 2 THEN -1 ELSE 1 END * embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def snk7_vector_update(spark, d):
    """New vectors replace stored ones; one that meets no row, or several, stops the write."""
    p = photos(spark, d).select("photo", "vector", "category")
    new = p.where("category = 2").select("photo", F.transform("vector", lambda x: -x).alias("new"))
    met = new.join(p.groupBy("photo").agg(F.count("*").alias("n")), "photo", "left")
    sure = F.when(F.coalesce("n", F.lit(0)) == 1, F.col("new")).otherwise(F.raise_error(F.lit("a vector must meet one row")).cast("array<double>"))
    out = p.join(met.select("photo", sure.alias("new")), "photo", "left")
    return out.select("photo", F.round(F.get(F.coalesce("new", "vector"), F.lit(0)), 6).alias("first"))


@query("SELECT c_custkey AS k, CASE WHEN c_nationkey = 3 AND c_custkey % 2 = 0 THEN 'renamed' ELSE c_name END AS name, c_nationkey = 3 AND c_custkey % 2 = 0 AS affected FROM customer")
def snk13_owned_update(spark, d):
    """Only rows of the asking user change, and each row says whether it did."""
    mine = (F.col("c_nationkey") == 3) & (F.col("c_custkey") % 2 == 0)
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(mine, "renamed").otherwise(F.col("c_name")).alias("name"), mine.alias("affected"))


@query("""WITH gone AS (SELECT o_orderkey AS project, o_custkey AS photo FROM orders WHERE o_orderkey % 4 = 0), stay AS (SELECT o_custkey AS photo FROM orders WHERE o_orderkey % 4 <> 0)
SELECT 'project' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'photo', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT photo FROM gone) OR c_custkey IN (SELECT photo FROM stay)""")
def snk14_cascading_delete(spark, d):
    """Projects go, and with them photos that no other project shares (also X28: the row first, its files after)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_custkey").alias("photo"))
    gone = o.where("project % 4 = 0")
    stay = deleted(o, gone.select("project"), "project")
    alone = gone.select("photo").distinct().join(stay.select("photo"), "photo", "left_anti")
    left = deleted(table(spark, d, "customer").select(F.col("c_custkey").alias("photo")), alone, "photo")
    return stay.select(F.lit("project").alias("kind"), F.col("project").alias("id")).unionAll(left.select(F.lit("photo"), "photo"))


@query("SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def x1_pending_embedding(spark, d):
    """Rows with a key whose first step is done, less those whose second step is."""
    done = table(spark, d, "labels")
    return table(spark, d, "documents").where("text is not null").join(done, "doc_id", "left_semi").join(done.where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("SELECT n_name AS reference, n_nationkey AS id FROM nation WHERE n_regionkey = 1")
def x3_reference_map(spark, d):
    return table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_name").alias("reference"), F.col("n_nationkey").alias("id"))


@query(f"WITH {EDITS_SQL}, c AS (SELECT photo FROM edits WHERE NOT excluded GROUP BY photo HAVING count(*) >= 20) SELECT count(*) AS eligible, count(*) FILTER (photo % 3 <> 0) AS marked FROM c")
def x4_mark_complete(spark, d):
    """Complete references that aren't marked yet are; the number marked comes back (also X2, the scan of the eligible)."""
    eligible = edits(spark, d).where("not excluded").groupBy("photo").agg(F.count("*").alias("n")).where("n >= 20").select("photo")
    before = eligible.where("photo % 3 = 0")
    new = eligible.join(before, "photo", "left_anti")
    return eligible.agg(F.count("*").alias("eligible")).join(F.broadcast(new.agg(F.count("*").alias("marked"))))  # one row each


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'Done' WHEN event_type = 'error' OR value > 80 THEN 'Failed' ELSE 'Running' END AS state, CASE WHEN event_type <> 'purchase' AND (event_type = 'error' OR value > 80) THEN length(left(repeat('x', CAST(floor(value * 40) AS INTEGER)), 2000)) END AS error_length FROM events""")
def x5_job_outcome(spark, d):
    """Done clears the error; failed keeps its first 2000 characters."""
    failed = (F.col("event_type") == "error") | (F.col("value") > 80)
    state = F.when(F.col("event_type") == "purchase", "Done").when(failed, "Failed").otherwise("Running")
    error = F.when(state == "Failed", F.substring(F.repeat(F.lit("x"), F.floor(F.col("value") * 40).cast("int")), 1, 2000))
    return table(spark, d, "events").select("event_id", state.alias("state"), F.length(error).cast("long").alias("error_length"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 'refused' WHEN o_custkey % 3 = 0 THEN 'V' || printf('%02d', row_number() OVER (PARTITION BY o_custkey, o_orderkey % 5 = 0 ORDER BY o_orderdate, o_orderkey)) ELSE 'not yours' END AS outcome FROM orders""")
def x26_save_version(spark, d):
    """A version is refused when its recipe isn't valid, not saved for another owner, else labelled in the order of saving (X26, X29, X31)."""
    bad = F.col("o_orderkey") % 5 == 0
    place = F.row_number().over(Window.partitionBy("o_custkey", bad).orderBy("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.when(bad, "refused").when(F.col("o_custkey") % 3 == 0, F.format_string("V%02d", place)).otherwise("not yours").alias("outcome"))


# ---- orders


@query("SELECT o_orderkey AS job, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def t9_recent_first(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderdate").alias("created")).orderBy(F.desc("created"), F.desc("job")).limit(20)


@query("""WITH p AS (SELECT l_orderkey AS curve, l_linenumber AS point, l_quantity AS q, sqrt(pow(l_discount * 10 - 0.5, 2) + pow(l_tax / 0.08 - 0.5, 2)) AS away FROM lineitem)
SELECT curve, arg_min(point, (round(away, 9), point)) AS point FROM p WHERE away <= 0.4 GROUP BY curve""")
def t11_nearest_point(spark, d):
    """Of each curve the point nearest to the pointer, if one lies within the grab radius."""
    away = F.hypot(F.col("l_discount") * 10 - 0.5, F.col("l_tax") / 0.08 - 0.5)
    p = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("curve"), F.col("l_linenumber").alias("point"), away.alias("away")).where("away <= 0.4")
    return p.groupBy("curve").agg(F.min_by("point", F.struct(F.round("away", 9), "point")).alias("point"))


@query("""WITH a AS (SELECT l_linenumber AS k, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT CASE WHEN k = 6 THEN 'a6-no-exclusion' ELSE 'a' || k END AS arm, n FROM a)
SELECT arm, n, row_number() OVER (ORDER BY coalesce(list_position(['a3', 'a1'], arm), 99), arm) AS place FROM s WHERE arm NOT LIKE '%-no-exclusion'""")
def x17_report_order(spark, d):
    """Arms in a fixed reading order and then the rest by name; controls are left out. One row for each arm."""
    a = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count("*").alias("n"))
    arm = F.concat(F.lit("a"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") == 6, "-no-exclusion").otherwise(""))
    s = a.select(arm.alias("arm"), "n").where(~F.col("arm").endswith("-no-exclusion"))
    known = F.array_position(F.array(F.lit("a3"), F.lit("a1")), F.col("arm"))
    return s.withColumn("place", F.row_number().over(Window.orderBy(F.when(known > 0, known).otherwise(99), "arm")))


@query(f"""WITH {EDITS_SQL} SELECT photo, expert, min(edit) AS edit FROM edits GROUP BY ALL""")
def x25_versions_by_expert(spark, d):
    """Of each photo one edit of every expert, in the experts' order."""
    return latest(edits(spark, d), ["photo", "expert"], F.col("edit")).select("photo", "expert", "edit").orderBy("photo", "expert")


# ---- text and geometry


@query("SELECT p_partkey AS k, '0 0 ' || p_size || ' 128 255 255' AS curve FROM part")
def st2_curve_block(spark, d):
    """The numbers of a nested block, joined by spaces."""
    raw = F.concat(F.lit('s = { Exposure = 1,\nToneCurve = { 0, 0, '), F.col("p_size").cast("string"), F.lit(',\n 128, 255, 255 },\nTint = 3 }'))
    block = F.regexp_extract(raw, r"ToneCurve\s*=\s*\{([^}]*)\}", 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.array_join(F.filter(F.split(F.trim(block), r"[,\s]+"), lambda x: x != ""), " ").alias("curve"))


@query("SELECT p_partkey AS k, regexp_full_match(CASE p_partkey % 5 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN '-' || p_partkey || '.5' WHEN 2 THEN '1e5' WHEN 3 THEN '.5' ELSE '7.' END, '-?[0-9]+(\\.[0-9]+)?') AS numeric FROM part")
def st6_numeric_literal(spark, d):
    s = F.col("p_partkey").cast("string")
    text = F.when(F.col("p_partkey") % 5 == 0, s).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("-"), s, F.lit(".5"))).otherwise(F.get(F.array(F.lit("1e5"), F.lit(".5"), F.lit("7.")), (F.col("p_partkey") % 5 - 2).cast("int")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), text.rlike(r"^-?\d+(\.\d+)?$").alias("numeric"))


@query("SELECT l_orderkey, l_linenumber, replace(printf('%.2f', l_discount), '.', ',') AS shown FROM lineitem")
def st15_decimal_comma(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.translate(F.format_string("%.2f", "l_discount"), ".", ",").alias("shown"))


@query("SELECT c_custkey AS k, CASE WHEN starts_with(raw, 'tag:') THEN raw[5:] ELSE raw END AS tag FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'tag:' ELSE '' END || lower(c_mktsegment) AS raw FROM customer)")
def st3_prefix_strip(spark, d):
    raw = F.concat(F.when(F.col("c_custkey") % 2 == 0, '"tag:').otherwise('"'), F.lower("c_mktsegment"), F.lit('"'))
    bare = F.expr("trim(BOTH '\"' FROM raw)")
    return table(spark, d, "customer").withColumn("raw", raw).select(F.col("c_custkey").alias("k"), F.regexp_replace(bare, "^tag:", "").alias("tag"))


@query("""WITH s AS (SELECT p_partkey AS k, p_size * 64 AS w, 1024 AS h FROM part), c AS (SELECT k, w, h, CASE WHEN w * 2 > h * 3 THEN CAST(h * 3 // 2 AS BIGINT) ELSE w END AS cw, CASE WHEN w * 2 > h * 3 THEN h ELSE CAST(w * 2 // 3 AS BIGINT) END AS ch FROM s)
SELECT k, cw AS width, ch AS height, (w - cw) // 2 AS x, (h - ch) // 2 AS y FROM c""")
def m6_centred_crop(spark, d):
    """The largest centred crop of three to two."""
    w, h = (F.col("p_size") * 64).cast("long"), F.lit(1024).cast("long")
    wide = w * 2 > h * 3
    cw, ch = F.when(wide, F.floor(h * 3 / 2)).otherwise(w), F.when(wide, h).otherwise(F.floor(w * 2 / 3))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), cw.alias("width"), ch.alias("height"), F.floor((w - cw) / 2).alias("x"), F.floor((h - ch) / 2).alias("y"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, 0 AS n_experts FROM events")
def x14_typed_score(spark, d):
    """Known keys of a stored row; a list that isn't there is empty."""
    x = F.from_json("props", "k string, experts array<string>")
    return table(spark, d, "events").withColumn("x", x).select("event_id", "x.k", F.size(F.coalesce("x.experts", F.array().cast("array<string>"))).alias("n_experts"))


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'photos/' || p_partkey || '/original' WHEN 1 THEN 'photos/' || p_partkey || '/preview.jpg' END AS key FROM part")
def x30_image_key(spark, d):
    """An unknown kind has no key."""
    at = F.concat(F.lit("photos/"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 3 == 0, F.concat(at, F.lit("/original"))).when(F.col("p_partkey") % 3 == 1, F.concat(at, F.lit("/preview.jpg"))).alias("key"))


@query("SELECT event_id, i, 'r' || (event_id + i) AS recipe FROM events, range(3) t(i)")
def x32_positional_suggestions(spark, d):
    made = F.to_json(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.concat(F.lit("r"), (F.col("event_id") + i).cast("string"))))
    return table(spark, d, "events").select("event_id", F.posexplode(F.from_json(made, "array<string>")).alias("i", "recipe"))


@query("SELECT c_custkey AS k, CASE WHEN EXISTS (FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') THEN 'editor' ELSE 'suggestions' END AS page FROM customer")
def x33_redirect(spark, d):
    """A project with a choice opens in the editor."""
    chosen = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("choice", F.lit(True))
    return table(spark, d, "customer").join(chosen, "c_custkey", "left").select(F.col("c_custkey").alias("k"), F.when(F.col("choice").isNotNull(), "editor").otherwise("suggestions").alias("page"))
