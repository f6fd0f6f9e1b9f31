"""Nearest neighbours and the strategies that choose from the pool they give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.colour import with_ciede2000, with_lab
from lumenframe.functions.vectors import euclidean, restored, standardised, weighted_blocks
from lumenframe.operators import knn, selection
from lumenframe.plans.registry import query
from lumenframe.plans.tables import EDITS_SQL, PHOTOS_SQL, edits, photos

K, QUERIES_EVERY = 20, 100


def _first_vector(spark, sf_dir) -> list[float]:
    return photos(spark, sf_dir).where("photo = 0").first()["vector"]


@query(f"""WITH {PHOTOS_SQL}, q AS (SELECT vector AS v FROM photos WHERE photo = 0)
SELECT photo, round(1 - list_inner_product(vector, v) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(v, v))), 6) + 0 AS distance
FROM photos, q WHERE photo <> 0 ORDER BY 1 - list_inner_product(vector, v) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(v, v))), photo LIMIT 20""")
def t1_knn_topk(spark, sf_dir):
    return knn.nearest(photos(spark, sf_dir), _first_vector(spark, sf_dir), K, [0]).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {PHOTOS_SQL}, q AS (SELECT vector AS v FROM photos WHERE photo = 0), c AS (SELECT CASE WHEN photo % 7 = 0 THEN NULL ELSE photo END AS reference, photo, vector FROM photos)
SELECT photo, round(1 - list_inner_product(vector, v) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(v, v))), 6) + 0 AS distance
FROM c, q WHERE NOT (coalesce(reference, -1) IN (1, 2, 3, 4, 5)) ORDER BY 1 - list_inner_product(vector, v) / (sqrt(list_inner_product(vector, vector)) * sqrt(list_inner_product(v, v))), photo LIMIT 20""")
def f1_null_safe_exclusion(spark, sf_dir):
    """A photo without a reference stays a candidate however long the list of exclusions is."""
    c = photos(spark, sf_dir).withColumn("reference", F.when(F.col("photo") % 7 == 0, None).otherwise(F.col("photo")))
    kept = c.where(~F.coalesce("reference", F.lit(-1)).isin(1, 2, 3, 4, 5))
    return knn.nearest(kept, _first_vector(spark, sf_dir), K, []).withColumn("distance", F.round("distance", 6))


_BATCH_SQL = f"""{PHOTOS_SQL},
n AS (SELECT photo, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) AS vector FROM photos),
near AS (
  SELECT q.photo AS query, c.photo, 1 - list_inner_product(q.vector, c.vector) AS distance FROM n q, n c WHERE q.photo % 100 = 0 AND c.photo <> q.photo
  QUALIFY row_number() OVER (PARTITION BY q.photo ORDER BY 1 - list_inner_product(q.vector, c.vector), c.photo) <= 20)"""


def neighbours(spark, sf_dir) -> DataFrame:
    p = photos(spark, sf_dir)
    return knn.nearest_of_each(p, p.where(F.col("photo") % QUERIES_EVERY == 0).select(F.col("photo").alias("query"), "vector"), K)


@query(f"WITH {_BATCH_SQL} SELECT query, photo, round(distance, 6) AS distance FROM near")
def t2_knn_batch(spark, sf_dir):
    return neighbours(spark, sf_dir).select("query", "photo", F.round("distance", 6).alias("distance"))


def joined_pool(spark, sf_dir, near: DataFrame) -> DataFrame:
    """The usable edits of each query's neighbours; an edit id found twice counts once, with its smallest error."""
    e = edits(spark, sf_dir).where(~F.col("excluded") & F.col("fingerprint").isNotNull())
    one = e.groupBy("photo", "edit").agg(F.min_by("fingerprint", F.struct("fit_error", "fingerprint")).alias("fingerprint"), F.min("fit_error").alias("fit_error"))
    # the query set is stated and K bounds its neighbours, so rows follow the queries; no hint: Spark decides by size
    joined = one.join(near.select("query", "photo", "distance"), "photo")
    return joined.groupBy("query", "edit").agg(F.min_by(F.struct("photo", "distance", "fit_error", "fingerprint"), F.struct("distance", "photo", "fit_error")).alias("x")).select("query", "edit", "x.*")


def pool(spark, sf_dir) -> DataFrame:
    return joined_pool(spark, sf_dir, neighbours(spark, sf_dir))


_POOL_SQL = f"""{_BATCH_SQL}, {EDITS_SQL},
one AS (SELECT photo, edit, arg_min(fingerprint, (fit_error, fingerprint)) AS fingerprint, min(fit_error) AS fit_error FROM edits WHERE NOT excluded GROUP BY ALL),
pool AS (
  SELECT query, edit, photo, distance, fit_error, fingerprint FROM one JOIN near USING (photo)
  QUALIFY row_number() OVER (PARTITION BY query, edit ORDER BY distance, photo, fit_error) = 1)"""


@query(f"WITH {_POOL_SQL} SELECT query, edit, photo, round(distance, 6) AS distance, fit_error FROM pool")
def j1_candidate_pool(spark, sf_dir):
    return pool(spark, sf_dir).select("query", "edit", "photo", F.round("distance", 6).alias("distance"), "fit_error")


@query(f"WITH {_POOL_SQL} SELECT query, edit, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, edit) AS INTEGER) AS place FROM pool QUALIFY place <= 3")
def sel1_top(spark, sf_dir):
    return selection.top(pool(spark, sf_dir))


@query(f"""WITH {_POOL_SQL}, first AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query, photo ORDER BY distance, fit_error, edit) = 1)
SELECT query, edit, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, fit_error, edit) AS INTEGER) AS place FROM first QUALIFY place <= 3""")
def sel2_top_per_scene_best_fit(spark, sf_dir):
    return selection.top(pool(spark, sf_dir), one_per_photo=True, best_fit=True)


@query(f"""WITH {_POOL_SQL}, first AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query, photo ORDER BY distance, edit) = 1)
SELECT query, edit, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, edit) AS INTEGER) AS place FROM first QUALIFY place <= 3""")
def sel2_top_per_scene(spark, sf_dir):
    return selection.top(pool(spark, sf_dir), one_per_photo=True)


@query()
def sel3_random(spark, sf_dir):
    return selection.random_choice(pool(spark, sf_dir), seed=7)


@query("SELECT DISTINCT vec_id AS query, CAST(1 AS BIGINT) AS edit, 1 AS place FROM embeddings WHERE vec_id % 100 = 0")
def sel4_average(spark, sf_dir):
    return selection.always(photos(spark, sf_dir).where(F.col("photo") % QUERIES_EVERY == 0).select(F.col("photo").alias("query")).distinct(), 1)


@query()
def sel5_mmr_03(spark, sf_dir):
    return selection.marginal_relevance(pool(spark, sf_dir), weight=0.3)


@query()
def sel5_mmr_05(spark, sf_dir):
    return selection.marginal_relevance(pool(spark, sf_dir), weight=0.5)


@query()
def sel5_mmr_07(spark, sf_dir):
    return selection.marginal_relevance(pool(spark, sf_dir), weight=0.7)


@query()
def sel6_kmeans_groups(spark, sf_dir):
    return selection.grouped(pool(spark, sf_dir))


@query()
def sel7_render_aware(spark, sf_dir):
    """Six finalists by relevance, then farthest first by the colour difference of their renditions."""
    candidates = pool(spark, sf_dir)
    finalists = selection.top(candidates, 6)
    shown = finalists.join(candidates, ["query", "edit"]).select("query", "edit", *[F.least(F.lit(1.0), F.col("fingerprint")[i]).alias(n) for i, n in ((1, "r"), (2, "g"), (0, "b"))])
    shown = with_lab(shown, ("r", "g", "b"), "c")
    a, b = (shown.select("query", F.col("edit").alias(n), *[F.col(f"c_{k}").alias(f"{n}_{k}") for k in "Lab"]) for n in "ab")
    pairs = with_ciede2000(a.join(b, "query").where("a <> b"), "a", "b", "difference").select("query", "a", "b", "difference")
    return selection.farthest_first(finalists, pairs)


@query(f"WITH {EDITS_SQL} SELECT photo, expert, edit FROM edits QUALIFY row_number() OVER (PARTITION BY photo ORDER BY expert, edit, fit_error) <= 3")
def sel9_own_recipes(spark, sf_dir):
    w = Window.partitionBy("photo").orderBy("expert", "edit", "fit_error")
    return edits(spark, sf_dir).withColumn("r", F.row_number().over(w)).where("r <= 3").select("photo", "expert", "edit")


@query(f"""WITH {_POOL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, edit) AS p FROM pool)
SELECT a.query, a.edit AS a, b.edit AS b, round(sqrt(list_sum(list_transform(list_zip(a.fingerprint, b.fingerprint), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS distance
FROM r a JOIN r b ON a.query = b.query AND a.p < b.p WHERE a.p <= 5 AND b.p <= 5""")
def v3_fingerprint_pairs(spark, sf_dir):
    p = pool(spark, sf_dir)
    first = selection.top(p, 5).join(p.select("query", "edit", "fingerprint"), ["query", "edit"])
    a, b = (first.select("query", F.col("edit").alias(n), F.col("place").alias(f"p{n}"), F.col("fingerprint").alias(f"f{n}")) for n in "ab")
    return a.join(b, "query").where("pa < pb").select("query", "a", "b", F.round(euclidean(F.col("fa"), F.col("fb")), 6).alias("distance"))


@query(f"""WITH {PHOTOS_SQL}, m AS (SELECT i, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS deviation FROM (SELECT unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS i FROM photos) GROUP BY i)
SELECT CAST(i AS INTEGER) AS i, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM m""")
def a19_scaling_constants(spark, sf_dir):
    c = photos(spark, sf_dir).select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("d"))
    return c.select("i", F.round("mean", 6).alias("mean"), F.round(F.when(F.col("d") == 0, 1.0).otherwise(F.col("d")), 6).alias("deviation"))


@query(f"""WITH {PHOTOS_SQL}, x AS (SELECT photo, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM photos), m AS (SELECT i, avg(x) AS mean, stddev_pop(x) AS d FROM x GROUP BY i)
SELECT photo, round(sum((x - mean) / d), 5) AS total, round(sum(abs(x)), 5) AS restored FROM x JOIN m USING (i) GROUP BY photo""")
def v5_standardise_and_restore(spark, sf_dir):
    p = photos(spark, sf_dir)
    c = p.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    row = c.agg(F.array_sort(F.collect_list(F.struct("i", "m", "d"))).alias("c")).select(F.col("c.m").alias("mean"), F.col("c.d").alias("dev"))
    # one row of constants
    scaled = p.join(F.broadcast(row)).withColumn("s", standardised(F.col("vector"), F.col("mean"), F.col("dev")))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    return scaled.select("photo", F.round(total(F.col("s")), 5).alias("total"), F.round(total(F.transform(restored(F.col("s"), F.col("mean"), F.col("dev")), F.abs)), 5).alias("restored"))


@query(f"""WITH {PHOTOS_SQL}, b AS (SELECT photo, vector[1:13] AS x, vector[14:30] AS y FROM photos)
SELECT photo, round(list_sum(list_transform(x, lambda v: v * 2 / sqrt(list_inner_product(x, x)))) + list_sum(list_transform(y, lambda v: v / sqrt(list_inner_product(y, y)))), 6) AS total, 30 AS width FROM b""")
def v4_weighted_blocks(spark, sf_dir):
    v = weighted_blocks((F.slice("vector", 1, 13), 2.0), (F.slice("vector", 14, 17), 1.0))
    return photos(spark, sf_dir).select("photo", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size(v).alias("width"))


@query(f"""WITH {PHOTOS_SQL} SELECT photo, '[' || array_to_string(list_transform(vector, lambda x: printf('%.4f', x)), ',') || ']' AS literal, len(vector) AS width, round(list_sum(list_transform(vector, lambda x: CAST(printf('%.4f', x) AS DOUBLE))), 3) AS total FROM photos""")
def src16_vector_literal(spark, sf_dir):
    literal = F.concat(F.lit("["), F.array_join(F.transform("vector", lambda x: F.format_string("%.4f", x)), ","), F.lit("]"))
    parsed = F.from_json("literal", "array<double>")
    # sums of four decimals end in ties at the third: scaled first, as SQL rounds the product
    total = F.round(F.aggregate("parsed", F.lit(0.0), lambda s, x: s + x) * 1000) / 1000
    p = photos(spark, sf_dir).select("photo", literal.alias("literal")).withColumn("parsed", parsed)
    return p.select("photo", "literal", F.size("parsed").cast("long").alias("width"), total.alias("total"))


@query(f"""WITH {_BATCH_SQL}, h AS (SELECT query, photo FROM near WHERE photo % 3 <> 0)
SELECT near.query, count(h.photo) / 20.0::DOUBLE AS recall FROM near LEFT JOIN h USING (query, photo) GROUP BY near.query""")
def a32_recall_at_k(spark, sf_dir):
    """Recall of a list that misses every third photo, against the exact one."""
    exact = neighbours(spark, sf_dir)
    lists = exact.groupBy("query").agg(F.collect_list("photo").alias("exact"), F.collect_list(F.when(F.col("photo") % 3 != 0, F.col("photo"))).alias("found"))
    return lists.select("query", (F.size(F.array_intersect("exact", "found")) / F.lit(20.0)).alias("recall"))


@query(f"WITH {PHOTOS_SQL} SELECT photo FROM photos WHERE photo % 10 <> 0")
def f16_build_set(spark, sf_dir):
    p = photos(spark, sf_dir).select("photo")
    return p.join(p.where(F.col("photo") % 10 == 0), "photo", "left_anti")
