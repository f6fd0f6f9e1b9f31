"""Arms on the stand-in tables: their scores, distributions, curves and chart series.

An edit's colour stands for its rendition on the photo: three numbers of its fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators import harness, knn
from lumenframe.operators.kept import kept
from lumenframe.plans.registry import query
from lumenframe.plans.retrieval import QUERIES_EVERY, joined_pool
from lumenframe.plans.tables import EDITS_SQL, PHOTOS_SQL, edits, photos

#: The blocks of the fingerprint that some arms compare by.
BLOCKS = (0, 2), (2, 2)
#: Arms that SQL can restate, with the neighbours of their pools.
PLAIN = ("top", "top-per-scene", "top-per-scene-bestfit", "random", "average", "oracle")
#: Stands for the average edit: the smallest id.
AVERAGE_SQL = "(SELECT min(edit) FROM edits)"


def _scored(spark, d, names):
    every = harness.arms(*BLOCKS)
    chosen = [every[n] for n in names]
    p = photos(spark, d)
    queries = p.where(F.col("photo") % QUERIES_EVERY == 0).select(F.col("photo").alias("query"), "vector")
    widths = sorted({a.neighbours for a in chosen})
    near = kept(knn.nearest_of_each(p, queries, widths[-1]), "neighbours")
    pools = {k: kept(joined_pool(spark, d, near.where(F.col("place") <= k)), "pool") for k in widths}
    colour = F.transform(F.slice("fingerprint", 1, 3), lambda x: x * 20)
    e = edits(spark, d)
    known = kept(e.groupBy("edit").agg(F.min_by(F.struct("photo", "fingerprint"), F.struct("photo", "fit_error", "fingerprint")).alias("x")).select("edit", "x.*").withColumn("colour", colour), "known-edits")
    # an expert's first edit of a photo
    mine = e.join(queries.select(F.col("query").alias("photo")), "photo").groupBy(F.col("photo").alias("query"), "expert").agg(F.min_by(F.struct("edit", "fingerprint"), F.struct("edit", "fit_error", "fingerprint")).alias("x"))
    experts = kept(mine.select("query", "expert", "x.*").withColumn("colour", colour), "experts")
    # a photo has a handful of experts
    own = experts.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("expert")))
    got = kept(harness.choices(chosen, pools, queries.select("query"), own, e.agg(F.min("edit")).first()[0] or 0), "choices")
    sizes = None
    for k in widths:
        names_of = F.explode(F.array(*[F.lit(a.name) for a in chosen if a.neighbours == k])).alias("arm")
        part = pools[k].groupBy("query").agg(F.count("*").alias("pool_size")).select(names_of, "query", "pool_size")
        sizes = part if sizes is None else sizes.unionAll(part)
    return kept(harness.score(got, known, experts, sizes, list(names)), "scores")


def _euclid(x, y):
    return f"sqrt(list_sum(list_transform(list_zip({x}, {y}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


_COLOUR = "list_transform({}[1:3], lambda x: x * 20)"
_SCORED_SQL = f"""{PHOTOS_SQL}, {EDITS_SQL},
u AS (SELECT photo, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) AS v FROM photos),
near AS (
  SELECT q.photo AS query, c.photo, 1 - list_inner_product(q.v, c.v) AS distance FROM u q, u c WHERE q.photo % {QUERIES_EVERY} = 0 AND c.photo <> q.photo
  QUALIFY row_number() OVER (PARTITION BY q.photo ORDER BY 1 - list_inner_product(q.v, c.v), c.photo) <= 50),
one AS (SELECT photo, edit, min(fit_error) AS fit_error FROM edits WHERE NOT excluded GROUP BY ALL),
pool AS (
  SELECT query, edit, photo, distance, fit_error FROM one JOIN near USING (photo)
  QUALIFY row_number() OVER (PARTITION BY query, edit ORDER BY distance, photo, fit_error) = 1),
scene AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query, photo ORDER BY distance, edit) = 1),
best AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query, photo ORDER BY distance, fit_error, edit) = 1),
known AS (
  SELECT edit, photo, fingerprint, {_COLOUR.format("fingerprint")} AS colour FROM edits
  QUALIFY row_number() OVER (PARTITION BY edit ORDER BY photo, fit_error, fingerprint) = 1),
queries AS (SELECT vec_id AS query FROM embeddings WHERE vec_id % {QUERIES_EVERY} = 0),
experts AS (
  SELECT photo AS query, expert, edit, fingerprint, {_COLOUR.format("fingerprint")} AS colour FROM edits WHERE photo IN (FROM queries)
  QUALIFY row_number() OVER (PARTITION BY photo, expert ORDER BY edit, fit_error, fingerprint) = 1),
chosen AS (
  SELECT 'top' AS arm, query, edit, row_number() OVER (PARTITION BY query ORDER BY distance, edit) AS place FROM pool
  UNION ALL SELECT 'top-per-scene', query, edit, row_number() OVER (PARTITION BY query ORDER BY distance, edit) FROM scene
  UNION ALL SELECT 'top-per-scene-bestfit', query, edit, row_number() OVER (PARTITION BY query ORDER BY distance, fit_error, edit) FROM best
  UNION ALL SELECT 'random', query, edit, row_number() OVER (PARTITION BY query ORDER BY sha256('{harness.RANDOM_SEED}|' || query || '|' || edit), edit) FROM pool
  UNION ALL SELECT 'average', query, {AVERAGE_SQL}, 1 FROM queries
  UNION ALL SELECT 'oracle', query, edit, row_number() OVER (PARTITION BY query ORDER BY expert) FROM experts),
items AS (SELECT c.*, photo, fingerprint, colour FROM chosen c JOIN known USING (edit) WHERE place <= 3),
scales AS (
  SELECT a.query, avg({_euclid("a.colour", "b.colour")}) AS human_mean, quantile_cont({_euclid("a.colour", "b.colour")}, 0.5) AS threshold, avg({_euclid("a.fingerprint", "b.fingerprint")}) AS fingerprint_mean
  FROM experts a JOIN experts b ON a.query = b.query AND a.expert < b.expert GROUP BY a.query),
counts AS (SELECT arm, query, count(*) AS suggestions, count(DISTINCT photo) AS sources FROM items GROUP BY ALL),
spread AS (
  SELECT a.arm, a.query, avg({_euclid("a.colour", "b.colour")}) AS diversity_rendered, avg({_euclid("a.fingerprint", "b.fingerprint")}) AS diversity_fingerprint
  FROM items a JOIN items b ON a.arm = b.arm AND a.query = b.query AND a.place < b.place GROUP BY ALL),
close AS (
  SELECT i.arm, i.query, min({_euclid("i.colour", "e.colour")}) AS closeness, min({_euclid("i.fingerprint", "e.fingerprint")}) AS closeness_recipe
  FROM items i JOIN experts e USING (query) GROUP BY ALL),
scores AS (
  SELECT arm, query, CAST(coalesce(pool_size, 0) AS BIGINT) AS pool_size, coalesce(suggestions, 0) AS suggestions, sources, diversity_rendered, diversity_fingerprint,
    CASE WHEN human_mean > 0 THEN diversity_rendered / human_mean END AS diversity_ratio, CASE WHEN fingerprint_mean > 0 THEN diversity_fingerprint / fingerprint_mean END AS fingerprint_ratio,
    closeness, closeness_recipe, threshold, closeness < threshold AS hit
  FROM scales CROSS JOIN (SELECT unnest({list(PLAIN)}) AS arm) LEFT JOIN (SELECT query, count(*) AS pool_size FROM pool GROUP BY query) USING (query)
    LEFT JOIN counts USING (arm, query) LEFT JOIN spread USING (arm, query) LEFT JOIN close USING (arm, query)),
long AS (
  {" UNION ALL ".join(f"SELECT arm, '{m}' AS measure, CAST({c} AS DOUBLE) AS value FROM scores" for m, c in [*((m, m) for m in harness.MEASURES), ("diversity_gap", "fingerprint_ratio - diversity_ratio")])}),
report AS (
  SELECT arm, measure, count(*) AS count, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.9), 6) AS p90
  FROM long WHERE value IS NOT NULL GROUP BY ALL)"""


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"""WITH {_SCORED_SQL} SELECT arm, query, pool_size, suggestions, sources, hit,
  {", ".join(f"round({c}, 6) AS {c}" for c in ("diversity_rendered", "diversity_fingerprint", "diversity_ratio", "fingerprint_ratio", "closeness", "closeness_recipe", "threshold"))} FROM scores""")
def o13_scored_photos(spark, d):
    """One row for each arm and photo: what was chosen, how varied it is, how close to an expert's, and whether that is a hit."""
    return _rounded(_scored(spark, d, PLAIN))


@query(f"WITH {_SCORED_SQL} SELECT * FROM report")
def a13_arm_distributions(spark, d):
    return harness.aggregated(_scored(spark, d, PLAIN))


@query(f"""WITH {_SCORED_SQL}
SELECT arm, count(*) AS photographs, count(hit) AS decided, round(avg(hit::INT::DOUBLE), 6) AS hit_rate FROM scores GROUP BY arm""")
def sel10_arm_hit_rates(spark, d):
    return harness.hit_rates(_scored(spark, d, PLAIN))


@query()
def sel10_every_arm(spark, d):
    """All arms, those too whose choice SQL can't restate, from one search and one scoring."""
    return harness.aggregated(_scored(spark, d, tuple(harness.arms(*BLOCKS))))


_CURVE_SQL = "curve AS (SELECT arm, i * 0.5::DOUBLE AS threshold, round(avg((closeness < i * 0.5)::INT::DOUBLE), 6) AS rate FROM scores, range(1, 41) t(i) WHERE closeness IS NOT NULL GROUP BY ALL)"


@query(f"""WITH {_SCORED_SQL}, {_CURVE_SQL}
SELECT 'hit-rate' AS chart, arm, threshold AS x, rate AS y FROM curve
UNION ALL SELECT 'closeness', arm, NULL, median FROM report WHERE measure = 'closeness'
UNION ALL SELECT 'diversity', r.arm, f.median, r.median FROM report r LEFT JOIN report f ON f.arm = r.arm AND f.measure = 'fingerprint_ratio' WHERE r.measure = 'diversity_ratio'""")
def x18_chart_series(spark, d):
    """The points of three charts: hit rates by threshold, median closeness, and rendered against compared variety."""
    scores = _scored(spark, d, PLAIN)
    report = kept(harness.aggregated(scores), "report")
    of = lambda m, name: report.where(F.col("measure") == m).select("arm", F.col("median").alias(name))
    none = F.lit(None).cast("double")
    lines = harness.hit_curves(scores).select(F.lit("hit-rate").alias("chart"), "arm", F.col("threshold").alias("x"), F.col("rate").alias("y"))
    close = of("closeness", "y").select(F.lit("closeness").alias("chart"), "arm", none.alias("x"), "y")
    # a row for each arm
    varied = of("diversity_ratio", "y").join(of("fingerprint_ratio", "x"), "arm", "left").select(F.lit("diversity").alias("chart"), "arm", "x", "y")
    return lines.unionAll(close).unionAll(varied)
