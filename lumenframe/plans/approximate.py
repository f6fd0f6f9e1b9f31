"""Approximate neighbours from the inverted-list index, what they change, and their recall.

The photos' vectors are spread almost evenly over the sphere, where lists tell little, so a
query probes PROBES of all lists to find nine tenths of its neighbours; fewer do on vectors that
form groups. Centres are the sample's vectors as they are (no rounds), which SQL can restate.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lumenframe.operators import ivf, knn, selection
from lumenframe.plans.registry import query
from lumenframe.operators.ranking import quantiles
from lumenframe.plans.retrieval import QUERIES_EVERY, joined_pool
from lumenframe.plans.tables import EDITS_SQL, PHOTOS_SQL, photos

K, PROBES = 50, 0.85


def _queries(p):
    return p.where(F.col("photo") % QUERIES_EVERY == 0).select(F.col("photo").alias("query"), "vector")


def found(spark, d):
    """Each query's K neighbours by the index, itself left out."""
    p = photos(spark, d)
    index = ivf.build(p, rounds=0)
    return ivf.search(index, _queries(p), K, math.ceil(len(index.centres) * PROBES))


_NEAR = """{name} AS (
  SELECT query, photo, distance FROM {rows} WHERE photo <> query QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, photo) <= {k})"""
_FOUND_SQL = f"""{PHOTOS_SQL},
u AS (SELECT photo, list_transform(vector, lambda x: x / sqrt(list_inner_product(vector, vector))) AS v FROM photos),
lists AS (
  SELECT row_number() OVER (ORDER BY sha256(CAST(photo AS VARCHAR)), photo) - 1 AS list, v AS centre FROM u
  QUALIFY list < (SELECT greatest(1, least({ivf.MOST_LISTS}, floor(sqrt(count(*))))) FROM u)),
probes AS (SELECT CAST(ceil(count(*) * {PROBES}) AS BIGINT) AS n FROM lists),
rows AS (SELECT photo, v, list FROM u, lists QUALIFY row_number() OVER (PARTITION BY photo ORDER BY list_inner_product(v, centre) DESC, list) = 1),
probed AS (
  SELECT photo AS query, v AS q, list FROM u, lists WHERE photo % {QUERIES_EVERY} = 0
  QUALIFY row_number() OVER (PARTITION BY photo ORDER BY list_inner_product(v, centre) DESC, list) <= (SELECT n FROM probes)),
seen AS (SELECT query, photo, 1 - list_inner_product(q, v) AS distance FROM probed JOIN rows USING (list)),
wide AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY query ORDER BY distance, photo) <= {knn.ann_width(K)}),
every AS (SELECT q.photo AS query, c.photo, 1 - list_inner_product(q.v, c.v) AS distance FROM u q, u c WHERE q.photo % {QUERIES_EVERY} = 0),
{_NEAR.format(name="found", rows="wide", k=K)},
{_NEAR.format(name="exact", rows="every", k=K)}"""


def _chosen_sql(near: str) -> str:
    """The three that the shipped strategy chooses from a list of neighbours."""
    return f"""pool_{near} AS (
  SELECT query, edit, photo, distance, fit_error FROM one JOIN {near} USING (photo)
  QUALIFY row_number() OVER (PARTITION BY query, edit ORDER BY distance, photo, fit_error) = 1),
first_{near} AS (SELECT * FROM pool_{near} QUALIFY row_number() OVER (PARTITION BY query, photo ORDER BY distance, fit_error, edit) = 1),
chosen_{near} AS (
  SELECT query, edit, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, fit_error, edit) AS INTEGER) AS place FROM first_{near} QUALIFY place <= 3)"""


_CHOSEN_SQL = f"""{_FOUND_SQL}, {EDITS_SQL},
one AS (SELECT photo, edit, min(fit_error) AS fit_error FROM edits WHERE NOT excluded GROUP BY ALL),
{_chosen_sql("found")},
{_chosen_sql("exact")}"""


def _chosen(spark, d, near):
    return selection.top(joined_pool(spark, d, near), one_per_photo=True, best_fit=True)


@query(f"""WITH {_FOUND_SQL}
SELECT query, photo, round(distance, 6) AS distance, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, photo) AS INTEGER) AS place FROM found""")
def t3_index_search(spark, d):
    return found(spark, d).select("query", "photo", F.round("distance", 6).alias("distance"), "place")


@query(f"WITH {_CHOSEN_SQL} SELECT * FROM chosen_found")
def x9_index_suggestions(spark, d):
    """Suggestions from the index's lists, from which the query's photo was removed after the search."""
    return _chosen(spark, d, found(spark, d))


@query(f"""WITH {_CHOSEN_SQL},
r AS (SELECT e.query, count(f.photo) / count(*) AS recall FROM exact e LEFT JOIN found f USING (query, photo) GROUP BY e.query),
c AS (SELECT query, list(edit ORDER BY place) AS edits FROM chosen_found GROUP BY query),
e AS (SELECT query, list(edit ORDER BY place) AS edits FROM chosen_exact GROUP BY query)
SELECT count(*) AS queries, round(avg(recall), 6) AS recall_mean, round(quantile_cont(recall, 0.5), 6) AS recall_median, round(min(recall), 6) AS recall_min,
  round(avg((recall = 1)::INT::DOUBLE), 6) AS perfect_share, count(*) FILTER (recall < 1) AS lists_differing,
  count(*) FILTER (c.edits IS DISTINCT FROM e.edits) AS suggestions_differing
FROM r LEFT JOIN c USING (query) LEFT JOIN e USING (query)""")
def o12_index_vs_exact(spark, d):
    """Recall of the index against the exact lists, and how many queries get other lists and other suggestions."""
    p = photos(spark, d)
    near = {"found": found(spark, d), "exact": knn.nearest_of_each(p, _queries(p), K)}
    recalls = ivf.recall(near["found"], near["exact"]).withColumn("g", F.lit(0))
    chosen = [_chosen(spark, d, n).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "edit"))).alias(name)) for name, n in near.items()]
    rows = recalls.join(chosen[0], "query", "left").join(chosen[1], "query", "left")
    whole = F.col("recall") == 1
    out = rows.groupBy("g").agg(
        F.count("*").alias("queries"), F.round(F.avg("recall"), 6).alias("recall_mean"), F.round(F.min("recall"), 6).alias("recall_min"), F.round(F.avg(whole.cast("double")), 6).alias("perfect_share"),
        F.count_if(~whole).alias("lists_differing"), F.count_if(~F.col("found").eqNullSafe(F.col("exact"))).alias("suggestions_differing"),
    )
    median = quantiles(recalls, "g", "recall", {"recall_median": 0.5})
    return out.join(median, "g").drop("g").withColumn("recall_median", F.round("recall_median", 6))
