"""What every strategy promises, and how each chooses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import selection
from lumenframe.operators.knn import ann_width, nearest, nearest_of_each
from lumenframe.plans.relational import w12_stratified_sample

SCHEMA = "query long, photo long, edit long, distance double, fit_error double, fingerprint array<double>"
TWINS = [(1, 1, 11, 0.10, 1.0, [0.0, 0.0]), (1, 1, 12, 0.11, None, [0.01, 0.0]), (1, 2, 13, 0.30, 2.0, [5.0, 5.0])]
STRATEGIES = {
    "top": selection.top,
    "scene": lambda p, n: selection.top(p, n, one_per_photo=True, best_fit=True),
    "random": lambda p, n: selection.random_choice(p, n, 3),
    "mmr": selection.marginal_relevance,
    "kmeans": selection.grouped,
}


@pytest.mark.parametrize("name", STRATEGIES)
@pytest.mark.parametrize("n", [0, 1, 2, 3, 5])
def test_promises(spark, name, n):
    pool = spark.createDataFrame(TWINS + [(2, 5, 21, 0.2, 0.0, [1.0, 1.0])], SCHEMA)
    one = sorted(map(tuple, STRATEGIES[name](pool, n).collect()))
    assert one == sorted(map(tuple, STRATEGIES[name](pool.repartition(3), n).collect()))
    assert len({(q, e) for q, e, _ in one}) == len(one)
    assert all(sum(1 for q, _, _ in one if q == k) <= n for k in (1, 2))
    assert STRATEGIES[name](pool.limit(0), max(n, 1)).count() == 0


def order(df, query=1):
    return [r.edit for r in df.where(F.col("query") == query).orderBy("place").collect()]


def test_choices(spark):
    pool = spark.createDataFrame(TWINS, SCHEMA)
    assert order(selection.top(pool, 2)) == [11, 12]
    assert order(selection.top(pool, 2, one_per_photo=True)) == [11, 13]
    assert order(selection.marginal_relevance(pool, 2, 0.3)) == [11, 13]
    assert order(selection.marginal_relevance(pool, 2, 1.0)) == [11, 12]
    assert order(selection.grouped(pool, 2)) == [11, 13]
    same = spark.createDataFrame([(1, 1, 7, 0.5, None, [0.0]), (1, 1, 6, 0.5, 1.0, [0.0])], SCHEMA)
    assert order(selection.top(same, 1, best_fit=True)) == [7] and order(selection.top(same, 1)) == [6]
    with pytest.raises(ValueError):
        selection.marginal_relevance(pool, 2, 1.5)


def test_farthest_first(spark):
    finalists = spark.createDataFrame([(1, e, p) for p, e in enumerate((1, 2, 3, 4), 1)], "query long, edit long, place int")
    away = {(1, 2): 1.0, (1, 3): 9.0, (1, 4): 5.0, (2, 3): 4.0, (2, 4): 4.0, (3, 4): 1.0}
    pairs = spark.createDataFrame([(1, a, b, v) for (x, y), v in away.items() for a, b in ((x, y), (y, x))], "query long, a long, b long, difference double")
    assert order(selection.farthest_first(finalists, pairs, 3)) == [1, 3, 2]


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0]), (4, None), (5, [3.0, 0.0])]
    corpus = spark.createDataFrame(rows, "photo long, vector array<double>")
    got = [(r.photo, round(r.distance, 6)) for r in nearest(corpus, [2.0, 0.0], 4, [0]).collect()]
    assert got == [(5, 0.0), (1, 1.0), (2, 1.0), (3, 2.0)]
    assert nearest(corpus, [1.0, 0.0], 0, []).count() == 0
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (9, [0.0, 0.0])], "query long, vector array<double>")
    each = sorted((r["query"], r.place, r.photo) for r in nearest_of_each(corpus, queries, 2).collect())
    assert each == [(0, 1, 5), (0, 2, 1), (9, 1, 0), (9, 2, 1)]
    assert nearest_of_each(corpus, queries.limit(0), 2).count() == 0
    rng = np.random.default_rng(4)
    wide = rng.normal(size=(300, 512)).round(1)
    wide[7], wide[8] = 0, wide[9]
    corpus = spark.createDataFrame([(i if i != 20 else None, v.tolist()) for i, v in enumerate(wide)], "photo long, vector array<double>").repartition(3)
    unit = wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-300)
    queries = corpus.where("photo % 50 = 9").select(F.col("photo").alias("query"), "vector")
    found = sorted((r["query"], r.place, -1 if r.photo is None else r.photo) for r in nearest_of_each(corpus, queries, 12).collect())
    want = []
    for q in range(9, 300, 50):
        order = sorted((round(1 - float(unit[i] @ unit[q]), 12), -1 if i == 20 else i) for i in range(300) if i != q)[:12]
        want += [(q, p + 1, i) for p, (_, i) in enumerate(order)]
        if q == 9:
            assert [r.photo for r in nearest(corpus, wide[9].tolist(), 12, [9]).collect()] == [None if i < 0 else i for _, i in order]
    assert found == want
    assert [ann_width(k) for k in (1, 20, 50)] == [40, 40, 100]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_random_is_a_partial_top(spark):
    pool = spark.range(5000).selectExpr("id % 2 AS query", "id AS photo", "id AS edit", "0.5D AS distance", "1.0D AS fit_error", "array(0.0D) AS fingerprint")
    some = selection.random_choice(pool, 3, 7)
    assert "InPandas" not in plan(some) and "WindowGroupLimit" in plan(some)
    assert len(order(some)) == 3 and order(some) == order(selection.random_choice(pool.repartition(5), 3, 7)) != order(selection.random_choice(pool, 3, 8))


def test_stratified_places(spark, tmp_path):
    rows = [(k, ("a", "a", "a", None, "b")[k % 5] if k < 40 else "a") for k in range(1, 1000)]
    spark.createDataFrame(rows, "c_custkey long, c_mktsegment string").repartition(3).write.parquet(str(tmp_path / "customer.parquet"))
    got = w12_stratified_sample(spark, str(tmp_path))
    want = []
    for g in ("a", "b", None):
        keys = sorted(k for k, s in rows if s == g)
        want += [(g, keys[i]) for i in {j * len(keys) // 10 for j in range(10)}]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "windowspecdefinition(g#" not in plan(got)
