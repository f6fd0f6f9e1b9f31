"""Scores, distributions and curves of arms on a few photos, and ranks over many equal values."""

import numpy as np
from pyspark.sql import functions as F

from lumenframe.operators import harness
from lumenframe.operators.ranking import distributions, quantiles, value_places


def test_ranks_of_equal_values(spark):
    """Three values in 3000 rows are three rows to rank; nulls don't count, a null group is one."""
    rng = np.random.default_rng(1)
    rows = [(g, None if v == 3 else float(v)) for g in ("a", None, "b") for v in rng.integers(0, 4, 1000).tolist()] + [("c", -1.5)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    assert value_places(df.where("v is not null"), "g", "v").count() == 10
    got = {r.g: (r.p10, r.median, r.p93) for r in quantiles(df, "g", "v", {"p10": 0.1, "median": 0.5, "p93": 0.93}).collect()}
    for g in ("a", None, "b", "c"):
        v = [x for h, x in rows if h == g and x is not None]
        np.testing.assert_allclose(got[g], np.percentile(v, [10, 50, 93]))


def test_distributions(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, None), ("a", None, 5), ("b", None, None)], "arm string, x double, y int")
    got = sorted(map(tuple, distributions(df, "arm", {"x": F.col("x"), "y": F.col("y")}).collect()))
    assert got == [("a", "x", 2, 1.1, 1.5, 1.5, 1.9), ("a", "y", 1, 5.0, 5.0, 5.0, 5.0)]


def test_registry():
    arms = harness.arms((0, 2), (2, 2))
    assert len(arms) == 15 and all(name == a.name for name, a in arms.items())
    assert (arms["mmr-0.5-k20"].neighbours, arms["mmr-0.5"].neighbours, arms["fp-statistics"].ruler) == (20, 50, (2, 2))


EDITS = [(1, 10, [0.0, 0.0]), (2, 10, [3.0, 4.0]), (3, 11, [0.0, 1.0]), (4, 12, [6.0, 8.0])]


def scored(spark):
    """Photo 1 has three experts, photo 2 one (and no scale), photo 3 two that are equal."""
    known = spark.createDataFrame([(e, p, f, f) for e, p, f in EDITS], "edit long, photo long, fingerprint array<double>, colour array<double>")
    own = [(1, 1, [0.0, 0.0]), (1, 2, [0.0, 2.0]), (1, 3, [0.0, 6.0]), (2, 1, [0.0, 0.0]), (3, 1, [1.0, 1.0]), (3, 2, [1.0, 1.0])]
    experts = spark.createDataFrame([(q, e, f, f) for q, e, f in own], "query long, expert long, fingerprint array<double>, colour array<double>")
    chosen = spark.createDataFrame([("x", 1, 2, 1), ("x", 1, 3, 2), ("x", 3, 4, 1), ("y", 1, 1, 1), ("x", 2, 1, 1)], "arm string, query long, edit long, place int")
    sizes = spark.createDataFrame([("x", 1, 7)], "arm string, query long, pool_size long")
    return harness.score(chosen, known, experts, sizes, ["x", "y"])


def test_scores(spark):
    got = {(r.arm, r["query"]): r for r in scored(spark).collect()}
    assert set(got) == {("x", 1), ("y", 1), ("x", 3), ("y", 3)}
    r = got["x", 1]
    # experts are 2, 4 and 6 apart; suggestions (3, 4) and (0, 1) are 18 ** 0.5 apart
    assert (r.pool_size, r.suggestions, r.sources, r.threshold, r.closeness, r.hit) == (7, 2, 2, 4.0, 1.0, True)
    np.testing.assert_allclose((r.diversity_rendered, r.diversity_ratio, r.fingerprint_ratio), (18**0.5, 18**0.5 / 4, 18**0.5 / 4))
    assert (got["y", 1].closeness, got["y", 1].hit, got["y", 1].diversity_rendered) == (0.0, True, None)
    # equal experts give no ratio, and nothing is nearer than they are
    assert (got["x", 3].hit, got["x", 3].diversity_ratio, got["x", 3].threshold) == (False, None, 0.0)
    assert (got["y", 3].suggestions, got["y", 3].closeness, got["y", 3].hit) == (0, None, None)


def test_reports(spark):
    scores = scored(spark)
    assert {(r.arm, r.photographs, r.decided, r.hit_rate) for r in harness.hit_rates(scores).collect()} == {("x", 2, 2, 0.5), ("y", 2, 1, 1.0)}
    curve = {(r.arm, r.threshold): r.rate for r in harness.hit_curves(scores).collect()}
    assert len(curve) == 80 and (curve["x", 1.0], curve["x", 1.5], curve["x", 20.0], curve["y", 0.5]) == (0.0, 0.5, 1.0, 1.0)
    report = {(r.arm, r.measure): r for r in harness.aggregated(scores).collect()}
    assert report["x", "closeness"]["count"] == 2 and ("y", "diversity_gap") not in report
    assert report["y", "suggestions"].mean == 0.5
