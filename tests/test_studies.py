"""Leakage, agreement, translation, curve edits, rulers and bands against plain Python and NumPy."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import colour_arrays, curves, recipes, text, translation
from lumenframe.operators import agreement, bands, leakage, rulers
from lumenframe.plans import studies

RNG = np.random.default_rng(5)


# ---- leakage


def test_leakage_against_numpy(spark):
    """Raw vectors, scaled by all rows, against a scaling of the seen ones: every figure of the report."""
    raw = RNG.normal(size=(300, 3)) * (1, 5, 0.2) + (0, 2, 7)
    raw[250:] *= 3
    mean, deviation = raw.mean(0), raw.std(0)
    stored = (raw - mean) / deviation
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(stored)], "k long, vector array<double>").repartition(5)
    committed = spark.createDataFrame([(i, float(m), float(s)) for i, (m, s) in enumerate(zip(mean, deviation, strict=True))], "component int, mean double, deviation double")
    both, fitted = leakage.restated(rows, committed, F.col("k") < 250)
    got = leakage.report(leakage.moved_distances(both, "k", 5000, "test")).first()

    seen = raw[:250]
    new = (raw - seen.mean(0)) / seen.std(0)
    pairs = [(r.left, r.right) for r in leakage.random_pairs(rows, 300, 5000, "test").collect()]
    left, right = np.array(pairs).T
    assert (left != right).all() and len(set(pairs)) > 4500 and {*left, *right} == set(range(300))
    before, after = (np.linalg.norm(v[left] - v[right], axis=1) for v in (stored, new))
    change = np.abs(after - before) / before * 100
    assert got.pairs == len(pairs) and not got.negligible
    for name, want in (("median", np.median(change)), ("p90", np.percentile(change, 90)), ("p99", np.percentile(change, 99)), ("worst", change.max()), ("mean_before", before.mean()), ("mean_after", after.mean())):
        assert got[name] == pytest.approx(want, rel=1e-9)

    drift = {r.component: r for r in leakage.drift(committed, fitted).collect()}
    ratio = seen.std(0) / deviation
    assert [c for c in drift if drift[c].worst] == [int(np.argmax(np.abs(ratio - 1)))]
    for i in range(3):
        assert drift[i].ratio == pytest.approx(ratio[i]) and drift[i].shift == pytest.approx(abs(seen.mean(0)[i] - mean[i]) / deviation[i])


def test_leakage_without_a_leak(spark):
    """Copies of one vector are at distance 0: no relative change, no division; constants that were right move nothing; nulls don't count."""
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [3.0, 2.0]), (4, None)], "k long, vector array<double>")
    committed = leakage.constants(rows.where("vector is not null"), "vector")
    assert {r.component: r.deviation for r in committed.collect()}[1] == 1.0
    scaled = spark.createDataFrame([(r.k, r.vector) for r in rows.collect()], rows.schema)
    both, _ = leakage.restated(scaled, committed, F.lit(True))
    moved = leakage.moved_distances(both, "k", 200)
    got = {(r.before == 0, r.change is None) for r in moved.collect()}
    assert got == {(True, True), (False, False)}
    assert leakage.report(leakage.moved_distances(both.where("k = 1"), "k", 50)).collect() == []


def test_pairs_do_not_depend_on_partitions(spark):
    rows = spark.range(40).select(F.col("id").alias("k"), F.array(F.col("id").cast("double")).alias("vector")).withColumn("rebuilt", F.transform("vector", lambda x: x * 2))
    one, many = (sorted(map(tuple, leakage.moved_distances(rows.repartition(n), "k", 500).collect())) for n in (1, 7))
    assert one == many and all(c == pytest.approx(100) for *_, c in one)


def test_control_sample(spark):
    rows = spark.range(100).select(F.col("id").alias("k"))
    first, again, other = ({r.k for r in leakage.control_sample(rows.repartition(n), "k", 20, seed).collect()} for n, seed in ((2, "a"), (5, "a"), (2, "b")))
    assert first == again and len(first) == 20 and first != other
    assert leakage.control_sample(rows, "k", 500, "a").count() == 100


# ---- agreement


def test_agreement_against_numpy(spark):
    """Three experts on one photo, two on another, one on a third, which is incomplete."""
    shown = {(p, e): RNG.random((6, 3)) for p, e in ((1, 1), (1, 2), (1, 3), (2, 1), (2, 4), (3, 1))}
    labs = {k: colour_arrays.lab(v) for k, v in shown.items()}
    rows = [(p, e, i, tuple(map(float, x))) for (p, e), lab in labs.items() for i, x in enumerate(lab)]
    renditions = spark.createDataFrame(rows, "photo long, expert int, place int, lab struct<L: double, a: double, b: double>").repartition(3)
    prints = spark.createDataFrame([(p, e, v.mean(0).tolist()) for (p, e), v in shown.items()], "photo long, expert int, fingerprint array<double>")
    pairs = agreement.colour_pairs(renditions)
    scaled = agreement.scales(prints, pairs, pairs.where("photo = 1"), agreement.fingerprint_pairs(prints))
    got = {r.photo: r for r in scaled.collect()}
    for p, experts in ((1, (1, 2, 3)), (2, (1, 4))):
        away = [colour_arrays.ciede2000(labs[p, a], labs[p, b]).mean() for a, b in itertools.combinations(experts, 2)]
        near = [np.linalg.norm(shown[p, a].mean(0) - shown[p, b].mean(0)) for a, b in itertools.combinations(experts, 2)]
        assert (got[p].human_mean, got[p].human_median) == pytest.approx((np.mean(away), np.median(away)))
        assert (got[p].fingerprint_mean, got[p].fingerprint_median) == pytest.approx((np.mean(near), np.median(near)))
    assert got[3].human_mean is None and got[2].reachable_mean is None
    counted = agreement.incomplete(scaled.withColumn("set", F.lit("all")), "set").first()
    assert (counted.photos, counted.human_incomplete, counted.reachable_incomplete, counted.fingerprint_incomplete) == (3, 1, 2, 1)


# ---- translation


def translate(spark, expert, shot=""):
    m = spark.createDataFrame([(expert, shot)], "e string, s string").select(text.settings_map(F.col("e")).alias("e"), text.settings_map(F.col("s")).alias("s"))
    return m.select(F.to_json(translation.translated(F.col("e"), F.col("s"))).alias("j")).first().j


def test_translation(spark):
    neutral = json.loads(translate(spark, ""))
    assert neutral["white_balance"] == {"temperature": 0.0, "tint": 0.0} and not any(neutral["tone"].values()) and neutral["tone_curve"]["points"] == [[0, 0], [0.5, 0.5], [1, 1]]
    one = translate(spark, 'Temperature = 5000, Tint = "30", Exposure = 9, Contrast = -20, HighlightRecovery = 150, FillLight = 12, Shadows = 5, Saturation = -999999, Vibrance = 7, ToneCurveName = "Medium Contrast", Brightness = 50', "Temperature = 4000, Tint = 0")
    r = json.loads(one)
    # cooler light at the shot: less kelvin is more mired
    assert r["white_balance"]["temperature"] == pytest.approx(1e6 / 4000 - 1e6 / 5000) and r["white_balance"]["tint"] == pytest.approx(20)
    assert {k: v for k, v in r["tone"].items() if v} == {"exposure": 5, "contrast": -40, "highlights": -100, "shadows": 12, "blacks": -5} and r["color"] == {"saturation": 0, "vibrance": 7}
    lift = 50 * 0.5 / 150
    for (x, y), (a, b) in zip(r["tone_curve"]["points"], translation.MEDIUM, strict=True):
        assert x == pytest.approx(a) and y == pytest.approx(b if a in (0, 1) else min(1, b + lift * (1 - abs(2 * a - 1))))
    assert spark.createDataFrame([(one,), (translate(spark, ""),)], "j string").where(recipes.valid(F.col("j"))).count() == 2


@pytest.mark.parametrize("shot", ["", "Temperature = 0", 'Temperature = "auto"'])
def test_translation_without_a_baseline(spark, shot):
    """No as-shot white point: no shift, whatever the expert chose; a zero counts as missing."""
    assert json.loads(translate(spark, "Temperature = 7000", shot))["white_balance"]["temperature"] == 0
    assert json.loads(translate(spark, "Temperature = 0", "Temperature = 5000"))["white_balance"]["temperature"] == pytest.approx(1e6 / 5000 - 1e6 / 5500)


# ---- curves


def apply(spark, points, *edits):
    rows = [(list(points), kind, index, x, y) for kind, index, x, y in edits]
    df = spark.createDataFrame(rows, f"p {curves.POINTS}, kind string, i int, x double, y double")
    return [[tuple(q) for q in r.p] if r.p else r.p for r in df.select(curves.edited(F.col("p"), F.col("kind"), F.col("i"), F.col("x"), F.col("y")).alias("p")).collect()]


def test_curve_edits(spark):
    base, gap = [(0.0, 0.0), (0.5, 0.4), (0.501, 0.6), (1.0, 1.0)], curves.GAP
    edits = [("move", 0, 0.3, 2.0), ("move", 3, 0.2, -1.0), ("move", 1, 0.9, 0.5), ("move", 2, 0.1, 0.5), ("insert", None, 0.25, 0.3), ("insert", None, 0.5005, 0.5), ("insert", None, 0.0, 0.5), ("insert", None, 7.0, 0.5), ("remove", 1, None, None)]
    still = [("remove", 0, None, None), ("remove", 3, None, None), ("remove", 9, None, None), ("move", -1, 0.1, 0.1), ("move", 4, 0.1, 0.1), ("move", 1, None, 0.1), ("insert", None, None, 0.1), ("draw", 1, 0.1, 0.1), (None, 1, 0.1, 0.1)]
    got = apply(spark, base, *edits, *still)
    assert got[0] == [(0.0, 1.0), *base[1:]] and got[1] == [*base[:3], (1.0, 0.0)]
    assert got[2][1] == (pytest.approx(0.501 - gap), 0.5) and got[3][2] == (pytest.approx(0.5 + gap), 0.5)
    assert got[4] == [base[0], (0.25, 0.3), *base[1:]] and got[5] == base
    assert got[6][1] == (pytest.approx(gap), 0.5) and got[7][3] == (pytest.approx(1 - gap), 0.5)
    assert got[8] == [base[0], *base[2:]] and got[9:] == [base] * len(still)
    for edit, want in zip((*edits, *still), got, strict=True):
        assert curves.step(base, *edit) == want


def test_replay_is_the_fold_of_single_edits(spark, sf_dir):
    """Every user's whole history through the column expressions, and every curve that comes out is valid."""
    got = {r.user_id: (r.edits, [tuple(p) for p in r.points]) for r in studies.ar1_replayed_curves(spark, sf_dir).collect()}
    events = studies.curve_events(spark, sf_dir)
    history = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "kind", F.col("index").cast("int").alias("index"), "x", "y"))).alias("h"))
    start = F.from_json(F.lit('[{"x": 0, "y": 0}, {"x": 1, "y": 1}]'), curves.POINTS)
    folded = history.select("user_id", F.size("h").alias("n"), F.aggregate("h", start, lambda p, e: curves.edited(p, e["kind"], e["index"], e["x"], e["y"])).alias("p"))
    want = {r.user_id: (r.n, [(round(p.x, 9), round(p.y, 9)) for p in r.p]) for r in folded.collect()}
    assert got == want and len(got) > 10
    for _, points in got.values():
        xs, ys = zip(*points, strict=True)
        assert xs[0] == 0 and xs[-1] == 1 and min(np.diff(xs)) >= curves.GAP - 1e-8 and 0 <= min(ys) and max(ys) <= 1


def test_replay_of_odd_tables(spark):
    schema = "u long, at int, kind string, index int, x double, y double"
    assert curves.replayed(spark.createDataFrame([], schema), "u", ["at"]).collect() == []
    rows = [(None, 1, "insert", None, 0.5, 0.7), (None, 2, "insert", None, None, 0.7), (7, 1, "remove", 0, None, None)]
    got = {r.u: (r.edits, [tuple(p) for p in r.points]) for r in curves.replayed(spark.createDataFrame(rows, schema), "u", ["at"]).collect()}
    assert got == {None: (2, [(0, 0), (0.5, 0.7), (1, 1)]), 7: (1, [(0, 0), (1, 1)])}


# ---- rulers


def test_rulers(spark):
    rows = spark.createDataFrame([(1, "a", [3.0, 4.0, 0.0, 0.0]), (2, "b", [0.0, 0.0, 5.0, 12.0])], "edit long, note string, fingerprint array<double>")
    wide = spark.createDataFrame([(1, [2.0, 0.0, 0.0])], "edit long, vector array<double>")
    of = lambda name: {r.edit: [round(x, 9) for x in r.fingerprint] for r in rulers.restamped(rows, name, studies.SLICES, {"wide": wide}, "edit").collect()}
    assert of("combined") == {1: [3, 4, 0, 0], 2: [0, 0, 5, 12]} and of("statistics") == {1: [0, 0], 2: [5, 12]}
    assert of("recipe + statistics") == {1: [0.6, 0.8, 0, 0], 2: [0, 0, round(5 / 13, 9), round(12 / 13, 9)]}
    assert of("recipe+recipe")[1] == [0.6, 0.8, 0.6, 0.8]
    with pytest.raises(Exception, match="no vector in wide for 2"):
        of("combined+wide")
    one = rulers.restamped(rows.where("edit = 1"), "wide+recipe", studies.SLICES, {"wide": wide}, "edit")
    assert one.columns == rows.columns and one.first().fingerprint == [1, 0, 0, 0.6, 0.8]
    for bad in ("", "recipe+", "recipe+depth"):
        with pytest.raises(ValueError, match="no ruler named"):
            of(bad)


# ---- bands


@pytest.mark.parametrize("rows", [1, 3, 7, 100])
def test_bands_are_the_whole_image(spark, rows):
    """Any number of rows in a band gives the same bytes, those of the whole image rendered at once."""
    recipe = {"white_balance": {"temperature": 30, "tint": -20}, "tone": {"exposure": 0.4, "contrast": 30, "shadows": 40}, "color": {"saturation": 15}}
    images = {1: RNG.integers(0, 256, (13, 5, 3)), 2: RNG.integers(0, 256, (1, 2, 3))}
    given = spark.createDataFrame([(n, x, y, *map(int, im[y, x])) for n, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])], "image long, x int, y int, r int, g int, b int").repartition(4)
    done = {}
    for r in bands.rendered_bands(given, recipe, rows).orderBy("image", "band").collect():
        assert r.top == r.band * rows and len(r.data) == r.height * images[r.image].shape[1] * 3 and r.height <= rows
        done[r.image] = done.get(r.image, b"") + bytes(r.data)
    vector = [recipe.get(g, {}).get(k, 0) / limit for g, k, limit in colour_arrays.SLIDERS]
    for n, im in images.items():
        want = np.floor(colour_arrays.render(im.reshape(-1, 3) / 255, np.array(vector)) * 255 + 0.5)
        np.testing.assert_allclose(np.frombuffer(done[n], np.uint8), want.ravel(), atol=1)
        assert np.mean(np.frombuffer(done[n], np.uint8) != want.ravel()) < 0.02
    whole = {r.image: bytes(r.data) for r in bands.rendered_bands(given, recipe, 1000).collect()}
    assert done == whole


def test_band_of_no_rows(spark):
    given = spark.createDataFrame([(1, 0, 0, None, 255, 0)], "image long, x int, y int, r int, g int, b int")
    assert bytes(bands.rendered_bands(given, {}).first().data) == bytes([0, 255, 0])
    assert bands.rendered_bands(given.where("false"), {}).count() == 0
    with pytest.raises(ValueError, match="at least one row"):
        bands.rendered_bands(given, {}, 0)


def test_experts_of_a_row_need_no_shuffle(spark, sf_dir):
    """Rows that hold a pixel's experts give what gathered ones give; only means are shuffled, and pixels aren't numbered."""
    data = [(p, i, e, {"L": 40.0 + p + e * i % 7, "a": 3.0 * e - i % 5, "b": i % 9 - 2.0 * e}) for p in (1, 2) for i in range(20) for e in (1, 2, 3)]
    rows = spark.createDataFrame(data, "photo int, place int, expert int, lab struct<L: double, a: double, b: double>")
    met = rows.groupBy("photo", "place").agg(F.array_sort(F.collect_list(F.struct("expert", F.col("lab").alias("v")))).alias("e"))
    of = lambda df: sorted((r.photo, r.a, r.b, round(r.away, 9)) for r in df.collect())
    assert of(agreement.met_colour_pairs(met)) == of(agreement.colour_pairs(rows)) and len(of(agreement.met_colour_pairs(met))) == 6
    written = spark.createDataFrame([(1, [(1, {"L": 1.0, "a": 0.0, "b": 0.0})])], "photo int, e array<struct<expert: int, v: struct<L: double, a: double, b: double>>>")
    assert agreement.met_colour_pairs(written)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_rulers_are_dealt_by_rows(spark, monkeypatch):
    """A task's share doesn't grow with the rows, whatever the session's number of shuffle partitions; four rulers read them once."""
    monkeypatch.setattr(rulers, "TASK_ROWS", 100)
    rows = spark.range(950).select(F.col("id").alias("k"), F.array(F.lit(1.0), F.lit(2.0)).alias("fingerprint"))
    met = rulers.with_tables(rows, {}, "k")
    assert met.rdd.getNumPartitions() == 10 and met.count() == 950


def test_numbered_shuffles_once(spark):
    from lumenframe.operators.ranking import numbered

    df = numbered(spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))).select("k").repartition(5), "k")
    # the rows' own places come from the table; the only exchange left is that of counts
    assert "Window [row_number" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.k, r.i) for r in df.collect()) == [(i, i) for i in range(1000)]


@pytest.mark.parametrize("most", [3, 2])
def test_few_values_are_worked_out_once(spark, monkeypatch, most):
    """One row for each distinct value is parsed where they are few; results are the same where they aren't."""
    from lumenframe.operators import distinct

    monkeypatch.setattr(distinct, "MOST_VALUES", most)
    stored = []
    kept = distinct.kept
    monkeypatch.setattr(distinct, "kept", lambda df, what: stored.append(df.count()) or kept(df, what))
    df = spark.createDataFrame([(i, "ab" if i % 3 == 0 else "cde" if i % 3 == 1 else None) for i in range(30)], "k int, t string")
    got = {r.k: (r.t, r.n) for r in distinct.by_distinct(df, "t", {"n": F.coalesce(F.length("t"), F.lit(-1))}).collect()}
    assert stored == [3] * (most == 3) and len(got) == 30 and (got[0], got[1], got[2]) == (("ab", 2), ("cde", 3), (None, -1))


def test_a_recipe_is_parsed_once(spark):
    """Not once for each field that is read (components reads its points apart)."""
    df = spark.createDataFrame([('{"schema":1,"tone":{"exposure":2}}',), ("{",), (None,)], "j string")
    for of in (recipes.valid, recipes.components, recipes.canonical):
        plan = df.select(of(F.col("j")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert 1 <= plan.count("from_json(") <= 3
    assert [r.x for r in df.select(recipes.valid(F.col("j")).alias("x")).collect()][:2] == [True, False]
