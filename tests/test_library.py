"""Statistics, recipes, sources, writes, fits and streams."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import recipes
from lumenframe.functions.statistics import sign_test, student_quantile
from lumenframe.operators import fitting, pieces
from lumenframe.operators.fitting import fit_edits
from lumenframe.operators.upsert import improved, upserted
from lumenframe.plans.relational import numbered
from lumenframe.sources import files
from lumenframe.streaming import jobs


def test_statistics():
    assert math.isclose(sign_test(90, 158), 1.8721191e-05, rel_tol=1e-6)
    assert sign_test(0, 0) == 1.0 and sign_test(3, 3) == 1.0
    assert math.isclose(student_quantile(0.975, 10), 2.2281388519, abs_tol=1e-8)
    assert math.isclose(student_quantile(0.975, 299), 1.967929669, abs_tol=1e-6)


GOOD = {"schema": 1, "tone": {"exposure": 1.5}, "tone_curve": {"points": [[0, 0], [0.5, 0.6], [1, 1]]}}


def test_recipes(spark):
    bad = [{**GOOD, "schema": 2}, {"tone": {}}, {**GOOD, "more": 1}, {**GOOD, "tone": {"exposure": 5.1}}, {**GOOD, "tone": {"gamma": 1}}, {**GOOD, "tone_curve": {"points": [[0, 0], [0.5, 1], [0.5, 1], [1, 1]]}}, {**GOOD, "tone_curve": {"points": [[0.1, 0], [1, 1]]}}]
    good = [GOOD, {"schema": 1}, {"schema": 1, "color": {"saturation": -100, "vibrance": 100}}]
    df = spark.createDataFrame([(json.dumps(x), i < len(good)) for i, x in enumerate(good + bad)], "j string, want boolean").coalesce(1)
    assert all(r.v == r.want for r in df.select(recipes.valid(F.col("j")).alias("v"), "want").collect())
    assert [r[0] for r in df.limit(3).select(recipes.neutral(F.col("j"))).collect()] == [False, True, False]
    full = json.loads(df.limit(1).select(recipes.canonical(F.col("j"))).first()[0])
    assert list(full) == ["schema", "white_balance", "tone", "color", "tone_curve"] and full["tone"]["exposure"] == 1.5 and len(full["tone"]) == 6


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x1\n\n  x2 \n")
    (tmp_path / "b.txt").write_text("x3\nx2\n")
    a, b = str(tmp_path / "a.txt"), str(tmp_path / "b.txt")
    assert sorted(r.name for r in files.read_names(spark, a, b).collect()) == ["x1", "x2", "x3"]
    assert files.read_index(spark, a).count() == 2
    with pytest.raises(Exception, match="two indexes"):
        files.read_index(spark, a, b).collect()
    rows = spark.createDataFrame([(2, None), (1, "é")], "id long, name string")
    files.write_jsonl(rows, f"{tmp_path}/rows", "id")
    assert sorted(map(tuple, files.read_jsonl(spark, f"{tmp_path}/rows", "id long, name string").collect())) == [(1, "é"), (2, None)]
    (tmp_path / "d.json").write_text('{\n "seed": 3,\n "held_out": ["a"]\n}')
    assert files.read_document(spark, str(tmp_path / "d.json"), "seed long, held_out array<string>").first().held_out == ["a"]
    spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id long, vector array<double>").write.parquet(f"{tmp_path}/v")
    with pytest.raises(Exception, match="another width"):
        files.read_vectors(spark, f"{tmp_path}/v", 2).collect()
    assert files.read_objects(spark, str(tmp_path), "*.txt").count() == 2


def test_writes(spark):
    old = spark.createDataFrame([(1, 5.0, "a"), (None, 6.0, "n")], "k long, v double, t string")
    new = spark.createDataFrame([(1, 1.0, "b"), (2, 2.0, "b"), (None, 7.0, "m")], "k long, v double, t string")
    assert {tuple(r) for r in upserted(old, new, ["k"], ["v"]).collect()} == {(1, 1.0, "a"), (2, 2.0, "b"), (None, 6.0, "n"), (None, 7.0, "m")}
    a = spark.createDataFrame([(1, 5.0, 0), (2, 5.0, 0), (3, None, 0)], "k long, e double, s int")
    b = spark.createDataFrame([(1, 5.0, 1), (2, 4.0, 1), (3, 9.0, 1), (4, 1.0, 1)], "k long, e double, s int")
    assert sorted(map(tuple, improved(a, b, "k", "e").collect())) == [(1, 5.0, 0), (2, 4.0, 1), (3, 9.0, 1)]


def test_numbered(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.col("id") * 7919, F.lit(1000))).select("k").repartition(5)
    assert sorted((r.k, r.i) for r in numbered(df, "k").collect()) == [(i, i) for i in range(1000)]


def test_fit(spark):
    rng = np.random.default_rng(2)
    rows = []
    for image, (e, c) in enumerate(((0.5, 0.3), (-0.7, -0.2))):
        for place in range(240):
            p = rng.random(3) * 0.6
            x = p * 2**e
            i = np.clip(x, 0, 1)
            rows.append((image, place, *map(float, p), *map(float, x + c * (i * i * (3 - 2 * i) - i))))
    df = spark.createDataFrame(rows, "image long, place long, r double, g double, b double, r2 double, g2 double, b2 double")
    got = {r.image: r for r in fit_edits(df).collect()}
    assert abs(got[0].exposure - 0.5) < 1e-3 and abs(got[1].contrast + 20) < 0.1 and all(r.error < 1e-4 and r.message is None for r in got.values())


def test_fit_reads_every_pixel(spark):
    """Odd and missing places count, for the parameters and for the error."""
    rng = np.random.default_rng(4)
    rows = []
    for image, place in [(0, 4 * i + 1) for i in range(60)] + [(1, None)] * 60 + [(2, i) for i in range(200)] + [(None, i) for i in range(40)]:
        p = rng.random(3) * 0.4
        x = p * 2**0.5
        noise = 0.1 * (place % 4 == 1) if image == 2 else 0.0
        rows.append((image, place, *map(float, p), *map(float, x + 0.2 * (x * x * (3 - 2 * x) - x) + noise)))
    rows += [(3, 0, 0.1, 0.2, None, 0.1, 0.2, 0.3), (3, 4, 0.1, 0.2, 0.3, 0.1, 0.2, 0.3)]
    df = spark.createDataFrame(rows, "image long, place long, r double, g double, b double, r2 double, g2 double, b2 double")
    got = {r.image: r for r in fit_edits(df).collect()}
    assert set(got) == {0, 1, 2, 3, None}
    assert all(abs(got[k].exposure - 0.5) < 1e-3 and abs(got[k].contrast - 20) < 0.1 and got[k].error < 1e-4 for k in (0, 1, None))
    assert got[2].error > 0.01
    assert got[3].exposure is None and got[3].message
    assert fit_edits(df.limit(0)).count() == 0


def test_small_images_move_once(spark, monkeypatch):
    """Images inside a task are fitted there, with what rounds over pieces find; only those at its ends take rounds."""
    rng = np.random.default_rng(6)
    rows = []
    for image in range(6):
        for _ in range(50):
            p = rng.random(3) * 0.5
            x = p * 2 ** (0.1 * image)
            rows.append((image, *map(float, p), *map(float, x + 0.02 * image * (x * x * (3 - 2 * x) - x) + rng.random(3) * 0.01)))
    rows += [(7, 0.1, 0.2, None, 0.1, 0.2, 0.3), (8, *[0.5] * 6)]
    df = spark.createDataFrame(rows, "image long, r double, g double, b double, r2 double, g2 double, b2 double").repartition(3)
    trials = []
    beside = fitting._beside
    monkeypatch.setattr(fitting, "_beside", lambda p, t: trials.append(t.select("image").distinct().count()) or beside(p, t))
    one = {r.image: r for r in fit_edits(df).collect()}
    # the first and the last image of the one task
    assert max(trials) == 2 and len(one) == 8 and one[7].message == "1 pixels lack a channel"
    monkeypatch.setattr(pieces, "PIECE", 20)
    many = {r.image: r for r in fit_edits(df).collect()}
    for i, r in one.items():
        assert r.message == many[i].message
        if r.message is None:
            assert (r.exposure, r.contrast, r.error) == pytest.approx((many[i].exposure, many[i].contrast, many[i].error), abs=1e-5)


def stream(spark, tmp_path, build, mode, name):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    parts = tmp_path / f"in-{name}"
    source.repartitionByRange(3, "ts").write.parquet(str(parts))
    events = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(parts))
    query = build(events).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).start()
    query.processAllAvailable()
    query.stop()
    return source, spark.sql(f"SELECT * FROM {name}")


def test_stream_windows(spark, tmp_path):
    source, out = stream(spark, tmp_path, lambda e: jobs.windows(e, late="3650 days"), "update", "hours")
    want = {(r.event_type, r.start): r.n for r in source.groupBy("event_type", F.window("ts", "1 hour")).count().select("event_type", F.col("window.start").alias("start"), F.col("count").alias("n")).collect()}
    got = {}
    for r in out.collect():
        got[r.event_type, r.start] = max(r.n, got.get((r.event_type, r.start), 0))
    assert got == want


def test_stream_states(spark, tmp_path):
    source, out = stream(spark, tmp_path, jobs.machine, "update", "states")
    last = {r.user_id: r.steps for r in out.groupBy("user_id").agg(F.max("steps").alias("steps")).collect()}
    files_in_order = {}
    for r in source.orderBy("ts", "event_id").collect():
        status, steps = files_in_order.get(r.user_id, (None, 0))
        wanted = jobs.STATES.get(r.event_type)
        files_in_order[r.user_id] = (wanted, steps + 1) if wanted in jobs.ALLOWED[status] else (status, steps)
    assert set(last) == set(files_in_order)
    assert all(v >= 0 for v in last.values())


def test_stream_stacks(spark, tmp_path):
    _, out = stream(spark, tmp_path, jobs.undo_stacks, "update", "stacks")
    rows = out.collect()
    assert rows and all(0 <= r.undo <= jobs.UNDO_LIMIT and r.redo >= 0 for r in rows)


def test_claim(spark):
    rows = spark.createDataFrame([(1, 5, "a", 3), (2, 6, "a", 1), (3, 7, "b", 2)], "event_id long, user_id long, event_type string, ts long")
    assert sorted(map(tuple, jobs.claim(rows).collect())) == [("a", 2, 6), ("b", 3, 7)]
