"""Two-axis resampling against NumPy, wide-gamut colours, and commits through a crash and a restart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import colour_arrays
from lumenframe.operators import derivatives
from lumenframe.streaming.durable import ERROR_CHARS, Ledger, outcomes, sink

RNG = np.random.default_rng(9)


def image_rows(spark, images):
    rows = [(n, x, y, im.shape[1], im.shape[0], *map(float, im[y, x])) for n, im in images.items() for y in range(im.shape[0]) for x in range(im.shape[1])]
    return spark.createDataFrame(rows, "image long, x int, y int, width int, height int, r double, g double, b double").repartition(3)


def pooled(a, target, axis):
    starts = np.arange(target) * a.shape[axis] // target
    sums, counts = np.add.reduceat(a, starts, axis), np.diff(np.append(starts, a.shape[axis]))
    return sums / counts.reshape([-1 if i == axis else 1 for i in range(a.ndim)])


def test_two_sizes(spark):
    """Shapes whose sides divide by nothing, a line of one pixel, and one that is never enlarged."""
    images = {1: RNG.random((23, 37, 3)), 2: RNG.random((40, 1, 3)), 3: RNG.random((5, 4, 3))}
    sizes = {(1, 10): (6, 10), (1, 20): (12, 20), (2, 10): (10, 1), (2, 20): (20, 1), (3, 10): (5, 4), (3, 20): (5, 4)}
    found = {}
    for r in derivatives.derivatives(derivatives.linear(image_rows(spark, images), False), (10, 20)).collect():
        found.setdefault((r.image, r.longest), {})[r.y, r.x] = (r.r, r.g, r.b)
    assert set(found) == set(sizes)
    for (n, longest), (h, w) in sizes.items():
        want = colour_arrays.encode(pooled(pooled(colour_arrays.decode(images[n]), h, 0), w, 1))
        got = np.array([[found[n, longest][y, x] for x in range(w)] for y in range(h)])
        assert len(found[n, longest]) == h * w
        np.testing.assert_allclose(got, np.clip(want, 0, 1), atol=1e-12)


def test_prophoto(spark):
    """White is white, and a saturated green lies outside."""
    pixels = np.array([[[1, 1, 1], [0.5, 0.5, 0.5], [0, 1, 0], [0.01, 0.02, 0.015]]], float)
    light = derivatives.linear(image_rows(spark, {1: pixels}), True)
    rows = {r.x: r for r in light.collect()}
    np.testing.assert_allclose((rows[0].r, rows[0].g, rows[0].b), 1, atol=1e-4)
    np.testing.assert_allclose((rows[1].r, rows[1].g), 0.5**1.8, atol=1e-4)
    assert [rows[i].outside for i in (1, 2)] == [False, True] and rows[2].r < 0
    want = np.array(derivatives.ROMM_TO_RGB) @ (pixels[0, 3] / 16)
    np.testing.assert_allclose((rows[3].r, rows[3].g, rows[3].b), want, atol=1e-12)
    share = derivatives.gamut_share(light.where("x > 0")).first().outside
    assert share == pytest.approx(1 / 3)


def stream(spark, source, checkpoint, write):
    rows = spark.readStream.schema("id long, error string").option("maxFilesPerTrigger", 1).parquet(source)
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def test_stream_through_a_crash(spark, tmp_path):
    """The query dies after a batch's results and before its mark; after the restart each row is there once, and nothing half."""
    source, ledger = str(tmp_path / "in"), Ledger(str(tmp_path / "out"))
    for i in range(4):
        spark.createDataFrame([(10 * i + j, "x" * 3000 if j == 2 else None) for j in range(3)], "id long, error string").coalesce(1).write.mode("append").parquet(source)

    def work(batch):
        rows = outcomes(batch)
        return {"results": rows.where("status = 'Done'").select("id"), "states": rows.select("id", "status", "error")}

    def dies(batch, number):
        if number == 2:
            ledger.write(number, work(batch))
            raise RuntimeError("killed before the mark")
        sink(ledger, work)(batch, number)

    with pytest.raises(Exception, match="killed before the mark"):
        stream(spark, source, str(tmp_path / "checkpoint"), dies).awaitTermination()
    assert {r.commit for r in ledger.read(spark, "results").collect()} == {0, 1}
    assert ledger.read(spark, "states").count() == 6
    stream(spark, source, str(tmp_path / "checkpoint"), sink(ledger, work)).awaitTermination()
    assert sorted(r.id for r in ledger.read(spark, "results").collect()) == [10 * i + j for i in range(4) for j in range(2)]
    states = ledger.read(spark, "states")
    assert states.count() == 12 and states.where("status = 'Failed'").select(F.max(F.length("error"))).first()[0] == ERROR_CHARS
    assert {(r.name, r.n) for r in ledger.marks(spark).collect()} == {("results", 2), ("states", 3)}


def test_a_commit_again_replaces_itself(spark, tmp_path):
    ledger = Ledger(str(tmp_path))
    one = lambda ids: {"photos": spark.createDataFrame([(i,) for i in ids], "id long"), "projects": spark.createDataFrame([(i, "p") for i in ids], "id long, name string")}
    ledger.commit(1, one([1, 2, 3]))
    ledger.write(2, one([9]))
    ledger.commit(1, one([1, 2]))
    assert sorted(r.id for r in ledger.read(spark, "photos").collect()) == [1, 2] and ledger.read(spark, "projects").count() == 2
