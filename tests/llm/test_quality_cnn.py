"""Held-out accuracy, gradients, whole-text coverage and odd inputs."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import quality_cnn as q


@pytest.fixture(scope="module")
def tables(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return q.fit(*tables)


def test_held_out_accuracy(spark, tables, model):
    docs, labels = tables
    rows = q.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    right = [(r.score >= q.THRESHOLD) == bool(r.quality) for r in held]
    assert len(held) > 50 and np.mean(right) > 0.95


def test_every_byte_counts(spark, model):
    # a filter that answers to one byte finds it wherever it stands
    net = q.Network(np.zeros((256, q.DEPTH), np.float32), np.zeros((q.WIDTH * q.DEPTH, q.FILTERS), np.float32), np.zeros(q.FILTERS, np.float32), np.zeros(2 * q.FILTERS, np.float32), -1.0)
    net.bytes_[ord("#"), 0] = 1
    net.filters[:: q.DEPTH, 0] = 1
    net.out[q.FILTERS] = 5
    texts = ["x" * n + "#" + "y" * m for n in (0, 1, 7, 8, 447, 448, 511, 512, 900, 5000) for m in (0, 1, 300, 2000)]
    df = spark.createDataFrame(list(enumerate([*texts, "xyz", "", None])), "doc_id long, text string")
    got = {r.doc_id: r.score for r in q.score(df, net).collect()}
    assert all(got[i] > 0.5 for i in range(len(texts))) and all(got[len(texts) + i] < 0.5 for i in range(3))


def forward(net, text):
    """The network window by window, in double precision."""
    raw = (text or "").encode()
    n_windows = max(1, (len(raw) + q.STEP - 1) // q.STEP)
    held = raw + bytes(q.WIDTH + q.STEP)
    answers = []
    for w in range(n_windows):
        vector = [float(x) for b in held[w * q.STEP : w * q.STEP + q.WIDTH] for x in net.bytes_[b]]
        answers.append([sum(v * float(net.filters[i, f]) for i, v in enumerate(vector)) for f in range(q.FILTERS)])
    chunks, first = [], 0
    while True:
        part = answers[first : first + q.CHUNK]
        chunks.append([max(0.0, max(a[f] for a in part) + float(net.bias[f])) for f in range(q.FILTERS)])
        if first + q.CHUNK >= n_windows:
            break
        first += q.HOP
    mean = [sum(c[f] for c in chunks) / len(chunks) for f in range(q.FILTERS)]
    most = [max(c[f] for c in chunks) for f in range(q.FILTERS)]
    logit = float(net.intercept) + sum(float(w) * x for w, x in zip(net.out, mean + most, strict=True))
    return 1 / (1 + math.exp(-logit))


def test_forward_by_hand(spark):
    """Scores of whole texts, around every chunk's bounds, against the naive pass."""
    rng = np.random.default_rng(5)
    net = q.Network(rng.normal(0, 0.5, (256, q.DEPTH)).astype(np.float32), rng.normal(0, 0.2, (q.WIDTH * q.DEPTH, q.FILTERS)).astype(np.float32), rng.normal(0, 0.1, q.FILTERS).astype(np.float32), rng.normal(0, 0.05, 2 * q.FILTERS).astype(np.float32), 0.1)
    sizes = (1, 2, 7, 8, 9, 511, 512, 513, 959, 960, 961, 1500)
    texts = [None, "", "é" * 300, *["".join(rng.choice(list("abcdefgh \n"), n)) for n in sizes]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in q.score(df, net).collect()}
    assert all(abs(got[i] - forward(net, t)) < 1e-4 for i, t in enumerate(texts))


def test_training_learns_and_is_repeatable():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcde "), 60 + 10 * (i % 9))) + (" $$ " if i % 2 else "") for i in range(200)]
    labels = np.array([i % 2 for i in range(200)], np.float32)
    one, two = q.train(texts, labels, 0.5), q.train(texts, labels, 0.5)
    assert (one.filters == two.filters).all()
    data, starts, last, bounds = q.padded(*q._joined(texts))
    assert ((one.logit(one.pooled(data, starts, last), bounds) > 0) == labels).mean() > 0.95


def test_gradients():
    """Against finite differences in double precision, for texts of one chunk and of many."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abcdefgh \n"), n)) for n in (5, 300, 2000, 90_000)]
    labels = np.array([0, 1, 1, 0], np.float32)
    net = q.Network(rng.normal(0, 0.5, (256, q.DEPTH)), rng.normal(0, 0.2, (q.WIDTH * q.DEPTH, q.FILTERS)), rng.normal(0, 0.1, q.FILTERS), rng.normal(0, 0.1, 2 * q.FILTERS), 0.1)
    data, starts, last, bounds = q.padded(*q._joined(texts))
    assert len(starts) > 2 * q.GROUP - 100
    _, grads = q.gradients(net, data, starts, last, bounds, labels)
    for name, at in (("bytes_", (ord("a"), 0)), ("bytes_", (ord(" "), 3)), ("filters", (5, 2)), ("filters", (40, 31)), ("bias", (7,)), ("out", (3,)), ("out", (q.FILTERS + 4,))):
        values, found = getattr(net, name), []
        for move in (1e-5, -2e-5):
            values[at] += move
            found.append(q.gradients(net, data, starts, last, bounds, labels)[0])
        values[at] += 1e-5
        assert abs((found[0] - found[1]) / 2e-5 - grads[name][at]) < 1e-4


def test_sample_bounds_and_labels(spark):
    """Texts beyond the sample's bytes are left out, and of contradictory labels the smallest counts, whatever the order."""
    docs = spark.createDataFrame([(i, "good text " * 5 if i % 2 else "$$ bad " * 5) for i in range(40)] + [(1, "x" * 200_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, 0)], "doc_id long, quality int")
    one, two = (q.fit(docs, labels.orderBy(order), sample_bytes=1500) for order in ("quality", "doc_id"))
    assert (one.filters == two.filters).all()
    assert q.fit(docs, labels, sample_bytes=1) == q.fit(docs, labels, sample_bytes=0)


def test_odd_tables(spark, tables, model):
    docs = spark.createDataFrame([(1, None, 2.0), (None, "", 1.0), (3, "x" * 400_000, 1.0), (3, "x" * 400_000, 1.0)], "doc_id long, text string, quality double")
    rows = q.score(docs, model).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    named = q.score(docs.withColumn("_score", F.lit(7)).withColumn("rest", F.lit(8)), model, "_score")
    assert named.columns == ["doc_id", "text", "quality", "_score", "rest"] and {r.rest for r in named.collect()} == {8} and all(0 <= r["_score"] <= 1 for r in named.collect())
    assert q.score(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert q.fit(docs, labels) == 1.0 and q.fit(docs, labels.limit(0)) == 0.5
