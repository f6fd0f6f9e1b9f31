"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become learned vectors; learned filters slide over overlapping chunks that together cover
the whole document; each filter keeps its largest response in a chunk, and the mean and the
maximum over the chunks meet in one logistic unit. The network is trained on the driver, on a
bounded sample of labelled rows: of each class at most SAMPLE ids, those with the smallest hash,
as long as their texts have SAMPLE_BYTES together. A text of the sample is read whole in each of
its steps, in groups of chunks. The share of each class among all labelled rows then sets the
intercept. Scoring reads every byte of every text, likewise in groups of a bounded size.

Defined results: a null or empty text is scored as one chunk of padding; without labelled rows,
or with one class only, the score is the share of label 1 (0.5 if there is none); repeated rows
repeat; an id with several labels counts once, with the smallest, and with its first text in
order; labels of unknown ids aren't used; other columns are kept, one named as the score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import packed, prepared, released, unpacked
from .textbatch import slices

#: Labelled rows of each class that the network is trained on, at most, and bytes of their texts.
SAMPLE, SAMPLE_BYTES = 1000, 16 << 20
WIDTH, STEP, DEPTH, FILTERS = 8, 2, 8, 32
#: Windows in a chunk, and from one chunk's start to the next: 512 and 448 bytes.
CHUNK, HOP = 256, 224
GROUP = 128
STEPS, BATCH, RATE = 250, 32, 0.01
THRESHOLD = 0.3


@dataclass
class Network:
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    intercept: float

    def windows(self, data: np.ndarray, starts: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte places of each chunk's windows (beyond a text's last window that one again), and their vectors."""
        at = np.minimum(starts[:, None] + STEP * np.arange(CHUNK), last[:, None])
        held = data[at[:, :, None] + np.arange(WIDTH)]
        return held, self.bytes_[held].reshape(-1, WIDTH * DEPTH)

    def pooled(self, data: np.ndarray, starts: np.ndarray, last: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(starts), GROUP):
            _, x = self.windows(data, starts[i : i + GROUP], last[i : i + GROUP])
            parts.append((x @ self.filters).reshape(-1, CHUNK, FILTERS).max(1))
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def logit(self, pooled: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(pooled, bounds[:-1]) / np.diff(bounds)[:, None]
        return np.concatenate((mean, np.maximum.reduceat(pooled, bounds[:-1])), 1) @ self.out + self.intercept


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts with zero bytes after each; starts and last windows of all chunks; each text's bounds among them."""
    size = np.diff(offsets)
    room = size + WIDTH + size % STEP
    begin = np.concatenate(([0], np.cumsum(room)))
    out = np.zeros(begin[-1], np.uint8)
    out[np.arange(len(data)) + np.repeat(begin[:-1] - offsets[:-1], size)] = data
    n_windows = np.maximum(1, -(-size // STEP))
    n_chunks = np.maximum(1, -(-(n_windows - (CHUNK - HOP)) // HOP))
    bounds = np.concatenate(([0], np.cumsum(n_chunks)))
    place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n_chunks)
    starts = np.repeat(begin[:-1], n_chunks) + place * HOP * STEP
    last = np.repeat(begin[:-1] + (n_windows - 1) * STEP, n_chunks)
    return out, starts, last, bounds


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def gradients(net: Network, data: np.ndarray, starts: np.ndarray, last: np.ndarray, local: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """The logistic loss of some texts, given by their chunks and bounds among them, and its gradients. Windows are held for a group of chunks at a time."""
    won, top = [], []
    for i in range(0, len(starts), GROUP):
        _, x = net.windows(data, starts[i : i + GROUP], last[i : i + GROUP])
        z = (x @ net.filters).reshape(-1, CHUNK, FILTERS)
        won.append(z.argmax(1))
        top.append(np.take_along_axis(z, won[-1][:, None], 1)[:, 0] + net.bias)
    won, top = np.concatenate(won), np.concatenate(top)
    pooled = np.maximum(top, 0)
    counts = np.diff(local)
    doc = np.repeat(np.arange(len(labels)), counts)
    mean, most = np.add.reduceat(pooled, local[:-1]) / counts[:, None], np.maximum.reduceat(pooled, local[:-1])
    feature = np.concatenate((mean, most), 1)
    logit = feature @ net.out + net.intercept
    loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
    wrong = (1 / (1 + np.exp(-logit)) - labels).astype(np.float32) / len(labels)
    spread = wrong[:, None] * net.out
    # a window in two overlapping chunks may be the largest in both, which then share its gradient
    ties = (pooled == most[doc]).astype(np.float32)
    down = (spread[:, :FILTERS] / counts[:, None])[doc] + (spread[:, FILTERS:] / np.add.reduceat(ties, local[:-1]))[doc] * ties
    down *= top > 0
    to_filters, to_bytes = np.zeros_like(net.filters), np.zeros_like(net.bytes_)
    for i in range(0, len(starts), GROUP):
        g = down[i : i + GROUP]
        chunk, f = np.nonzero(g)
        at = np.minimum(starts[i + chunk] + STEP * won[i + chunk, f], last[i + chunk])
        held = data[at[:, None] + np.arange(WIDTH)]
        g = g[chunk, f][:, None]
        x = net.bytes_[held].reshape(-1, WIDTH * DEPTH) * g
        order = np.argsort(f, kind="stable")
        present, first = np.unique(f[order], return_index=True)
        if len(first):
            to_filters[:, present] += np.add.reduceat(x[order], first).T
        back = (net.filters.T[f] * g).reshape(-1, DEPTH)
        for k in range(DEPTH):
            to_bytes[:, k] += np.bincount(held.ravel(), back[:, k], 256)
    return loss, {"bytes_": to_bytes, "filters": to_filters, "bias": down.sum(0), "out": feature.T @ wrong, "intercept": wrong.sum()}


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 7) -> Network:
    """Adam on the logistic loss; only the windows that win a pool carry gradients."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.5, (256, DEPTH)).astype(np.float32), rng.normal(0, (2 / (WIDTH * DEPTH)) ** 0.5, (WIDTH * DEPTH, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0)
    data, starts, last, bounds = padded(*_joined(texts))
    state = {k: [np.zeros_like(np.asarray(getattr(net, k), np.float32)) for _ in range(2)] for k in ("bytes_", "filters", "bias", "out", "intercept")}
    step, n = 0, len(texts)
    for _ in range(-(-STEPS * BATCH // n)):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            docs = order[i : i + BATCH]
            chunks = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in docs])
            local = np.concatenate(([0], np.cumsum([bounds[d + 1] - bounds[d] for d in docs])))
            _, grads = gradients(net, data, starts[chunks], last[chunks], local, labels[docs])
            grads["out"] = grads["out"] + 1e-4 * net.out
            step += 1
            for k, grad in grads.items():
                m, v = state[k]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, (getattr(net, k) - move).astype(np.float32))
    share = float(labels.mean())
    net.intercept = float(net.intercept + np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def fit(docs: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Network | float:
    """The network, or a constant score where the labels have no two classes. Only rows of labels count that aren't held out."""
    known = labels.where(F.col(target).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return counts.get(1, 0) / total if total else 0.5
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("label") == label).select("doc_id", "label", F.xxhash64("doc_id").alias("hash")).orderBy("hash", "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most twice the sample of rows: first their sizes, then the texts that fit
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    sizes = texts.groupBy("doc_id", "label", "hash").agg(F.max(F.octet_length("text")).alias("size")).collect()
    room, picked = {0: sample_bytes, 1: sample_bytes}, []
    for r in sorted(sizes, key=lambda r: (r.hash, r.doc_id)):
        if r.size <= room[r.label]:
            room[r.label] -= r.size
            picked.append((r.doc_id, r.label))
    if not picked:
        return counts[1] / total
    ids = docs.sparkSession.createDataFrame(picked, known.schema)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    y = np.array([r.label for r in rows], np.float32)
    if not 0 < y.sum() < len(y):
        return counts[1] / total
    return train([r.text for r in rows], y, counts[1] / total)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def score(docs: DataFrame, model: Network | float, column: str = "score") -> DataFrame:
    """docs with the probability of label 1, from the text alone, as one more column or in place of one of its name."""
    spark = prepared(docs.sparkSession)
    columns, docs = docs.columns, packed(docs, "text")
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for batch in batches:
            parts = []
            for row, end, data, offsets in slices(batch):
                if isinstance(net, Network):
                    padded_data, starts, last, bounds = padded(data, offsets)
                    logit = net.logit(net.pooled(padded_data, starts, last), bounds)
                    parts.append(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -50, 50))))
                else:
                    parts.append(np.full(end - row, float(net)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts) if parts else [], pa.float64())], [*batch.schema.names, "score"])

    return unpacked(docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])), columns, ("text",), **{column: F.col("score")})


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
