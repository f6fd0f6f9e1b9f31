"""Quality rules: plain counts of each document, and lines that too many documents of one host share.

Each document is read once; what the later steps need of it (counts, and for each distinct
line its hash and words) is kept as a table in the shared folder. Line frequencies are counted
over (host, line) pairs, so a hot host spreads over all tasks, and only lines over the limit go on.

The limit is absolute: lines in more than min_docs documents of a host, however large it is.
Lines over it are removed; a document that keeps less than min_left of its words is rejected.

Defined results: a null or empty text has no words and fails the base rules; a null host is
the host ""; lines without a word have no frequency; each row is one document, also where ids
repeat; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import prepared, released, semi_by_counts, written
from .textbatch import LOWER, NOT_SPACE, Grams, lines, list_array, mix, owner, slices, span_hashes, stripped, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BROADCAST_LINES = 500_000


def repeated_words(hashes: np.ndarray, bounds: np.ndarray, k: int = 3) -> np.ndarray:
    """Per text, the words inside windows of k words that its text holds twice or more."""
    n, text = len(hashes), owner(bounds)
    grams = Grams(hashes).all(k)
    if not len(grams):
        return np.zeros(len(bounds) - 1, np.int64)
    grams = grams ^ mix(text[: len(grams)].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(text[k - 1 :] == text[: len(grams)])
    order = np.sort(grams[at])
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        bits = np.uint64(44)
        table = np.zeros(1 << 20, bool)
        table[twice >> bits] = True
        at = at[table[grams[at] >> bits]]
        at = at[twice[np.minimum(np.searchsorted(twice, grams[at]), len(twice) - 1)] == grams[at]]
    else:
        at = at[:0]
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + k, -1)
    covered = np.concatenate(([0], np.cumsum(np.cumsum(delta[:n]) > 0)))
    return np.diff(covered[bounds])


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(flags), offsets))


def _duplicate_lines(raw: bytes, where: list[int]) -> list[int]:
    out = []
    for a, b in zip(where, where[1:], strict=False):
        rows = raw[a:b].split(b"\n")
        n = 0
        if len(set(rows)) < len(rows):
            seen: set[bytes] = set()
            for row in rows:
                if row in seen:
                    n += bool(row.strip())
                seen.add(row)
        out.append(n)
    return out


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        for row, end, data, offsets in slices(batch):
            starts, ends, bounds = words(data, offsets, NOT_SPACE)
            counts = [
                np.diff(bounds),
                _per_text(NOT_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
                _per_text(SYMBOLS[data], offsets),
                _duplicate_lines(data.tobytes(), offsets.tolist()),
                repeated_words(span_hashes(data, starts, ends), bounds),
            ]
            lo, hi, line_bounds = lines(data, offsets)
            in_line = np.diff(np.searchsorted(starts, np.stack((lo, hi), 1)), axis=1)[:, 0]
            first, last = stripped(data, lo, hi)
            at = np.flatnonzero(in_line)
            raw = LOWER[data].tobytes()
            hashes = np.array([digest(raw[s:e]) for s, e in zip(first[at].tolist(), last[at].tolist(), strict=True)], np.uint64)
            text = owner(line_bounds)[at]
            order = np.lexsort((hashes, text))
            hashes, text, n = hashes[order], text[order], in_line[at][order]
            new = np.ones(len(order), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            n = np.add.reduceat(n, np.flatnonzero(new)) if len(n) else n
            pairs = pa.StructArray.from_arrays([pa.array(hashes[new].view(np.int64)), pa.array(n.astype(np.int64))], ["line", "words"])
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("host"), *[pa.array(np.asarray(c), pa.int64()) for c in counts], list_array(pairs, np.bincount(text[new], minlength=end - row))],
                ["doc_id", "host", *_BASE, "lines"],
            )


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the five base counts, and lines: each distinct line's hash and words."""
    prepared(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce(F.col(host), F.lit("")).alias("host"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{name} long" for name in _BASE)
    return rows.mapInArrow(released(_measure), f"doc_id {kind}, host string, {counts}, lines array<struct<line: long, words: long>>")


def frequent_lines(measured: DataFrame, min_docs: int) -> DataFrame:
    """host, line, n_docs of the lines in more than min_docs documents of their host, at any size of host."""
    return measured.select("host", F.explode("lines.line").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > min_docs)


def judge(docs: DataFrame, host: str = "source", min_docs: int = 20, min_left: float = 0.3, min_words: int = 50) -> DataFrame:
    """doc_id, the base counts, base_failed, n_left_words (outside frequent lines) and kept."""
    base = written(measure(docs, host).withColumn("row", F.monotonically_increasing_id()), "quality-base")
    often = written(frequent_lines(base, min_docs), "quality-lines")
    pairs = base.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.line", "x.words")
    if often.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        found = pairs.join(F.broadcast(often.select("host", "line")), ["host", "line"])
    else:
        found = semi_by_counts(pairs, often.withColumnRenamed("n_docs", "n"), ["host", "line"])
    gone = found.groupBy("row").agg(F.sum("words").alias("n_gone"))
    left = F.col("n_words") - F.coalesce("n_gone", F.lit(0))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return base.drop("lines").join(gone, "row", "left").select("doc_id", *_BASE, failed.alias("base_failed"), left.alias("n_left_words"), (~failed & (left >= F.col("n_words") * min_left)).alias("kept"))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_left_words")
