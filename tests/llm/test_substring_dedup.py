"""The factors against counting every window."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import cluster
from lumenframe.llm import substring_dedup as sd


def brute(texts, w):
    rows = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(x[i : i + w]) for x in rows for i in range(len(x) - w + 1))
    for x in rows:
        gone = {j for i in range(len(x) - w + 1) if counts[tuple(x[i : i + w])] > 1 for j in range(i, i + w)}
        yield len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone)


def test_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for (i, _), (n, g, t) in zip(docs, brute([t for _, t in docs], 35), strict=True)]
    assert sorted(map(tuple, sd.op3_substring_dedup(spark, d).collect())) == want
    assert any(x[2] for x in want)


# wide: so few stretches of one anchor that windows of their own and hot keys occur
@pytest.mark.parametrize(("seed", "w", "k", "wide"), [(1, 6, 3, 20_000), (2, 8, 4, 3), (3, 5, 1, 2), (4, 35, 12, 20_000), (5, 9, 2, 20_000)])
def test_random(spark, seed, w, k, wide):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(6 if i % 3 else 900)}" for _ in range(rng.randrange(2, 3 * w))] for i in range(8)]
    texts = [None, "", " \n", "a " * (5 * w), "b " * (w - 1), "c " * w, "é " * (w + 1)]
    for _ in range(80):
        parts = [rng.choice(passages) if rng.random() < 0.4 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 2 * w))] for _ in range(rng.randrange(1, 6))]
        texts.append("  ".join(" ".join(p) for p in parts))
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[20])]
    df = spark.createDataFrame([(*r, "s", 1, 2, 3, 4) for r in rows], "doc_id long, text string, spans string, _spans int, copy int, _copy int, rest int").repartition(3)
    got = sorted((r["_n_words"], r["_n_removed"], r["_text"]) for r in sd.dedup_substrings(df, w, k, wide).collect())
    assert got == sorted(brute([t for _, t in rows], w))
    assert {(r["spans"], r["_spans"], r["copy"], r["_copy"], r["rest"]) for r in sd.dedup_substrings(df, w, k, wide).collect()} == {("s", 1, 2, 3, 4)}
    assert sd.dedup_substrings(df.limit(0), w, k).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_longest_matches(seed):
    """Factors are greedy, each the longest run of windows found elsewhere under its anchor, and their sources read the same."""
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 12, 60)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    windows = rng.integers(0, 4 if seed % 2 else 30, bounds[-1])
    group = np.sort(rng.integers(0, 8, len(sizes)))
    found = sd.Reference(windows, bounds, group)
    runs = [(g, windows[a:b].tolist(), a) for g, a, b in zip(group.tolist(), bounds, bounds[1:], strict=False)]

    def longest(g, rest, at):
        best = 0
        for h, other, start in runs:
            for j in range(len(other)):
                if h == g and start + j != at:
                    n = 0
                    while n < min(len(rest), len(other) - j) and rest[n] == other[j + n]:
                        n += 1
                    best = max(best, n)
        return best

    want = []
    for s, (g, x, a) in enumerate(runs):
        i = 0
        while i < len(x):
            n = longest(g, x[i:], a + i)
            if n:
                want.append((s, i, n))
            i += max(n, 1)
    stretch, place, source, length = found.parse()
    assert sorted(zip(stretch.tolist(), place.tolist(), length.tolist(), strict=True)) == want
    for s, p, q, n in zip(stretch, place, source, length, strict=True):
        assert q != bounds[s] + p and windows[q : q + n].tolist() == windows[bounds[s] + p : bounds[s] + p + n].tolist()


def test_smallest():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 24, 25, 100):
        values = rng.integers(0, 5, n).astype(np.uint64) << np.uint64(40)
        for width in (1, 2, 3, 7, 24):
            want = [i + int(np.argmin(values[i : i + width])) for i in range(n - width + 1)]
            assert sd.leftmost_smallest(values, width).tolist() == want


def test_bloom(spark):
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 3000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key long").repartition(3)
    held = sd.bloom_of(df, len(keys))
    assert held.holds(keys.view(np.uint64)).all()
    assert held.holds((keys + 12345).view(np.uint64)).mean() < 0.1


# hot: how many stretches may be looked up, the rest are joined
@pytest.mark.parametrize("hot", [200_000, 20, 1])
def test_copies_under_wide_anchors(spark, hot, monkeypatch):
    """A passage that comes many times, in copies, near copies and behind itself, under anchors too wide for blocks."""
    monkeypatch.setattr(cluster, "HOT_KEYS", hot)
    rng = random.Random(9)
    base = [f"p{i}" for i in range(30)]
    texts = [" ".join(base * (1 + i % 5)) for i in range(30)]
    for _ in range(40):
        near = base * 3
        for _ in range(2):
            near[rng.randrange(len(near))] = f"u{rng.randrange(10**6)}"
        texts += [" ".join(near)] * rng.choice([1, 1, 1, 2, 5])
    rows = [(None if i % 11 == 0 else str(i // 2), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    got = sorted((r["doc_id"] or "", r["_n_words"], r["_n_removed"], r["_text"]) for r in sd.dedup_substrings(df, 9, 4, 5).collect())
    assert got == sorted((i or "", *x) for (i, _), x in zip(rows, brute([t for _, t in rows], 9), strict=True))


def test_wide_rows(spark, monkeypatch):
    """Copies of stretches that follow each other come back as one span of each document, not as a row for each stretch."""
    # of 900 stretches, 300 of a kind; those without copies share a window with them or not
    rows = [(d, 7, k, 10 + k, 12 * k, 12, [100 * k + i for i in range(12)]) for d in range(300) for k in (1, 2, 3)]
    rows += [(900, 8, 1, 50, 5, 3, [105, 106, 999]), (901, 8, 1, 51, 5, 2, [997, 998]), (902, 8, 2, 11, 0, 2, [201, 996])]
    placed = spark.createDataFrame(rows, "doc_id long, copy long, key long, content long, first int, count int, windows array<long>").repartition(1, F.lit(0))
    want = [(d, 7, 12, 36) for d in range(300)] + [(900, 8, 5, 2), (902, 8, 0, 1)]
    assert sorted(map(tuple, sd._wide(placed, 3).collect())) == want
    # none looked up, all joined: the same windows, a row for each stretch
    monkeypatch.setattr(cluster, "HOT_KEYS", 1)
    assert sorted(map(tuple, sd._wide(placed, 3).collect())) == sorted([(d, 7, 12 * k, 12) for d in range(300) for k in (1, 2, 3)] + want[300:])


def test_pairs():
    rng = np.random.default_rng(4)
    a, b = rng.integers(-5, 5, 30), rng.integers(-5, 5, 30)
    held = set(zip(a.tolist(), b.tolist(), strict=True))
    x, y = (v.ravel() for v in np.meshgrid(np.arange(-7, 7), np.arange(-7, 7)))
    assert sd.Pairs(a, b).holds(x, y).tolist() == [p in held for p in zip(x.tolist(), y.tolist(), strict=True)]
    assert not sd.Pairs(a[:0], b[:0]).holds(x, y).any()
