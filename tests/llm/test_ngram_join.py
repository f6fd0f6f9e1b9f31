"""The join against comparing all pairs."""

import random
import re

import numpy as np
import pytest

from lumenframe.llm import ngram_join as j


def brute(docs, n=4, percent=85):
    sets, index = [], {}
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(docs)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        near = {k for g in s for k in index.get(g, ())}
        for k in near:
            both = len(s & sets[k])
            if 100 * both >= percent * (len(s) + len(sets[k]) - both):
                up[root(i)] = root(k)
        for g in s:
            index.setdefault(g, []).append(i)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(root(i), []).append(d)
    return sorted((d, len(sets[i]), min(groups[root(i)])) for i, (d, _) in enumerate(docs))


def run(spark, docs, **more):
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, node string, component int").repartition(3)
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in j.jaccard_groups(df, **more).collect())


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, j.op2_ngram_jaccard(spark, sf_dir).collect())) == brute(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_the_limit(spark, seed, monkeypatch):
    monkeypatch.setattr(j, "HEAVY", 4)
    rng = random.Random(seed)
    docs = [(0, None), (1, ""), (2, "\n \t"), (3, "One two"), (3, "one TWO"), (4, "one two three"), (5, "word " * 50_000)]
    shared = " ".join(f"p{i}" for i in range(30))
    for base in range(14):
        size = rng.choice([5, 9, 12, 20, 45, 90, 200, 400])
        words = [f"w{base}_{rng.randrange(10**6)}" for _ in range(size)]
        for _ in range(rng.choice([2, 3, 6, 25])):
            copy = list(words)
            for _ in range(rng.randrange(0, max(2, size // 20))):
                k = rng.randrange(len(copy))
                if rng.random() < 0.5:
                    copy[k] = f"x{rng.randrange(10**6)}"
                else:
                    del copy[k]
            docs.append((len(docs) + 1, " ".join(copy)))
    for i in range(60):
        docs.append((1000 + i, shared + " " + " ".join(f"q{i}_{k}" for k in range(rng.randrange(5, 60)))))
    got, want = run(spark, docs), brute(docs)
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert j.jaccard_groups(df).count() == 0
    rows = [(1, "a b c d e"), (2, "A b c D e"), (3, None), (3, None), (1, "a b c d e"), (1, "a  b c d e"), (None, "a b c d e"), (4, "other text of five")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, copy int")
    kept = j.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 3, 4]


def test_pigeonhole():
    rng = np.random.default_rng(3)
    for size in (7, 8, 12, 13, 30, 100, 333):
        for many in (10, 10**8):
            uppers, levels = j.plan({s: many for s in range(1, 500)}, 85)
            for _ in range(40):
                base = rng.integers(0, 2**63, size * 2).astype(np.uint64)
                drop = rng.integers(0, j.difference(size, size, 85) + 1)
                a, b = np.unique(base[:size]), np.unique(base[drop : size + rng.integers(0, 2)])
                both = len(np.intersect1d(a, b))
                if 100 * both < 85 * (len(a) + len(b) - both) or np.array_equal(a, b):
                    continue
                sets, bounds = np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)])
                found = [set(), set()]
                for sig, text in j.signatures(sets, bounds, uppers, levels, 85):
                    for s, t in zip(sig.tolist(), text.tolist(), strict=True):
                        found[t].add(s)
                assert found[0] & found[1]
                x, y = j.sketches(sets, bounds)
                assert j.apart(x, y) <= len(np.setxor1d(a, b))


def test_groups_across_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(j, "HEAVY", 3)
    rng = random.Random(4)
    rows = sorted((rng.choice([1, 2, 2, 3, 3, 3, 3, 3, 4, 9]), rng.randrange(9)) for _ in range(60)) + [(50, k) for k in range(20)] + [(60, 1), (61, 1), (61, 1), (62, 1), (62, 5)]
    want = {}
    for s, x in rows:
        want.setdefault(s, set()).add(x)
    expected = sorted((s, x, 3 if len(v) > 3 else 2) for s, v in want.items() for x in v if len(v) > 1)
    for step in (1, 2, 3, 7, 100):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        out = j._shared(pa.RecordBatch.from_arrays([pa.array([s for s, _ in p], pa.int64()), pa.array([x for _, x in p], pa.int64())], ["sig", "node"]) for p in parts)
        got = {tuple(r.values()) for b in out for r in b.to_pylist()}
        assert sorted(got) == expected
