"""Every piece is placed once, sequences hold no gap and fit, and bins are few."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumenframe.llm.packing import best_fit, crossover, evolve, op7_best_fit_packing, pack, pack_documents, packing_report

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, capacity):
    library = Tokenizer.from_file(PATH)
    want = []
    for doc, text in docs:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        x.sort()
        assert [o for o, _ in x] == [sum(n for _, n in x[:i]) for i in range(len(x))]
        assert sum(n for _, n in x) <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_query(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    n, least = check(op7_best_fit_packing(spark, sf_dir).collect(), docs, 4096)
    assert n <= least + 1


def test_corners_and_levels(spark):
    docs = [(1, None), (2, ""), (3, "a b c " * 40), (3, "a b c " * 40), (4, "Ünï 9 " * 500)] + [(10 + i, "word " * (i % 29)) for i in range(300)]
    df = spark.createDataFrame([(*d, 5, 6) for d in docs], "doc_id long, text string, row int, piece int").repartition(3)
    rows = pack_documents(df, PATH, capacity=64, shard_pieces=40).collect()
    n, least = check(rows, docs, 64)
    assert n <= least * 1.02 + 2
    assert pack_documents(df.limit(0), PATH).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=2, max_size=60), st.integers(0, 1000))
def test_island(sizes, seed):
    down = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    first, other = best_fit(sizes, down, 100), best_fit(sizes, down[::-1], 100)
    child = crossover(first, other, sizes, 100, np.random.default_rng(seed))
    for bins in (first, child, evolve(sizes, 100, seed, [])):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 100 for b in bins)
    assert len(evolve(sizes, 100, seed, [first, other])) <= len(first)


def triples(seed, n, capacity=1000):
    """Pieces that fill n bins wholly, three to a bin."""
    rng = np.random.default_rng(seed)
    first = rng.integers(capacity * 2 // 5, capacity // 2, n)
    second = rng.integers(capacity // 4, capacity * 3 // 10, n)
    return np.concatenate((first, second, capacity - first - second)).tolist()


def test_genetic_gain():
    gains = []
    for seed in range(6):
        sizes = triples(seed, 20)
        first = best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -sizes[i]), 1000)
        gains.append(len(first) - len(evolve(sizes, 1000, seed, [first], generations=150, population=8)))
    assert min(gains) >= 0 and max(gains) > 0


def test_report(spark):
    easy = [(i, 0, 10 + i % 7) for i in range(300)]
    hard = [(1000 + i, 0, n) for i, n in enumerate(triples(1, 40))]
    for rows, evolves in ((easy, False), (hard, True)):
        df = spark.createDataFrame(rows, "row long, piece int, length long").repartition(2)
        report = packing_report(df, 1000, 60).collect()
        assert all(r.least <= r.evolved <= r.best_fit for r in report)
        assert any(r.best_fit > r.least for r in report) == evolves
        placed = pack(df, 1000, 60).collect()
        assert sorted((r.row, r.piece) for r in placed) == sorted(x[:2] for x in rows)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "row long, piece int, length long")).count() == 0


def test_room_is_evolved(spark):
    """A shard that needs no fewer bins is still bred while room lies in several of them."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, 0, int(n)) for i, n in enumerate(rng.integers(150, 420, 240))], "row long, piece int, length long").repartition(2)
    report = packing_report(df, 1000, 120).collect()
    assert all(r.evolved <= r.best_fit and r.crossed > 0 for r in report if r.open_before > 1)
    assert any(r.open_after < r.open_before or r.evolved < r.best_fit for r in report)
