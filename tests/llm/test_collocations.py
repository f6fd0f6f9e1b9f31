"""Collocations against plain counting: overlaps, pieces, languages, ties, crowded sketches and many automata."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenframe.llm.collocations import collocations, op11_phrase_collocations
from lumenframe.llm.queries import ORACLE
from tests.compare import difference, views


def brute(docs, least, top, percent=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = {q[i : i + k] for q, b in often.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if q[i : i + k] in often and 100 * b >= percent * often[q[i : i + k]]}
        rows = []
        for p, a in often.items():
            if p not in inside:
                cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        yield from ((lang, i, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(rows[:top], 1))


def texts():
    rng = random.Random(3)
    vocabulary = ["the", "The", "a", "x" * 40, "é", "à la", "😀", "c-d", "(e", "\x0e", "f", "g"]
    out = []
    for _ in range(150):
        w = rng.choices(vocabulary, k=rng.randrange(40))
        out.append(("".join(x + rng.choice([" ", "  ", "\t", " ", ". ", "\n", "!", ", "]) for x in w), rng.choice(["en", "en", "de", None, "und"])))
    return [*out, *[("la la la la la la", "fr")] * 3, *[("one two three four five six seven", "en")] * 5, (None, "en"), ("", None), ("...", "xx"), ("w " * 30_000, "es")]


@pytest.mark.parametrize("least,top,chars,cells", [(3, 50, 10**6, None), (5, 4, 300, 1), (2, 10**6, 5000, 1)])
def test_all(spark, least, top, chars, cells):
    """Also with 65536 cells and several automata, where sketches let much through."""
    df = spark.createDataFrame([(t, x, 1, "p") for t, x in texts()], "text string, lang string, f int, phrase string").repartition(4)
    got = sorted(map(tuple, collocations(df, least=least, top=top, block_chars=chars, cells=cells).collect()))
    assert got == sorted(brute(texts(), least, top))
    assert collocations(df.limit(0)).count() == 0


def test_scans(spark):
    """Documents are read as often with many automata as with one."""
    read = spark.sparkContext.accumulator(0)

    def counted(row):
        read.add(1)
        return row

    scans = []
    for chars in (10**6, 300):
        df = spark.createDataFrame(spark.sparkContext.parallelize(texts(), 4).map(counted), "text string, lang string")
        before = read.value
        got = sorted(map(tuple, collocations(df, least=5, top=50, block_chars=chars, cells=1).collect()))
        assert got == sorted(brute(texts(), 5, 50))
        scans.append((read.value - before) / len(texts()))
    assert scans[0] == scans[1] <= 5


def test_chunks(monkeypatch):
    """Stretches, words and texts that meet only across slices, chunks and languages; texts that end and begin without a blank."""
    from lumenframe.llm import collocations as module

    monkeypatch.setattr(module, "SLICE_BYTES", 7)
    docs = [("a b", "en"), ("c a b c", "en"), ("a b c", "de"), ("b c. a", None), ("b", "de"), ("a  b\tc a", "en")] * 6
    for size, chars in ((1, 10**6), (3000, 10**6), (10**6, 10**6), (10**6, 500), (10**6, 5000)):
        monkeypatch.setattr(module, "CHUNK_BYTES", size)
        chunk, found = module._Chunk(lambda part, upto: ((k, np.flatnonzero(part.room >= k), None) for k in range(1, upto + 1)), chars), Counter()
        for text, lang in docs:
            data = np.frombuffer(text.encode(), np.uint8)
            twice = np.concatenate((data, data))
            chunk.add(module._Slice(twice, np.array([0, len(data), len(twice)]), [lang or "und"] * 2))
            if chunk.full():
                found += chunk_counts(chunk)
                chunk = module._Chunk(chunk.passing, chars)
        found += chunk_counts(chunk)
        want = Counter()
        for text, lang in docs:
            for piece in text.split("."):
                w = piece.split()
                want.update(2 * [(lang or "und", " ".join(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1)])
        assert found == want


def chunk_counts(chunk):
    out = Counter()
    for batch in chunk.counts():
        for row in batch.to_pylist():
            out[row["lang"], row["phrase"]] += row["f"]
    return out


def test_large_products(spark):
    """Scores are exact beyond 64 bits."""
    from lumenframe.llm.collocations import _score

    row = (4_000_000_000_000, 90_000_000_000_001, 5_000_000_000_003, 4_000_000_000_007)
    df = spark.createDataFrame([row], "a long, n long, l long, r long")
    assert df.select(_score("a", "n", "l", "r")).first()[0] == 1000 * row[0] * row[1] // (row[2] * row[3])


def test_sql(spark, sf_dir):
    assert difference(op11_phrase_collocations(spark, sf_dir), views(sf_dir), ORACLE["op11_phrase_collocations"]) == ""
