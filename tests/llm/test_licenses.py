"""Licence search against every run of words and a plain edit distance."""

import random
import re

from lumenframe.llm.licenses import NOTICES, PHRASES, Search, find_licenses, op12_license_scan, pieces
from lumenframe.llm.queries import ORACLE
from tests.compare import difference, views

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SOME = (("mit license", "mit", 1), ("mozilla public license", "mpl", 2), ("cc by nc", "cc-by-nc", 0), ("boost software license", "boost", 3), ("a b", "ab", 1))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def split(text):
    return WORDS.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(text, phrases, notices):
    w = split(text)
    places = sorted((i, label) for phrase, label in phrases for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
    spans = []
    for notice, label, most in notices:
        runs = []
        for s in range(len(w)):
            for e in range(s + 1, min(len(w), s + len(notice)) + 1):
                run = " ".join(w[s:e])
                if abs(len(run) - len(notice)) <= most and (d := distance(run, notice)) <= most:
                    runs.append((d, s, e))
        taken = []
        for d, s, e in sorted(runs):
            if not any(s < f and b < e for _, b, f in taken):
                taken.append((d, s, e))
        spans += [(label, notice, s, e, d) for d, s, e in taken]
    return len(w), places, sorted(spans)


def check(df, phrases, notices):
    texts = {r.doc_id: r.text for r in df.collect()}
    found = find_licenses(df, phrases, notices).collect()
    assert len(found) == len(texts)
    for r in found:
        got = r.n_words, sorted((p.word, p.label) for p in r.places), sorted(map(tuple, r.spans))
        assert got == brute(texts[r.doc_id], phrases, notices), texts[r.doc_id]


def mutated(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text) + 1)
        text = text[:i] + rng.choice(["", "x", "é", " ", ", ", "LI", "😀"]) + text[i + rng.randrange(2) :]
    return text


def test_edits(spark):
    """Notices with up to five edits, next to others, across punctuation and line ends."""
    rng, rows = random.Random(4), []
    for i in range(400):
        parts = [mutated(rng, rng.choice([*(n for n, _, _ in SOME), "GNU General-Public License", "Apache License"]), rng.randrange(5)) for _ in range(rng.randrange(1, 4))]
        rows.append((i, rng.choice([" ", ", ", "\n", " mit ", " a "]).join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "mit"), (1003, "license mit license mit license"), (1004, "é" * 3000), (1005, "word " * 2_000 + "M.I.T. mit-licence"), (1006, "cc by cc by nc"), (1007, "MIT"), (1008, "License")]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PHRASES, SOME)


def test_phrases_end_with_their_document(spark):
    """Documents laid end to end don't make phrases."""
    rows = [(1, "the mit"), (2, "license cc"), (3, "by"), (4, "gnu general public"), (5, "license")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert all(not r.places and not r.spans for r in find_licenses(df).collect())


def test_notices():
    search = Search()
    for i, (notice, _, edits) in enumerate(NOTICES):
        assert WORDS.findall(notice) == notice.split()
        assert "".join(p for _, p in pieces(notice, edits)) == notice and min(len(p) for _, p in pieces(notice, edits)) > 4
        assert search.edits(i, notice) == 0 and search.edits(i, notice + "z" * (edits + 1)) is None
        assert edits == 0 or search.edits(i, "z" + notice[1:]) == 1


def test_table(spark, sf_dir):
    assert difference(op12_license_scan(spark, sf_dir), views(sf_dir), ORACLE["op12_license_scan"]) == ""
    odd = spark.createDataFrame([(None, "MIT License", 1), (3, "x", 2), (3, "x", 2)], "doc_id long, text string, spans int")
    assert sorted((r.doc_id or 0, len(r.places)) for r in find_licenses(odd).collect()) == [(0, 1), (3, 0), (3, 0)]
    assert find_licenses(odd.limit(0)).count() == 0
