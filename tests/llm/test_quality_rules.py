"""The counts and the verdict against plain Python."""

import re
from collections import Counter, defaultdict

import duckdb

from lumenframe.llm.quality_rules import judge, op8_quality_rules
from lumenframe.llm.queries import ORACLE

SPACE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def brute(docs, min_docs, min_left):
    hosts, lines = Counter(), defaultdict(Counter)
    for _, t, h in docs:
        hosts[h or ""] += 1
        lines[h or ""].update({low(x.strip(SPACE)) for x in (t or "").split("\n")} - {""})
    for d, t, h in docs:
        t, h = t or "", h or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        rows = t.split("\n")
        dup = sum(1 for i, x in enumerate(rows) if x.strip(SPACE) and x in rows[:i])
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        gone = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in rows if x.strip(SPACE) and lines[h][low(x.strip(SPACE))] > min_docs)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        yield d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), failed, len(w) - gone, not failed and len(w) - gone >= min_left * len(w)


def test_tables(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    got = sorted(map(tuple, judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=2).collect()))
    assert got == sorted(brute(docs, 2, 0.3))
    got = sorted(map(tuple, op8_quality_rules(spark, sf_dir).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{sf_dir}/documents.parquet'")
    con.execute(f"CREATE TEMP TABLE got AS {ORACLE['op8_quality_rules']}")
    cols = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept"
    assert got == sorted(con.execute(f"SELECT {cols} FROM got").fetchall())


def test_corners(spark):
    body = " ".join(f"w{i}" for i in range(60))
    docs = [(1, None, "a"), (2, "", None), (3, " \n\t\n", "a"), (4, "a b c a b c", "a"), (5, "x\nx\n x\n\n\n", "b")]
    docs += [(10 + i, "Shared Header\n" + body + "\n" + " ".join(f"u{i}_{j}" for j in range(60)), "a") for i in range(8)]
    docs += [(30 + i, body + "\nshared header ", None) for i in range(8)] + [(30, body + "\nshared header ", None), (50, "é€😀 " * 300_00, "b")]
    df = spark.createDataFrame([(*d, 1, "h") for d in docs], "doc_id long, text string, source string, row int, host string").repartition(3)
    for min_docs in (3, 50):
        assert sorted(map(tuple, judge(df, min_docs=min_docs).collect())) == sorted(brute(docs, min_docs, 0.3))
    assert judge(df.limit(0)).count() == 0
