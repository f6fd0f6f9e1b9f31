"""Manifest against plain Python: trees of several rounds, ties, nulls and odd tables."""

import hashlib
import zlib
from itertools import groupby

import pytest

from lumenframe.llm.merkle import folded, leaf_of, manifest, op13_merkle_manifest, proof
from lumenframe.llm.queries import ORACLE
from tests.compare import difference, views

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root, and for each node the siblings on its way there."""
    paths = [[] for _ in nodes]
    own = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(own):
            first = at // 16 * 16
            paths[i].append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + 16])))
            own[i] = at // 16
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def brute(rows):
    key = lambda r: (r[3] is not None, (r[3] or "").encode())
    groups = []
    for _, part in groupby(sorted(rows, key=lambda r: (*key(r), r[0] is not None, r[0] or 0, leaf(*r))), key):
        part = list(part)
        groups.append((part, *tree([leaf(*r) for r in part])))
    root, tops = tree([g[1] for g in groups]) if groups else (None, [])
    for (part, subroot, paths), top in zip(groups, tops, strict=True):
        for r, path in zip(part, paths, strict=True):
            path = path + top
            low = "".join(c.lower() if c.isascii() else c for c in r[1]) if r[1] is not None else None
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            at = leaf(r[0], low if tampered else r[1], *r[2:])
            for left, right in path:
                at = h(left, at, right)
            yield r[0], leaf(*r), subroot, root, h(*[x for pair in path for x in pair]), at, at == root


def got(df, levels):
    chosen = "if(crc32(cast(doc_id as string)) % 5 = 0, true, false)"
    from pyspark.sql import functions as F

    tampered = F.when(F.expr(chosen), leaf_of(text=F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    rows = manifest(df, levels=levels, tampered=tampered).withColumn("folded_root", folded(F.coalesce("tampered", "leaf")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof(), "folded_root", F.col("folded_root") == F.col("root")).collect()


def same(a, b):
    return sorted(map(repr, map(tuple, a))) == sorted(map(repr, b))


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_rounds(spark, levels):
    """Sources of 1, 15, 16, 17, 256, 257 and 300 rows: up to three rounds of one level, and lone nodes at the ends of levels."""
    sizes = {"one": 1, "B": 15, "C": 16, "a": 17, "é": 256, "z": 257, None: 300}
    rows = [(i, f"Text {s} {i}", None if i % 7 == 0 else "en", s, i) for s, n in sizes.items() for i in range(n)]
    assert same(got(spark.createDataFrame(rows, SCHEMA).repartition(5), levels), brute(rows))


def test_many_sources(spark):
    rows = [(i, f"T{i}", "en", f"s{i}", 1) for i in range(40)]
    assert same(got(spark.createDataFrame(rows, SCHEMA).repartition(3), 1), brute(rows))


def test_corners(spark):
    rows = [(5, None, None, None, None), (None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (7, "", "", "", 0), (8, "Ä b" * 50_000, "de", "s", 3)]
    rows += [(9, "Same", "en", "s", 4)] * 20 + [(9, "Other", "en", "s", 5)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS g", "'x' AS digest", "2 AS load", "3 AS place", "4 AS path").repartition(4)
    assert same(got(df, 2), brute(rows))
    assert got(df.limit(0), 2) == []
    assert same(got(spark.createDataFrame(rows[:1], SCHEMA), 2), brute(rows[:1]))


def test_sql(spark, sf_dir):
    assert difference(op13_merkle_manifest(spark, sf_dir), views(sf_dir), ORACLE["op13_merkle_manifest"]) == ""
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert same(op13_merkle_manifest(spark, sf_dir).collect(), brute(docs))
