"""The store's round trip against the library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm.token_store import chunk_ends, crc_joined, manifest_of, merkle_root, op5_token_store, read_ids, read_store, write_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows):
    library, start = Tokenizer.from_file(PATH), 0
    for doc, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        yield doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids
        start += len(ids)


def test_query(spark, sf_dir):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, op5_token_store(spark, sf_dir).collect())) == [x[:4] for x in want(rows)]


def test_corners(spark, tmp_path):
    texts = [None, "", " ", "a  b\n\n c ", "é" * 10_000, "x y " * 30_000, "same passage " * 500, "same passage " * 500, "<|endoftext|>a <|endoftext|>"]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(6, " ")]
    df = spark.createDataFrame([(*r, "k", 9) for r in rows], "doc_id long, text string, kind string, row int").repartition(3)
    path = str(tmp_path / "store")
    write_store(df, path, PATH)
    expected = list(want(sorted(rows, key=lambda r: r[0])))
    assert sorted(map(tuple, read_store(spark, path).collect())) == [x[:4] for x in expected]
    assert sorted((r.doc_id, r.start, r.ids) for r in read_ids(spark, path).collect()) == [(x[0], x[1], x[4]) for x in expected]
    held = spark.read.parquet(f"{path}/blocks").where("kind = 'chunks'")
    assert held.count() == held.select("digest").distinct().count() < spark.read.parquet(f"{path}/blocks").where("kind = 'refs'").count()
    write_store(df.limit(0), str(tmp_path / "none"), PATH)
    assert read_store(spark, str(tmp_path / "none")).count() == 0


def test_damage_is_found(spark, tmp_path):
    path = str(tmp_path / "store")
    write_store(spark.createDataFrame([(1, "some text here")], "doc_id long, text string"), path, PATH)
    held = spark.read.parquet(f"{path}/recipes").collect()[0]
    changed = held.asDict() | {"root": bytearray(32)}
    spark.createDataFrame([changed], spark.read.parquet(f"{path}/recipes").schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/other/recipes")
    spark.read.parquet(f"{path}/blocks").write.partitionBy("kind").parquet(f"{path}/other/blocks")


    with pytest.raises(Exception, match="manifest"):
        spark.read.parquet(f"{path}/manifest").write.parquet(f"{path}/other/manifest")
        read_store(spark, f"{path}/other")
    manifest_of(spark.read.parquet(f"{path}/other/recipes")).write.mode("overwrite").parquet(f"{path}/other/manifest")
    with pytest.raises(Exception, match="Merkle"):
        read_store(spark, f"{path}/other").collect()


def test_wide_ids(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    path = str(tmp_path / "store")
    write_store(docs, path, PATH, end=70_000)
    assert [r.ids[-1] for r in read_ids(spark, path).collect()] == [70_000] * 2
    with pytest.raises(Exception, match="fit into 2 bytes"):
        write_store(docs, str(tmp_path / "narrow"), PATH, end=70_000, width=2)


def test_parts():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    bounds = np.array([0, 0, 10, 12_000, 20_000])
    ends = chunk_ends(ids, bounds)
    assert [x[-1] if x else None for x in ends] == [None, 10, 12_000, 20_000]
    raw = ids.astype("<u4").tobytes()
    cuts = [0, 17, 17, 4000, 20_000]
    parts = [(zlib.crc32(raw[4 * a : 4 * b]), 4 * (b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert crc_joined(parts) == zlib.crc32(raw)
    assert merkle_root([b"a", b"b", b"c"]) != merkle_root([b"a", b"b", b"d"])
