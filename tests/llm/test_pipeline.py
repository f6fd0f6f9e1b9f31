"""Every stage against a brute-force version on what its predecessor kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from lumenframe.llm import quality_cnn as q
from tests.llm import test_decontaminate, test_line_dedup, test_ngram_join, test_packing


def rows(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text").collect())


def test_stages(spark, sf_dir):
    assert [name for name, _ in p.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard", "benchmark_decontamination", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = [rows(docs)]
    for name, stage in p.STAGES:
        docs = p.written(stage(spark, docs, sf_dir), f"test-{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.collect())
            seen.append(rows(docs))
    model = q.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = []
    for doc in seen[0]:
        data, starts, last, bounds = q.padded(*q._joined([doc[1]]))
        if 1 / (1 + np.exp(-model.logit(model.pooled(data, starts, last), bounds)[0])) >= q.THRESHOLD:
            kept.append(doc)
    assert seen[1] == kept
    assert seen[2] == [(d, t) for (d, _), (_, _, t) in zip(seen[1], test_line_dedup.brute([t for _, t in seen[1]], 10), strict=True)]
    firsts = {d for d, _, c in test_ngram_join.brute(seen[2], 5, 80) if d == c}
    assert seen[3] == [x for x in seen[2] if x[0] in firsts]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {x[0] for x in test_decontaminate.brute(seen[3], bench) if not x[5]}
    assert seen[4] == [x for x in seen[3] if x[0] in clean]
    n, least = test_packing.check(docs.collect(), seen[4], 4096)
    assert n <= least + 1
    assert all(len(b) < len(a) for a, b in zip(seen[2:], seen[3:], strict=False)) and len(seen[1]) < len(seen[0])


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0


INTERNAL = ("_score", "score", "rest", "row", "_row", "copy", "_copy", "marks", "_marks", "_text", "kept", "n_lines", "_n_lines", "spans", "_spans", "node", "group", "first", "none")


def test_any_columns_and_odd_rows(spark, sf_dir):
    """Names that operators use themselves, nulls, empty texts, ties and repeated rows, through every stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "en", "s", None), (9003, "a b c d e f g " * 30, "en", "s", 420), (9003, "a b c d e f g " * 30, "en", "s", 420)], docs.schema)
    docs = docs.unionByName(odd)
    for i, name in enumerate(INTERNAL):
        docs = docs.withColumn(name, F.lit(i))
    docs = p.written(docs, "odd")
    columns = docs.columns
    want = tuple(range(len(INTERNAL)))
    for name, stage in p.STAGES:
        before = docs.count()
        docs = p.written(stage(spark, docs, sf_dir), f"odd-{name}")
        if name == "best_fit_packing":
            assert docs.count() >= before
            break
        assert docs.columns == columns
        kept = docs.collect()
        assert 0 < len(kept) <= before and {tuple(r)[5:] for r in kept} == {want}
