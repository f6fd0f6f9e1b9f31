"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in
the shared folder and reads it again as the next stage's docs.

Defined results, for every stage but the last: all columns of docs come out, in their order and
whatever their names (only text and n_chars may change their values, as said); rows with a null
doc_id are documents like others; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.cluster import packed, unpacked, written
from lumenframe.llm.decontaminate import decontaminate
from lumenframe.llm.line_dedup import dedup_lines
from lumenframe.llm.ngram_join import keep_first
from lumenframe.llm.packing import pack_documents, word_tokenizer
from lumenframe.llm.quality_cnn import THRESHOLD, fit, score


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels that aren't held out, doesn't reject.

    A null or empty text is scored as padding; equal texts score alike, so repeated rows stay or
    go together; a score at the threshold stays.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(packed(docs, "doc_id", "text"), model, "score")
    return unpacked(scored.where(F.col("score") >= THRESHOLD), docs.columns, ("doc_id", "text"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them hold; n_chars is that of what is left.

    A null text is one empty line and comes out empty; each row is one document, so ten repeated
    rows lose all their lines, and a document that loses all of them stays, with an empty text.
    """
    out = dedup_lines(packed(docs, "doc_id", "text")).select("doc_id", F.col("_text").alias("text"), "rest")
    length = {"n_chars": F.length("text").cast("long")} if "n_chars" in docs.columns else {}
    return unpacked(out, docs.columns, ("doc_id", "text"), **length)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by five-word shingles at 0.8.

    Documents without words are linked with nothing and all stay; of rows with one id, that with
    the smallest hash of its text stays, and of wholly repeated rows any one; a null id comes last.
    """
    return keep_first(docs, n=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth.

    A null or empty text has no words and stays; exactly a twentieth goes; repeated rows stay or
    go together.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens.

    A null or empty text is the end id alone; each row is one document, also where ids repeat;
    columns other than doc_id and text are ignored.
    """
    return pack_documents(docs.select("doc_id", "text"), word_tokenizer())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The first stage's network can't be told in SQL; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
