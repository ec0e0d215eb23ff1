"""A corpus pipeline over ``documents``: each stage is written as Parquet and read by the next.

1. ``quality``: line-first cleaning; documents that the rules reject go, failed lines of the others too.
2. ``lines``: lines that many sites share stay in one document only; no document goes.
3. ``near_duplicates``: one document of each group of near copies (five-word shingles, similarity 0.8).
4. ``benchmark``: documents that hold a benchmark item go.
5. ``tokens``: ids of every document, and the check that decoding them gives the text again.

All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penprint.llm import bpe, decontaminate, line_dedup, near_dedup, quality_rules
from penprint.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(docs)
    length = F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
    return cleaned.withColumn("n_chars", length).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, size=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary.load(bpe.tokenizer_path())
    return bpe.digests(bpe.encode(docs, vocabulary), vocabulary)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("tokens", tokens),
]

# Near-duplicates by connected components and byte-pair encoding have no SQL of acceptable size.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
