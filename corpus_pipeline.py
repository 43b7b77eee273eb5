"""A training corpus from `documents`, in five stages. Each takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netloom.llm import decontaminate, langid, linededup, ngramjoin, pieces
from netloom.llm.common import documents, small_batches, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't recognise go."""
    small_batches(spark)
    return langid.language_filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are deleted from the texts; documents of which nothing is left go."""
    small_batches(spark)
    return linededup.lines_filtered(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the document with the smallest id stays."""
    small_batches(spark)
    return ngramjoin.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return decontaminate.leaks_filtered(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, whether they decode to it again, and whether they are those of the model's own library."""
    small_batches(spark)
    out = pieces.encoded(docs.select("doc_id", "lang", "source", "text"), columns=["doc_id", "lang", "source", "ids", "round_trip", "parity"])
    return out.selectExpr("doc_id", "lang", "source", "CAST(size(ids) AS BIGINT) AS n_tokens", "ids", "round_trip", "parity")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_join", ngram_join), ("decontamination", decontamination), ("sentencepiece", tokens)]
#: The stages are beyond SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
