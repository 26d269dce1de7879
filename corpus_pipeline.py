"""A corpus pipeline: language, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; every
stage but the last returns the columns of ``documents``.

Defined results: a row with a null text or without a letter goes in the first stage; a null id, source or
language is no reason to go. Of rows that repeat an id and a text one stays. An empty table gives no rows.
Further columns pass through all stages but the last, whatever they are called (dots and spaces too). Ids may repeat: rows are told apart by
id and text. The result of a stage is deleted when the next one's is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saunter.llm import decontam, exact_dedup, langid, ngram_join, packing
from saunter.llm.shared import columns_of, discard, free_name, shared_dir, written

#: A document stays if its language is told with this much probability; `und` has 0.
LEAST_LANGUAGE_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go; a missing language is filled in."""
    pred, score = free_name(docs, "language_pred"), free_name(docs, "language_score")
    found = langid.label(docs, names=(pred, score)).where((F.col(pred) != langid.UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", pred)).select(*columns_of(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.drop_duplicates(docs, keep="largest")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return ngram_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go: to train on what is left around it would still leak its place."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("ngram_jaccard", near_copies), ("decontamination", benchmark_passages), ("packing", pack)]

#: Token ids and a trained classifier are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        path = shared_dir(spark)
        written(stage(spark, docs, sf_dir), path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)  # its rows are in the next one's result
        before = path
    return docs
