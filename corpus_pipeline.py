"""Corpus pipeline: from raw documents to a weighed training mix.

Each stage works on all that the one before kept and is written as Parquet and read again, so
a lost executor costs at most one stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitledger.llm.decontaminate import decontaminate
from bitledger.llm.jaccard_join import keep_one
from bitledger.llm.language import UNKNOWN, fit, label_languages
from bitledger.llm.mixing import mix_sources
from bitledger.llm.quality import keep_quality
from bitledger.llm.text import table
from bitledger.session import remove_path, scratch_path

# Share of a text's letters that its main language must have.
MIN_LANGUAGE_SHARE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents up to their language's perplexity limit; null and empty texts go."""
    return keep_quality(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; those without a letter, or of no main language, go.

    The model is learned from the documents' own ``lang``, which decides nothing else.
    """
    labelled = label_languages(docs, fit(docs))
    kept = labelled.where((F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") >= MIN_LANGUAGE_SHARE))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays; documents without words all do."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents that it takes, with ``copies``, how often it takes them."""
    mixed = mix_sources(docs)
    rest = [c for c in docs.columns if c.lower() != "copies"]
    return mixed.where("mix_copies > 0").select(*rest, F.col("mix_copies").alias("copies"))


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again; what a
    stage has read is removed when its own output is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove_path(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)


# Perplexities, learned languages and hash thresholds are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
