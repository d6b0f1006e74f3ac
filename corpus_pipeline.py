"""Corpus pipeline: quality, line dedup, near duplicates, mixing, tokenising.

Each stage takes the rows of ``documents`` that the one before kept; all but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import linededup, mixing, parity, spm, subword
from vigil.llm import queries as Q
from vigil.llm.common import read, ready, scratch

MIN_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below ``MIN_SCORE`` go."""
    ready(spark)
    return subword.keep(docs, Q.quality_model(spark, sf_dir), MIN_SCORE)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, short ones too, and documents that so lose their last word."""
    ready(spark)
    out = linededup.dedup(docs, min_words=1)
    return out.withColumn("n_chars", F.length("text").cast(out.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words, similarity 0.8 or more, one stays."""
    ready(spark)
    return parity.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: left out, once or twice."""
    ready(spark)
    return mixing.repeat_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, the ids of a sampled segmentation, and whether they decode to the text."""
    ready(spark)
    return spm.encode(docs, Q.PIECES)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("SentencePiece", token_stage),
]

ORACLE_SQL = None  # models are trained and segmentations sampled


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, "stage-" + name.replace(" ", "-"))
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
