"""Stages of the corpus pipeline.

Each takes (spark, docs, sf_dir), works on all documents it is given and
returns those that stay (all but the last with the columns of ``documents``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postline.llm import decontam, jaccard, passages, pieces, quality, suffix
from postline.llm.textops import table
from postline.session import remember_scratch, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.clean(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, the one with the least id."""
    return jaccard.dedup(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; what repeated strings of 400 bytes and repeated runs of
    over 50 words cover is cut from their texts.  ``n_chars`` follows the text."""
    cut = suffix.dedup(docs, words=passages.WORDS)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, with their language and source; ``round_trip``
    tells that the ids decode to the text."""
    return pieces.encode(docs, keep=("lang", "source"))


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("suffix_dedup", suffix_dedup),
          ("decontamination", decontamination), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as
    Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = scratch_path(spark, f"pipeline_{name}_{uuid.uuid4().hex}")
            docs.write.parquet(remember_scratch(path))
            docs = spark.read.parquet(path)
    return docs
