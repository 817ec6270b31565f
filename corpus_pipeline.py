"""Corpus pipeline: the stages that documents go through, each of them one operator.

Every stage works on all documents its predecessor kept and returns the columns of ``documents``; the last adds its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from linehaul.llm.decontaminate import decontaminate
from linehaul.llm.frames import id_text, table
from linehaul.llm.mixing import mix
from linehaul.llm.near_dedup import near_dedup
from linehaul.llm.quality import reject
from linehaul.llm.substring_dedup import substring_dedup
from linehaul.scratch import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return reject(docs, docs, table(spark, sf_dir, "labels"), lambda i: id_text(i) % 3 == 1)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of a smaller id has too."""
    return substring_dedup(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words in the mix, and which words: ``repeats`` times the text and once more the ranges ``picks``."""
    return mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources", mix_stage),
]

#: Trained models and approximate search have no SQL twin; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex[:12]}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
