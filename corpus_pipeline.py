"""Curation of a corpus in five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept."""
    from cohortloom.llm.quality import quality_filter

    return quality_filter(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document, or an earlier place, has already."""
    from cohortloom.llm import line_dedup

    return line_dedup.line_dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: candidates by SimHash fingerprints and bands, whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    from cohortloom.llm import near_copies

    return near_copies.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    from cohortloom.llm import decontam

    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    from cohortloom.llm.packing import pack

    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express stages that fit models, hash and cluster; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each one's rows are written as Parquet and read again by the next.

    Of a stage only its rows stay on disk, and those only until the next one's are written. What a
    null, empty, repeated or clashing value means is stated by the operators; an empty table gives an
    empty result.
    """
    from cohortloom.llm.workspace import Workspace, closing

    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with closing():  # once the stage's rows are written, nothing reads its operator's tables
            docs = space.save(stage(spark, docs, sf_dir), f"stage{k}_{name}")
        if k:
            space.drop(f"stage{k - 1}_{STAGES[k - 1][0]}")
    return docs
