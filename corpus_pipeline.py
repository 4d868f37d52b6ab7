"""Corpus pipeline: each stage reads the documents that the one before it left.

run() writes what each stage returns to the shared folder and reads it again, so a
lost executor costs a stage's lost tasks, not the stages before it. All other tables
of a stage are deleted then, and so is what the stage before it returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberlake.llm import decontaminate, mixing, neardup, pii, quality
from emberlake.llm.shared import cut, drop, scratch, table


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fit on the labelled ones of ``docs``, does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.drop_near_duplicates(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out, so that sources come near their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("quality", reject_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
]

#: Voting, similarity components and phrase positions have no practical SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), f"stage-{name}"))
        if before is not None:
            drop(before)
        before = docs
    return docs
