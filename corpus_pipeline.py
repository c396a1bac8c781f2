"""Corpus pipeline: documents through the training-data operators, stage by stage.

Language identification drops documents without a language, near-duplicates keep one
document of each group, decontamination drops documents that hold a benchmark item, and
packing puts what is left into batches. Stages but the last return the columns of
documents; each works on all rows that the one before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm import decontam, langid, neardup, packing
from offerlake.llm.common import read, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    return langid.keep_identified(docs, learned)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicate(docs, percent=80)


def remove_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_batches(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", remove_near_duplicates),
    ("decontamination", remove_benchmark_items),
    ("packing", pack),
]

#: No SQL form: the stages hash, embed and optimise. tests/llm compares them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
