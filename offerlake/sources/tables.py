"""Parquet scans of the input tables (S1/S2 on the columnar path)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str,
               columns: list[str] | None = None) -> DataFrame:
    """Projected scan: selecting right after the scan lets the Parquet reader prune."""
    df = spark.read.parquet(table_path(sf_dir, name))
    if columns:
        df = df.select(*columns)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """pandas skips NaN; Spark sorts it as the largest value. Make it NULL at load."""
    fixes = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """S3: raise on a missing required column (the reference raises too)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


#: Bytes up to which an input counts as small enough to be dealt out row by row.
SPREAD_BYTES = 256 << 20


def spread_for_cpu(df: DataFrame) -> DataFrame:
    """CPU-heavy per-row work (regexes over whole texts) wants at least one task per core. A small input of
    fewer files than cores (one file with one row group, say) is dealt out row by row first; anything above ``SPREAD_BYTES``, by
    the planner's estimate, is read in the splits that it has and never shuffled. No job runs to decide, and
    rows are the same either way."""
    want = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(want) if size <= SPREAD_BYTES and len(df.inputFiles()) < want else df
