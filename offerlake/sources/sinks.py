"""Sinks and exports.

All writes are distributed DataFrame writes (Parquet by default, CSV/JSON
where the reference produced them); nested documents are built with
``struct``/``collect_list`` over small aggregate tables, never on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.operators.market import restrict_to


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Cleaned-table sink; CSV gets a header, UTF-8 (Spark's default)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", "true").option("escape", '"').csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def write_json(df: DataFrame, path: str) -> DataFrame:
    """Write nested documents as JSON lines and read them back with their schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def read_csv_table(spark, path: str, schema) -> DataFrame:
    """CSV scan with an explicit schema (no inference), multi-line quoted fields."""
    return (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
            .option("escape", '"').csv(path))


def export_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Project the listed columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def roadmap_export(roadmap: DataFrame) -> DataFrame:
    """Skill, gain, frequency %, ROI, rarity, sorted by ROI desc."""
    return roadmap.select("profile_id", "skill", "gain", (F.col("frequency") * 100).alias("frequency_pct"),
                          "roi", "rarity").orderBy("profile_id", F.col("roi").desc(), "skill")


def market_report(meta: DataFrame, summary: DataFrame, multipliers: dict[str, DataFrame], impacts: DataFrame,
                  stacks: DataFrame, selected: dict[str, DataFrame] | None = None) -> DataFrame:
    """One nested row: metadata, summary statistics, multipliers per group column
    (those of the ``selected`` values only, where given), skill impacts, stacks. Each list
    is an aggregate of a small table (bounded by the vocabularies), gathered with
    collect_list."""
    chosen = []
    for group, table in multipliers.items():
        if selected and group in selected:
            table = restrict_to(table, selected[group], [group])
        chosen.append(table.select(F.lit(group).alias("column"), F.col(group).cast("string").alias("group"), "multiplier"))
    m = reduce(DataFrame.unionByName, chosen).agg(
        F.sort_array(F.collect_list(F.struct("group", "multiplier", "column"))).alias("multipliers"))
    i = impacts.agg(F.sort_array(F.collect_list(F.struct("skill", "impact"))).alias("skill_impacts"))
    s = stacks.agg(F.sort_array(F.collect_list(F.struct("stack", "median", "n"))).alias("stacks"))
    return meta.select(F.struct(*meta.columns).alias("metadata"),
                       summary.select(F.struct(*summary.columns)).scalar().alias("statistics"),
                       m.scalar().alias("multipliers"), i.scalar().alias("skill_impacts"),
                       s.scalar().alias("stacks"))


def flatten_report(report: DataFrame) -> DataFrame:
    """One row per leaf value (section, item, field, value as string) for checks."""
    parts = []
    for sec in ("multipliers", "skill_impacts", "stacks"):
        elem = report.select(F.explode(sec).alias("e")).select("e.*")
        key = elem.columns[0]
        for fld in [c for c in elem.columns[1:] if c != "column"]:
            parts.append(elem.select(F.lit(sec).alias("section"), F.col(key).cast("string").alias("item"),
                                     F.lit(fld).alias("field"), F.col(fld).cast("double").alias("value")))
    stats = report.select("statistics.*")
    for fld in stats.columns:
        parts.append(stats.select(F.lit("statistics").alias("section"), F.lit("").alias("item"),
                                  F.lit(fld).alias("field"), F.col(fld).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def per_profile_document(base: DataFrame, sections: dict[str, DataFrame], key: str = "profile_id") -> DataFrame:
    """One nested row per profile; each section (a table keyed by
    ``key``) becomes an array of structs ordered by its remaining columns.
    Sections are grouped per profile (bounded by the section's rows per profile)."""
    out = base
    for name, df in sections.items():
        cols = [c for c in df.columns if c != key]
        agg = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(agg, key, "left")
    return out
