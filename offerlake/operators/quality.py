"""Quality and validation jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerlake.operators.quantiles import exact_quantiles


def completeness(df: DataFrame, columns: list[str], name: str = "profile_completeness") -> DataFrame:
    """Q1: % of the existing listed columns that are non-null, per row."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in present])
    return df.withColumn(name, filled * 100.0 / len(present))


def fill_rates(df: DataFrame, columns: list[str], rows_in: Column | None = None) -> DataFrame:
    """Q2: one row: rows before cleaning (``rows_in``, a scalar subquery), rows, columns,
    % non-null per key column (single pass)."""
    present = [c for c in columns if c in df.columns]
    return df.agg(
        *([] if rows_in is None else [F.max(rows_in).alias("initial_rows")]),
        F.count(F.lit(1)).alias("final_rows"),
        F.lit(len(df.columns)).alias("final_columns"),
        *[(F.avg(F.col(c).isNotNull().cast("double")) * 100).alias(f"fill_rate_{c}") for c in present])


def iqr_trim(df: DataFrame, value: str, factor: float = 1.5, max_share: float = 0.05) -> DataFrame:
    """Q3: drop rows outside [Q1 - f*IQR, Q3 + f*IQR], but only when the outliers are
    fewer than ``max_share`` of the rows; otherwise return every row."""
    q = exact_quantiles(df, value, [0.25, 0.75], names=["q1", "q3"])
    lo = q.select(F.col("q1") - factor * (F.col("q3") - F.col("q1"))).scalar()
    hi = q.select(F.col("q3") + factor * (F.col("q3") - F.col("q1"))).scalar()
    v = F.col(value)
    flagged = df.withColumn("_out", F.coalesce((v < lo) | (v > hi), F.lit(False)).cast("double"))
    share = flagged.select(F.avg("_out")).scalar()
    # NULL values fail both bounds, as in pandas
    return df.where(F.when(share < max_share, F.coalesce((v >= lo) & (v <= hi), F.lit(False)))
                    .otherwise(F.lit(True)))


def profile_warnings(df: DataFrame, contract: str, ml: Column, dl: Column, experience: str,
                     sector: str, cdi_value: str = "CDI") -> DataFrame:
    """Q4: array of warning codes per profile; 'standard' when none applies."""
    w = F.filter(F.array(
        F.when(F.col(contract) != cdi_value, F.lit("non_cdi")),
        F.when(ml & dl, F.lit("ml_and_dl")),
        F.when(F.col(experience) < 0.5, F.lit("very_junior")),
        F.when(F.col(experience) >= 15, F.lit("very_senior")),
        F.when(F.col(sector) == "Non spécifié", F.lit("sector_unspecified")),
    ), lambda x: x.isNotNull())
    return df.withColumn("warnings", F.when(F.size(w) == 0, F.array(F.lit("standard"))).otherwise(w))


def generalisation_verdict(train_r2: Column, test_r2: Column, test_mae: Column, cv_mae: Column) -> Column:
    """Q5."""
    d = train_r2 - test_r2
    return (F.when(d > 0.2, "critical_overfit").when(d > 0.1, "moderate_overfit")
            .when(F.abs(test_mae - cv_mae) / cv_mae > 0.15, "high_variance").otherwise("ok"))
