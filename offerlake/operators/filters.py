"""Projection and filter operators.

Every filter is a Column predicate combined into one ``filter``; Catalyst pushes
comparisons on scan columns down to the Parquet reader.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Columns the cleaner drops when present.
DROPPED_COLUMNS = ("company", "location", "salary", "date_posted", "missions", "profile",
                   "advantages", "hash", "contract")
UNSPECIFIED = "Non spécifié"


def drop_columns(df: DataFrame, columns=DROPPED_COLUMNS) -> DataFrame:
    """Drop the listed names that exist (``drop`` ignores missing ones)."""
    return df.drop(*columns)


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """S3: to_numeric(errors='coerce') -> try_cast to double."""
    return df.withColumns({c: F.col(c).cast("string").try_cast("double") for c in columns})


def market_load(df: DataFrame, job: str, salary: str, city: str, sector: str,
                derive: dict[str, Column] | None = None) -> DataFrame:
    """Drop rows where job AND salary are both NULL, fill NULL city/sector, derive."""
    out = (df.na.drop(how="all", subset=[job, salary])
           .na.fill({city: UNSPECIFIED, sector: UNSPECIFIED}))
    return out.withColumns(derive) if derive else out


def model_rows(df: DataFrame, data_job: Column, salary: str) -> DataFrame:
    """Data jobs with a salary."""
    return df.where(data_job & F.col(salary).isNotNull())


def in_filter(col: str, values) -> Column | None:
    """An empty selection means no filter."""
    return F.col(col).isin(list(values)) if values else None


def range_filter(col: str, lo, hi) -> Column:
    """Inclusive; NULL rows fail the comparison and drop out."""
    return F.col(col).between(lo, hi)


@dataclass
class MarketFilter:
    """P5: categorical IN filters + salary/experience ranges + stack filters (AND)."""

    jobs: list = field(default_factory=list)
    cities: list = field(default_factory=list)
    sectors: list = field(default_factory=list)
    salary_range: tuple | None = None
    experience_range: tuple | None = None
    stacks: list = field(default_factory=list)   # names of P4 stack predicates

    def predicates(self, cols, stack_preds: dict[str, Column]) -> list[Column]:
        preds = [in_filter(cols.job, self.jobs), in_filter(cols.city, self.cities),
                 in_filter(cols.sector, self.sectors)]
        if self.salary_range is not None:
            preds.append(range_filter(cols.salary, *self.salary_range))
        if self.experience_range is not None:
            preds.append(range_filter(cols.experience, *self.experience_range))
        preds += [stack_preds[s] for s in self.stacks if s in stack_preds]
        return [p for p in preds if p is not None]

    def active_count(self) -> int:
        """Filters that restrict anything: non-empty selections and given ranges."""
        given = [bool(x) for x in (self.jobs, self.cities, self.sectors, self.stacks)]
        return sum(given) + (self.salary_range is not None) + (self.experience_range is not None)

    def apply(self, df: DataFrame, cols, stack_preds: dict[str, Column]) -> DataFrame:
        preds = self.predicates(cols, stack_preds)
        return df.where(reduce(lambda a, b: a & b, preds)) if preds else df


def tech_stack_predicates(df: DataFrame, skill_of) -> dict[str, Column]:
    """P4 named stack filters; a missing skill column is treated as absent."""
    def has(name):
        c = skill_of(name)
        return (F.coalesce(F.col(c).cast("int"), F.lit(0)) == 1) if c and c in df.columns else F.lit(False)
    modern = has("python") & (has("aws") | has("azure") | has("gcp")) & has("spark")
    return {
        "Python + Cloud + Spark": modern,
        "BI Tools": has("tableau") | has("power_bi"),
        "Machine Learning": has("machine_learning"),
        # the reference skips this filter when the column is absent
        "Deep Learning": has("deep_learning") if skill_of("deep_learning") in df.columns else F.lit(True),
        "SQL": has("sql"),
    }


def filter_options(df: DataFrame, col: str) -> DataFrame:
    """Non-null distinct values, sorted."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def numeric_bounds(df: DataFrame, col: str) -> DataFrame:
    """min/max of a numeric column."""
    return df.agg(F.min(col).alias("min"), F.max(col).alias("max"))


def title_length_filter(df: DataFrame, title: str, min_len: int = 5) -> DataFrame:
    """Keep titles longer than ``min_len`` characters."""
    return df.where(F.length(title) > min_len)
