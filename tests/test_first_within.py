"""The first rows of each group by hash: the same as by rank, without moving the rows."""

import pytest
from pyspark.sql import functions as F

from offerlake.operators import model as M
from offerlake.operators.quantiles import first_within, rank_within


@pytest.mark.parametrize("share", [0.0, 0.001, 0.2, 0.5, 1.0])
@pytest.mark.parametrize("digits", [1, 4])
def test_equals_the_ranks(spark, share, digits):
    """Groups of 0 to 4,000 rows and a null one; one digit puts many rows into the bucket of the bound."""
    df = spark.range(9_000).select("id", F.when(F.col("id") < 4_000, 1).when(F.col("id") < 4_003, 2).when(F.col("id") == 5_000, 3)
                                   .when(F.col("id") < 7_000, 4).alias("g"), M.hash_key(F.col("id")).alias("h"))
    want = rank_within(df, ["g"], "h").where(F.col("_rank") < F.round(F.col("_group_n") * share))
    got = first_within(df, ["g"], "h", share, "is_test", digits)
    assert got.columns == ["id", "g", "h", "is_test"] and got.count() == 9_000
    assert {r.id for r in got.where("is_test = 1").collect()} == {r.id for r in want.collect()}


def test_the_split_shuffles_few_rows(spark):
    """Rows go to the writer as they are read; before, every row went through two exchanges (window, join)."""
    df = spark.range(20_000).select("id", (F.col("id") * 7 % 1000).cast("double").alias("y"), F.lit("x" * 50).alias("wide"))
    plan = M.stratified_split(df, "id", "y")._jdf.queryExecution().sparkPlan().toString()
    union = plan[plan.index("Union"):]
    clear = union[:union.index("Window")]
    assert "Sort" not in clear and "SortMergeJoin" not in plan
