"""Folds prepared once, ridge from sums, searches over grids."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from offerlake.operators import model as M
from offerlake.session import materialize, materialize_for_fit


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        a, b, c = float(rng.integers(0, 30)), float(rng.normal()), float(rng.integers(0, 2))
        rows.append((i, a if i % 41 else None, b, c, str(rng.choice(["x", "y", "z"])), 1000 + 35 * a - 200 * b + 90 * c * (a > 10) + 20 * float(rng.normal()), i % 5))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, k string, label double, fold int")


@pytest.mark.parametrize("penalty", [0.0, 0.01, 1.0, 25.0])
def test_ridge_equals_refits(spark, table, penalty):
    features = ["a", "b", "c"]
    path = {(r.fold, r.penalty): r for r in M.ridge_path(table, features, "label", [penalty]).collect()}
    whole = VectorAssembler(inputCols=features, outputCol="features").transform(table.dropna(subset=["a"]))
    for k in range(5):
        train, held = whole.where(F.col("fold") != k), whole.where(F.col("fold") == k)
        deviation = train.agg(F.stddev_pop("label")).first()[0]  # MLlib's penalty is for a label of deviation one
        model = LinearRegression(regParam=penalty * deviation, solver="normal").fit(train)
        r = path[k, penalty]
        assert r.coefficients == pytest.approx([model.intercept, *model.coefficients], rel=1e-9)
        errors = model.transform(held).agg(F.avg((F.col("prediction") - F.col("label")) ** 2), F.var_pop("label")).first()
        assert r.mse == pytest.approx(errors[0], rel=1e-9) and r.r2 == pytest.approx(1 - errors[0] / errors[1], rel=1e-9)


def test_sums_leave_out_rows_with_nulls(table):
    assert sum(m[0, 0] for _, m in M.fold_sums(table, ["a", "b"], "label")) == table.where("a is not null").count()


def test_a_constant_feature_gets_no_weight(spark):
    df = spark.createDataFrame([(i % 2, 1.0, float(i), 2.0 * i) for i in range(20)], "fold int, one double, x double, label double")
    for r in M.ridge_path(df, ["one", "x"], "label", [0.0, 0.1]).collect():
        assert r.coefficients[1] == pytest.approx(0.0, abs=1e-9)


@pytest.fixture(scope="module")
def folds(table):
    return M.prepare_folds(table, ["a", "b", "c"], ["k"], folds=3)


def test_folds_learn_from_their_fit_rows_only(spark, table, folds):
    assert len(folds) == 3
    for k, (fit_rows, other) in enumerate(folds):
        assert other.count() == table.where(F.col("fold") == k).count()
        assert fit_rows.count() + other.count() == table.count()
        assert len(fit_rows.first().features) == len(other.first().features)


def test_grid_search_takes_the_best_mean(folds):
    best, rows = M.grid_search(folds, "gbt", {"maxDepth": [2, 4], "maxIter": [5], "stepSize": [0.05, 0.3]})
    assert len(rows) == 4 and best == min(rows, key=lambda r: r[1])[0]
    again = M.fold_scores(folds, "gbt", [best])[0]
    assert float(np.mean(again)) == pytest.approx(min(r[1] for r in rows))


def test_halving_finds_the_winner_of_the_full_search(folds):
    grid = {"maxDepth": [2, 5], "stepSize": [0.01, 0.3]}
    best, log = M.successive_halving(folds, "gbt", grid, rungs=(2, 8), keep=2)
    full, _ = M.grid_search(folds, "gbt", {**grid, "maxIter": [8]})
    assert best == full
    assert [sum(1 for i, _, _ in log if i == rung) for rung in (0, 1)] == [4, 2]


def test_no_task_reads_many_rows_of_a_table_to_fit_on(spark, table):
    """The file is compact (three values), its rows are not: splits go by rows, whatever the bytes."""
    wide = table.crossJoin(spark.range(100)).coalesce(2).select("label", "fold", F.array(F.lit(0.0), "c").alias("x"))
    per_task = lambda df: df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert max(per_task(materialize(wide))) >= 20_000
    read = materialize_for_fit(wide, rows=2_000)
    assert max(per_task(read)) <= 4_000 and read.count() == 40_000
    assert read.groupBy("label").count().exceptAll(wide.groupBy("label").count().withColumnRenamed("n", "count")).isEmpty()


def test_fit_rows_of_folds_are_read_in_bounded_tasks(table, monkeypatch):
    monkeypatch.setattr(M, "materialize_for_fit", lambda df: materialize_for_fit(df, rows=50))
    for fit_rows, other in M.prepare_folds(table.coalesce(1), ["a", "b", "c"], ["k"], folds=2):
        sizes = fit_rows.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert max(sizes) <= 100 and sum(sizes) + other.count() == table.count()
        assert "ml_attr" in fit_rows.schema["features"].metadata
