"""Exact contributions of trees against all coalitions, and the roll-up of one-hot slots."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from offerlake.operators import model as M
from offerlake.operators import trees as T

NUMERIC, CATEGORICAL = ["a", "b"], ["c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(0, 20)), float(rng.normal()), str(rng.choice(["x", "y", "z"])), str(rng.choice(["p", "q"]))) for i in range(240)]
    rows = [(*r, 10 * r[1] + 5 * r[2] * (r[3] == "x") - 30 * (r[4] == "q") * (r[1] > 7) + rng.normal()) for r in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, c string, d string, label double")


@pytest.fixture(scope="module")
def prepared(table):
    from pyspark.ml import Pipeline
    return Pipeline(stages=M.preprocessing(NUMERIC, CATEGORICAL)).fit(table).transform(table).select("id", "features", "label").persist()


def plain(predict, x, background):
    """Shapley values by all coalitions, averaged over the background."""
    n, out = len(x), np.zeros(len(x))
    for z in background:
        value = {}
        for k in range(n + 1):
            for s in combinations(range(n), k):
                mixed = z.copy()
                mixed[list(s)] = x[list(s)]
                value[s] = predict(mixed)
        for i in range(n):
            for k in range(n):
                for s in combinations([j for j in range(n) if j != i], k):
                    weight = factorial(k) * factorial(n - k - 1) / factorial(n)
                    out[i] += weight * (value[tuple(sorted((*s, i)))] - value[s])
    return out / len(background)


@pytest.mark.parametrize("kind,params", [(DecisionTreeRegressor, {"maxDepth": 4}), (RandomForestRegressor, {"numTrees": 4, "maxDepth": 3}),
                                         (GBTRegressor, {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3})], ids=["tree", "forest", "gbt"])
def test_equal_to_all_coalitions(spark, prepared, kind, params):
    from pyspark.ml.linalg import Vectors
    model = kind(seed=1, **params).fit(prepared)
    names = [n for n, _ in T.slots(prepared, NUMERIC, CATEGORICAL)]
    rows, background = prepared.where("id < 6"), prepared.where("id >= 200 and id < 208")
    got = {(r.id, r.feature): r.contribution for r in T.tree_contributions(model, rows, background, "id", names).collect()}
    bg = [r.features.toArray() for r in background.collect()]
    mean = np.mean([model.predict(Vectors.dense(z)) for z in bg])
    for r in rows.collect():
        x = r.features.toArray()
        want = plain(lambda v: model.predict(Vectors.dense(v)), x, bg)
        assert [got.get((r.id, n), 0.0) for n in names] == pytest.approx(want.tolist(), abs=1e-9)
        assert sum(got.get((r.id, n), 0.0) for n in names) == pytest.approx(model.predict(r.features) - mean, abs=1e-9)


def test_deep_trees_and_many_rows_add_up(spark, prepared):
    model = GBTRegressor(maxIter=8, maxDepth=9, maxBins=64, seed=2).fit(prepared)
    names = [n for n, _ in T.slots(prepared, NUMERIC, CATEGORICAL)]
    background = prepared.where("id % 3 = 0")
    mean = model.transform(background).agg(F.avg("prediction")).first()[0]
    sums = T.tree_contributions(model, prepared, background, "id", names).groupBy("id").agg(F.sum("contribution").alias("s"))
    off = model.transform(prepared).join(sums, "id").where(F.abs(F.col("prediction") - mean - F.col("s")) > 1e-8)
    assert off.count() == 0


def test_a_model_without_splits(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(1, 1.0, 5.0), (2, 1.0, 5.0)], "id long, a double, label double"))
    model = DecisionTreeRegressor().fit(df)
    assert T.tree_contributions(model, df, df, "id", ["a"]).collect() == []


def test_slots_are_named_by_their_source(prepared):
    found = T.slots(prepared, NUMERIC, CATEGORICAL)
    assert found[:2] == [("a", "a"), ("b", "b")]
    assert {n for n, s in found if s == "c"} == {"c_x", "c_y", "c_z", "c___unknown"} and {s for _, s in found} == {"a", "b", "c", "d"}


def test_slots_roll_up_to_the_contributions_of_their_sources(spark, table):
    pipe = M.fit_pipeline(table, NUMERIC, CATEGORICAL, "linear", {"regParam": 0.1})
    rows, background = table.where("id < 20"), table.where("id >= 100 and id < 150")
    whole = pipe.transform(rows)
    named = T.slots(whole, NUMERIC, CATEGORICAL)
    parts = T.linear_slot_contributions(pipe.stages[-1], whole, pipe.transform(background), "id", [n for n, _ in named])
    rolled = {(r.id, r.source): r.contribution for r in M.rollup_one_hot(parts, "id", dict(named)).collect()}
    direct = {(r.id, r.feature): r.contribution for r in M.linear_contributions(pipe, rows, background, "id", NUMERIC, CATEGORICAL).collect()}
    assert rolled.keys() == direct.keys() and all(rolled[k] == pytest.approx(v, abs=1e-8) for k, v in direct.items())
