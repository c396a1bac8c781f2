"""Trees from shared scans against MLlib's own fits; linear models from sums against fits on rows."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from offerlake.operators import histograms as H
from offerlake.operators import model as M
from offerlake.plans import model_queries as Q
from tests.conftest import SF_SMALL

PLAIN = {"gbt": {"maxDepth": 3, "maxIter": 4, "stepSize": 0.2}, "linear": {"regParam": 10.0}}


def _table(spark, rows=3000, seed=1):
    """Two features of many values, one of few, a constant, a flag and two of one that are never both set."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(rows):
        a, b, c, one = float(rng.normal()), float(rng.integers(0, 50)), float(rng.integers(0, 5)), int(rng.integers(0, 3))
        y = 300 + 40 * (a > 0.3) * (c > 2) - 7 * b + 25 * (one == 1) * (b > 20) + 3 * float(rng.normal())
        out.append((Vectors.dense([a, b, c, 1.0, float(rng.random() < 0.4), float(one == 1), float(one == 2)]), y))
    return spark.createDataFrame(out, ["features", "label"])


@pytest.fixture(scope="module")
def tables(spark):
    return [_table(spark, 3000, 1).cache(), _table(spark, 2000, 2).cache()]


def _predictions(model, df):
    return np.array([r.prediction for r in model.transform(df).select("prediction").collect()])


def test_boosted_trees_equal_mllib(tables):
    settings = [{"maxDepth": d, "maxIter": n, "stepSize": s} for d, n, s in ((2, 5, 0.1), (4, 5, 0.3), (4, 2, 0.1))]
    for table, models in zip(tables, M.fit_many("gbt", tables, settings), strict=True):
        for s, model in zip(settings, models, strict=True):
            reg = M.build_regressor("gbt")
            own = reg.fit(table, {reg.getParam(k): v for k, v in s.items()})
            assert len(model.trees) == s["maxIter"] and list(model.treeWeights) == list(own.treeWeights)
            assert _predictions(model, table) == pytest.approx(_predictions(own, table), rel=1e-9)
            assert [t.depth for t in model.trees] == [t.depth for t in own.trees]


def test_a_tree_without_bags_equals_mllib(tables):
    table = H.binned(tables[0])
    reg = M.build_regressor("rf").setNumTrees(1)
    model = H.forest_model(reg, H.grow_forest(table, 1, 5, 42, bootstrap=False, share=1.0), table)
    own = DecisionTreeRegressor(maxDepth=5).fit(tables[0])
    assert _predictions(model, tables[0]) == pytest.approx(_predictions(own, tables[0]), rel=1e-9)


def test_a_forest_is_as_good_as_mllibs(tables):
    """Bags and node features are drawn anew, so single forests differ: means over some seeds do not."""
    codes, labels = H.binned(tables[0]), np.array([r.label for r in tables[1].collect()])
    reg = M.build_regressor("rf").setNumTrees(20).setMaxDepth(5)
    mine = [H.forest_model(reg, H.grow_forest(codes, 20, 5, seed), codes) for seed in range(5)]
    theirs = [reg.copy({reg.seed: seed}).fit(tables[0]) for seed in range(5)]
    errors = [float(np.mean([np.abs(_predictions(m, tables[1]) - labels).mean() for m in some])) for some in (mine, theirs)]
    assert errors[0] == pytest.approx(errors[1], rel=0.2)
    assert mine[0].getNumTrees == 20 and len({str(t._call_java("toDebugString")).split("\n", 1)[1] for t in mine[0].trees}) == 20


@pytest.mark.parametrize("params", [{"regParam": 0.1}, {"regParam": 10.0}, {"regParam": 1.0, "elasticNetParam": 1.0}, {"regParam": 1.0, "elasticNetParam": 0.5}])
def test_linear_models_from_sums_equal_fits_on_rows(tables, params):
    (model,), = M.fit_many("linear", tables[:1], [params])
    reg = M.build_regressor("linear")
    own = reg.fit(tables[0], {reg.getParam(k): v for k, v in params.items()})
    assert [model.intercept, *model.coefficients] == pytest.approx([own.intercept, *own.coefficients], rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("kind", ["gbt", "rf", "linear"])
def test_all_fits_share_their_scans(spark, tables, kind):
    """Jobs grow with trees and levels, not with tables and settings: a job per fit and level was what did not end in time."""
    sc, grid = spark.sparkContext, {"gbt": ("stepSize", [0.1, 0.2, 0.3, 0.4]), "rf": ("numTrees", [5, 6]), "linear": ("regParam", [0.1, 1.0, 5.0, 10.0])}
    name, values = grid[kind]
    fixed = {"gbt": {"maxDepth": 2, "maxIter": 2}, "rf": {"maxDepth": 2}, "linear": {}}[kind]

    def jobs(settings):
        M.fit_many(kind, tables, settings)     # tables are binned
        sc.setJobGroup(group := f"{kind}-{len(settings)}", group)
        scans = []
        real = H._level, H.moments
        H._level = lambda *a: scans.append(1) or real[0](*a)
        H.moments = lambda *a: scans.append(1) or real[1](*a)
        try:
            M.fit_many(kind, tables, settings)
        finally:
            H._level, H.moments = real
        return len(scans)

    few, many = jobs([{**fixed, name: values[0]}]), jobs([{**fixed, name: v} for v in values])
    assert few > 0 and (many == few if kind != "rf" else many == few * len(values))


def test_rows_of_the_same_bins_are_one_row(spark):
    df = _table(spark, 50, 3)
    twice = df.unionAll(df).unionAll(df)
    assert H.binned(twice).grouped.agg(F.sum("n")).first()[0] == 150.0
    assert H.binned(twice).grouped.count() == H.binned(df).grouped.count() <= 50
    for own, other in zip(M.fit_many("gbt", [df], [PLAIN["gbt"]]), M.fit_many("gbt", [twice], [PLAIN["gbt"]]), strict=True):
        assert _predictions(own[0], df) == pytest.approx(_predictions(other[0], df), rel=1e-9)


def test_rare_values_are_candidates(spark):
    """One row of 30,000 has a value of its own: a sample of 10,000 rows misses it two times in three."""
    df = spark.range(30_000).selectExpr("CAST(id = 12345 AS double) AS x", "id % 7 + 900.0 * CAST(id = 12345 AS double) AS label")
    df = df.rdd.map(lambda r: (Vectors.dense([r.x]), float(r.label))).toDF(["features", "label"])
    assert [list(c) for c in H.thresholds(df, 32)] == [[0.5]]
    (model,), = M.fit_many("gbt", [df], [PLAIN["gbt"]])
    assert model.transform(df).where("label > 800").first().prediction == pytest.approx(904, abs=1)


def test_many_values_are_cut_at_exact_quantiles(spark, monkeypatch):
    df = spark.createDataFrame([(Vectors.dense([float(i), float(i % 3)]),) for i in range(1, 1001)], ["features"])
    listed = H.thresholds(df, 8)
    monkeypatch.setattr(H, "LISTED_VALUES", 100)
    by_rank = H.thresholds(df, 8)
    assert len(listed[0]) == len(by_rank[0]) == 7 and np.abs(listed[0] - by_rank[0]).max() <= 1.0
    assert list(by_rank[1]) == list(listed[1]) == [0.5, 1.5]


def test_constant_features_give_the_mean(spark):
    df = spark.createDataFrame([(Vectors.dense([1.0, 2.0]), float(i)) for i in range(10)], ["features", "label"])
    for kind in ("gbt", "rf"):
        (model,), = M.fit_many(kind, [df], [{"maxDepth": 2}])
        assert _predictions(model, df) == pytest.approx([4.5] * 10, abs=1e-9 if kind == "gbt" else 2.0)


def test_scores_of_all_models_come_from_one_scan(tables):
    models = M.fit_many("linear", tables[:1], [{"regParam": 0.1}, {"regParam": 100.0}])[0]
    found = M.regression_metrics(M.score_all(models, tables[1]), by=["candidate"]).collect()
    for r in found:
        alone = M.regression_metrics(models[r.candidate].transform(tables[1])).first()
        assert (r.mae, r.rmse, r.r2, r.n) == pytest.approx((alone.mae, alone.rmse, alone.r2, alone.n), rel=1e-9)


def test_other_parameters_go_to_mllib(tables):
    (model,), = M.fit_many("gbt", tables[:1], [{"maxIter": 2, "subsamplingRate": 0.5}])
    assert model.getOrDefault(model.subsamplingRate) == 0.5


def _only_shared_fits(monkeypatch):
    def fail(*_):
        raise AssertionError("a fit over rows of its own")

    for kind in (GBTRegressor, RandomForestRegressor):
        monkeypatch.setattr(kind, "_fit", fail)


def test_train_and_predict_equals_mllib_and_shares_its_scans(spark, monkeypatch):
    chosen, search = [], M.grid_search
    with monkeypatch.context() as patched:
        patched.setattr(M, "grid_search", lambda *a: chosen.append(search(*a)) or chosen[0])
        _only_shared_fits(patched)
        found = {r.offer_id: r.prediction for r in Q.q_train_and_predict(spark, SF_SMALL).collect()}
    train, test = Q._whole(spark, SF_SMALL)
    reg = M.build_regressor("gbt")
    own = {r.offer_id: r.prediction for r in reg.fit(train, {reg.getParam(k): v for k, v in chosen[0][0].items()}).transform(test).collect()}
    # two splits that part the fit rows alike are a tie, which rounding decides: a few held-out rows may fall otherwise
    equal = [found[k] == pytest.approx(v, rel=1e-9) for k, v in own.items()]
    assert found.keys() == own.keys() and sum(equal) >= 0.97 * len(own)


def test_model_ranking_equals_mllib_and_shares_its_scans(spark, monkeypatch):
    with monkeypatch.context() as patched:
        _only_shared_fits(patched)
        found = {r.model: r for r in Q.q_model_ranking(spark, SF_SMALL).collect()}
    assert found.keys() == {name for name, _, _ in Q.CANDIDATES}
    train, test = Q._whole(spark, SF_SMALL)
    for name, kind, params in Q.CANDIDATES:
        if kind != "rf":      # bags are drawn
            reg = M.build_regressor(kind)
            model = reg.fit(train, {reg.getParam(k): v for k, v in params.items()})
            if kind == "gbt":     # held-out rows may fall otherwise where two splits part the fit rows alike
                assert found[name].train_r2 == pytest.approx(M.regression_metrics(model.transform(train)).first().r2, rel=1e-9)
            else:                 # the linear solver stops at a tolerance of 1e-6, and its sums are added in another order
                own = M.regression_metrics(model.transform(test)).first()
                assert (found[name].test_mae, found[name].test_r2) == pytest.approx((own.mae, own.r2), rel=1e-4, abs=1e-4)
