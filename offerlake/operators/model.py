"""Model training, evaluation, batch scoring and contributions.

* M1 split, M5 metrics, M7 error profile, M8 batch prediction and M6 ranking are
  aggregates over a DataFrame with ``label`` and ``prediction``; they work with
  any scorer (rule scorer or an MLlib PipelineModel).
* M2-M4: an MLlib Pipeline (median imputation + robust scaling of numeric
  columns with exact medians, frequency-capped one-hot of categoricals, a
  regressor) tuned by CrossValidator on deterministic folds.
* M3, M4 for linear candidates: ``ridge_path`` solves every fold and penalty from one
  pass of sums; ``grid_search`` and ``successive_halving`` share folds that were prepared once,
  and the scans that models are fitted in (``fit_many``, ``histograms``).
* M9: exact contributions of linear pipelines here and of tree models in ``trees``;
  ``shapley_contributions`` samples orderings for any other model. Sum of contributions =
  prediction minus the mean background prediction.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import product

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.operators import histograms as H
from offerlake.operators.quantiles import exact_quantiles, first_within, rank_within
from offerlake.session import materialize, materialize_for_fit

SEED = 42


def hash_key(id_col: Column, seed: int = SEED) -> Column:
    """Deterministic order key: md5 of '<id>:<seed>' (same text hash in DuckDB)."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))


# --------------------------------------------------------------------- M1
def stratified_split(df: DataFrame, id_col: str, label: str, test_fraction: float = 0.2,
                     bins: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``stratum`` (quantile bin of the label, duplicate edges dropped,
    right-closed, lowest edge included) and ``is_test``: exactly
    round(test_fraction * n) rows of each stratum, the first ones by hash."""
    probs = [i / bins for i in range(bins + 1)]
    edges = exact_quantiles(df, label, probs, names=[f"e{i}" for i in range(bins + 1)])
    arr = edges.select(F.array(*[f"e{i}" for i in range(bins + 1)])).scalar()   # one subquery
    e = [F.element_at(arr, i + 1) for i in range(bins + 1)]
    v = F.col(label)
    # bin index = number of distinct interior edges strictly below the value
    # (an edge equal to its predecessor is a dropped duplicate)
    interior = [F.when((e[i] < v) & (e[i] > e[i - 1]), 1).otherwise(0) for i in range(1, bins)]
    stratum = reduce(lambda a, b: a + b, interior)
    x = df.where(v.isNotNull()).withColumn("stratum", stratum).withColumn("_h", hash_key(F.col(id_col), seed))
    return first_within(x, ["stratum"], "_h", test_fraction, "is_test").drop("_h")


def fold_column(df: DataFrame, id_col: str, k: int = 5, seed: int = SEED) -> DataFrame:
    """M4 folds: 0..k-1 by rank of the hash key (balanced, deterministic)."""
    r = rank_within(df.withColumn("_h", hash_key(F.col(id_col), seed)), [], "_h")
    return r.withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_h", "_rank", "_group_n")


# --------------------------------------------------------------------- M5, M7
def regression_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] | tuple = ()) -> DataFrame:
    """MAE, RMSE, R2 (1 - SSE/SST) and n in one aggregate pass."""
    err = F.col(prediction) - F.col(label)
    agg = scored.groupBy(*by).agg(
        F.avg(F.abs(err)).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        F.sum(err * err).alias("_sse"), F.var_pop(label).alias("_var"), F.count(F.lit(1)).alias("n"))
    return agg.select(*by, "mae", "rmse", (1 - F.col("_sse") / (F.col("_var") * F.col("n"))).alias("r2"), "n")


def error_profile(scored: DataFrame, label: str = "label", prediction: str = "prediction",
                  thresholds=(0.05, 0.10, 0.15, 0.20)) -> DataFrame:
    """% of predictions within t of the label, and the P75 absolute error."""
    rel = F.abs(F.col(prediction) - F.col(label)) / F.col(label)
    within = scored.agg(*[(F.avg((rel <= t).cast("double")) * 100).alias(f"within_{int(t * 100)}")
                          for t in thresholds])
    p75 = exact_quantiles(scored.withColumn("_ae", F.abs(F.col(prediction) - F.col(label))), "_ae", [0.75],
                          names=["abs_error_p75"]).select("abs_error_p75")
    return within.select("*", p75.scalar().alias("abs_error_p75"))


# --------------------------------------------------------------------- M6
def composite_ranking(results: DataFrame) -> DataFrame:
    """results: model, test_r2, cv_r2, test_mae, cv_mae, train_r2 ->
    0.4 test R2 + 0.3 CV R2 + 0.2 stability - 0.1 overfit, stability =
    1 - |test - cv| / cv MAE, overfit = train R2 - test R2; best first."""
    stability = 1 - F.abs(F.col("test_mae") - F.col("cv_mae")) / F.col("cv_mae")
    overfit = F.col("train_r2") - F.col("test_r2")
    scored = results.withColumn("stability", stability).withColumn("overfit", overfit).withColumn(
        "composite", 0.4 * F.col("test_r2") + 0.3 * F.col("cv_r2") + 0.2 * F.col("stability") - 0.1 * F.col("overfit"))
    return scored.orderBy(F.col("composite").desc(), "model")


# --------------------------------------------------------------------- M8
def batch_predict(scored: DataFrame, error_p75: float, mae: float, version: str,
                  prediction: str = "prediction") -> DataFrame:
    """Prediction with its band [max(0, p - P75), p + P75], the MAE, date and version."""
    p = F.col(prediction)
    return scored.withColumns({
        "band_low": F.greatest(p - error_p75, F.lit(0.0)), "band_high": p + error_p75,
        "model_mae": F.lit(float(mae)), "predicted_on": F.current_date(), "model_version": F.lit(version)})


# --------------------------------------------------------------------- M2-M4
class _JsonState(Params):
    state = Param(Params._dummy(), "state", "fitted state as JSON", typeConverter=TypeConverters.toString)

    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.state))


class FrequentCategories(Transformer, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the ``max_categories - 1`` most frequent values of each column
    (ties by value) and maps the rest to 'infrequent', NULL to 'Missing'.
    Learned on fit rows by ``fit_frequent``; the kept sets are bounded by
    max_categories, so they travel as small literal arrays (and persist as JSON)."""

    def __init__(self, kept: dict[str, list[str]] | None = None):
        super().__init__()
        self._set(state=json.dumps(kept or {}))

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            f"{c}_cat": F.when(F.col(c).isNull(), F.lit("Missing"))
            .when(F.col(c).cast("string").isin(vals), F.col(c).cast("string")).otherwise(F.lit("infrequent"))
            for c, vals in self._state().items()})


def fit_frequent(df: DataFrame, columns: list[str], max_categories: int = 20) -> FrequentCategories:
    """One pass over (column, value) pairs: counts, then the top values of each
    column by a per-column row_number (WindowGroupLimit keeps it to k rows)."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v"))
                                          for c in columns])).alias("p")).select("p.*").where(F.col("v").isNotNull())
    counts = pairs.groupBy("c", "v").count()
    w = Window.partitionBy("c").orderBy(F.col("count").desc(), "v")
    top = counts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") < max_categories)
    kept = {c: [] for c in columns}
    for r in top.orderBy("c", "_rn").collect():     # <= len(columns) * (max_categories - 1) rows
        kept[r["c"]].append(r["v"])
    return FrequentCategories(kept)


class RobustScale(Transformer, _JsonState, DefaultParamsReadable, DefaultParamsWritable):
    """(x - median) / IQR with exact medians and quartiles learned by ``fit_robust``
    (one small row of statistics per column); NULL -> median before scaling."""

    def __init__(self, stats: dict[str, tuple[float, float]] | None = None):
        super().__init__()
        self._set(state=json.dumps(stats or {}))

    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c, (med, iqr) in self._state().items():
            x = F.coalesce(F.col(c).cast("double"), F.lit(med))
            out[f"{c}_scaled"] = (x - F.lit(med)) / F.lit(iqr if iqr else 1.0)
        return df.withColumns(out)


def fit_robust(df: DataFrame, columns: list[str]) -> RobustScale:
    """Exact quartiles of every column in one rank pass over (column, value) pairs."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v"))
                                          for c in columns])).alias("p")).select("p.*")
    q = {r["c"]: r for r in exact_quantiles(pairs, "v", [0.25, 0.5, 0.75], ["c"], ["q1", "m", "q3"]).collect()}
    stats = {}
    for c in columns:                                   # one row per column
        r = q.get(c)
        stats[c] = ((r["m"] or 0.0), (r["q3"] or 0.0) - (r["q1"] or 0.0)) if r else (0.0, 1.0)
    return RobustScale(stats)


class FitFrequent(Estimator, _JsonState):
    """Estimator of ``FrequentCategories``: refitted on the fit rows of every fold."""

    def __init__(self, columns: list[str] | None = None, max_categories: int = 20):
        super().__init__()
        self._set(state=json.dumps({"columns": columns or [], "max": max_categories}))

    def _fit(self, df: DataFrame) -> FrequentCategories:
        s = self._state()
        return fit_frequent(df, s["columns"], s["max"])


class FitRobust(Estimator, _JsonState):
    """Estimator of ``RobustScale``: refitted on the fit rows of every fold."""

    def __init__(self, columns: list[str] | None = None):
        super().__init__()
        self._set(state=json.dumps({"columns": columns or []}))

    def _fit(self, df: DataFrame) -> RobustScale:
        return fit_robust(df, self._state()["columns"])


def build_regressor(kind: str):
    """``linear`` with regParam and elasticNetParam is ridge (0), lasso (1) and elastic net (between)."""
    if kind == "gbt":
        return GBTRegressor(featuresCol="features", labelCol="label", seed=SEED)
    if kind == "rf":
        return RandomForestRegressor(featuresCol="features", labelCol="label", seed=SEED)
    return LinearRegression(featuresCol="features", labelCol="label")


def preprocessing(numeric: list[str], categorical: list[str], imputer=None) -> list:
    """Unfitted stages: optional group-median imputer (F6), frequent categories, exact robust
    scaling, index, one-hot, assemble. All are estimators, so nothing is learned outside the
    rows that a fit (or a cross-validation fold) is given."""
    indexer = StringIndexer(inputCols=[f"{c}_cat" for c in categorical], outputCols=[f"{c}_idx" for c in categorical],
                            handleInvalid="keep")      # one scan for all columns
    encoder = OneHotEncoder(inputCols=[f"{c}_idx" for c in categorical],
                            outputCols=[f"{c}_ohe" for c in categorical], handleInvalid="keep")
    assembler = VectorAssembler(inputCols=[f"{c}_scaled" for c in numeric] + [f"{c}_ohe" for c in categorical],
                                outputCol="features", handleInvalid="keep")
    return [*([imputer] if imputer is not None else []), FitFrequent(categorical), FitRobust(numeric),
            indexer, encoder, assembler]


def build_pipeline(numeric: list[str], categorical: list[str], kind: str, imputer=None) -> tuple:
    reg = build_regressor(kind)
    return Pipeline(stages=[*preprocessing(numeric, categorical, imputer), reg]), reg


def fit_pipeline(train: DataFrame, numeric: list[str], categorical: list[str], kind: str,
                 params: dict | None = None, imputer=None) -> PipelineModel:
    pipe, reg = build_pipeline(numeric, categorical, kind, imputer)
    return pipe.fit(train, {reg.getParam(k): v for k, v in (params or {}).items()})


def train_model(train: DataFrame, numeric: list[str], categorical: list[str], kind: str = "gbt",
                grid: dict | None = None, folds: int = 5, parallelism: int = 2, imputer=None):
    """M2-M4: CrossValidator over ``grid`` (param name -> values) minimising MAE
    on the deterministic ``fold`` column (see ``fold_column``). The model's ``avgMetrics`` and
    ``stdMetrics`` are the mean and deviation over the folds."""
    pipe, reg = build_pipeline(numeric, categorical, kind, imputer)
    pg = ParamGridBuilder()
    for name, values in (grid or {}).items():
        pg = pg.addGrid(reg.getParam(name), values)
    cv = CrossValidator(estimator=pipe, estimatorParamMaps=pg.build(),
                        evaluator=RegressionEvaluator(labelCol="label", predictionCol="prediction", metricName="mae"),
                        numFolds=folds, seed=SEED, parallelism=parallelism, foldCol="fold")
    return cv.fit(train)


def prepare_folds(train: DataFrame, numeric: list[str], categorical: list[str], imputer=None, folds: int = 5,
                  parallelism: int = 4) -> list[tuple[DataFrame, DataFrame]]:
    """(fit rows, other rows) of every fold with the assembled features, written: preprocessing is fitted once
    per fold, on its fit rows, for all settings and candidates. Folds are independent jobs."""
    def one(k: int) -> tuple[DataFrame, DataFrame]:
        parts = train.where(F.col("fold") != k), train.where(F.col("fold") == k)
        prep = Pipeline(stages=preprocessing(numeric, categorical, imputer)).fit(parts[0])
        fit_rows, other = (prep.transform(x).select("features", "label") for x in parts)
        return materialize_for_fit(fit_rows), materialize(other)

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(one, range(folds)))


def _settings(grid: dict) -> list[dict]:
    return [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


#: Parameters that ``fit_many`` varies in shared scans; a setting with any other is fitted by MLlib, one model after the other.
SHARED_PARAMS = {"gbt": {"maxDepth", "maxIter", "stepSize"}, "rf": {"maxDepth", "numTrees"}, "linear": {"regParam", "elasticNetParam"}}


def fit_many(kind: str, tables: list[DataFrame], settings: list[dict], parallelism: int = 4) -> list[list]:
    """A model per table and setting, fitted as ``build_regressor(kind)`` does, in scans that tables and settings share."""
    regs = []
    for s in settings:
        reg = build_regressor(kind)
        regs.append(reg.copy({reg.getParam(k): v for k, v in s.items()}))
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        if any(set(s) - SHARED_PARAMS[kind] for s in settings):
            found = list(pool.map(lambda job: job[1].fit(job[0]), [(t, r) for t in tables for r in regs]))
            return [found[i * len(regs):(i + 1) * len(regs)] for i in range(len(tables))]
        if kind == "linear":
            def linear(table):
                rows = H.rows_of_moments(table.sparkSession, H.moments(table)).cache()
                models = [r.copy({r.weightCol: "weight"}).fit(rows) for r in regs]
                rows.unpersist()
                return models

            return list(pool.map(linear, tables))
    full = [{k: r.getOrDefault(r.getParam(k)) for k in SHARED_PARAMS[kind]} for r in regs]
    codes = H.binned_all(tables, kind == "gbt", parallelism)
    if kind == "gbt":
        return [[H.boosted_model(r, trees, s["stepSize"], t) for r, s, trees in zip(regs, full, own, strict=True)]
                for t, own in zip(codes, H.boost(codes, full), strict=True)]
    return [[H.forest_model(r, H.grow_forest(t, s["numTrees"], s["maxDepth"], SEED), t) for r, s in zip(regs, full, strict=True)] for t in codes]


def score_all(models: list, rows: DataFrame, label: str = "label") -> DataFrame:
    """(candidate, label, prediction): the predictions of every model, by its number, from one scan of the rows."""
    out = rows
    for i, m in enumerate(models):
        out = m.copy({m.predictionCol: f"_p{i}"}).transform(out)
    each = F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(f"_p{i}").alias("prediction")) for i in range(len(models))])
    return out.select(label, F.explode(each).alias("_s")).select("_s.candidate", label, "_s.prediction")


def fold_scores(folds, kind: str, settings: list[dict], parallelism: int = 4) -> list[list[float]]:
    """MAE on the held-out rows of every fold, for each setting."""
    def one(job) -> list[float]:
        models, (_, other) = job
        found = score_all(models, other).groupBy("candidate").agg(F.avg(F.abs(F.col("prediction") - F.col("label"))).alias("mae")).collect()
        return [r["mae"] for r in sorted(found)]   # one row per setting

    models = fit_many(kind, [fit_rows for fit_rows, _ in folds], settings, parallelism)
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return [list(x) for x in zip(*pool.map(one, zip(models, folds, strict=True)), strict=True)]


def grid_search(folds, kind: str, grid: dict, parallelism: int = 4) -> tuple[dict, list[tuple[dict, float, float]]]:
    """M4 over prepared folds: the setting with the smallest mean MAE (the first of equals), and (setting, mean, deviation) of all."""
    settings = _settings(grid)
    scores = fold_scores(folds, kind, settings, parallelism)
    table = [(s, float(np.mean(x)), float(np.std(x))) for s, x in zip(settings, scores, strict=True)]
    return min(table, key=lambda r: r[1])[0], table


def successive_halving(folds, kind: str, grid: dict, resource: str = "maxIter", rungs: tuple[int, ...] = (2, 6, 20), keep: int = 3,
                       parallelism: int = 4) -> tuple[dict, list[tuple[int, dict, float]]]:
    """M4 over a large grid: all settings with a small ``resource`` (trees) on one fold, one in ``keep`` of the best with more
    on two, and so on; the last rung uses all folds. Returns the winner and (rung, setting, mean MAE) of all fits."""
    left, log = _settings({k: v for k, v in grid.items() if k != resource}), []
    for i, amount in enumerate(rungs):
        last = i == len(rungs) - 1
        some = folds if last else folds[:min(len(folds), i + 1)]
        settings = [{**s, resource: amount} for s in left]
        means = [float(np.mean(x)) for x in fold_scores(some, kind, settings, parallelism)]
        log += [(i, s, m) for s, m in zip(settings, means, strict=True)]
        order = sorted(range(len(left)), key=lambda k: (means[k], k))
        if last:
            return settings[order[0]], log
        left = [left[k] for k in order[:max(1, -(-len(left) // keep))]]
    raise ValueError("no rungs")


# --------------------------------------------------------------------- M3, M4 by sufficient statistics
def fold_sums(df: DataFrame, features: list[str], label: str, fold: str = "fold") -> list[tuple[int, np.ndarray]]:
    """Per fold the sums of all products of (1, features, label): one pass, a partial aggregate. Rows with a null among
    them are left out. (features + 2)^2 numbers a fold reach the driver."""
    names = ["_one", *features, label]
    rows = df.withColumn("_one", F.lit(1.0)).dropna(subset=[*features, label])
    x = [F.col(n).cast("double") for n in names]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    out = []
    for r in rows.groupBy(fold).agg(*[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i, j in pairs]).orderBy(fold).collect():
        m = np.zeros((len(names), len(names)))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"s{i}_{j}"]
        out.append((r[fold], m))
    return out


def ridge_fit(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Intercept and coefficients that minimise SSE / 2n + penalty / 2 * sum((deviation * coefficient)^2)."""
    n, mean = sums[0, 0], sums[0] / sums[0, 0]
    centred = sums / n - np.outer(mean, mean)
    xx, xy = centred[1:-1, 1:-1], centred[1:-1, -1]
    b = np.linalg.lstsq(xx + penalty * np.diag(np.diag(xx)), xy, rcond=None)[0]
    return np.concatenate([[mean[-1] - b @ mean[1:-1]], b])


def ridge_path(df: DataFrame, features: list[str], label: str, penalties: list[float], fold: str = "fold") -> DataFrame:
    """Held-out mean squared error and R2 of every fold and penalty, with the coefficients, all from one scan: the sums of a
    fold's fit rows are the total less its own, and squared errors of the held-out rows follow from theirs."""
    per_fold = fold_sums(df, features, label, fold)
    total = sum((m for _, m in per_fold), np.zeros((len(features) + 2,) * 2))
    rows = []
    for k, held in per_fold:
        for penalty in penalties:
            w = np.concatenate([ridge_fit(total - held, penalty), [-1.0]])
            sse, n = float(w @ held @ w), float(held[0, 0])
            spread = float(held[-1, -1] - held[0, -1] ** 2 / n)
            rows.append((k, float(penalty), sse / n, 1 - sse / spread if spread > 0 else None, [float(x) for x in w[:-1]]))
    return df.sparkSession.createDataFrame(rows, "fold int, penalty double, mse double, r2 double, coefficients array<double>")


# --------------------------------------------------------------------- M9
def shapley_contributions(model: PipelineModel, rows: DataFrame, background: DataFrame, id_col: str,
                          features: list[str], orderings: int = 8, seed: int = SEED) -> DataFrame:
    """Permutation Shapley values, batched. For each (row, background row,
    ordering) the features are switched from background to row values one at a
    time in the ordering; the prediction change at each step is the marginal
    contribution of that feature. One ``transform`` scores every coalition. A prediction
    counts once for the feature just switched and once, negated, for the next one, so
    the marginals add up in a partial aggregate without ordering any path. For linear
    models ``linear_contributions`` has the exact values without sampling.
    ``background`` must be small (the reference used 100 rows): it is the
    sampled part of the estimate and is broadcast."""
    nf = len(features)
    perms = rows.sparkSession.range(orderings).select(
        F.col("id").alias("perm"),
        F.transform(F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(nf - 1)),
                                             lambda i: F.struct(F.md5(F.concat_ws(":", F.col("id").cast("string"), i.cast("string"), F.lit(str(seed)))).alias("h"), i.alias("i")))),
                    lambda s: s["i"]).alias("order"))
    bg = background.select(*[F.col(f).alias(f"_bg_{f}") for f in features]) \
        .withColumn("_bg_id", F.monotonically_increasing_id())
    base = rows.select(id_col, *features)
    combos = base.crossJoin(F.broadcast(bg)).crossJoin(F.broadcast(perms))   # rows x |bg| x orderings, bg bounded
    steps = combos.select("*", F.posexplode(F.sequence(F.lit(0), F.lit(nf))).alias("step", "_s")).drop("_s")
    # feature f takes the row value when its position in the ordering is < step
    pos = {f: F.array_position(F.col("order"), F.lit(i)) - 1 for i, f in enumerate(features)}
    mixed = steps.select(id_col, "_bg_id", "perm", "step", "order",
                         *[F.when(pos[f] < F.col("step"), F.col(f)).otherwise(F.col(f"_bg_{f}")).alias(f)
                           for f in features])
    scored = model.transform(mixed).select(id_col, "step", "order", "prediction")
    feat_names = F.array(*[F.lit(f) for f in features])
    switched = lambda at: F.element_at(feat_names, F.element_at(F.col("order"), at) + 1)
    part = lambda cond, at, sign: F.when(cond, F.struct(
        switched(F.when(cond, at).otherwise(1)).alias("feature"), (F.col("prediction") * sign).alias("d")))
    parts = F.filter(F.array(part(F.col("step") > 0, F.col("step"), 1.0), part(F.col("step") < nf, F.col("step") + 1, -1.0)),
                     lambda x: x.isNotNull())
    split = scored.select(id_col, F.explode(parts).alias("p"))
    # every feature has as many pluses as there are (background row, ordering) pairs, and as many minuses
    return split.groupBy(id_col, F.col("p.feature").alias("feature")).agg(
        (F.sum("p.d") * 2 / F.count(F.lit(1))).alias("contribution"))


def linear_contributions(model: PipelineModel, rows: DataFrame, background: DataFrame, id_col: str,
                         numeric: list[str], categorical: list[str]) -> DataFrame:
    """Exact Shapley values of a linear pipeline: a feature's share of the prediction minus its
    mean share over ``background``. One row per (row, feature), no coalition is scored."""
    coefficients = [float(x) for x in model.stages[-1].coefficients]
    sizes = next(s for s in model.stages if hasattr(s, "categorySizes")).categorySizes
    shares, at = {}, len(numeric)
    for i, c in enumerate(numeric):
        shares[c] = F.col(f"{c}_scaled") * F.lit(coefficients[i])
    for c, size in zip(categorical, sizes):        # the slots of one one-hot block; the last category has none
        block = F.array(*[F.lit(x) for x in coefficients[at:at + size]])
        index = F.col(f"{c}_idx").cast("int")
        shares[c] = F.when(index < size, F.try_element_at(block, index + 1)).otherwise(F.lit(0.0))
        at += size
    features = [*numeric, *categorical]
    mean = model.transform(background).agg(*[F.avg(shares[f]).alias(f) for f in features]).first()   # one row
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), (shares[f] - F.lit(float(mean[f]))).alias("contribution"))
                                  for f in features])).alias("_c")
    return model.transform(rows).select(id_col, stacked).select(id_col, "_c.*")


# --------------------------------------------------------------------- M10, A30, W1
def contribution_report(contrib: DataFrame, id_col: str, min_abs: float = 100.0, k: int = 10) -> DataFrame:
    """Drop |c| < min_abs, keep the top k by |c|, two boosters, the main brake,
    and the running total in |c| order (waterfall, W1)."""
    c = contrib.where(F.abs("contribution") >= min_abs)
    w = Window.partitionBy(id_col).orderBy(F.abs("contribution").desc(), "feature")
    top = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    run = F.sum("contribution").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pos_w = Window.partitionBy(id_col).orderBy(F.col("contribution").desc(), "feature")
    neg_w = Window.partitionBy(id_col).orderBy(F.col("contribution").asc(), "feature")
    return top.select(id_col, "feature", "contribution", "rank", run.alias("running_total"),
                      ((F.row_number().over(pos_w) <= 2) & (F.col("contribution") > 0)).alias("is_booster"),
                      ((F.row_number().over(neg_w) == 1) & (F.col("contribution") < 0)).alias("is_main_brake"))


def rollup_one_hot(contrib: DataFrame, id_col: str, source_of: dict[str, str]) -> DataFrame:
    """Sum contributions of one-hot parts back to their source feature."""
    m = F.create_map(*[x for k, v in source_of.items() for x in (F.lit(k), F.lit(v))])
    src = F.coalesce(F.try_element_at(m, F.col("feature")), F.col("feature"))
    return contrib.groupBy(id_col, src.alias("source")).agg(F.sum("contribution").alias("contribution"))
