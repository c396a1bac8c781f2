"""Driver queries for feature jobs (F), the learned imputer (F6), the split,
metrics, ranking and batch scoring (M), and MLlib training + contributions.

Queries with a rule scorer have DuckDB oracles; MLlib training and Shapley
contributions are rows-only for the driver and have invariant tests.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from offerlake.functions import features as FT
from offerlake.functions import text as E
from offerlake.operators import market as A
from offerlake.operators import model as M
from offerlake.operators import trees as TR
from offerlake.operators.profiles import representative_profiles
from offerlake.operators.quality import generalisation_verdict
from offerlake.operators.scoring import RuleScorer, rule_scorer_sql
from offerlake.plans.market_queries import offers
from offerlake.plans.registry import finish, query, with_offers
from offerlake.sources import sinks as SK
from offerlake.sources.offers import FLAG_COLUMNS, OFFER_COLUMNS as C
from offerlake.sources.tables import read_table, spread_for_cpu
from offerlake.session import materialize, materialize_for_fit
from offerlake.streaming.dedup import shared_scratch

CONTIENT = {f"contient_{n}": c for n, c in C.skills}   # reference skill names -> proxy flags


def _r(x: str) -> str:
    return f"round({x}, 4)"


def _case_map(expr: str, mapping: dict, default) -> str:
    return "CASE " + " ".join(f"WHEN {expr} = '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {default} END"


def feature_offers(spark, sf_dir):
    off = offers(spark, sf_dir)
    return off.withColumns({k: F.col(v) for k, v in CONTIENT.items()}).withColumn(
        "seniority", FT.seniority_from_experience(F.col(C.experience)))


# --------------------------------------------------------------------- F1-F18, F22-F24
_SEN_SQL = ("CASE WHEN experience IS NULL THEN NULL WHEN experience < 1 THEN 'Stage/Alternance' "
            "WHEN experience <= 3 THEN 'Junior (1-3 ans)' WHEN experience <= 5 THEN 'Mid-level' "
            "WHEN experience <= 8 THEN 'Senior (5-8 ans)' ELSE 'Expert (8-12 ans)' END")
_SQL_SKILLS = {k: v for k, v in CONTIENT.items()}
_SKILLS_COUNT_SQL = " + ".join(f"coalesce({_SQL_SKILLS[c]}, 0)" for c in FT.COUNTED_SKILLS if c in _SQL_SKILLS)
_TECH_SQL = "least(" + " + ".join(f"coalesce({_SQL_SKILLS[c]}, 0) * {w}" for c, w in FT.SKILL_WEIGHTS.items()
                                  if c in _SQL_SKILLS) + ", 15)"


def _flag_sql(name: str) -> str:
    col = C.skill(name)
    return f"coalesce({col}, 0) = 1" if col else "FALSE"


_CLOUD = f"({_flag_sql('aws')} OR {_flag_sql('azure')} OR {_flag_sql('gcp')})"


@query("feature_row", with_offers(f"""
SELECT offer_id, seniority, CAST({_case_map('seniority', FT.SENIORITY_ORDINAL, 0)} AS BIGINT) AS seniority_numeric,
       CAST({_case_map('seniority', FT.HIERARCHY_SCORE, 0)} AS BIGINT) AS hierarchy_score,
       CAST(experience IS NULL AS BIGINT) AS experience_missing, coalesce(location, 'Non spécifié') AS location_final,
       CAST(coalesce({' OR '.join(f"contains(location, '{x}')" for x in FT.MAJOR_CITIES)}, FALSE) AS BIGINT) AS is_grande_ville,
       CAST(coalesce({' OR '.join(f"contains(location, '{x}')" for x in FT.PARIS_CODES)}, FALSE) AS BIGINT) AS is_paris_region,
       CAST(coalesce({C.skill('machine_learning')}, 0) + coalesce({C.skill('spark')}, 0) + coalesce({C.skill('aws')}, 0) AS BIGINT) AS advanced_data_score,
       CAST(coalesce(sector IN ({', '.join(repr(s) for s in FT.HIGH_PAYING_SECTORS)}), FALSE) AS BIGINT) AS is_high_paying_sector,
       CAST({_flag_sql('python')} AND {_CLOUD} AND {_flag_sql('spark')} AS BIGINT) AS has_modern_stack,
       CAST({_flag_sql('python')} AND {_flag_sql('machine_learning')} AND {_CLOUD} AS BIGINT) AS has_ds_stack,
       CAST({_flag_sql('sql')} AND ({_flag_sql('tableau')} OR {_flag_sql('power_bi')}) AS BIGINT) AS has_bi_stack,
       CAST({_SKILLS_COUNT_SQL} AS BIGINT) AS skills_count, CAST({_TECH_SQL} AS BIGINT) AS technical_score,
       CASE WHEN kw > -1 AND kw <= 2 THEN 'Faible' WHEN kw > 2 AND kw <= 5 THEN 'Moyenne'
            WHEN kw > 5 AND kw <= 10 THEN 'Élevée' WHEN kw > 10 THEN 'Très élevée' END AS tech_complexity,
       CAST(CASE WHEN kw <= 2 THEN 0 WHEN kw <= 5 THEN 1 WHEN kw <= 10 THEN 2 ELSE 3 END AS BIGINT) AS tech_complexity_encoded,
       {_r(f'{_TECH_SQL} * ln(1 + coalesce(experience, 8.0))')} AS tech_exp_interaction,
       {_r("CAST(0.5 AS DOUBLE)")} AS telework_numeric, {_r("CAST(kw AS DOUBLE)")} AS nb_mots_cles_techniques,
       CAST(0 AS BIGINT) AS benefits_score
FROM (SELECT *, {_SEN_SQL} AS seniority, 2 * ({_SKILLS_COUNT_SQL}) AS kw FROM offers)"""))
def q_feature_row(spark, sf_dir):
    df = FT.bools_to_int(feature_offers(spark, sf_dir))
    sen = F.col("seniority")
    kw = FT.skills_count(df) * 2
    tech = FT.technical_score(df)
    out = df.select(
        C.id, "seniority", FT.seniority_ordinal(sen).alias("seniority_numeric"),
        FT.hierarchy_score(sen).alias("hierarchy_score"),
        FT.missing_indicator(F.col(C.experience)).alias("experience_missing"),
        FT.final_location(F.col(C.city)).alias("location_final"),
        FT.is_major_city(F.col(C.city)).alias("is_grande_ville"),
        FT.is_paris_region(F.col(C.city)).alias("is_paris_region"),
        FT.advanced_data_score(df, "contient_machine_learning", "contient_spark", "contient_aws")
        .alias("advanced_data_score"),
        FT.is_high_paying_sector(F.col(C.sector)).alias("is_high_paying_sector"),
        *[v.alias(k) for k, v in FT.stack_flags(df, C.skill).items()],
        FT.skills_count(df).alias("skills_count"), tech.alias("technical_score"),
        FT.complexity_band(kw).alias("tech_complexity"), FT.complexity_ordinal(kw).alias("tech_complexity_encoded"),
        FT.tech_exp_interaction(tech, F.coalesce(F.col(C.experience), F.lit(8.0))).alias("tech_exp_interaction"),
        FT.telework_of_profile(F.lit(None).cast("string")).alias("telework_numeric"),
        FT.numeric_repair(kw).alias("nb_mots_cles_techniques"),
        FT.benefits_score(df).alias("benefits_score"))   # no benefit flags in the proxy: all absent
    return finish(out)


# --------------------------------------------------------------------- M1
def _split_sql(bins: int = 5) -> str:
    probs = [i / bins for i in range(bins + 1)]
    edges = ", ".join(f"quantile_cont(salary_mid, {p}) AS e{i}" for i, p in enumerate(probs))
    stratum = " + ".join(f"CASE WHEN e{i} < salary_mid AND e{i} > e{i - 1} THEN 1 ELSE 0 END" for i in range(1, bins))
    return f"""e AS (SELECT {edges} FROM offers),
st AS (SELECT o.*, {stratum} AS stratum, md5(concat(CAST(offer_id AS VARCHAR), ':42')) AS h
       FROM offers o, e WHERE salary_mid IS NOT NULL),
split AS (SELECT * EXCLUDE (h), CAST(row_number() OVER (PARTITION BY stratum ORDER BY h) - 1
                 < round(count(*) OVER (PARTITION BY stratum) * 0.2::DOUBLE) AS INTEGER) AS is_test FROM st),
train AS (SELECT * FROM split WHERE is_test = 0)"""


def split_offers(spark, sf_dir):
    # reused by every model query (fit, score, metrics): checkpointed once
    return materialize(M.stratified_split(offers(spark, sf_dir), C.id, C.salary))


@query("stratified_split", with_offers("SELECT offer_id, CAST(stratum AS BIGINT) AS stratum, CAST(is_test AS BIGINT) AS is_test FROM split",
                                        _split_sql()))
def q_stratified_split(spark, sf_dir):
    return finish(split_offers(spark, sf_dir).select(C.id, "stratum", "is_test"))


# --------------------------------------------------------------------- F6
@query("median_impute", with_offers(f"""
SELECT s.offer_id, {_r('coalesce(s.experience, grp.m, gm.g)')} AS experience_imputed
FROM split s LEFT JOIN grp ON CAST(substring(s.sector, 1, 1) AS INTEGER) = grp.k CROSS JOIN gm""", _split_sql() + """,
gm AS (SELECT median(experience) AS g FROM train),
grp AS (SELECT CAST(substring(sector, 1, 1) AS INTEGER) AS k, median(experience) AS m FROM train
        GROUP BY 1 HAVING median(experience) IS NOT NULL)"""))
def q_median_impute(spark, sf_dir):
    sp = split_offers(spark, sf_dir).withColumn("sector_ord", F.substring(C.sector, 1, 1).cast("int"))
    imp = FT.GroupMedianImputer(inputCol=C.experience, outputCol="experience_imputed", groupCol="sector_ord")
    model = imp.fit(sp.where(F.col("is_test") == 0))
    return finish(model.transform(sp).select(C.id, "experience_imputed"))


# --------------------------------------------------------------------- F19-F21
_WC = "len(regexp_extract_all(text, '\\S+'))"
_KW = " + ".join(f"CAST(contains(lower(text), '{k}') AS INTEGER)" for k in E.TECH_KEYWORDS)


def _interp_sql(v: str, knots: list, outs: list[str]) -> str:
    cases = " ".join(
        f"WHEN {v} >= {knots[i]} AND {v} < {knots[i + 1]} THEN CAST(trunc({outs[i]} + ({v} - {knots[i]}) / "
        f"{float(knots[i + 1] - knots[i])} * ({outs[i + 1]} - {outs[i]})) AS BIGINT)" for i in range(len(knots) - 1))
    return f"CASE {cases} WHEN {v} >= {knots[-1]} THEN CAST({outs[-1]} AS BIGINT) ELSE CAST({outs[0]} AS BIGINT) END"


_WORD_OUTS = ["d.p25", "d.p25", "d.med", "CAST(trunc((d.med + d.p75) / 2) AS BIGINT)", "d.p75", "d.p90", "d.p90"]
_KW_OUTS = ["k.med", "k.med", "k.p75", "CAST(trunc((k.p75 + k.p90) / 2) AS BIGINT)", "k.p90", "k.p90"]
_JOB_BONUS = ("CASE WHEN contains(job_type, 'Lead') OR contains(job_type, 'Manager') OR contains(job_type, 'Architect') "
              "THEN 80 WHEN contains(job_type, 'Scientist') OR contains(job_type, 'Engineer') THEN 40 ELSE 0 END")


@query("expected_text_size", with_offers(f"""
SELECT offer_id,
  CAST(least(greatest({_interp_sql('experience', [0, 1, 3, 5, 8, 10, 30], _WORD_OUTS)}
        + CAST(trunc((sk - 3) * sl.slope) AS BIGINT) + coalesce(a.adjustment, 0) + {_JOB_BONUS}, d.p10), d.p90 + 100) AS BIGINT) AS expected_words,
  CAST(least(greatest({_interp_sql('sk', [0, 2, 4, 6, 8, 15], _KW_OUTS)}
        + CASE WHEN adv >= 3 THEN 1 ELSE 0 END + CASE WHEN experience >= 8 THEN 1 ELSE 0 END, k.med), k.p90) AS BIGINT) AS expected_keywords
FROM (SELECT offer_id, job_type, experience, concat('src', substring(sector, 1, 1)) AS src, {' + '.join(FLAG_COLUMNS)} AS sk,
             coalesce({C.skill('machine_learning')}, 0) + coalesce({C.skill('spark')}, 0)
             + CASE WHEN coalesce({C.skill('aws')}, 0) = 1 THEN 1 ELSE 0 END AS adv FROM offers) o
     LEFT JOIN (SELECT source, CAST(trunc(median({_WC}) - (SELECT median({_WC}) FROM documents)) AS BIGINT) AS adjustment
                FROM documents GROUP BY source) a ON a.source = o.src,
     (SELECT round(coalesce(CASE WHEN count(*) < 10 THEN 15.0 ELSE regr_slope(w, kw) END, 15.0), 6) AS slope
      FROM (SELECT CAST({_WC} AS DOUBLE) AS w, CAST({_KW} AS DOUBLE) AS kw FROM documents)) sl,
     (SELECT CAST(trunc(quantile_cont(w, 0.1)) AS BIGINT) AS p10, CAST(trunc(quantile_cont(w, 0.25)) AS BIGINT) AS p25,
             CAST(trunc(median(w)) AS BIGINT) AS med, CAST(trunc(quantile_cont(w, 0.75)) AS BIGINT) AS p75,
             CAST(trunc(quantile_cont(w, 0.9)) AS BIGINT) AS p90 FROM (SELECT {_WC} AS w FROM documents)) d,
     (SELECT CAST(trunc(median(kw)) AS BIGINT) AS med, CAST(trunc(quantile_cont(kw, 0.75)) AS BIGINT) AS p75,
             CAST(trunc(quantile_cont(kw, 0.9)) AS BIGINT) AS p90 FROM (SELECT {_KW} AS kw FROM documents)) k"""))
def q_expected_text_size(spark, sf_dir):
    off = offers(spark, sf_dir)
    # word and keyword counts of every text, written once: five statistics read them
    docs = materialize(spread_for_cpu(read_table(spark, sf_dir, "documents", ["source", "text"])).select(
        "source", E.word_count(F.col("text")).alias("w"), E.text_metrics(F.col("text"))["nb_mots_cles_techniques"].alias("k")))
    words, kws = A.distribution_profile(docs, "w"), A.distribution_profile(docs, "k")
    d = {n: words.select(n).scalar() for n in ("p10", "p25", "median", "p75", "p90")}
    k = {n: kws.select(n).scalar() for n in ("median", "p75", "p90")}
    sk = F.col("skills_count")
    adv = (FT._flag(off, C.skill("machine_learning")) + FT._flag(off, C.skill("spark"))
           + F.when(FT._flag(off, C.skill("aws")) == 1, 1).otherwise(0))
    # Words per technical keyword (documented default 15); A20: adjustment of the text's source, which
    # stands in for the sector (first digit of the priority)
    slope = A.regression_slope(docs.select(F.col("w").cast("double").alias("w"), F.col("k").cast("double").alias("k")),
                               "w", "k", 15.0, name="slope").select(F.round(F.coalesce("slope", F.lit(15.0)), 6)).scalar()
    adjust = A.group_adjustments(docs, "source", "w").select(F.col("source").alias("_src"), "adjustment")
    off = off.join(adjust, F.concat(F.lit("src"), F.substring(C.sector, 1, 1)) == F.col("_src"), "left")
    return off.select(
        C.id,
        FT.expected_word_count(F.col(C.experience), sk, F.col("adjustment"), F.col(C.job), d, slope).alias("expected_words"),
        FT.expected_keyword_count(sk, adv, F.col(C.experience), k).alias("expected_keywords"))


# --------------------------------------------------------------------- M5, Q5
_SCORED_SPLIT = f"sc AS ({rule_scorer_sql('split', stats='train')})"


@query("model_metrics", with_offers(f"""
SELECT CASE WHEN is_test = 1 THEN 'test' ELSE 'train' END AS part, {_r('avg(abs(prediction - salary_mid))')} AS mae,
       {_r('sqrt(avg((prediction - salary_mid) * (prediction - salary_mid)))')} AS rmse,
       {_r('1 - sum((prediction - salary_mid) * (prediction - salary_mid)) / (var_pop(salary_mid) * count(*))')} AS r2,
       count(*) AS n
FROM sc GROUP BY 1""", _split_sql() + ",\n" + _SCORED_SPLIT))
def q_model_metrics(spark, sf_dir):
    sp = split_offers(spark, sf_dir)
    scorer = RuleScorer(sp.where(F.col("is_test") == 0), C)
    scored = scorer(sp).withColumn("part", F.when(F.col("is_test") == 1, "test").otherwise("train"))
    return finish(M.regression_metrics(scored, C.salary, "prediction", ["part"]))


# --------------------------------------------------------------------- M7
@query("error_profile", with_offers(f"""
SELECT {', '.join(f"{_r(f'avg(CAST(abs(prediction - salary_mid) / salary_mid <= {t} AS DOUBLE)) * 100')} AS within_{int(t * 100)}" for t in (0.05, 0.10, 0.15, 0.20))},
       {_r('quantile_cont(abs(prediction - salary_mid), 0.75)')} AS abs_error_p75
FROM sc WHERE is_test = 1""", _split_sql() + ",\n" + _SCORED_SPLIT))
def q_error_profile(spark, sf_dir):
    sp = split_offers(spark, sf_dir)
    scorer = RuleScorer(sp.where(F.col("is_test") == 0), C)
    return finish(M.error_profile(scorer(sp.where(F.col("is_test") == 1)), C.salary))


# --------------------------------------------------------------------- M8
@query("batch_predict", with_offers(f"""
SELECT p.profile_id, {_r('p.prediction')} AS prediction,
       {_r('greatest(p.prediction - (SELECT quantile_cont(abs(prediction - salary_mid), 0.75) FROM sc WHERE is_test = 1), 0.0)')} AS band_low,
       {_r('p.prediction + (SELECT quantile_cont(abs(prediction - salary_mid), 0.75) FROM sc WHERE is_test = 1)')} AS band_high,
       {_r('(SELECT avg(abs(prediction - salary_mid)) FROM sc WHERE is_test = 1)')} AS model_mae,
       'rule-v1' AS model_version
FROM ({rule_scorer_sql('profiles', stats='train')}) p""", _split_sql() + ",\n" + _SCORED_SPLIT + """,
profiles AS (SELECT offer_id AS profile_id, * EXCLUDE (offer_id) FROM (
    SELECT o.*, row_number() OVER (PARTITION BY job_type, location ORDER BY offer_id) AS rn FROM offers o) WHERE rn = 1)"""))
def q_batch_predict(spark, sf_dir):
    sp = split_offers(spark, sf_dir)
    train, test = sp.where(F.col("is_test") == 0), sp.where(F.col("is_test") == 1)
    scorer = RuleScorer(train, C)
    scored_test = scorer(test)
    err = M.error_profile(scored_test, C.salary)
    mae = M.regression_metrics(scored_test, C.salary).select("mae")
    prof = representative_profiles(offers(spark, sf_dir).drop("skills_count"), C, [C.job, C.city])
    out = M.batch_predict(scorer(prof), 0.0, 0.0, "rule-v1")
    p75 = err.select("abs_error_p75").scalar()
    return finish(out.select("profile_id", "prediction",
                             F.greatest(F.col("prediction") - p75, F.lit(0.0)).alias("band_low"),
                             (F.col("prediction") + p75).alias("band_high"),
                             mae.scalar().alias("model_mae"), "model_version"))


# --------------------------------------------------------------------- M2-M4, M6, M9, M10, A30, W1
NUMERIC = [C.experience, "skills_count", *FLAG_COLUMNS]
CATEGORICAL = [C.job, C.city, C.sector, C.contract]


_ONCE: dict[tuple, object] = {}


def once(spark, sf_dir, name: str, build):
    """What several model queries share (split, prepared folds, the fitted trees), made once per application."""
    key = (spark.conf.get("spark.app.id", "app"), os.path.abspath(sf_dir), name)
    if key not in _ONCE:
        _ONCE[key] = build()
    return _ONCE[key]


def _split(spark, sf_dir):
    def build():
        sp = split_offers(spark, sf_dir).withColumnRenamed(C.salary, "label").withColumn(
            "sector_ord", F.substring(C.sector, 1, 1).cast("int"))
        return [sp.where(F.col("is_test") == part) for part in (0, 1)]

    return once(spark, sf_dir, "rows", build)


def _train_test(spark, sf_dir):
    def build():
        train, test = _split(spark, sf_dir)
        return materialize(M.fold_column(train, C.id, 5)), test

    return once(spark, sf_dir, "split", build)


def _folds(spark, sf_dir):
    return once(spark, sf_dir, "folds", lambda: M.prepare_folds(_train_test(spark, sf_dir)[0], IMPUTED, CATEGORICAL, _imputer()))


def _whole(spark, sf_dir):
    """(train, test) with the features that preprocessing learns from all train rows, with ids and labels."""
    def build():
        train, test = _train_test(spark, sf_dir)
        prep = Pipeline(stages=M.preprocessing(IMPUTED, CATEGORICAL, _imputer())).fit(train)
        fit_rows, other = (prep.transform(x).select(C.id, "features", "label") for x in (train, test))
        return materialize_for_fit(fit_rows), materialize(other)

    return once(spark, sf_dir, "whole", build)


def _imputer():
    """F6 as the first pipeline stage: experience by the ordinal of the sector."""
    return FT.GroupMedianImputer(inputCol=C.experience, outputCol="experience_imputed", groupCol="sector_ord")


IMPUTED = ["experience_imputed", *NUMERIC[1:]]


@query("train_and_predict")
def q_train_and_predict(spark, sf_dir):
    """M2-M4: a boosted model tuned by 5-fold CV on MAE over folds that are prepared once (imputer, categories and
    scaling learned from each fold's fit rows), refitted on all train rows; test-set predictions."""
    best, _ = M.grid_search(_folds(spark, sf_dir), "gbt", {"maxDepth": [3, 4], "maxIter": [10], "stepSize": [0.1, 0.2]})
    train, test = _whole(spark, sf_dir)
    (model,), = M.fit_many("gbt", [train], [best])
    return model.transform(test).select(C.id, "label", "prediction")


RIDGE_FEATURES, PENALTIES = ("experience", "skills_count"), (0.0, 0.01, 0.1, 1.0, 10.0)


@query("ridge_path", with_offers(f"""
SELECT CAST(fold AS BIGINT) AS fold, penalty, round((hyy - 2 * (c * hy + b1 * h1y + b2 * h2y) + c * c * hn + b1 * b1 * h11 + b2 * b2 * h22
         + 2 * (c * b1 * h1 + c * b2 * h2 + b1 * b2 * h12)) / hn / 1e6, 4) AS mse_millions, round(b1, 4) AS experience_coefficient,
       round(b2, 4) AS skills_coefficient
FROM (SELECT *, my - b1 * m1 - b2 * m2 AS c FROM (
  SELECT *, (v1y * a22 - v2y * v12) / (a11 * a22 - v12 * v12) AS b1, (v2y * a11 - v1y * v12) / (a11 * a22 - v12 * v12) AS b2 FROM (
    SELECT *, v11 * (1 + penalty) AS a11, v22 * (1 + penalty) AS a22 FROM (
      SELECT *, s1 / n AS m1, s2 / n AS m2, sy / n AS my, s11 / n - s1 * s1 / n / n AS v11, s22 / n - s2 * s2 / n / n AS v22,
             s12 / n - s1 * s2 / n / n AS v12, s1y / n - s1 * sy / n / n AS v1y, s2y / n - s2 * sy / n / n AS v2y
      FROM (SELECT h.fold, {', '.join(f'sum(t.{x}) AS {x}' for x in 'n s1 s2 sy s11 s22 s12 s1y s2y'.split())},
                   any_value(h.n) AS hn, any_value(h.s1) AS h1, any_value(h.s2) AS h2, any_value(h.sy) AS hy, any_value(h.s11) AS h11,
                   any_value(h.s22) AS h22, any_value(h.s12) AS h12, any_value(h.s1y) AS h1y, any_value(h.s2y) AS h2y, any_value(h.syy) AS hyy
            FROM sums h JOIN sums t ON t.fold <> h.fold GROUP BY h.fold),
           (SELECT unnest([0.0, 0.01, 0.1, 1.0, 10.0]::DOUBLE[]) AS penalty)))))""", _split_sql() + """,
folds AS (SELECT CAST((row_number() OVER (ORDER BY md5(concat(CAST(offer_id AS VARCHAR), ':42'))) - 1) % 5 AS INTEGER) AS fold,
                 experience::DOUBLE AS x1, (""" + " + ".join(FLAG_COLUMNS) + """)::DOUBLE AS x2, salary_mid::DOUBLE AS y FROM train),
sums AS (SELECT fold, count(*)::DOUBLE AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS s11, sum(x2 * x2) AS s22, sum(x1 * x2) AS s12,
                sum(x1 * y) AS s1y, sum(x2 * y) AS s2y, sum(y * y) AS syy
         FROM folds WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY fold)"""))
def q_ridge_path(spark, sf_dir):
    """M3, M4: five folds and five ridge penalties from one pass of sums."""
    train = _split(spark, sf_dir)[0].select(C.id, *RIDGE_FEATURES, "label")   # folds of narrow rows: all that the sums read
    path = M.ridge_path(M.fold_column(train, C.id, 5), list(RIDGE_FEATURES), "label", list(PENALTIES))
    return finish(path.select("fold", "penalty", (F.col("mse") / 1e6).alias("mse_millions"), F.col("coefficients")[1].alias("experience_coefficient"),
                              F.col("coefficients")[2].alias("skills_coefficient")))


CANDIDATES = (("linear", "linear", {"regParam": 0.1}), ("ridge", "linear", {"regParam": 10.0}),
              ("lasso", "linear", {"regParam": 10.0, "elasticNetParam": 1.0}),
              ("elastic_net", "linear", {"regParam": 10.0, "elasticNetParam": 0.5}),
              ("forest", "rf", {"numTrees": 20, "maxDepth": 5}), ("gbt", "gbt", {"maxDepth": 4, "maxIter": 10}))


@query("model_ranking")
def q_model_ranking(spark, sf_dir):
    """M5 + M6: train / test metrics, mean and deviation of 5-fold CV metrics of six candidate
    models, then the composite ranking. Preprocessing is fitted once per fold on that
    fold's fit rows and shared by the candidates, and so are the scans that they are fitted and scored in."""
    folds, whole = _folds(spark, sf_dir), _whole(spark, sf_dir)
    tables = [fit_rows for fit_rows, _ in (*folds, whole)]
    fitted = {kind: iter(M.fit_many(kind, tables, [p for _, k, p in CANDIDATES if k == kind])) for kind in dict.fromkeys(k for _, k, _ in CANDIDATES)}
    models = []     # per table, in the order of the candidates
    for _ in tables:
        own = {kind: iter(next(found)) for kind, found in fitted.items()}
        models.append([next(own[kind]) for _, kind, _ in CANDIDATES])

    def metrics(job):
        own, rows = job
        return sorted(M.regression_metrics(M.score_all(own, rows), by=["candidate"]).collect())   # a row per candidate

    # scores are independent jobs: submitted concurrently, as CrossValidator(parallelism=n) does
    with ThreadPoolExecutor(max_workers=4) as pool:
        jobs = [(own, other) for own, (_, other) in zip(models[:-1], folds, strict=True)] + [(models[-1], x) for x in whole]
        *held, on_train, on_test = pool.map(metrics, jobs)
    rows = []
    for i, (name, _, _) in enumerate(CANDIDATES):
        tr, te, cv = on_train[i], on_test[i], [x[i] for x in held]
        mae = [m["mae"] for m in cv]
        mean = sum(mae) / 5
        rows.append((name, tr["r2"], te["r2"], te["mae"], sum(m["r2"] for m in cv) / 5, mean,
                     (sum((x - mean) ** 2 for x in mae) / 5) ** 0.5))
    # seven numbers per candidate model: a bounded result table
    res = spark.createDataFrame(rows, "model string, train_r2 double, test_r2 double, test_mae double, "
                                      "cv_r2 double, cv_mae double, cv_mae_std double")
    ranked = M.composite_ranking(res)
    return ranked.withColumn("verdict", generalisation_verdict(F.col("train_r2"), F.col("test_r2"),
                                                               F.col("test_mae"), F.col("cv_mae")))


BACKGROUND_ROWS = 100    # the sample size of the reference's explainer
GBT_PARAMS = {"maxDepth": 4, "maxIter": 10}


def _contributions(spark, sf_dir):
    """(contributions per slot, (name, source) of the slots) of a boosted model for every test row, written once."""
    def build():
        train, test = _whole(spark, sf_dir)
        reg = M.build_regressor("gbt")
        model = reg.fit(train, {reg.getParam(k): v for k, v in GBT_PARAMS.items()})
        named = TR.slots(train, IMPUTED, CATEGORICAL)
        ranked = train.withColumn("_h", M.hash_key(F.col(C.id), 7))
        bg = ranked.orderBy("_h").limit(BACKGROUND_ROWS)   # the background sample is the sampling feature
        return materialize(TR.tree_contributions(model, test, bg, C.id, [n for n, _ in named])), named

    return once(spark, sf_dir, "contributions", build)


@query("contributions")
def q_contributions(spark, sf_dir):
    """M9 + M10 + W1: exact Shapley contributions of a boosted model for every test row against 100 background
    rows, rolled up to the source columns, then the top-10 report with boosters, main brake and running total."""
    parts, named = _contributions(spark, sf_dir)
    rolled = M.rollup_one_hot(parts, C.id, dict(named)).withColumnRenamed("source", "feature")
    return M.contribution_report(rolled, C.id, min_abs=100.0, k=10)


@query("contribution_rollup")
def q_contribution_rollup(spark, sf_dir):
    """Contributions of the one-hot slots rolled up to the columns that they come from, by the vector's attributes."""
    parts, named = _contributions(spark, sf_dir)
    return M.rollup_one_hot(parts, C.id, dict(named))


@query("prediction_contributions")
def q_prediction_contributions(spark, sf_dir):
    """The document of each prediction with its ten largest contributions, written as JSON and read back."""
    report = q_contributions(spark, sf_dir)
    entry = F.struct("rank", "feature", "contribution", "running_total", "is_booster", "is_main_brake")
    doc = report.groupBy(C.id).agg(F.sort_array(F.collect_list(entry)).alias("contributions"))  # at most ten a row
    doc = SK.write_json(doc, f"{shared_scratch(spark, 'contributions')}/json")
    return doc.select(C.id, F.explode("contributions").alias("c")).select(C.id, "c.*")
