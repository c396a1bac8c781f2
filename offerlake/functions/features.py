"""Feature jobs as column expressions, plus the one learned
step, ``GroupMedianImputer`` (F6), as an MLlib Estimator/Model pair.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from offerlake.operators.quantiles import exact_quantiles

UNSPECIFIED = "Non spécifié"
# Cities counted as major (substring test), Paris-region department
# codes, sectors flagged as high paying, and the seniority encodings.
MAJOR_CITIES = ("Paris", "Lyon", "Marseille", "Toulouse", "Bordeaux", "Lille", "Nice", "Nantes",
                "Strasbourg", "Rennes", "Grenoble", "Toulon", "Montpellier")
PARIS_CODES = ("75", "77", "78", "91", "92", "93", "94", "95")
HIGH_PAYING_SECTORS = ("Banque", "Finance", "Tech", "Consulting", "Assurance", "Pharma")
SENIORITY_ORDINAL = {
    "Débutant (<1 an)": 1, "Junior (1-3 ans)": 2, "Mid confirmé (3-5 ans)": 3, "Senior (5-8 ans)": 4,
    "Expert (8-12 ans)": 5, "Lead/Manager (12-20 ans)": 6, "Directeur/VP (>20 ans)": 7,
    "Non spécifié": 0, "Stage/Alternance": 1, "Freelance/Consultant": 3,
}
HIERARCHY_SCORE = {
    "Stage/Alternance": 1, "Débutant (<1 an)": 2, "Junior (1-3 ans)": 3, "Mid confirmé (3-5 ans)": 4,
    "Senior (5-8 ans)": 5, "Expert (8-12 ans)": 6, "Lead/Manager (12-20 ans)": 7, "Directeur/VP (>20 ans)": 8,
}
# Technical-score weights per skill (cap 15) and the 12 counted skills.
SKILL_WEIGHTS = {
    "contient_python": 2, "contient_sql": 2, "contient_machine_learning": 2, "contient_deep_learning": 2,
    "contient_r": 1, "contient_aws": 1, "contient_azure": 1, "contient_gcp": 1, "contient_spark": 1,
    "contient_tableau": 1, "contient_power_bi": 1,
}
COUNTED_SKILLS = ("contient_sql", "contient_python", "contient_r", "contient_tableau", "contient_power_bi",
                  "contient_aws", "contient_azure", "contient_gcp", "contient_spark",
                  "contient_machine_learning", "contient_deep_learning", "contient_etl")
BENEFIT_FLAGS = ("has_teletravail", "has_mutuelle", "has_tickets", "has_prime")
TELEWORK_LABELS = {"Présentiel": 0.0, "Hybride (1-3j)": 0.5, "Full remote": 1.0}
COMPLEXITY_LABELS = ("Faible", "Moyenne", "Élevée", "Très élevée")


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _flag(df: DataFrame, c: str | None) -> Column:
    return F.coalesce(F.col(c).cast("int"), F.lit(0)) if c and c in df.columns else F.lit(0)


# F1
def bools_to_int(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.col(f.name).cast("int") for f in df.schema.fields
                           if isinstance(f.dataType, T.BooleanType)})


# F2
def missing_indicator(c: Column) -> Column:
    return c.isNull().cast("int")


# F3
def final_location(c: Column) -> Column:
    return F.coalesce(c, F.lit(UNSPECIFIED))


# F4
def is_major_city(c: Column, cities=MAJOR_CITIES) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.contains(x) for x in cities]), F.lit(False)).cast("int")


# F5
def seniority_ordinal(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_lit_map(SENIORITY_ORDINAL), c), F.lit(0))


# F7
def tech_exp_interaction(technical_score: Column, exp_imputed: Column) -> Column:
    return technical_score * F.log1p(exp_imputed)


# F8
def numeric_repair(c: Column) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(0.0))


# F9
def is_paris_region(location: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [location.contains(x) for x in PARIS_CODES]),
                      F.lit(False)).cast("int")


# F10
def advanced_data_score(df: DataFrame, ml: str | None, spark_: str | None, aws: str | None) -> Column:
    return _flag(df, ml) + _flag(df, spark_) + _flag(df, aws)


# F11
def is_high_paying_sector(sector: Column, sectors=HIGH_PAYING_SECTORS) -> Column:
    return F.coalesce(sector.isin(list(sectors)), F.lit(False)).cast("int")


# F12
def stack_flags(df: DataFrame, skill_of) -> dict[str, Column]:
    s = {n: _flag(df, skill_of(n)) == 1 for n in
         ("python", "aws", "azure", "gcp", "spark", "machine_learning", "sql", "tableau", "power_bi")}
    cloud = s["aws"] | s["azure"] | s["gcp"]
    return {"has_modern_stack": (s["python"] & cloud & s["spark"]).cast("int"),
            "has_ds_stack": (s["python"] & s["machine_learning"] & cloud).cast("int"),
            "has_bi_stack": (s["sql"] & (s["tableau"] | s["power_bi"])).cast("int")}


# F13 (right-closed bins (-1,2] (2,5] (5,10] (10,inf]; not Bucketizer, which is left-closed)
def complexity_band(n: Column) -> Column:
    return (F.when((n > -1) & (n <= 2), COMPLEXITY_LABELS[0]).when((n > 2) & (n <= 5), COMPLEXITY_LABELS[1])
            .when((n > 5) & (n <= 10), COMPLEXITY_LABELS[2]).when(n > 10, COMPLEXITY_LABELS[3]))


def complexity_ordinal(n: Column) -> Column:
    return F.when(n <= 2, 0).when(n <= 5, 1).when(n <= 10, 2).otherwise(3)


# F14
def hierarchy_score(seniority: Column) -> Column:
    return F.coalesce(F.try_element_at(_lit_map(HIERARCHY_SCORE), seniority), F.lit(0))


# F15
def skills_count(df: DataFrame, flags=COUNTED_SKILLS) -> Column:
    return reduce(lambda a, b: a + b, [_flag(df, c) for c in flags])


# F16
def technical_score(df: DataFrame, weights=None) -> Column:
    weights = weights or SKILL_WEIGHTS
    return F.least(reduce(lambda a, b: a + b, [_flag(df, c) * w for c, w in weights.items()]), F.lit(15))


# F17
def benefits_score(df: DataFrame, flags=BENEFIT_FLAGS) -> Column:
    return reduce(lambda a, b: a + b, [_flag(df, c) for c in flags])


# F18
def seniority_from_experience(exp: Column, with_lead: bool = False) -> Column:
    out = (F.when(exp < 1, "Stage/Alternance").when(exp <= 3, "Junior (1-3 ans)")
           .when(exp <= 5, "Mid-level").when(exp <= 8, "Senior (5-8 ans)"))
    if with_lead:
        out = out.when(exp <= 12, "Expert (8-12 ans)").otherwise("Lead/Manager (12-20 ans)")
    else:
        out = out.otherwise("Expert (8-12 ans)")
    return F.when(exp.isNotNull(), out)


# F19
def interpolate(value: Column, knots: list, outputs: list[Column]) -> Column:
    """Piecewise-linear on [k_i, k_{i+1}), int-truncated; clamped to the end outputs."""
    out = None
    for i in range(len(knots) - 1):
        lo, hi = knots[i], knots[i + 1]
        seg = (outputs[i] + (value - lo) / F.lit(float(hi - lo)) * (outputs[i + 1] - outputs[i])).cast("long")
        cond = (value >= lo) & (value < hi)
        out = F.when(cond, seg) if out is None else out.when(cond, seg)
    return out.when(value >= knots[-1], outputs[-1].cast("long")).otherwise(outputs[0].cast("long"))


# F20. The knots of experience and, below, of skills (F21), with the bonuses of job words.
def expected_word_count(exp: Column, skills: Column, sector_adj: Column, job: Column, d: dict,
                        skills_slope: Column) -> Column:
    """``d`` holds Columns p10, p25, median, p75, p90 of the word-count distribution."""
    outs = [d["p25"], d["p25"], d["median"], ((d["median"] + d["p75"]) / 2).cast("long"), d["p75"], d["p90"], d["p90"]]
    base = interpolate(exp, [0, 1, 3, 5, 8, 10, 30], outs)
    base = base + ((skills - 3) * skills_slope).cast("long") + F.coalesce(sector_adj, F.lit(0))
    bonus = (F.when(job.contains("Lead") | job.contains("Manager") | job.contains("Architect"), 80)
             .when(job.contains("Scientist") | job.contains("Engineer"), 40).otherwise(0))
    return F.least(F.greatest(base + bonus, d["p10"]), d["p90"] + 100).cast("long")


# F21
def expected_keyword_count(skills: Column, advanced: Column, exp: Column, d: dict) -> Column:
    """``d`` holds Columns median, p75, p90 of the keyword-count distribution."""
    outs = [d["median"], d["median"], d["p75"], ((d["p75"] + d["p90"]) / 2).cast("long"), d["p90"], d["p90"]]
    k = interpolate(skills, [0, 2, 4, 6, 8, 15], outs)
    k = k + F.when(advanced >= 3, 1).otherwise(0) + F.when(exp >= 8, 1).otherwise(0)
    return F.least(F.greatest(k, d["median"]), d["p90"]).cast("long")


# F22. Defaults of the fields that a profile may lack, the experience that stands for an unknown
# one, and the levels of the serving form (its map differs from those of F5 and F14).
PROFILE_DEFAULTS = {
    "job_type": "Data Analyst", "seniority": "Mid-level", "contract_type": "CDI", "education": "Bac+5",
    "experience": 4.0, "location": "Paris", "sector": "Non spécifié",
    "contient_sql": 1, "contient_python": 1, "contient_r": 0, "contient_tableau": 0, "contient_power_bi": 0,
    "contient_aws": 0, "contient_azure": 0, "contient_gcp": 0, "contient_spark": 0, "contient_etl": 0,
    "contient_machine_learning": 0, "skills_count": 3, "technical_score": 2, "benefits_score": 1,
    "has_teletravail": 1, "has_mutuelle": 0, "has_tickets": 0, "has_prime": 0, "telework_numeric": 0.5,
}
UNKNOWN_EXPERIENCE = 8.0
SERVING_LEVELS = {
    "Stage/Alternance": 1, "Débutant (<1 an)": 1, "Junior (1-3 ans)": 2, "Mid-level": 4, "Mid confirmé (3-5 ans)": 3,
    "Senior (5-8 ans)": 4, "Senior": 5, "Expert (8-12 ans)": 5, "Lead/Manager (12-20 ans)": 6, "Lead/Manager": 7,
    "Directeur/VP (>20 ans)": 7, "Freelance/Consultant": 3, "Non spécifié": 0,
}


# F4, F11 (serving form): membership in a list that the data give (A19's first cities, A18's groups)
def flag_members(df: DataFrame, column: str, members: DataFrame, out: str) -> DataFrame:
    """1 where ``column`` is among the first column of ``members``, else 0. The table of members can be a whole
    vocabulary, so the planner decides by its size how to join."""
    listed = members.select(F.col(members.columns[0]).alias("_member")).where("_member is not null").distinct()
    return df.join(listed, F.col(column) == F.col("_member"), "left").withColumn(
        out, F.col("_member").isNotNull().cast("int")).drop("_member")


def profile_feature_row(profiles: DataFrame, median_words: Column, median_keywords: Column, cities: DataFrame,
                        sectors: DataFrame) -> DataFrame:
    """every field of a profile, by its own value or its default (a column that the table lacks
    counts as null), then the features derived from them. ``median_words`` and ``median_keywords`` are the
    defaults of the text sizes (scalar subqueries); ``cities`` and ``sectors`` the lists of A19 and A18, as
    tables. An experience that is not a number is unknown: flagged, and set to ``UNKNOWN_EXPERIENCE``."""
    def own(name, default):
        kind = "string" if isinstance(default, str) else ("double" if isinstance(default, float) else "int")
        return F.coalesce(F.col(name).cast(kind), F.lit(default)) if name in profiles.columns else F.lit(default)

    keep = [c for c in ("profile_id",) if c in profiles.columns]
    words, keywords = (F.col(c).cast("int") if c in profiles.columns else F.lit(None).cast("int")
                       for c in ("description_word_count", "nb_mots_cles_techniques"))
    x = profiles.select(
        *keep, *[own(n, d).alias(n) for n, d in PROFILE_DEFAULTS.items()],
        F.coalesce(words, median_words.cast("int")).alias("description_word_count"),
        F.coalesce(keywords, median_keywords.cast("int")).alias("nb_mots_cles_techniques"))
    x = x.withColumn("experience_missing", F.isnan("experience").cast("int")).withColumn(
        "experience", F.nanvl("experience", F.lit(UNKNOWN_EXPERIENCE)))
    x = flag_members(flag_members(x, "location", cities, "is_grande_ville"), "sector", sectors, "is_high_paying_sector")
    cloud = (F.col("contient_aws") + F.col("contient_azure") + F.col("contient_gcp")) > 0
    return x.select(
        "*", (F.col("technical_score") * F.log1p("experience")).alias("tech_exp_interaction"),
        F.contains("location", F.lit("Paris")).cast("int").alias("is_paris_region"),
        (F.col("contient_machine_learning") + F.col("contient_spark") + F.col("contient_aws")).alias("advanced_data_score"),
        complexity_ordinal(F.col("nb_mots_cles_techniques")).alias("tech_complexity_encoded"),
        ((F.col("contient_python") > 0) & cloud & (F.col("contient_spark") > 0)).cast("int").alias("has_modern_stack"),
        F.coalesce(F.try_element_at(_lit_map(SERVING_LEVELS), F.col("seniority")), F.lit(0)).alias("hierarchy_score"))


# F24
def telework_of_profile(label: Column | None = None, days: Column | None = None) -> Column:
    if days is not None:
        return days / 5.0
    return F.coalesce(F.try_element_at(_lit_map(TELEWORK_LABELS), label), F.lit(0.5))


# F23
def profile_summary(job: Column, seniority: Column, city: Column, sector: Column, exp: Column,
                    skills: Column, tech: Column) -> Column:
    return F.concat_ws(" | ", job, seniority, city, sector,
                       F.concat(F.format_number(exp, 1), F.lit(" ans")),
                       F.concat(skills.cast("string"), F.lit(" compétences")),
                       F.concat(F.lit("score "), tech.cast("string")))


# --------------------------------------------------------------------- F6
class _ImputerParams(HasInputCol, HasOutputCol):
    groupCol = Param(Params._dummy(), "groupCol", "ordinal group column", typeConverter=TypeConverters.toString)

    def getGroupCol(self):
        return self.getOrDefault(self.groupCol)


class GroupMedianImputer(Estimator, _ImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Fit (train rows only): exact median of ``inputCol`` per ``groupCol`` value
    and overall. Transform: NULL -> group median, else the overall median."""

    @keyword_only
    def __init__(self, inputCol="experience_final", outputCol="experience_final_imputed",
                 groupCol="seniority_numeric"):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol, groupCol=groupCol)

    def _fit(self, df: DataFrame) -> "GroupMedianImputerModel":
        value, group = self.getInputCol(), self.getGroupCol()
        both = df.select(F.explode(F.array(F.struct(F.lit(True).alias("overall"), F.lit(None).cast(df.schema[group].dataType).alias("g")),
                                           F.struct(F.lit(False).alias("overall"), F.col(group).alias("g")))).alias("_k"),
                         F.col(value).alias("v")).select("_k.*", "v")
        # one number per group value: the fitted state, kept and saved as a parameter
        rows = exact_quantiles(both, "v", [0.5], ["overall", "g"], ["m"]).where(
            F.col("overall") | F.col("g").isNotNull()).collect()
        medians = [[r["g"], r["m"]] for r in rows if not r["overall"]]
        overall = next((r["m"] for r in rows if r["overall"]), None)
        return GroupMedianImputerModel()._set(inputCol=value, outputCol=self.getOutputCol(), groupCol=group,
                                              fitted=json.dumps([overall, medians]))


class GroupMedianImputerModel(Model, _ImputerParams, DefaultParamsReadable, DefaultParamsWritable):
    """The fitted medians are a parameter, so the model is saved with its pipeline; they meet the
    rows in a join with a table of one row per group."""

    fitted = Param(Params._dummy(), "fitted", "[overall median, [[group, median], ...]] as JSON",
                   typeConverter=TypeConverters.toString)

    @property
    def medians(self) -> dict:
        return dict(map(tuple, json.loads(self.getOrDefault(self.fitted))[1]))

    @property
    def global_median(self) -> float | None:
        return json.loads(self.getOrDefault(self.fitted))[0]

    def _transform(self, df: DataFrame) -> DataFrame:
        value, group = self.getInputCol(), self.getGroupCol()
        kind = df.schema[group].dataType.simpleString()
        table = df.sparkSession.createDataFrame(list(self.medians.items()), f"_group {kind}, _median double")
        overall = F.lit(self.global_median).cast("double")
        joined = df.join(table, F.col(group) == F.col("_group"), "left")
        return joined.withColumn(self.getOutputCol(), F.coalesce(
            F.col(value).cast("double"), F.col("_median"), overall)).drop("_group", "_median")
