"""Counterfactual scoring, batch over all profiles.

A scenario grid is a short literal list; it is attached to every profile with
``explode(array(struct...))`` (no join), overrides are applied with
``coalesce(override, base)``, then ONE scorer call scores every
(profile, scenario) row. Deltas to the base scenario come from a window over
the profile's own rows (bounded by the grid size).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from offerlake.operators.profiles import missing_skills
from offerlake.operators.quantiles import exact_quantiles

# Months to learn a skill (career roadmap table).
ROADMAP_MONTHS = {
    "sql": 3, "tableau": 4, "power_bi": 4, "python": 6, "r": 6, "etl": 7, "aws": 8, "azure": 8,
    "spark": 9, "machine_learning": 12, "deep_learning": 15,
}
DEFAULT_MONTHS = 6
PROJECTION_YEARS = (0, 2, 4, 6, 8, 10)


def _months_map(months: dict) -> Column:
    return F.create_map(*[x for k, v in months.items() for x in (F.lit(k), F.lit(v))])


def with_scenarios(profiles: DataFrame, grid: list[dict], columns: list[str]) -> DataFrame:
    """Every profile x every grid entry; entry = {'scenario_id': ..., col: value};
    missing keys keep the profile's own value."""
    types = dict(profiles.dtypes)
    structs = [F.struct(F.lit(g["scenario_id"]).alias("scenario_id"),
                        *[F.lit(g.get(c)).cast(types[c]).alias(f"_o_{c}") for c in columns]) for g in grid]
    x = profiles.select("*", F.explode(F.array(*structs)).alias("_g"))
    return x.select(*[F.coalesce(F.col(f"_g._o_{c}"), F.col(c)).alias(c) if c in columns else F.col(c)
                      for c in profiles.columns], F.col("_g.scenario_id").alias("scenario_id"))


def delta_to_base(scored: DataFrame, base_id: str = "base") -> DataFrame:
    """Prediction minus the base scenario's prediction of the same profile."""
    w = Window.partitionBy("profile_id")
    base = F.max(F.when(F.col("scenario_id") == base_id, F.col("prediction"))).over(w)
    return scored.withColumn("base_prediction", base).withColumn("delta", F.col("prediction") - base)


def scenario_scores(profiles: DataFrame, scorer, grid: list[dict], columns: list[str]) -> DataFrame:
    grid = [{"scenario_id": "base"}] + [g for g in grid if g["scenario_id"] != "base"]
    return delta_to_base(scorer(with_scenarios(profiles, grid, columns)))


def scenario_insights(scores: DataFrame) -> DataFrame:
    """Best / worst scenario, spread, best gain over the base and its label."""
    s = scores.where(F.col("scenario_id") != "base")
    agg = s.groupBy("profile_id").agg(
        F.max_by("scenario_id", F.struct("prediction", F.col("scenario_id"))).alias("best_scenario"),
        F.min_by("scenario_id", F.struct("prediction", F.col("scenario_id"))).alias("worst_scenario"),
        F.max("prediction").alias("best_prediction"), F.min("prediction").alias("worst_prediction"),
        F.max("base_prediction").alias("base_prediction"))
    gain = F.col("best_prediction") - F.col("base_prediction")
    return agg.select("profile_id", "best_scenario", "worst_scenario",
                      (F.col("best_prediction") - F.col("worst_prediction")).alias("spread"),
                      gain.alias("best_gain"),
                      F.when(gain > 2000, "strong").when(gain > 1000, "moderate").otherwise("weak").alias("label"))


def _set_skill(profiles: DataFrame, skills: list[tuple[str, str]], skill_col: str = "skill") -> DataFrame:
    """Turn on the flag of the row's ``skill`` (other flags unchanged)."""
    return profiles.withColumns({c: F.when(F.col(skill_col) == n, F.lit(1)).otherwise(F.col(c))
                                 for n, c in skills})


def skill_roadmap(profiles: DataFrame, offers: DataFrame, scorer, skills: list[tuple[str, str]]) -> DataFrame:
    """Per missing skill: gain of adding it, market frequency, ROI =
    gain / (1 - freq + 0.01), rarity = 100 (1 - freq)."""
    base = scorer(profiles).select("profile_id", F.col("prediction").alias("base_prediction"))
    miss = missing_skills(profiles, skills).join(profiles, "profile_id")
    scored = scorer(_set_skill(miss, skills)).join(base, "profile_id")
    freq = offers.agg(*[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(n) for n, c in skills])
    freq_long = freq.select(F.explode(F.array(*[F.struct(F.lit(n).alias("skill"), F.col(n).alias("frequency"))
                                                for n, _ in skills])).alias("f")).select("f.*")
    gain = F.col("prediction") - F.col("base_prediction")
    # the frequency table has one row per skill: a bounded broadcast
    return scored.join(F.broadcast(freq_long), "skill").select(
        "profile_id", "skill", "skill_pos", gain.alias("gain"), "frequency",
        (gain / (1 - F.col("frequency") + 0.01)).alias("roi"),
        ((1 - F.col("frequency")) * 100).alias("rarity"))


def effort_impact(roadmap: DataFrame, months: dict | None = None) -> DataFrame:
    """Effort months, ROI per month and the Quick Win / Investissement /
    Équilibré class; skills without a months entry are skipped."""
    m = F.try_element_at(_months_map(months or ROADMAP_MONTHS), F.col("skill"))
    r = roadmap.withColumn("effort", m).where(F.col("effort").isNotNull())
    return r.select("profile_id", "skill", "effort", F.col("gain").alias("impact"),
                    (F.col("gain") / F.col("effort")).alias("roi_per_month"),
                    F.when((F.col("effort") <= 6) & (F.col("gain") >= 3000), "Quick Win")
                    .when(F.col("effort") > 9, "Investissement").otherwise("Équilibré").alias("category"))


def best_effort(effort: DataFrame) -> DataFrame:
    """C3 recommendation: per profile the skill with the best gain per month (ties: smallest name)."""
    w = Window.partitionBy("profile_id").orderBy(F.col("roi_per_month").desc(), "skill")
    return effort.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def effort_impact_medians(effort: DataFrame) -> DataFrame:
    """Median effort and median impact over a profile's skills."""
    e = exact_quantiles(effort, "effort", [0.5], ["profile_id"], ["median_effort"]).drop("_count")
    i = exact_quantiles(effort, "impact", [0.5], ["profile_id"], ["median_impact"]).drop("_count")
    return e.join(i, "profile_id")


def best_single_skill(roadmap: DataFrame, first_n: int | None = 3) -> DataFrame:
    """C4: max gain over the first ``first_n`` missing skills (all when None), floor 0."""
    r = roadmap if first_n is None else roadmap.where(F.col("skill_pos") < first_n)
    return r.groupBy("profile_id").agg(F.greatest(F.max("gain"), F.lit(0.0)).alias("best_gain"))


def role_transitions(profiles: DataFrame, gaps: DataFrame, scorer, cols, months: dict | None = None,
                     k: int = 3) -> DataFrame:
    """Score each profile as each other role; gain, missing demanded skills,
    total learning months (default 6 per skill), gain per month; top k by gain."""
    months_col = F.coalesce(F.try_element_at(_months_map(months or ROADMAP_MONTHS), F.col("skill")),
                            F.lit(DEFAULT_MONTHS))
    per_role = gaps.groupBy("profile_id", "role", "offer_count").agg(
        F.sum(F.when(F.col("skill").isNotNull(), months_col).otherwise(0)).alias("learning_months"),
        F.array_sort(F.collect_list("skill")).alias("missing_skills"))   # <= number of skills per group
    base = scorer(profiles).select("profile_id", F.col("prediction").alias("base_prediction"))
    as_role = per_role.join(profiles.drop(cols.job), "profile_id").withColumn(cols.job, F.col("role"))
    scored = scorer(as_role).join(base, "profile_id")
    gain = F.col("prediction") - F.col("base_prediction")
    out = scored.select("profile_id", "role", "offer_count", F.col("prediction").alias("salary"),
                        gain.alias("gain"), F.array_join("missing_skills", ",").alias("missing_skills"),
                        "learning_months",
                        F.when(F.col("learning_months") > 0, gain / F.col("learning_months"))
                        .otherwise(F.lit(0.0)).alias("roi_per_month"))
    w = Window.partitionBy("profile_id").orderBy(F.col("gain").desc(), F.col("role"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def projection(profiles: DataFrame, scorer, cols, skills: list[tuple[str, str]],
               years=PROJECTION_YEARS) -> DataFrame:
    """Years x 3 strategies. experience_only: +years; progressive: +years and
    one more missing skill (in skill order) per 2 years; full_stack: every skill."""
    flags = [c for _, c in skills]
    owned = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags]
    x = profiles.select("*", F.explode(F.array(*[F.lit(y) for y in years])).alias("year"),
                        F.explode(F.array(F.lit("experience_only"), F.lit("progressive"),
                                          F.lit("full_stack"))).alias("strategy"))
    # rank of each missing flag among the profile's missing flags (0-based)
    miss_rank = []
    for i in range(len(flags)):
        before = reduce(lambda a, b: a + b, [1 - owned[j] for j in range(i)], F.lit(0))
        miss_rank.append(before)
    added = F.floor(F.col("year") / 2)
    new_flags = {}
    for i, c in enumerate(flags):
        turn_on = ((F.col("strategy") == "full_stack")
                   | ((F.col("strategy") == "progressive") & (owned[i] == 0) & (miss_rank[i] < added)))
        new_flags[c] = F.when(turn_on, F.lit(1)).otherwise(owned[i])
    proj = x.withColumns(new_flags).withColumn(cols.experience, F.col(cols.experience) + F.col("year"))
    return scorer(proj).select("profile_id", "year", "strategy", cols.experience, "prediction")


def first_skill_boost(profiles: DataFrame, scorer, targets: list[tuple[str, str]]) -> DataFrame:
    """Score the profile with the first target skill it lacks turned on."""
    first = F.try_element_at(F.filter(F.array(*[F.when(F.coalesce(F.col(c).cast("int"), F.lit(0)) == 0, F.lit(n))
                                            for n, c in targets]), lambda s: s.isNotNull()), F.lit(1))
    x = profiles.withColumn("skill", first).where(F.col("skill").isNotNull())
    base = scorer(profiles).select("profile_id", F.col("prediction").alias("base_prediction"))
    return scorer(_set_skill(x, targets)).join(base, "profile_id").select(
        "profile_id", "skill", "prediction", (F.col("prediction") - F.col("base_prediction")).alias("boost"))


def _interp(pts: Column, x: Column) -> Column:
    """numpy.interp over an array of struct(e, p) sorted by e: clamped at both ends,
    slope * (x - e_j) + p_j inside [e_j, e_{j+1}]."""
    n = F.size(pts)
    i = F.size(F.filter(pts, lambda t: t["e"] <= x))          # points at or left of x
    lo = F.element_at(pts, F.greatest(i, F.lit(1)))
    hi = F.element_at(pts, F.least(i + 1, n))
    slope = (hi["p"] - lo["p"]) / (hi["e"] - lo["e"])
    return (F.when(i == 0, F.element_at(pts, 1)["p"])
            .when(i >= n, F.element_at(pts, -1)["p"])
            .otherwise(slope * (x - lo["e"]) + lo["p"]))


def experience_insights(scores: DataFrame, profiles: DataFrame, experience: str,
                        prefix: str = "experience:") -> DataFrame:
    """C7 for the experience series of C1: total and average annual growth across
    the series, and the salary 5 years ahead (capped at the last point) by
    linear interpolation. The series per profile is bounded by the grid size."""
    s = scores.where(F.col("scenario_id").startswith(prefix)).select(
        "profile_id", F.struct(F.col(experience).cast("double").alias("e"), F.col("prediction").alias("p")).alias("pt"))
    series = s.groupBy("profile_id").agg(F.array_sort(F.collect_list("pt")).alias("pts"))
    j = series.join(profiles.select("profile_id", F.col(experience).cast("double").alias("cur")), "profile_id")
    first, last = F.element_at("pts", 1), F.element_at("pts", -1)
    span = last["e"] - first["e"]
    total = last["p"] - first["p"]
    future_e = F.least(F.col("cur") + 5, last["e"])
    now = _interp(F.col("pts"), F.col("cur"))
    later = _interp(F.col("pts"), future_e)
    return j.where(F.col("cur").isNotNull()).select(
        "profile_id", total.alias("total_growth"),
        F.when(span > 0, total / span).otherwise(F.lit(0.0)).alias("avg_annual_growth"),
        future_e.alias("future_experience"), later.alias("future_salary"), (later - now).alias("five_year_growth"))
