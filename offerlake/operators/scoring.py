"""Pluggable salary scorers: ``scorer(df) -> df + prediction``.

``RuleScorer`` is the market rule of K5 made batch: the job median (global
median when the job is unknown) x city multiplier x sector multiplier x
experience-bin factor, + a fixed amount per skill. All its statistics are small
aggregate tables (one row per group value) joined by key, so it is plain SQL
and has a DuckDB oracle. ``offerlake.operators.model`` provides the MLlib scorer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.operators.market import experience_range_bin
from offerlake.operators.quantiles import median_by
from offerlake.session import materialize
from offerlake.sources.offers import FLAG_COLUMNS

SKILL_BONUS = 1000.0


class RuleScorer:
    """Statistics are learned once from ``offers``: every row is expanded into its
    five (kind, key) statistic groups and ONE exact-median pass computes them all;
    the result (one row per group value, bounded by the vocabularies) is
    checkpointed so every later scoring plan reads a small table."""

    def __init__(self, offers: DataFrame, cols, skill_bonus: float = SKILL_BONUS, use_experience: bool = True):
        self.cols = cols
        self.skill_bonus = skill_bonus
        self.use_experience = use_experience   # False = the K5 market rule exactly
        rows = offers.where(F.col(cols.salary).isNotNull())
        kinds = F.array(
            F.struct(F.lit("global").alias("kind"), F.lit("").alias("key")),
            F.struct(F.lit("job").alias("kind"), F.col(cols.job).cast("string").alias("key")),
            F.struct(F.lit("city").alias("kind"), F.col(cols.city).cast("string").alias("key")),
            F.struct(F.lit("sector").alias("kind"), F.col(cols.sector).cast("string").alias("key")),
            F.struct(F.lit("exp").alias("kind"), experience_range_bin(F.col(cols.experience)).alias("key")))
        expanded = rows.select(F.col(cols.salary).alias("v"), F.explode(kinds).alias("g")) \
            .select("g.kind", "g.key", "v").where(F.col("key").isNotNull())
        self.stats = materialize(median_by(expanded, "v", ["kind", "key"], name="m").drop("_count"))

    def _median(self, kind: str, name: str) -> DataFrame:
        return self.stats.where(F.col("kind") == kind).select(F.col("key").alias(f"_k_{name}"),
                                                              F.col("m").alias(name))

    def skills_count(self, df: DataFrame) -> F.Column:
        return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("int"), F.lit(0))
                                            for c in self.cols.skill_cols if c in df.columns])

    def __call__(self, df: DataFrame, job: str | None = None, city: str | None = None,
                 sector: str | None = None, experience: str | None = None) -> DataFrame:
        c = self.cols
        job, city, sector, experience = job or c.job, city or c.city, sector or c.sector, experience or c.experience
        g = self.stats.where(F.col("kind") == "global").select("m").scalar()
        out = df.withColumn("_exp_bin", experience_range_bin(F.col(experience)))
        # statistic tables hold one row per group value; they are checkpointed
        # files, so the planner sees their real size and broadcasts them only
        # when they are below the broadcast threshold (no unconditional hint)
        for kind, key, name in (("job", job, "job_median"), ("city", city, "city_median"),
                                ("sector", sector, "sector_median"), ("exp", "_exp_bin", "exp_median")):
            out = out.join(self._median(kind, name),
                           F.col(key).cast("string") == F.col(f"_k_{name}"), "left").drop(f"_k_{name}")

        def factor(m):
            return F.coalesce(F.col(m) / g, F.lit(1.0))

        base = F.coalesce(F.col("job_median"), g) * factor("city_median") * factor("sector_median")
        if self.use_experience:
            base = base * factor("exp_median")
        pred = base + F.lit(self.skill_bonus) * self.skills_count(df)
        return out.withColumn("prediction", pred).drop(
            "_exp_bin", "job_median", "city_median", "sector_median", "exp_median")


def rule_scorer_sql(profiles: str, job="job_type", city="location", sector="sector", experience="experience",
                    skills=FLAG_COLUMNS,
                    bins=((0, 1), (1, 3), (3, 5), (5, 8), (8, 12), (12, 30)), stats: str = "offers",
                    use_experience: bool = True) -> str:
    """The same scorer as SQL, statistics from CTE ``stats``, for the rows of ``profiles`` (a CTE name).
    Returns a SELECT with all profile columns plus ``prediction``."""
    bin_case = "CASE " + " ".join(f"WHEN {{e}} >= {lo} AND {{e}} < {hi} THEN '{lo}-{hi}'" for lo, hi in bins) + " END"
    skill_sum = " + ".join(f"coalesce(CAST(p.{s} AS INTEGER), 0)" for s in skills)
    exp_factor = " * coalesce(em.m / gm.g, 1.0)" if use_experience else ""
    return f"""SELECT p.*, coalesce(jm.m, (SELECT median(salary_mid) FROM {stats} WHERE salary_mid IS NOT NULL))
         * coalesce(cm.m / gm.g, 1.0) * coalesce(sm.m / gm.g, 1.0){exp_factor}
         + {SKILL_BONUS} * ({skill_sum}) AS prediction
FROM {profiles} p
CROSS JOIN (SELECT median(salary_mid) AS g FROM {stats} WHERE salary_mid IS NOT NULL) gm
LEFT JOIN (SELECT job_type AS k, median(salary_mid) AS m FROM {stats} WHERE salary_mid IS NOT NULL AND job_type IS NOT NULL GROUP BY 1) jm ON p.{job} = jm.k
LEFT JOIN (SELECT location AS k, median(salary_mid) AS m FROM {stats} WHERE salary_mid IS NOT NULL AND location IS NOT NULL GROUP BY 1) cm ON p.{city} = cm.k
LEFT JOIN (SELECT sector AS k, median(salary_mid) AS m FROM {stats} WHERE salary_mid IS NOT NULL AND sector IS NOT NULL GROUP BY 1) sm ON p.{sector} = sm.k
LEFT JOIN (SELECT {bin_case.format(e='experience')} AS k, median(salary_mid) AS m FROM {stats}
           WHERE salary_mid IS NOT NULL GROUP BY 1 HAVING k IS NOT NULL) em ON {bin_case.format(e='p.' + experience)} = em.k"""
