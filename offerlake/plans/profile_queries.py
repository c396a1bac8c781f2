"""Driver queries for profile and scenario operators (K, J, A24-A28, C).

Profiles: one representative offer per (job, city) cell of the whole offers
table (the smallest offer id of the cell), derived by Spark from the data;
every profile query scans all offers. Scores use the rule scorer, which is
plain SQL, so each query has a DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlake.operators import profiles as K
from offerlake.operators import scenarios as S
from offerlake.operators.scoring import RuleScorer, rule_scorer_sql
from offerlake.plans.market_queries import offers
from offerlake.plans.registry import finish, query, with_offers
from offerlake.sources.offers import FLAG_COLUMNS, OFFER_COLUMNS as C

SKILLS = list(C.skills)
PROFILE_COLS = ["offer_id AS profile_id", "job_type", "location", "sector", "contract", "posted_at", "salary_mid",
                "salary_min", "salary_max", "experience", *FLAG_COLUMNS]
PROFILES_CTE = f"""profiles AS (
  SELECT {', '.join(PROFILE_COLS)} FROM (
    SELECT o.*, row_number() OVER (PARTITION BY job_type, location ORDER BY offer_id) AS rn FROM offers o)
  WHERE rn = 1)"""
MASK_SQL = " | ".join(f"({c} << {i})" for i, c in enumerate(FLAG_COLUMNS))
STACK_SQL = " + ".join(FLAG_COLUMNS)


def _r(x: str) -> str:
    return f"round({x}, 4)"


class _LazyScorer:
    """The rule scorer is fitted (one statistics job) only when first used."""

    def __init__(self, off):
        self._off, self._s = off, None

    def _get(self):
        if self._s is None:
            self._s = RuleScorer(self._off, C)
        return self._s

    def __call__(self, *a, **k):
        return self._get()(*a, **k)

    def __getattr__(self, name):
        return getattr(self._get(), name)


def setup(spark, sf_dir):
    off = offers(spark, sf_dir)
    prof = K.representative_profiles(off.drop("skills_count"), C, [C.job, C.city])
    return off, prof, _LazyScorer(off)


def _sql(body: str, *extra: str) -> str:
    return with_offers(body, ",\n".join([PROFILES_CTE, *extra]))


# --------------------------------------------------------------------- K1
@query("employability", _sql(f"""
SELECT profile_id, {_r('sum(CASE WHEN (CASE WHEN bit_count(om) = 0 THEN 1.0 ELSE bit_count(pm & om) / bit_count(om) END) >= 0.7 THEN n ELSE 0 END) / (SELECT count(*) FROM offers)')} AS employability
FROM pm, om GROUP BY profile_id""",
    f"pm AS (SELECT profile_id, {MASK_SQL} AS pm FROM profiles)",
    f"om AS (SELECT {MASK_SQL} AS om, count(*) AS n FROM offers GROUP BY 1)"))
def q_employability(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    return finish(K.employability(prof, off, list(FLAG_COLUMNS)))


# --------------------------------------------------------------------- K2, T3
_O_STACK = " + ".join("o." + c for c in FLAG_COLUMNS)
_P_STACK = " + ".join("p." + c for c in FLAG_COLUMNS)
_SIM_SQL = f"""sim AS (
  SELECT profile_id, offer_id, similarity, o_salary,
         row_number() OVER (PARTITION BY profile_id ORDER BY similarity DESC, offer_id) AS rank
  FROM (SELECT p.profile_id, o.offer_id, o.salary_mid AS o_salary,
               -abs(o.experience - p.experience) * 0.3::DOUBLE - abs(({_O_STACK}) - ({_P_STACK})) * 0.2::DOUBLE
               + CASE WHEN o.sector = p.sector THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
               + CASE WHEN o.location = p.location THEN 0.8::DOUBLE ELSE 0.0::DOUBLE END AS similarity
        FROM profiles p, offers o WHERE o.experience IS NOT NULL AND p.experience IS NOT NULL)
  QUALIFY rank <= 5)"""


@query("similar_offers", _sql(f"""
SELECT profile_id, CAST(rank AS BIGINT) AS rank, offer_id, {_r('similarity')} AS similarity,
       {_r('o_salary')} AS o_salary FROM sim""", _SIM_SQL))
def q_similar_offers(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    return finish(K.similar_offers(prof, off, C, list(FLAG_COLUMNS)))


@query("similar_summary", _sql(f"""
SELECT s.profile_id, {_r('avg(o_salary)')} AS mean_match_salary,
       {_r('avg(CAST(o_salary < p.salary_mid AS DOUBLE))')} AS share_below, count(*) AS n_matches
FROM sim s JOIN profiles p ON s.profile_id = p.profile_id GROUP BY s.profile_id""", _SIM_SQL))
def q_similar_summary(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    sim = K.similar_offers(prof, off, C, list(FLAG_COLUMNS))
    return finish(K.similar_summary(sim, prof, C.salary))


# --------------------------------------------------------------------- K3, K4
_PCT = ("CASE WHEN (SELECT count(salary_mid) FROM offers) = 0 THEN 50.0 ELSE least(greatest("
        "(SELECT count(*) FROM offers o WHERE o.salary_mid < p.salary_mid) * 100.0 / "
        "(SELECT count(salary_mid) FROM offers), 0.0), 100.0) END")


@query("percentile_rank", _sql(f"""
SELECT profile_id, {_r('pct')} AS percentile,
       CASE WHEN pct >= 90 THEN 'Top 10%' WHEN pct >= 75 THEN 'Top 25%' WHEN pct >= 50 THEN 'Above median'
            WHEN pct >= 25 THEN 'Below median' ELSE 'Bottom 25%' END AS position,
       CASE WHEN pct >= 75 THEN 'excellent' WHEN pct >= 50 THEN 'above average' ELSE 'below median' END AS verdict
FROM (SELECT profile_id, CASE WHEN salary_mid IS NULL THEN NULL ELSE {_PCT} END AS pct FROM profiles p)"""))
def q_percentile_rank(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    pr = K.percentile_rank(prof, C.salary, off, C.salary)
    return finish(pr.select("profile_id", "percentile", K.position_label(F.col("percentile")).alias("position"),
                            K.position_verdict(F.col("percentile")).alias("verdict")))


# --------------------------------------------------------------------- J4, K5
_SCORED = f"scored AS ({rule_scorer_sql('profiles', use_experience=False)})"   # the K5 market rule
_PEERS = """peers AS (
  SELECT p.profile_id, count(o.salary_mid) AS n_peers, median(o.salary_mid) AS peer_median
  FROM profiles p LEFT JOIN offers o ON o.job_type = p.job_type AND o.location = p.location
       AND o.sector = p.sector AND abs(o.experience - p.experience) <= 1.0 AND o.salary_mid IS NOT NULL
  GROUP BY p.profile_id)"""
_EST = f"""est AS (
  SELECT s.profile_id, pe.n_peers, CASE WHEN pe.n_peers >= 3 THEN pe.peer_median + 1000.0 * ({STACK_SQL})
                                        ELSE s.prediction END AS estimate
  FROM scored s JOIN peers pe ON s.profile_id = pe.profile_id)"""


def k5_scorer(off):
    """K5 fallback: job median x city x sector multipliers + 1000 per skill."""
    return RuleScorer(off, C, use_experience=False)


@query("profile_estimate", _sql(f"SELECT profile_id, n_peers, {_r('estimate')} AS estimate FROM est",
                                _SCORED, _PEERS, _EST))
def q_profile_estimate(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    return finish(K.profile_estimate(prof, off, C, k5_scorer(off)))


# --------------------------------------------------------------------- A24, K7, P8
_BAND = """band AS (
  SELECT p.profile_id, count(*) AS n_peers, median(o.salary_min) AS band_min, median(o.salary_max) AS band_max,
         median(o.salary_mid) AS band_median
  FROM profiles p JOIN offers o ON o.job_type = p.job_type AND o.location = p.location
  GROUP BY p.profile_id HAVING count(*) >= 5)"""


@query("peer_band", _sql(f"""
SELECT profile_id, n_peers, {_r('band_min')} AS band_min, {_r('band_max')} AS band_max,
       {_r('band_median')} AS band_median FROM band""", _BAND))
def q_peer_band(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    return finish(K.peer_band(prof, off, C))


@query("negotiation_band", _sql(f"""
SELECT e.profile_id, {_r('greatest(e.estimate - 7417.0, b.band_min)')} AS lower, {_r('e.estimate')} AS target,
       {_r('least(e.estimate + 7417.0, b.band_max)')} AS upper,
       CASE WHEN e.estimate < b.band_min THEN 'below_market' WHEN e.estimate > b.band_max THEN 'above_market'
            ELSE 'in_market' END AS position
FROM est e JOIN band b ON e.profile_id = b.profile_id""", _SCORED, _PEERS, _EST, _BAND))
def q_negotiation_band(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    est = K.profile_estimate(prof, off, C, k5_scorer(off))
    return finish(K.negotiation_band(est, K.peer_band(prof, off, C)))


# --------------------------------------------------------------------- K6
@query("pair_compare", _sql(f"""
SELECT profile_a, profile_b, {_r('salary_a')} AS salary_a, {_r('salary_b')} AS salary_b,
       {_r('salary_b - salary_a')} AS difference,
       CASE WHEN abs(salary_b - salary_a) < 2000 THEN 'equivalent' WHEN salary_b - salary_a > 0 THEN 'b_higher'
            ELSE 'a_higher' END AS verdict
FROM (SELECT e.profile_id AS profile_a, e.estimate AS salary_a,
             lead(e.profile_id) OVER (PARTITION BY p.job_type ORDER BY e.profile_id) AS profile_b,
             lead(e.estimate) OVER (PARTITION BY p.job_type ORDER BY e.profile_id) AS salary_b
      FROM est e JOIN profiles p ON e.profile_id = p.profile_id) WHERE profile_b IS NOT NULL""",
    _SCORED, _PEERS, _EST))
def q_pair_compare(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    est = K.profile_estimate(prof, off, C, k5_scorer(off))
    return finish(K.pair_compare(est, prof, C, C.job))


# --------------------------------------------------------------------- A25, J8, J9
_SKILL_VALUES = ", ".join(f"('{n}', '{c}', {i})" for i, (n, c) in enumerate(SKILLS))
_FLAG_OF = "CASE sk.col " + " ".join(f"WHEN '{c}' THEN {{t}}.{c}" for c in FLAG_COLUMNS) + " END"
_DEMAND = f"""demand AS (
  SELECT job_type AS role, count(*) AS offer_count, sk.skill, avg(CAST({_FLAG_OF.format(t='o')} AS DOUBLE)) AS rate
  FROM offers o, (VALUES {_SKILL_VALUES}) sk(skill, col, idx) WHERE job_type IS NOT NULL
  GROUP BY job_type, sk.skill HAVING count(*) >= 10)"""
_MISS = f"""miss AS (
  SELECT p.profile_id, sk.skill, sk.idx,
         CAST(row_number() OVER (PARTITION BY p.profile_id ORDER BY sk.idx) - 1 AS INTEGER) AS skill_pos
  FROM profiles p, (VALUES {_SKILL_VALUES}) sk(skill, col, idx) WHERE coalesce({_FLAG_OF.format(t='p')}, 0) = 0)"""
_GAPS = """gaps AS (
  SELECT pr.profile_id, pr.role, pr.offer_count, g.skill, g.rate FROM
    (SELECT p.profile_id, r.role, r.offer_count FROM profiles p
       JOIN (SELECT DISTINCT role, offer_count FROM demand) r ON r.role <> p.job_type) pr
  LEFT JOIN (SELECT m.profile_id, d.role, d.skill, d.rate FROM miss m JOIN demand d ON m.skill = d.skill
             WHERE d.rate > 0.3) g ON pr.profile_id = g.profile_id AND pr.role = g.role)"""


@query("role_gap", _sql(f"SELECT profile_id, role, offer_count, skill, {_r('rate')} AS rate FROM gaps",
                        _DEMAND, _MISS, _GAPS))
def q_role_gap(spark, sf_dir):
    off, prof, _ = setup(spark, sf_dir)
    return finish(K.role_gap(prof, off, C, SKILLS))


# --------------------------------------------------------------------- C1, J10, C7
SECTOR_GRID = [{"scenario_id": f"sector:{s}", C.sector: s}
               for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]
CITY_GRID = [{"scenario_id": f"city:{c}", C.city: c}
             for c in ("FRANCE", "GERMANY", "JAPAN", "PERU", "BRAZIL", "CANADA", "INDIA", "KENYA")]
# Experience points, boosted skills in their order, and the four ML/DL combinations.
EXP_POINTS = (0.5, 1, 2, 3, 5, 7, 10, 12, 15, 20)
TARGET_SKILLS = ("machine_learning", "deep_learning", "aws", "spark", "gcp", "azure", "sql")
ML_DL = (("none", 0, 0), ("ml", 1, 0), ("dl", 0, 1), ("both", 1, 1))

EXP_GRID = [{"scenario_id": f"experience:{e}", C.experience: float(e)} for e in EXP_POINTS]
SKILL_GRID = [{"scenario_id": f"skill:{n}", C.skill(n): 1} for n in TARGET_SKILLS if C.skill(n)]
ML_DL_GRID = [{"scenario_id": f"ml_dl:{name}", C.skill("machine_learning"): ml, C.skill("deep_learning"): dl}
              for name, ml, dl in ML_DL]
GRID = SECTOR_GRID + CITY_GRID + EXP_GRID + SKILL_GRID + ML_DL_GRID
GRID_COLUMNS = [C.sector, C.city, C.experience, *FLAG_COLUMNS]
_SCEN = """scen AS (
  SELECT p.profile_id, p.job_type, coalesce(g.city, p.location) AS location, coalesce(g.sector, p.sector) AS sector,
         coalesce(g.exp, p.experience) AS experience, p.f_economy, coalesce(g.f_large, p.f_large) AS f_large,
         coalesce(g.f_medium, p.f_medium) AS f_medium, coalesce(g.f_promo, p.f_promo) AS f_promo,
         coalesce(g.f_small, p.f_small) AS f_small, p.f_standard, coalesce(g.f_deep, p.f_deep) AS f_deep, g.scenario_id
  FROM profiles p, (
    SELECT 'base' AS scenario_id, CAST(NULL AS VARCHAR) AS sector, CAST(NULL AS VARCHAR) AS city, CAST(NULL AS DOUBLE) AS exp,
           CAST(NULL AS INTEGER) AS f_large, CAST(NULL AS INTEGER) AS f_medium, CAST(NULL AS INTEGER) AS f_promo,
           CAST(NULL AS INTEGER) AS f_small, CAST(NULL AS INTEGER) AS f_deep
    UNION ALL SELECT 'sector:' || s, s, NULL, NULL, NULL, NULL, NULL, NULL, NULL
      FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) t(s)
    UNION ALL SELECT 'city:' || c, NULL, c, NULL, NULL, NULL, NULL, NULL, NULL
      FROM (VALUES ('FRANCE'), ('GERMANY'), ('JAPAN'), ('PERU'), ('BRAZIL'), ('CANADA'), ('INDIA'), ('KENYA')) t(c)
    UNION ALL SELECT 'experience:' || e, NULL, NULL, CAST(e AS DOUBLE), NULL, NULL, NULL, NULL, NULL
      FROM (VALUES ('0.5'), ('1'), ('2'), ('3'), ('5'), ('7'), ('10'), ('12'), ('15'), ('20')) t(e)
    UNION ALL VALUES ('skill:machine_learning', NULL, NULL, NULL, NULL, 1, NULL, NULL, NULL),
                     ('skill:deep_learning', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 1),
                     ('skill:aws', NULL, NULL, NULL, NULL, NULL, 1, NULL, NULL),
                     ('skill:spark', NULL, NULL, NULL, NULL, NULL, NULL, 1, NULL),
                     ('skill:sql', NULL, NULL, NULL, 1, NULL, NULL, NULL, NULL),
                     ('ml_dl:none', NULL, NULL, NULL, NULL, 0, NULL, NULL, 0),
                     ('ml_dl:ml', NULL, NULL, NULL, NULL, 1, NULL, NULL, 0),
                     ('ml_dl:dl', NULL, NULL, NULL, NULL, 0, NULL, NULL, 1),
                     ('ml_dl:both', NULL, NULL, NULL, NULL, 1, NULL, NULL, 1)) g)"""
_SCEN_SCORED = f"""ss AS (
  SELECT *, prediction - max(CASE WHEN scenario_id = 'base' THEN prediction END) OVER (PARTITION BY profile_id) AS delta,
         max(CASE WHEN scenario_id = 'base' THEN prediction END) OVER (PARTITION BY profile_id) AS base_prediction
  FROM ({rule_scorer_sql('scen')}))"""


def _scenario_scores(spark, sf_dir):
    _, prof, scorer = setup(spark, sf_dir)
    return S.scenario_scores(prof, scorer, GRID, GRID_COLUMNS)


@query("scenario_scores", _sql(f"""
SELECT profile_id, scenario_id, {_r('prediction')} AS prediction, {_r('delta')} AS delta FROM ss""",
                               _SCEN, _SCEN_SCORED))
def q_scenario_scores(spark, sf_dir):
    return finish(_scenario_scores(spark, sf_dir).select("profile_id", "scenario_id", "prediction", "delta"))


@query("scenario_insights", _sql(f"""
SELECT profile_id, arg_max(scenario_id, (prediction, scenario_id)) AS best_scenario,
       arg_min(scenario_id, (prediction, scenario_id)) AS worst_scenario,
       {_r('max(prediction) - min(prediction)')} AS spread, {_r('max(prediction) - max(base_prediction)')} AS best_gain,
       CASE WHEN max(prediction) - max(base_prediction) > 2000 THEN 'strong'
            WHEN max(prediction) - max(base_prediction) > 1000 THEN 'moderate' ELSE 'weak' END AS label
FROM ss WHERE scenario_id <> 'base' GROUP BY profile_id""", _SCEN, _SCEN_SCORED))
def q_scenario_insights(spark, sf_dir):
    return finish(S.scenario_insights(_scenario_scores(spark, sf_dir)))


def _interp_sql(pts: str, x: str) -> str:
    i = f"len(list_filter({pts}, lambda t: t.e <= {x}))"
    lo = f"{pts}[greatest({i}, 1)]"
    hi = f"{pts}[least({i} + 1, len({pts}))]"
    return (f"CASE WHEN {i} = 0 THEN {pts}[1].p WHEN {i} >= len({pts}) THEN {pts}[-1].p "
            f"ELSE ({hi}.p - {lo}.p) / ({hi}.e - {lo}.e) * ({x} - {lo}.e) + {lo}.p END")


@query("experience_insights", _sql(f"""
SELECT profile_id, {_r('pts[-1].p - pts[1].p')} AS total_growth,
       {_r('CASE WHEN pts[-1].e - pts[1].e > 0 THEN (pts[-1].p - pts[1].p) / (pts[-1].e - pts[1].e) ELSE 0.0 END')} AS avg_annual_growth,
       {_r('least(cur + 5, pts[-1].e)')} AS future_experience,
       {_r(_interp_sql('pts', 'least(cur + 5, pts[-1].e)'))} AS future_salary,
       {_r(_interp_sql('pts', 'least(cur + 5, pts[-1].e)') + ' - ' + _interp_sql('pts', 'cur'))} AS five_year_growth
FROM (SELECT s.profile_id, list_sort(list({{'e': CAST(s.experience AS DOUBLE), 'p': s.prediction}})) AS pts,
             max(CAST(p.experience AS DOUBLE)) AS cur
      FROM ss s JOIN profiles p ON s.profile_id = p.profile_id
      WHERE starts_with(s.scenario_id, 'experience:') GROUP BY s.profile_id)
WHERE cur IS NOT NULL""", _SCEN, _SCEN_SCORED))
def q_experience_insights(spark, sf_dir):
    _, prof, _ = setup(spark, sf_dir)
    return finish(S.experience_insights(_scenario_scores(spark, sf_dir), prof, C.experience))


# --------------------------------------------------------------------- C2, C3, C4, A26
_SET_FLAGS = ", ".join(f"CASE WHEN m.skill = '{n}' THEN 1 ELSE p.{c} END AS {c}" for n, c in SKILLS)
_ROAD = f"""mod AS (
  SELECT p.profile_id, p.job_type, p.location, p.sector, p.experience, {_SET_FLAGS}, m.skill, m.skill_pos
  FROM profiles p JOIN miss m ON p.profile_id = m.profile_id),
base AS (SELECT profile_id, prediction AS base_prediction FROM ({rule_scorer_sql('profiles')})),
freq AS ({' UNION ALL '.join(f"SELECT '{n}' AS skill, avg(CAST({c} AS DOUBLE)) AS frequency FROM offers" for n, c in SKILLS)}),
road AS (
  SELECT s.profile_id, s.skill, s.skill_pos, s.prediction - b.base_prediction AS gain, f.frequency,
         (s.prediction - b.base_prediction) / (1 - f.frequency + 0.01) AS roi, (1 - f.frequency) * 100 AS rarity
  FROM ({rule_scorer_sql('mod')}) s JOIN base b ON s.profile_id = b.profile_id JOIN freq f ON s.skill = f.skill)"""
_MONTHS_VALUES = ", ".join(f"('{k}', {v})" for k, v in S.ROADMAP_MONTHS.items())
_EFFORT = f"""eff AS (
  SELECT r.profile_id, r.skill, m.months AS effort, r.gain AS impact, r.gain / m.months AS roi_per_month,
         CASE WHEN m.months <= 6 AND r.gain >= 3000 THEN 'Quick Win' WHEN m.months > 9 THEN 'Investissement'
              ELSE 'Équilibré' END AS category
  FROM road r JOIN (VALUES {_MONTHS_VALUES}) m(skill, months) ON r.skill = m.skill)"""


def _roadmap(spark, sf_dir):
    off, prof, scorer = setup(spark, sf_dir)
    return S.skill_roadmap(prof, off, scorer, SKILLS)


@query("skill_roadmap", _sql(f"""
SELECT profile_id, skill, CAST(skill_pos AS BIGINT) AS skill_pos, {_r('gain')} AS gain, {_r('frequency')} AS frequency, {_r('roi')} AS roi,
       {_r('rarity')} AS rarity FROM road""", _DEMAND, _MISS, _ROAD))
def q_skill_roadmap(spark, sf_dir):
    return finish(_roadmap(spark, sf_dir))


@query("best_effort", _sql(f"""
SELECT profile_id, skill, CAST(effort AS BIGINT) AS effort, {_r('impact')} AS impact,
       {_r('roi_per_month')} AS roi_per_month, category FROM eff
QUALIFY row_number() OVER (PARTITION BY profile_id ORDER BY roi_per_month DESC, skill) = 1""", _DEMAND, _MISS, _ROAD, _EFFORT))
def q_best_effort(spark, sf_dir):
    return finish(S.best_effort(S.effort_impact(_roadmap(spark, sf_dir))))


@query("effort_impact", _sql(f"""
SELECT profile_id, skill, CAST(effort AS BIGINT) AS effort, {_r('impact')} AS impact,
       {_r('roi_per_month')} AS roi_per_month, category FROM eff""", _DEMAND, _MISS, _ROAD, _EFFORT))
def q_effort_impact(spark, sf_dir):
    return finish(S.effort_impact(_roadmap(spark, sf_dir)))


@query("effort_impact_medians", _sql(f"""
SELECT profile_id, {_r('median(effort)')} AS median_effort, {_r('median(impact)')} AS median_impact
FROM eff GROUP BY profile_id""", _DEMAND, _MISS, _ROAD, _EFFORT))
def q_effort_impact_medians(spark, sf_dir):
    return finish(S.effort_impact_medians(S.effort_impact(_roadmap(spark, sf_dir))))


@query("best_single_skill", _sql(f"""
SELECT profile_id, {_r('greatest(max(gain), 0.0)')} AS best_gain FROM road WHERE skill_pos < 3 GROUP BY profile_id""",
                                 _DEMAND, _MISS, _ROAD))
def q_best_single_skill(spark, sf_dir):
    return finish(S.best_single_skill(_roadmap(spark, sf_dir), 3))


# --------------------------------------------------------------------- C5
_TRANS = f"""asrole AS (
  SELECT g.profile_id, g.role AS job_type, p.location, p.sector, p.experience, {', '.join('p.' + c for c in FLAG_COLUMNS)},
         g.offer_count, g.learning_months, g.missing_skills
  FROM (SELECT profile_id, role, offer_count,
               sum(CASE WHEN skill IS NULL THEN 0 ELSE coalesce(m.months, 6) END) AS learning_months,
               coalesce(array_to_string(list_sort(list(skill) FILTER (WHERE skill IS NOT NULL)), ','), '') AS missing_skills
        FROM gaps LEFT JOIN (VALUES {_MONTHS_VALUES}) m(sk, months) ON gaps.skill = m.sk
        GROUP BY profile_id, role, offer_count) g JOIN profiles p ON g.profile_id = p.profile_id),
trans AS (
  SELECT s.profile_id, s.job_type AS role, s.offer_count, s.prediction AS salary,
         s.prediction - b.prediction AS gain, s.missing_skills, s.learning_months,
         CASE WHEN s.learning_months > 0 THEN (s.prediction - b.prediction) / s.learning_months ELSE 0.0 END AS roi_per_month
  FROM ({rule_scorer_sql('asrole')}) s JOIN ({rule_scorer_sql('profiles')}) b ON s.profile_id = b.profile_id)"""


@query("role_transitions", _sql(f"""
SELECT profile_id, role, offer_count, {_r('salary')} AS salary, {_r('gain')} AS gain, missing_skills,
       CAST(learning_months AS BIGINT) AS learning_months, {_r('roi_per_month')} AS roi_per_month,
       CAST(rank AS BIGINT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY gain DESC, role) AS rank FROM trans)
WHERE rank <= 3""", _DEMAND, _MISS, _GAPS, _TRANS))
def q_role_transitions(spark, sf_dir):
    off, prof, scorer = setup(spark, sf_dir)
    gaps = K.role_gap(prof, off, C, SKILLS)
    out = S.role_transitions(prof, gaps, scorer, C)
    return finish(out.withColumn("missing_skills", F.when(F.col("missing_skills") == "", F.lit(""))
                                 .otherwise(F.col("missing_skills"))))


# --------------------------------------------------------------------- C6
def _proj_flags_sql() -> str:
    out = []
    for i, c in enumerate(FLAG_COLUMNS):
        before = " + ".join([f"(1 - p.{FLAG_COLUMNS[j]})" for j in range(i)]) or "0"
        out.append(f"CASE WHEN y.strategy = 'full_stack' OR (y.strategy = 'progressive' AND p.{c} = 0 "
                   f"AND ({before}) < floor(y.year / 2)) THEN 1 ELSE p.{c} END AS {c}")
    return ", ".join(out)


_YEAR_VALUES = ", ".join(f"({y})" for y in S.PROJECTION_YEARS)
_PROJ = f"""proj AS (
  SELECT p.profile_id, p.job_type, p.location, p.sector, p.experience + y.year AS experience,
         {_proj_flags_sql()}, y.year, y.strategy
  FROM profiles p, (SELECT * FROM (VALUES {_YEAR_VALUES}) yy(year),
                    (VALUES ('experience_only'), ('progressive'), ('full_stack')) st(strategy)) y)"""


@query("projection", _sql(f"""
SELECT profile_id, CAST(year AS BIGINT) AS year, strategy, {_r('experience')} AS experience,
       {_r('prediction')} AS prediction FROM ({rule_scorer_sql('proj')})""", _PROJ))
def q_projection(spark, sf_dir):
    _, prof, scorer = setup(spark, sf_dir)
    return finish(S.projection(prof, scorer, C, SKILLS))


# --------------------------------------------------------------------- C8
_TARGETS = [(n, C.skill(n)) for n in TARGET_SKILLS if C.skill(n)]
_FIRST = """fs AS (
  SELECT profile_id, job_type, location, sector, experience, f_economy, f_standard,
         CASE WHEN skill = 'sql' THEN 1 ELSE f_large END AS f_large,
         CASE WHEN skill = 'machine_learning' THEN 1 ELSE f_medium END AS f_medium,
         CASE WHEN skill = 'aws' THEN 1 ELSE f_promo END AS f_promo,
         CASE WHEN skill = 'spark' THEN 1 ELSE f_small END AS f_small,
         CASE WHEN skill = 'deep_learning' THEN 1 ELSE f_deep END AS f_deep, skill
  FROM (SELECT *, CASE WHEN f_medium = 0 THEN 'machine_learning' WHEN f_deep = 0 THEN 'deep_learning'
                       WHEN f_promo = 0 THEN 'aws' WHEN f_small = 0 THEN 'spark' WHEN f_large = 0 THEN 'sql' END AS skill
        FROM profiles) WHERE skill IS NOT NULL)"""


@query("first_skill_boost", _sql(f"""
SELECT s.profile_id, s.skill, {_r('s.prediction')} AS prediction, {_r('s.prediction - b.prediction')} AS boost
FROM ({rule_scorer_sql('fs')}) s JOIN ({rule_scorer_sql('profiles')}) b ON s.profile_id = b.profile_id""",
    _FIRST))
def q_first_skill_boost(spark, sf_dir):
    _, prof, scorer = setup(spark, sf_dir)
    return finish(S.first_skill_boost(prof, scorer, _TARGETS))


# --------------------------------------------------------------------- J2, J3
_RANGE_BIN = "CASE " + " ".join(f"WHEN {{e}} >= {lo} AND {{e}} < {hi} THEN '{lo}-{hi}'"
                                for lo, hi in ((0, 1), (1, 3), (3, 5), (5, 8), (8, 12), (12, 30))) + " END"
_RANGES = f"""jr AS (SELECT job_type, CAST(trunc(quantile_cont(salary_mid, 0.25)) AS BIGINT) AS lo,
                    CAST(trunc(quantile_cont(salary_mid, 0.75)) AS BIGINT) AS hi
             FROM offers WHERE salary_mid IS NOT NULL AND job_type IS NOT NULL GROUP BY job_type HAVING count(*) >= 10),
er AS (SELECT b, CAST(trunc(quantile_cont(salary_mid, 0.25)) AS BIGINT) AS lo,
              CAST(trunc(quantile_cont(salary_mid, 0.75)) AS BIGINT) AS hi
       FROM (SELECT salary_mid, {_RANGE_BIN.format(e='experience')} AS b FROM offers WHERE salary_mid IS NOT NULL)
       WHERE b IS NOT NULL GROUP BY b HAVING count(*) >= 10)"""


@query("profile_ranges", _sql(f"""
SELECT p.profile_id, coalesce(jr.lo, 35000) AS job_low, coalesce(jr.hi, 60000) AS job_high,
       coalesce(er.lo, (SELECT max(lo) FROM er WHERE b = '12-30'), 60000) AS exp_low,
       coalesce(er.hi, (SELECT max(hi) FROM er WHERE b = '12-30'), 90000) AS exp_high
FROM profiles p LEFT JOIN jr ON p.job_type = jr.job_type
LEFT JOIN er ON {_RANGE_BIN.format(e='p.experience')} = er.b""", _RANGES))
def q_profile_ranges(spark, sf_dir):
    from offerlake.operators import market as A
    off, prof, _ = setup(spark, sf_dir)
    jobs = A.group_iqr_range(off, C.job, C.salary, 10)
    exps = A.experience_range(off, C.experience, C.salary, 10)
    return finish(K.profile_ranges(prof, jobs, exps, C))


# --------------------------------------------------------------------- Q4
@query("profile_warnings", _sql("""
SELECT profile_id, array_to_string(CASE WHEN len(w) = 0 THEN ['standard'] ELSE w END, ',') AS warnings FROM (
  SELECT profile_id, list_filter([CASE WHEN contract <> 'O' THEN 'non_cdi' END,
                                  CASE WHEN f_medium = 1 AND f_deep = 1 THEN 'ml_and_dl' END,
                                  CASE WHEN experience < 0.5 THEN 'very_junior' END,
                                  CASE WHEN experience >= 15 THEN 'very_senior' END,
                                  CASE WHEN sector = 'Non spécifié' THEN 'sector_unspecified' END],
                                 lambda x: x IS NOT NULL) AS w FROM profiles)"""))
def q_profile_warnings(spark, sf_dir):
    from offerlake.operators.quality import profile_warnings
    _, prof, _ = setup(spark, sf_dir)
    # proxy binding: the open-ended contract is 'O'
    ml, dl = (F.coalesce(F.col(C.skill(n)).cast("boolean"), F.lit(False)) for n in ("machine_learning", "deep_learning"))
    out = profile_warnings(prof, C.contract, ml, dl, C.experience, C.sector, cdi_value="O")
    return out.select("profile_id", F.array_join("warnings", ",").alias("warnings"))


# --------------------------------------------------------------------- F23, K6 axes
@query("profile_summary", _sql(f"""
SELECT profile_id, concat_ws(' | ', job_type, sen, location, sector, printf('%.1f', experience) || ' ans',
                             CAST(sk AS VARCHAR) || ' compétences', 'score ' || CAST(least(ts, 15) AS VARCHAR)) AS summary
FROM (SELECT *, CASE WHEN experience IS NULL THEN NULL WHEN experience < 1 THEN 'Stage/Alternance'
                     WHEN experience <= 3 THEN 'Junior (1-3 ans)' WHEN experience <= 5 THEN 'Mid-level'
                     WHEN experience <= 8 THEN 'Senior (5-8 ans)' ELSE 'Expert (8-12 ans)' END AS sen,
             {STACK_SQL} AS sk,
             {' + '.join(f"{c} * {w}" for c, w in ((C.skill(n), w) for n, w in (('python', 2), ('sql', 2), ('machine_learning', 2), ('aws', 1), ('spark', 1), ('tableau', 1), ('deep_learning', 2))))} AS ts
      FROM profiles)"""))
def q_profile_summary(spark, sf_dir):
    from offerlake.functions import features as FT
    _, prof, _ = setup(spark, sf_dir)
    x = prof.withColumns({f"contient_{n}": F.col(c) for n, c in SKILLS})
    tech = FT.technical_score(x)
    sk = FT.skills_count(x)
    sen = FT.seniority_from_experience(F.col(C.experience))
    return x.select("profile_id", FT.profile_summary(F.col(C.job), sen, F.col(C.city), F.col(C.sector),
                                                     F.col(C.experience), sk, tech).alias("summary"))


@query("profile_axes", _sql(f"""
SELECT p.profile_id, {_r('p.experience / 15 * 100')} AS axis_experience,
       {_r('coalesce(cm.m / g.g, 1.0) * 100')} AS axis_city, {_r('coalesce(sm.m / g.g, 1.0) * 100')} AS axis_sector,
       {_r(f'({STACK_SQL}) / 8 * 100')} AS axis_skills
FROM profiles p
CROSS JOIN (SELECT median(salary_mid) AS g FROM offers WHERE salary_mid IS NOT NULL) g
LEFT JOIN (SELECT location AS k, median(salary_mid) AS m FROM offers WHERE salary_mid IS NOT NULL GROUP BY 1) cm ON p.location = cm.k
LEFT JOIN (SELECT sector AS k, median(salary_mid) AS m FROM offers WHERE salary_mid IS NOT NULL GROUP BY 1) sm ON p.sector = sm.k"""))
def q_profile_axes(spark, sf_dir):
    from offerlake.operators.market import group_multiplier
    off, prof, _ = setup(spark, sf_dir)
    return finish(K.profile_axes(prof, group_multiplier(off, C.city, C.salary),
                                 group_multiplier(off, C.sector, C.salary), C, list(FLAG_COLUMNS)))
