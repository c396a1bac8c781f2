"""Driver queries for market aggregates, filters and quality jobs over the offers view."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from offerlake.operators import filters as P
from offerlake.operators import market as A
from offerlake.operators import quality as Q
from offerlake.plans.registry import finish, query, with_offers
from offerlake.sources.offers import FLAG_COLUMNS, OFFER_COLUMNS as C, offers_table
from offerlake.sources.tables import read_table, table_path

SKILLS_SUM_SQL = "(" + " + ".join(FLAG_COLUMNS) + ")"


def offers(spark, sf_dir):
    """The offers table (with skills_count), written once per application."""
    return offers_table(spark, sf_dir)


def skill_pairs():
    return list(C.skills)


def _r(x: str) -> str:
    return f"round({x}, 4)"


# ----------------------------------------------------------------- A4 / J1
def _mult_sql(g: str) -> str:
    return with_offers(f"""
SELECT {g}, {_r('median(salary_mid)')} AS group_median,
       {_r(f'median(salary_mid) / (SELECT median(salary_mid) FROM offers WHERE salary_mid IS NOT NULL)')} AS multiplier
FROM offers WHERE salary_mid IS NOT NULL AND {g} IS NOT NULL GROUP BY {g}""")


@query("group_multiplier_city", _mult_sql("location"))
def q_group_multiplier_city(spark, sf_dir):
    return finish(A.group_multiplier(offers(spark, sf_dir), C.city, C.salary))


@query("group_multiplier_sector", _mult_sql("sector"))
def q_group_multiplier_sector(spark, sf_dir):
    return finish(A.group_multiplier(offers(spark, sf_dir), C.sector, C.salary))


# ----------------------------------------------------------------- A5 / J2
@query("group_iqr_range", with_offers("""
SELECT job_type, CAST(trunc(quantile_cont(salary_mid, 0.25)) AS BIGINT) AS p25,
       CAST(trunc(quantile_cont(salary_mid, 0.75)) AS BIGINT) AS p75, count(*) AS n
FROM offers WHERE salary_mid IS NOT NULL AND job_type IS NOT NULL
GROUP BY job_type HAVING count(*) >= 10"""))
def q_group_iqr_range(spark, sf_dir):
    return finish(A.group_iqr_range(offers(spark, sf_dir), C.job, C.salary, 10))


# ----------------------------------------------------------------- A6 / J3
_RANGE_CASE = "CASE " + " ".join(
    f"WHEN experience >= {lo} AND experience < {hi} THEN '{lo}-{hi}'"
    for lo, hi in A.EXPERIENCE_RANGE_BINS) + " END"


@query("experience_range", with_offers(f"""
SELECT exp_bin, CAST(trunc(quantile_cont(salary_mid, 0.25)) AS BIGINT) AS p25,
       CAST(trunc(quantile_cont(salary_mid, 0.75)) AS BIGINT) AS p75, count(*) AS n
FROM (SELECT salary_mid, {_RANGE_CASE} AS exp_bin FROM offers WHERE salary_mid IS NOT NULL)
WHERE exp_bin IS NOT NULL GROUP BY exp_bin HAVING count(*) >= 10"""))
def q_experience_range(spark, sf_dir):
    return finish(A.experience_range(offers(spark, sf_dir), C.experience, C.salary, 10))


# ----------------------------------------------------------------- A1
@query("salary_summary", with_offers(f"""
SELECT {_r('avg(salary_mid)')} AS mean, {_r('median(salary_mid)')} AS median,
       {_r('stddev_pop(salary_mid)')} AS std, {_r('quantile_cont(salary_mid, 0.25)')} AS q1,
       {_r('quantile_cont(salary_mid, 0.75)')} AS q3,
       {_r('quantile_cont(salary_mid, 0.75) - quantile_cont(salary_mid, 0.25)')} AS iqr,
       {_r('min(salary_mid)')} AS min, {_r('max(salary_mid)')} AS max, count(salary_mid) AS count
FROM offers"""))
def q_salary_summary(spark, sf_dir):
    return finish(A.salary_summary(offers(spark, sf_dir), C.salary))


# ----------------------------------------------------------------- A2 / P5
KPI_FILTER = P.MarketFilter(jobs=["AUTOMOBILE", "BUILDING", "MACHINERY"],
                            sectors=["1-URGENT", "2-HIGH", "3-MEDIUM"],
                            salary_range=(50000, 400000), experience_range=(0, 40), stacks=["SQL"])
_KPI_WHERE = ("job_type IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY') "
              "AND sector IN ('1-URGENT', '2-HIGH', '3-MEDIUM') "
              "AND salary_mid BETWEEN 50000 AND 400000 AND experience BETWEEN 0 AND 40 AND f_large = 1")


def filtered_offers(spark, sf_dir):
    off = offers(spark, sf_dir)
    return off, KPI_FILTER.apply(off, C, P.tech_stack_predicates(off, C.skill))


@query("market_kpis", with_offers(f"""
SELECT (SELECT count(*) FROM f) AS n_offers,
       {_r('(SELECT count(*) FROM f) * 100.0 / (SELECT count(*) FROM offers)')} AS pct_of_total,
       {_r('median(salary_mid)')} AS median_salary,
       {_r('median(salary_mid) - (SELECT median(salary_mid) FROM offers)')} AS median_delta,
       {_r('avg(salary_mid)')} AS mean_salary, {_r(f'avg({SKILLS_SUM_SQL})')} AS mean_skills,
       {_r('avg(CASE WHEN telework > 0 THEN 1.0 ELSE 0.0 END) * 100')} AS telework_pct, CAST(5 AS BIGINT) AS active_filters
FROM f""", extra=f"f AS (SELECT * FROM offers WHERE {_KPI_WHERE})"))
def q_market_kpis(spark, sf_dir):
    off, filt = filtered_offers(spark, sf_dir)
    return finish(A.market_kpis(filt, off, C.salary, "skills_count", C.telework).withColumn(
        "active_filters", F.lit(KPI_FILTER.active_count())))


@query("compound_filter", with_offers(f"""
SELECT offer_id, job_type, location, sector, {_r('salary_mid')} AS salary_mid, {_r('experience')} AS experience
FROM offers WHERE {_KPI_WHERE}"""))
def q_compound_filter(spark, sf_dir):
    _, filt = filtered_offers(spark, sf_dir)
    return finish(filt.select(C.id, C.job, C.city, C.sector, C.salary, C.experience))


# ----------------------------------------------------------------- P6
@query("filter_options", with_offers("""
SELECT 'job' AS field, job_type AS option FROM offers WHERE job_type IS NOT NULL GROUP BY job_type
UNION ALL SELECT 'city', location FROM offers WHERE location IS NOT NULL GROUP BY location
UNION ALL SELECT 'sector', sector FROM offers WHERE sector IS NOT NULL GROUP BY sector"""))
def q_filter_options(spark, sf_dir):
    off = offers(spark, sf_dir)
    parts = [P.filter_options(off, c).select(F.lit(f).alias("field"), F.col(c).alias("option"))
             for f, c in (("job", C.job), ("city", C.city), ("sector", C.sector))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("filter_bounds", with_offers(f"""
SELECT {_r('min(salary_mid)')} AS salary_min, {_r('max(salary_mid)')} AS salary_max,
       {_r('min(experience)')} AS experience_min, {_r('max(experience)')} AS experience_max FROM offers"""))
def q_filter_bounds(spark, sf_dir):
    off = offers(spark, sf_dir)
    s = P.numeric_bounds(off, C.salary).select(F.col("min").alias("salary_min"), F.col("max").alias("salary_max"))
    e = P.numeric_bounds(off, C.experience)
    return finish(s.select("*", e.select("min").scalar().alias("experience_min"),
                           e.select("max").scalar().alias("experience_max")))


# ----------------------------------------------------------------- S2-S4, P1, P7
@query("market_load", with_offers(f"""
SELECT offer_id, job_type, coalesce(location, 'Non spécifié') AS location,
       coalesce(sector, 'Non spécifié') AS sector, {_r('salary_mid')} AS salary_mid,
       {_r('experience')} AS experience, CAST({SKILLS_SUM_SQL} AS BIGINT) AS skills_count
FROM offers WHERE (job_type IS NOT NULL OR salary_mid IS NOT NULL)
  AND job_type <> 'HOUSEHOLD' AND salary_mid IS NOT NULL"""))
def q_market_load(spark, sf_dir):
    off = P.drop_columns(offers(spark, sf_dir), ["contract", "posted_at"])
    loaded = P.market_load(off, C.job, C.salary, C.city, C.sector)
    # P7 model rows: the "data job" flag of the proxy is job != HOUSEHOLD
    rows = P.model_rows(loaded, F.col(C.job) != "HOUSEHOLD", C.salary)
    return finish(rows.select(C.id, C.job, C.city, C.sector, C.salary, C.experience, "skills_count"))


# ----------------------------------------------------------------- A23
@query("market_quantiles", with_offers(f"""
SELECT {_r('median(salary_mid)')} AS median, {_r('quantile_cont(salary_mid, 0.25)')} AS q1,
       {_r('quantile_cont(salary_mid, 0.75)')} AS q3,
       {_r('greatest(quantile_cont(salary_mid, 0.01), 0.0)')} AS p1,
       {_r('quantile_cont(salary_mid, 0.99)')} AS p99 FROM offers"""))
def q_market_quantiles(spark, sf_dir):
    return finish(A.market_quantiles(offers(spark, sf_dir), C.salary))


# ----------------------------------------------------------------- A29
@query("dataset_averages", with_offers(f"""
SELECT {_r('avg(experience)')} AS mean_experience, {_r(f'avg({SKILLS_SUM_SQL})')} AS mean_skills FROM offers"""))
def q_dataset_averages(spark, sf_dir):
    return finish(A.dataset_averages(offers(spark, sf_dir), C.experience, "skills_count"))


# ----------------------------------------------------------------- A7
_BAND_CASE = ("CASE WHEN experience >= 0 AND experience <= 1 THEN '<1 an' "
              + " ".join(f"WHEN experience > {A.EXPERIENCE_BAND_EDGES[i]} AND experience <= "
                         f"{A.EXPERIENCE_BAND_EDGES[i + 1]} THEN '{A.EXPERIENCE_BAND_LABELS[i]}'"
                         for i in range(1, len(A.EXPERIENCE_BAND_LABELS))) + " END")


@query("experience_band_stats", with_offers(f"""
SELECT exp_band, {_r('median(salary_mid)')} AS median, {_r('avg(salary_mid)')} AS mean,
       count(salary_mid) AS count
FROM (SELECT salary_mid, {_BAND_CASE} AS exp_band FROM offers) WHERE exp_band IS NOT NULL GROUP BY exp_band"""))
def q_experience_band_stats(spark, sf_dir):
    return finish(A.experience_band_stats(offers(spark, sf_dir), C.experience, C.salary))


# ----------------------------------------------------------------- A8
@query("city_stats", with_offers(f"""
SELECT location, {_r('median(salary_mid)')} AS median, {_r('avg(salary_mid)')} AS mean,
       count(salary_mid) AS count
FROM offers WHERE location IS NOT NULL GROUP BY location HAVING count(salary_mid) >= 3"""))
def q_city_stats(spark, sf_dir):
    return finish(A.city_stats(offers(spark, sf_dir), C.city, C.salary, 3))


# ----------------------------------------------------------------- A9 / T1
def _best_sql(dim, col):
    return f"""SELECT dimension, group_value, median, count FROM (
  SELECT '{dim}' AS dimension, {col} AS group_value, {_r('median(salary_mid)')} AS median,
         count(salary_mid) AS count,
         row_number() OVER (ORDER BY median(salary_mid) DESC, {col}) AS rk
  FROM offers WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(salary_mid) >= 5) WHERE rk <= 3"""


@query("best_groups", with_offers(_best_sql("city", "location") + "\nUNION ALL\n" + _best_sql("sector", "sector")))
def q_best_groups(spark, sf_dir):
    off = offers(spark, sf_dir)
    parts = [A.best_groups(off, c, C.salary, 5, 3).select(
        F.lit(d).alias("dimension"), F.col(c).alias("group_value"), "median", "count")
        for d, c in (("city", C.city), ("sector", C.sector))]
    return finish(parts[0].unionByName(parts[1]))


# ----------------------------------------------------------------- A3 / A19 / J7
@query("top_groups", with_offers(f"""
SELECT location, count(*) AS n, {_r('avg(salary_mid)')} AS mean_salary FROM offers
WHERE location IS NOT NULL GROUP BY location ORDER BY n DESC, location LIMIT 10"""))
def q_top_groups(spark, sf_dir):
    return finish(A.top_groups(offers(spark, sf_dir), C.city, C.salary, 10))


@query("most_frequent_groups", with_offers("""
SELECT sector, count(*) AS n FROM offers WHERE sector IS NOT NULL GROUP BY sector ORDER BY n DESC, sector LIMIT 3"""))
def q_most_frequent_groups(spark, sf_dir):
    return finish(A.top_groups(offers(spark, sf_dir), C.sector, C.salary, 3).drop("mean_salary"))


# ----------------------------------------------------------------- A31
@query("multiplier_class", with_offers(f"""
SELECT cs.location, {_r('cs.median')} AS median, {_r('coalesce(m.multiplier, 1.0)')} AS multiplier,
       CASE WHEN coalesce(m.multiplier, 1.0) >= 1.1 THEN 'high'
            WHEN coalesce(m.multiplier, 1.0) >= 1.0 THEN 'neutral' ELSE 'low' END AS class
FROM cs LEFT JOIN mult m ON cs.location = m.location""", extra="""
cs AS (SELECT location, median(salary_mid) AS median FROM offers WHERE location IS NOT NULL
       GROUP BY location HAVING count(salary_mid) >= 3 ORDER BY median DESC, location LIMIT 10),
mult AS (SELECT location, median(salary_mid) / (SELECT median(salary_mid) FROM offers WHERE salary_mid IS NOT NULL) AS multiplier
         FROM offers WHERE salary_mid IS NOT NULL AND location IS NOT NULL GROUP BY location)"""))
def q_multiplier_class(spark, sf_dir):
    return finish(A.multiplier_class(offers(spark, sf_dir), C.city, C.salary, 10))


# ----------------------------------------------------------------- A10 / J6
@query("city_sector_pivot", with_offers(f"""
SELECT location, sector, {_r('median(salary_mid)')} AS median FROM kept
WHERE salary_mid IS NOT NULL AND (SELECT count(*) FROM kept) >= 20 GROUP BY location, sector""", extra="""
tc AS (SELECT location FROM offers WHERE location IS NOT NULL GROUP BY location
       HAVING count(salary_mid) >= 3 ORDER BY median(salary_mid) DESC, location LIMIT 10),
ts AS (SELECT sector FROM offers WHERE sector IS NOT NULL GROUP BY sector ORDER BY count(*) DESC, sector LIMIT 8),
kept AS (SELECT * FROM offers WHERE location IN (SELECT location FROM tc) AND sector IN (SELECT sector FROM ts))"""))
def q_city_sector_pivot(spark, sf_dir):
    return finish(A.city_sector_pivot(offers(spark, sf_dir), C.city, C.sector, C.salary))


@query("city_sector_wide", with_offers(f"""
SELECT location, {_r("median(salary_mid) FILTER (WHERE sector = '1-URGENT')")} AS "1-URGENT",
       {_r("median(salary_mid) FILTER (WHERE sector = '2-HIGH')")} AS "2-HIGH",
       {_r("median(salary_mid) FILTER (WHERE sector = '5-LOW')")} AS "5-LOW" FROM offers
WHERE location IN (SELECT location FROM offers WHERE location IS NOT NULL GROUP BY location HAVING count(salary_mid) >= 3
                   ORDER BY median(salary_mid) DESC, location LIMIT 10)
GROUP BY location"""))
def q_city_sector_wide(spark, sf_dir):
    """A10 as the pivot table that the page shows."""
    return finish(A.city_sector_pivot(offers(spark, sf_dir), C.city, C.sector, C.salary,
                                      wide=["1-URGENT", "2-HIGH", "5-LOW"]))


# ----------------------------------------------------------------- A22
@query("boxplot_stats", with_offers(f"""
SELECT q.job_type, {_r('min(o.salary_mid)')} AS min, {_r('q.q1')} AS q1, {_r('q.med')} AS median,
       {_r('q.q3')} AS q3, {_r('max(o.salary_mid)')} AS max,
       {_r('min(CASE WHEN o.salary_mid >= q.q1 - 1.5 * (q.q3 - q.q1) THEN o.salary_mid END)')} AS lower_whisker,
       {_r('max(CASE WHEN o.salary_mid <= q.q3 + 1.5 * (q.q3 - q.q1) THEN o.salary_mid END)')} AS upper_whisker,
       CAST(sum(CASE WHEN o.salary_mid < q.q1 - 1.5 * (q.q3 - q.q1) OR o.salary_mid > q.q3 + 1.5 * (q.q3 - q.q1)
                THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers,
       q.n AS n
FROM offers o JOIN q ON o.job_type = q.job_type WHERE o.salary_mid IS NOT NULL
GROUP BY q.job_type, q.q1, q.med, q.q3, q.n""", extra="""
q AS (SELECT job_type, quantile_cont(salary_mid, 0.25) AS q1, median(salary_mid) AS med,
             quantile_cont(salary_mid, 0.75) AS q3, count(*) AS n
      FROM offers WHERE salary_mid IS NOT NULL AND job_type IS NOT NULL GROUP BY job_type)"""))
def q_boxplot_stats(spark, sf_dir):
    return finish(A.boxplot_stats(offers(spark, sf_dir), C.job, C.salary))


# ----------------------------------------------------------------- A21
@query("salary_histogram", with_offers(f"""
SELECT CAST(r.bin AS BIGINT) AS bin, {_r('b.lo + r.bin * ((b.hi - b.lo) / 25)')} AS lower,
       {_r('b.lo + (r.bin + 1) * ((b.hi - b.lo) / 25)')} AS upper, coalesce(c.n, 0) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(25)) r CROSS JOIN b LEFT JOIN c ON r.bin = c.bin""", extra="""
b AS (SELECT min(salary_mid) AS lo, max(salary_mid) AS hi FROM offers WHERE salary_mid IS NOT NULL),
c AS (SELECT CAST(least(floor((salary_mid - b.lo) / ((b.hi - b.lo) / 25)), 24) AS INTEGER) AS bin, count(*) AS n
      FROM offers, b WHERE salary_mid IS NOT NULL GROUP BY 1)"""))
def q_salary_histogram(spark, sf_dir):
    return finish(A.histogram(offers(spark, sf_dir), C.salary, 25))


# ----------------------------------------------------------------- A11
def _per_skill_union(select_fn) -> str:
    return "\nUNION ALL\n".join(select_fn(n, c) for n, c in C.skills)


@query("skill_frequency", with_offers(
    "SELECT skill, " + _r("frequency_pct") + " AS frequency_pct FROM (\n" + _per_skill_union(
        lambda n, c: f"SELECT '{n}' AS skill, avg({c}) * 100 AS frequency_pct FROM offers") + ")"))
def q_skill_frequency(spark, sf_dir):
    return finish(A.skill_frequency(offers(spark, sf_dir), skill_pairs()))


# ----------------------------------------------------------------- A12 / T2
_IMPACT_SQL = _per_skill_union(lambda n, c: (
    f"SELECT '{n}' AS skill, CAST(sum({c}) AS BIGINT) AS holders, "
    f"median(salary_mid) FILTER (WHERE {c} = 1) AS median_with, "
    f"median(salary_mid) FILTER (WHERE {c} = 0) AS median_without FROM offers"))


@query("skill_impact", with_offers(f"""
SELECT skill, holders, {_r('median_with')} AS median_with, {_r('median_without')} AS median_without,
       {_r('median_with - median_without')} AS impact
FROM imp WHERE holders >= 5 AND median_with - median_without IS NOT NULL""", extra=f"imp AS ({_IMPACT_SQL})"))
def q_skill_impact(spark, sf_dir):
    return finish(A.skill_impact(offers(spark, sf_dir), skill_pairs(), C.salary, 5))


@query("skill_impact_top3", with_offers(f"""
SELECT skill, holders, {_r('median_with')} AS median_with, {_r('median_without')} AS median_without,
       {_r('median_with - median_without')} AS impact
FROM imp WHERE median_with - median_without IS NOT NULL AND median_with - median_without <> 0
ORDER BY median_with - median_without DESC, skill LIMIT 3""", extra=f"imp AS ({_IMPACT_SQL})"))
def q_skill_impact_top3(spark, sf_dir):
    """A12 overview variant: no holder threshold, zero impacts dropped, top 3 by impact."""
    return finish(A.skill_impact(offers(spark, sf_dir), skill_pairs(), C.salary, min_holders=0,
                                 drop_zero=True, top=3, by_abs=False))


# ----------------------------------------------------------------- S3
@query("career_load", with_offers(f"""
SELECT offer_id, {_r('salary_mid')} AS salary_mid, {_r('experience')} AS experience FROM offers
WHERE salary_mid IS NOT NULL AND experience IS NOT NULL"""))
def q_career_load(spark, sf_dir):
    """S3: required columns (raises when one is missing), numeric coercion, rows
    without salary or experience dropped."""
    from offerlake.sources.tables import require_columns
    off = require_columns(offers(spark, sf_dir), [C.job, C.city, C.salary, C.experience])
    coerced = P.coerce_numeric(off, [C.salary, C.experience]).na.drop(subset=[C.salary, C.experience])
    return finish(coerced.select(C.id, C.salary, C.experience))


# ----------------------------------------------------------------- A13
_MONTHS_VALUES = ", ".join(f"('{k}', {v})" for k, v in A.SKILL_LEARNING_MONTHS.items())


@query("skill_roi", with_offers(f"""
SELECT imp.skill, {_r('median_with - median_without')} AS impact, CAST(m.months AS BIGINT) AS learning_months,
       {_r('(median_with - median_without) / m.months')} AS roi_per_month
FROM imp JOIN (VALUES {_MONTHS_VALUES}) m(skill, months) ON imp.skill = m.skill
WHERE holders >= 5 AND median_with - median_without IS NOT NULL""", extra=f"imp AS ({_IMPACT_SQL})"))
def q_skill_roi(spark, sf_dir):
    return finish(A.skill_roi(offers(spark, sf_dir), skill_pairs(), C.salary, 5))


# ----------------------------------------------------------------- A14
def stack_predicates_sql() -> dict[str, str]:
    s = {n: f"{C.skill(n)} = 1" if C.skill(n) else "FALSE" for n in (
        "python", "machine_learning", "aws", "azure", "gcp", "spark", "sql", "tableau", "power_bi")}
    return {
        "Data Scientist (Full Stack)": f"{s['python']} AND {s['machine_learning']} AND ({s['aws']} OR {s['azure']} OR {s['gcp']})",
        "Data Engineer (Cloud)": f"{s['python']} AND {s['spark']} AND ({s['aws']} OR {s['azure']})",
        "BI Analyst": f"{s['sql']} AND ({s['tableau']} OR {s['power_bi']})",
        "ML Engineer": f"{s['python']} AND {s['machine_learning']} AND {s['spark']}",
        "Full Stack Data": f"{s['python']} AND {s['sql']} AND ({s['aws']} OR {s['azure']} OR {s['gcp']})",
    }


@query("export_stacks", with_offers("""
SELECT stack, round(median(salary_mid), 4) AS median_salary, count(*) AS n FROM (
  SELECT 'Data Scientist' AS stack, salary_mid FROM offers WHERE f_economy = 1 AND f_medium = 1 AND f_promo = 1
  UNION ALL SELECT 'Data Engineer', salary_mid FROM offers WHERE f_economy = 1 AND f_small = 1
  UNION ALL SELECT 'BI Analyst', salary_mid FROM offers WHERE f_large = 1 AND f_standard = 1)
GROUP BY stack HAVING count(*) >= 5"""))
def q_export_stacks(spark, sf_dir):
    """A14, the three stacks of the market export."""
    out = A.stack_stats(offers(spark, sf_dir), C.skill, C.salary, 5, A.export_stacks)
    return finish(out.select("stack", F.col("median").alias("median_salary"), "n"))


def _stack_sql():
    parts = [f"""SELECT '{name}' AS stack, {_r('median(salary_mid)')} AS median, {_r('avg(salary_mid)')} AS mean,
       {_r('quantile_cont(salary_mid, 0.25)')} AS q25, {_r('quantile_cont(salary_mid, 0.75)')} AS q75, count(*) AS n
FROM offers WHERE {p} HAVING count(*) >= 5""" for name, p in stack_predicates_sql().items()]
    return with_offers("\nUNION ALL\n".join(parts))


@query("stack_stats", _stack_sql())
def q_stack_stats(spark, sf_dir):
    return finish(A.stack_stats(offers(spark, sf_dir), C.skill, C.salary, 5))


# ----------------------------------------------------------------- A16
@query("flag_correlation", with_offers(f"""
SELECT {_r('corr(CAST(coalesce(f_medium, 0) AS DOUBLE), CAST(coalesce(f_economy, 0) AS DOUBLE))')} AS correlation FROM offers"""))
def q_flag_correlation(spark, sf_dir):
    return finish(A.flag_correlation(offers(spark, sf_dir), "f_medium", "f_economy"))


# ----------------------------------------------------------------- A18
@query("high_paying_groups", with_offers(f"""
SELECT location, {_r('median')} AS median FROM med
WHERE median >= (SELECT quantile_cont(median, 0.75) FROM med)""", extra="""
med AS (SELECT location, median(salary_mid) AS median FROM offers GROUP BY location HAVING median(salary_mid) IS NOT NULL)"""))
def q_high_paying_groups(spark, sf_dir):
    return finish(A.high_paying_groups(offers(spark, sf_dir), C.city, C.salary))


# ----------------------------------------------------------------- Q1 / Q2 / Q3
@query("completeness", with_offers("""
SELECT offer_id, round((CAST(salary_mid IS NOT NULL AS INTEGER) + CAST(experience IS NOT NULL AS INTEGER)
       + CAST(salary_min IS NOT NULL AS INTEGER) + CAST(location IS NOT NULL AS INTEGER)) * 100.0 / 4, 4)
       AS profile_completeness FROM offers"""))
def q_completeness(spark, sf_dir):
    off = offers(spark, sf_dir)
    return finish(Q.completeness(off, [C.salary, C.experience, C.salary_min, C.city])
                  .select(C.id, "profile_completeness"))


@query("fill_rates", with_offers(f"""
SELECT (SELECT count(*) FROM orders) AS initial_rows, count(*) AS final_rows, CAST(19 AS BIGINT) AS final_columns,
       {_r('avg(CAST(job_type IS NOT NULL AS DOUBLE)) * 100')} AS fill_rate_job_type,
       {_r('avg(CAST(salary_mid IS NOT NULL AS DOUBLE)) * 100')} AS fill_rate_salary_mid,
       {_r('avg(CAST(experience IS NOT NULL AS DOUBLE)) * 100')} AS fill_rate_experience,
       {_r('avg(CAST(salary_min IS NOT NULL AS DOUBLE)) * 100')} AS fill_rate_salary_min,
       {_r('avg(CAST(location IS NOT NULL AS DOUBLE)) * 100')} AS fill_rate_location FROM offers"""))
def q_fill_rates(spark, sf_dir):
    off = offers(spark, sf_dir)
    rows_in = spark.read.parquet(table_path(sf_dir, "orders")).select(F.count(F.lit(1))).scalar()
    return finish(Q.fill_rates(off, [C.job, C.salary, C.experience, C.salary_min, C.city], rows_in))


@query("iqr_trim", with_offers(f"""
SELECT offer_id, {_r('salary_mid')} AS salary_mid FROM offers, b
WHERE CASE WHEN (SELECT avg(CAST(coalesce(salary_mid < lo OR salary_mid > hi, FALSE) AS DOUBLE)) FROM offers, b) < 0.05
           THEN coalesce(salary_mid >= lo AND salary_mid <= hi, FALSE) ELSE TRUE END""", extra="""
b AS (SELECT quantile_cont(salary_mid, 0.25) - 1.5 * (quantile_cont(salary_mid, 0.75) - quantile_cont(salary_mid, 0.25)) AS lo,
             quantile_cont(salary_mid, 0.75) + 1.5 * (quantile_cont(salary_mid, 0.75) - quantile_cont(salary_mid, 0.25)) AS hi
      FROM offers)"""))
def q_iqr_trim(spark, sf_dir):
    return finish(Q.iqr_trim(offers(spark, sf_dir), C.salary).select(C.id, C.salary))


_LI_BOUNDS = """b AS (SELECT quantile_cont(l_extendedprice, 0.25) - 1.5 * (quantile_cont(l_extendedprice, 0.75)
                  - quantile_cont(l_extendedprice, 0.25)) AS lo,
             quantile_cont(l_extendedprice, 0.75) + 1.5 * (quantile_cont(l_extendedprice, 0.75)
                  - quantile_cont(l_extendedprice, 0.25)) AS hi
      FROM lineitem)"""


@query("iqr_trim_lineitem", f"""WITH {_LI_BOUNDS}
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice, 4) AS l_extendedprice
FROM lineitem, b
WHERE CASE WHEN (SELECT avg(CAST(coalesce(l_extendedprice < lo OR l_extendedprice > hi, FALSE) AS DOUBLE))
                 FROM lineitem, b) < 0.05
           THEN coalesce(l_extendedprice >= lo AND l_extendedprice <= hi, FALSE) ELSE TRUE END""")
def q_iqr_trim_lineitem(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    return finish(Q.iqr_trim(li, "l_extendedprice"))
