"""Driver queries for the extraction jobs (E1-E23) and crawl dedup.

No driver table holds French offer text, so experience / salary / title rules
run over text built from ``part`` (FIXTURES 2.3): every part row gets one of
four text forms chosen by its key, with the same expression on both sides.
Description, tagging and dedup jobs run over ``documents``; page records over
``pages``. Every row of every table is processed.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlake.functions import pages as PG
from offerlake.functions import text as E
from offerlake.operators import market as A
from offerlake.operators.filters import title_length_filter
from offerlake.plans.registry import finish, query
from offerlake.sources.tables import read_table, spread_for_cpu

# --------------------------------------------------------------------- built text
BUILT_SQL = """SELECT p_partkey,
  CASE p_partkey % 4
    WHEN 0 THEN concat(p_size, ' ans d''expérience ', p_name)
    WHEN 1 THEN concat(p_size, '-', p_size + 2, ' ans d''expérience')
    WHEN 2 THEN concat('Data Engineer senior H/F ', replace(p_brand, '#', ' '))
    ELSE p_name END AS text,
  CASE p_partkey % 4
    WHEN 3 THEN concat(CAST(round(p_retailprice) AS INTEGER), ' k€')
    WHEN 1 THEN concat(p_size * 1000 + 500, ' €/an')
    ELSE p_name END AS salary_text,
  CASE p_partkey % 4
    WHEN 0 THEN concat('Master ', p_size)
    WHEN 1 THEN concat('Bac+', p_size % 9)
    WHEN 2 THEN 'Licence pro'
    ELSE p_name END AS education,
  CASE p_partkey % 4
    WHEN 0 THEN 'Télétravail partiel' WHEN 1 THEN '100% remote' WHEN 2 THEN 'Non' ELSE NULL END AS telework,
  concat('Site ', lpad(CAST(p_size AS VARCHAR), 2, '0'), '000 ', p_brand) AS location_text,
  concat('[''', replace(p_name, ' ', ''', '''), ''']') AS skills_raw,
  CASE p_partkey % 8 WHEN 3 THEN concat('Mission : data pipeline ', p_name) WHEN 7 THEN '' ELSE p_name END AS description
FROM part"""


def built_text(spark, sf_dir):
    p = spread_for_cpu(read_table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]))
    form = F.col("p_partkey") % 4
    size = F.col("p_size")

    def by_form(f0, f1, f2, f3):
        return F.when(form == 0, f0).when(form == 1, f1).when(form == 2, f2).otherwise(f3)

    return p.select(
        "p_partkey",
        by_form(F.concat(size, F.lit(" ans d'expérience "), "p_name"),
                F.concat(size, F.lit("-"), size + 2, F.lit(" ans d'expérience")),
                F.concat(F.lit("Data Engineer senior H/F "), F.replace("p_brand", F.lit("#"), F.lit(" "))),
                F.col("p_name")).alias("text"),
        by_form(F.col("p_name"),
                F.concat(size * 1000 + 500, F.lit(" €/an")),
                F.col("p_name"),
                F.concat(F.round("p_retailprice").cast("int"), F.lit(" k€"))).alias("salary_text"),
        by_form(F.concat(F.lit("Master "), size), F.concat(F.lit("Bac+"), size % 9),
                F.lit("Licence pro"), F.col("p_name")).alias("education"),
        by_form(F.lit("Télétravail partiel"), F.lit("100% remote"), F.lit("Non"),
                F.lit(None).cast("string")).alias("telework"),
        F.concat(F.lit("Site "), F.lpad(size.cast("string"), 2, "0"), F.lit("000 "), "p_brand")
        .alias("location_text"),
        F.concat(F.lit("['"), F.replace("p_name", F.lit(" "), F.lit("', '")), F.lit("']")).alias("skills_raw"),
        F.when(F.col("p_partkey") % 8 == 3, F.concat(F.lit("Mission : data pipeline "), "p_name"))
        .when(F.col("p_partkey") % 8 == 7, F.lit("")).otherwise(F.col("p_name")).alias("description"),
    )


def _built(body: str) -> str:
    return f"WITH built AS ({BUILT_SQL})\n{body}"


# --------------------------------------------------------------------- E2-E6
@query("experience_extract", _built(f"""
SELECT p_partkey, round({E.experience_years_sql('text')}, 4) AS experience_raw,
       round({E.correct_extreme_sql(E.experience_years_sql('text'))}, 4) AS experience_final
FROM built"""))
def q_experience_extract(spark, sf_dir):
    b = built_text(spark, sf_dir)
    return finish(b.select("p_partkey", E.experience_years(F.col("text")).alias("experience_raw"),
                           E.experience_final([F.col("text")]).alias("experience_final")))


# --------------------------------------------------------------------- E7-E8
@query("salary_parse", _built(f"""
SELECT p_partkey, round(s_min, 4) AS salary_min, round(s_max, 4) AS salary_max,
       round((s_min + s_max) / 2, 4) AS salary_mid, round(s_max - s_min, 4) AS salary_range
FROM (SELECT p_partkey, {E.parse_salary_sql('salary_text')} AS s_min,
             {E.parse_salary_sql("concat(CAST(p_partkey % 7 + 40 AS VARCHAR), 'k')")} AS s_max FROM built)"""))
def q_salary_parse(spark, sf_dir):
    b = built_text(spark, sf_dir)
    lo = E.parse_salary(F.col("salary_text"))
    hi = E.parse_salary(F.concat((F.col("p_partkey") % 7 + 40).cast("string"), F.lit("k")))
    mid, rng = E.salary_mid_range(lo, hi)
    return finish(b.select("p_partkey", lo.alias("salary_min"), hi.alias("salary_max"),
                           mid.alias("salary_mid"), rng.alias("salary_range")))


# --------------------------------------------------------------------- E9
@query("company_extract", _built(f"""
SELECT p_partkey, {E.company_from_title_sql('text')} AS company FROM built"""))
def q_company_extract(spark, sf_dir):
    b = built_text(spark, sf_dir)
    return b.select("p_partkey", E.company_from_title(F.col("text")).alias("company"))


# --------------------------------------------------------------------- E10-E12, E18, E19
@query("title_rules", _built(f"""
SELECT p_partkey, {E.job_type_sql('text', 'description')} AS job_type,
       {E.seniority_from_title_sql('text')} AS seniority,
       CAST({E.job_type_sql('text', 'description')} <> 'Autre' AS BIGINT) AS is_data_job,
       {E.simplify_job_type_sql(E.job_type_sql('text', 'description'))} AS job_type_simplified
FROM built"""))
def q_title_rules(spark, sf_dir):
    b = built_text(spark, sf_dir)
    jt = E.job_type(F.col("text"), F.col("description"))
    return finish(b.select("p_partkey", jt.alias("job_type"),
                           E.seniority_from_title(F.col("text")).alias("seniority"),
                           E.is_data_job(jt).cast("int").alias("is_data_job"),
                           E.simplify_job_type(jt).alias("job_type_simplified")))


_CITY_SQL = ("CASE WHEN location_text IS NULL THEN NULL "
             + " ".join("WHEN " + " OR ".join(f"contains(lower(location_text), {E._sq(k)})" for k in kws)
                        + f" THEN {E._sq(city)}" for city, kws in E.CITY_KEYWORDS)
             + " ELSE CASE substring(regexp_extract(location_text, '(^|[^\\pL\\pN_])(\\d{5})([^\\pL\\pN_]|$)', 2), 1, 2) "
             + " ".join(f"WHEN '{p}' THEN '{c}'" for p, c in E.POSTCODE_PREFIX) + " END END")


@query("city_extract", _built(f"SELECT p_partkey, {_CITY_SQL} AS city FROM built"))
def q_city_extract(spark, sf_dir):
    """Keyword rules in order, else the postcode-prefix map."""
    b = built_text(spark, sf_dir)
    return b.select("p_partkey", E.city_from_text(F.col("location_text")).alias("city"))


# --------------------------------------------------------------------- E16, E17
@query("education_telework", _built(f"""
SELECT p_partkey, {E.normalize_education_sql('education')} AS education_clean,
       round({E.telework_numeric_sql('telework')}, 4) AS telework_numeric FROM built"""))
def q_education_telework(spark, sf_dir):
    b = built_text(spark, sf_dir)
    return finish(b.select("p_partkey", E.normalize_education(F.col("education")).alias("education_clean"),
                           E.telework_numeric(F.col("telework")).alias("telework_numeric")))


# --------------------------------------------------------------------- E1
@query("list_parse", _built("""
SELECT p_partkey, array_to_string(lst, '|') AS skills, CAST(len(lst) AS BIGINT) AS skills_count FROM (
  SELECT p_partkey, list_filter(list_transform(regexp_extract_all(skills_raw, '''([^'']*)''', 1),
                                               lambda x: trim(x)), lambda x: x <> '') AS lst FROM built)"""))
def q_list_parse(spark, sf_dir):
    b = built_text(spark, sf_dir)
    lst = E.parse_list(F.col("skills_raw"))
    return b.select("p_partkey", F.array_join(lst, "|").alias("skills"),
                    F.size(lst).cast("long").alias("skills_count"))


# --------------------------------------------------------------------- E13
@query("clean_description", f"""
SELECT doc_id, md5({E.clean_description_sql('text')}) AS cleaned_md5,
       CAST(length({E.clean_description_sql('text')}) AS BIGINT) AS cleaned_chars FROM documents""")
def q_clean_description(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    cleaned = E.clean_description(F.col("text"))
    return d.select("doc_id", F.md5(cleaned).alias("cleaned_md5"),
                    F.length(cleaned).cast("long").alias("cleaned_chars"))


# --------------------------------------------------------------------- E14
_FLAGS_SQL = E.skill_flags_sql("text")


@query("skill_flags", "SELECT doc_id, " + ", ".join(
    f"CAST({v} AS BIGINT) AS {k}" for k, v in _FLAGS_SQL.items()) + " FROM documents")
def q_skill_flags(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return finish(d.select("doc_id", *[v.alias(k) for k, v in E.skill_flags(F.col("text")).items()]))


# --------------------------------------------------------------------- E15
_METRICS_SQL = E.text_metrics_sql("text")


@query("text_metrics", "SELECT doc_id, " + ", ".join(
    f"CAST({v} AS BIGINT) AS {k}" for k, v in _METRICS_SQL.items()) + " FROM documents")
def q_text_metrics(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return finish(d.select("doc_id", *[v.alias(k) for k, v in E.text_metrics(F.col("text")).items()]))


# --------------------------------------------------------------------- E22
@query("dictionary_tags", f"""
SELECT doc_id, array_to_string({E.dictionary_tags_sql('text')}, ',') AS skills,
       array_to_string({E.dictionary_tags_sql('text', E.TAG_BENEFITS)}, ',') AS benefits FROM documents""")
def q_dictionary_tags(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return d.select("doc_id", F.array_join(E.dictionary_tags(F.col("text")), ",").alias("skills"),
                    F.array_join(E.dictionary_tags(F.col("text"), E.TAG_BENEFITS), ",").alias("benefits"))


# --------------------------------------------------------------------- E23, T4, P9
@query("offer_dedup", """
SELECT doc_id, source, fingerprint FROM (
  SELECT doc_id, source, md5(concat_ws('_', coalesce(text, ''), coalesce(source, ''), coalesce(lang, ''))) AS fingerprint,
         row_number() OVER (PARTITION BY md5(concat_ws('_', coalesce(text, ''), coalesce(source, ''), coalesce(lang, '')))
                            ORDER BY doc_id) AS rn
  FROM documents WHERE length(text) > 5) WHERE rn = 1""")
def q_offer_dedup(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["doc_id", "text", "source", "lang"]))
    fp = d.select("doc_id", "source",
                  E.offer_fingerprint(F.col("text"), F.col("source"), F.col("lang")).alias("fingerprint"),
                  "text")
    kept = A.dedup_keep_first(title_length_filter(fp, "text", 5).drop("text"), "fingerprint", ["doc_id"])
    return kept.select("doc_id", "source", "fingerprint")


# --------------------------------------------------------------------- A27
@query("crawl_keyword_counts", """
SELECT source, count(*) AS collected, count(DISTINCT md5(text)) AS unique_offers,
       count(*) - count(DISTINCT md5(text)) AS duplicates
FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY collected DESC, source LIMIT 20""")
def q_crawl_keyword_counts(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["source", "text"]))
    # distinct per source via a two-level aggregate (source, hash) -> counts;
    # partial aggregation keeps a hot source from landing whole in one task
    per_hash = d.where(F.col("source").isNotNull()).groupBy("source", F.md5("text").alias("h")) \
        .agg(F.count(F.lit(1)).alias("c"))
    agg = per_hash.groupBy("source").agg(F.sum("c").cast("long").alias("collected"),
                                         F.count(F.lit(1)).alias("unique_offers"))
    return (agg.select("source", "collected", "unique_offers",
                       (F.col("collected") - F.col("unique_offers")).alias("duplicates"))
            .orderBy(F.col("collected").desc(), "source").limit(20))


# --------------------------------------------------------------------- A15, A17, A20 over documents
@query("distribution_profile", """
SELECT source, CAST(trunc(quantile_cont(w, 0.1)) AS BIGINT) AS p10, CAST(trunc(quantile_cont(w, 0.25)) AS BIGINT) AS p25,
       CAST(trunc(median(w)) AS BIGINT) AS median, CAST(trunc(quantile_cont(w, 0.75)) AS BIGINT) AS p75,
       CAST(trunc(quantile_cont(w, 0.9)) AS BIGINT) AS p90, CAST(trunc(avg(w)) AS BIGINT) AS mean, count(w) AS count
FROM (SELECT source, len(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY source""")
def q_distribution_profile(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["source", "text"])) \
        .select("source", E.word_count(F.col("text")).alias("w"))
    return A.distribution_profile(d, "w", ["source"])


@query("length_slopes", """
SELECT round(CASE WHEN regr_count(w, n_chars) < 10 THEN 15.0 ELSE regr_slope(w, n_chars) END, 4) AS slope_chars,
       round(CASE WHEN regr_count(w, n_lines) < 10 THEN 10.0 ELSE regr_slope(w, n_lines) END, 4) AS slope_lines,
       CAST(regr_count(w, n_chars) AS BIGINT) AS pairs
FROM (SELECT CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) AS w, CAST(n_chars AS DOUBLE) AS n_chars,
             CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines FROM documents)""")
def q_length_slopes(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["text", "n_chars"])).select(
        E.word_count(F.col("text")).cast("double").alias("w"), F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split("text", "\n", -1)).cast("double").alias("n_lines"))
    a = A.regression_slope(d, "w", "n_chars", 15.0, name="slope_chars")
    b = A.regression_slope(d, "w", "n_lines", 10.0, name="slope_lines")
    return finish(a.select("slope_chars", b.select("slope_lines").scalar().alias("slope_lines"),
                           F.col("pairs").cast("long").alias("pairs")))


@query("group_adjustments", """
SELECT lang, CAST(trunc(median(w) - (SELECT median(len(regexp_extract_all(text, '\\S+'))) FROM documents)) AS BIGINT) AS adjustment
FROM (SELECT lang, len(regexp_extract_all(text, '\\S+')) AS w FROM documents) GROUP BY lang""")
def q_group_adjustments(spark, sf_dir):
    d = spread_for_cpu(read_table(spark, sf_dir, "documents", ["lang", "text"])).select(
        "lang", E.word_count(F.col("text")).alias("w"))
    return A.group_adjustments(d, "lang", "w")


# --------------------------------------------------------------------- E20, E21
_PAGE_SQL = PG.page_fields_sql("url", "html", "t")
_TEXT_SQL = f"(SELECT *, {PG.visible_text_sql('html')} AS t FROM pages)"


@query("page_records", "SELECT page_id, " + ", ".join(
    (f"CAST({v} AS BIGINT) AS {k}" if k in ("text_chars", "n_links") else f"{v} AS {k}")
    for k, v in _PAGE_SQL.items()) + f" FROM {_TEXT_SQL} WHERE length(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))) BETWEEN 5 AND 200")
def q_page_records(spark, sf_dir):
    p = spread_for_cpu(read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])) \
        .withColumn("_text", PG.visible_text(F.col("html")))
    fields = PG.page_fields(F.col("url"), F.col("html"), F.col("_text"))
    out = p.select("page_id", *[v.alias(k) for k, v in fields.items()])
    return finish(out.where(F.length("title").between(5, 200)))


_SECTIONS_SQL = PG.page_sections_sql("t")


@query("page_sections", f"""
SELECT page_id, CAST(length({_SECTIONS_SQL['missions']}) AS BIGINT) AS missions_chars,
       CAST(length({_SECTIONS_SQL['profile_sought']}) AS BIGINT) AS profile_chars,
       CAST(len(regexp_extract_all(html, '/emplois/(\\d+)\\.html', 1)) AS BIGINT) AS n_offer_links
FROM {_TEXT_SQL}""")
def q_page_sections(spark, sf_dir):
    """E21 sections (missions, profile sought) and listing links per page."""
    p = spread_for_cpu(read_table(spark, sf_dir, "pages", ["page_id", "html"])).withColumn("_text", PG.visible_text(F.col("html")))
    s = PG.page_sections(F.col("_text"))
    return finish(p.select("page_id", F.length(s["missions"]).alias("missions_chars"),
                           F.length(s["profile_sought"]).alias("profile_chars"),
                           F.size(PG.multi_card_links(F.col("html"))).alias("n_offer_links")))
