"""Driver queries whose rules need French offer text, labels and listing pages.

The driver tables hold none, so the inputs are built from every row of ``part`` and
``pages`` with one SQL text that Spark and DuckDB both read; the rules themselves are
written twice (DataFrame expressions here, SQL for the oracle).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from offerlake.functions import features as FT
from offerlake.functions import pages as PG
from offerlake.functions import text as E
from offerlake.plans.registry import finish, query
from offerlake.sources.tables import read_table, spread_for_cpu

# --------------------------------------------------------------------- profiles from part
# Every column is null in some form, so that defaults and indicators show.
PROFILE_SELECT = """p_partkey AS profile_id,
  CASE p_partkey % 5 WHEN 0 THEN 'Paris 75001' WHEN 1 THEN 'Lyon' WHEN 2 THEN 'Marseille 13002' WHEN 3 THEN 'Brest 29200' END AS location,
  CASE p_size % 6 WHEN 0 THEN 'Banque' WHEN 1 THEN 'Retail' WHEN 2 THEN 'Tech' WHEN 3 THEN 'Santé' WHEN 4 THEN 'Finance' END AS sector,
  CASE p_size % 7 WHEN 0 THEN 'Stage/Alternance' WHEN 1 THEN 'Junior (1-3 ans)' WHEN 2 THEN 'Mid confirmé (3-5 ans)'
       WHEN 3 THEN 'Senior (5-8 ans)' WHEN 4 THEN 'Lead/Manager (12-20 ans)' WHEN 5 THEN 'Autre' END AS seniority,
  CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS DOUBLE) / 2 END AS experience,
  CASE p_partkey % 4 WHEN 0 THEN 'Présentiel' WHEN 1 THEN 'Hybride (1-3j)' WHEN 2 THEN 'Full remote' END AS telework_label,
  CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 2 = 0 END AS has_teletravail, p_size > 25 AS has_mutuelle,
  p_size % 2 = 0 AS has_tickets, p_partkey % 7 = 0 AS has_prime,
  p_partkey % 2 = 0 AS contient_python, p_size % 3 = 0 AS contient_sql, p_partkey % 3 = 1 AS contient_aws,
  p_size % 4 = 1 AS contient_spark, p_size % 5 = 2 AS contient_machine_learning,
  CASE WHEN p_partkey % 6 <> 0 THEN p_size % 13 END AS nb_mots_cles_techniques"""


def built_profiles(spark, sf_dir):
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size"])
    return spark.sql(f"SELECT {PROFILE_SELECT} FROM {{part}}", part=part)


_BUILT = f"built AS (SELECT {PROFILE_SELECT} FROM part)"


@query("feature_rules", f"""WITH {_BUILT}
SELECT profile_id, CAST(has_mutuelle AS BIGINT) AS has_mutuelle, CAST(experience IS NULL AS BIGINT) AS experience_missing,
  coalesce(location, 'Non spécifié') AS location_final,
  CAST(coalesce(location, '') LIKE '%Paris%' OR coalesce(location, '') = 'Lyon' OR coalesce(location, '') LIKE 'Marseille%' AS BIGINT) AS is_grande_ville,
  CAST(coalesce(regexp_matches(location, '75|77|78|91|92|93|94|95'), FALSE) AS BIGINT) AS is_paris_region,
  CAST(coalesce(sector, '') IN ('Banque', 'Finance', 'Tech', 'Consulting', 'Assurance', 'Pharma') AS BIGINT) AS is_high_paying_sector,
  CAST(CASE seniority WHEN 'Stage/Alternance' THEN 1 WHEN 'Junior (1-3 ans)' THEN 2 WHEN 'Mid confirmé (3-5 ans)' THEN 3
       WHEN 'Senior (5-8 ans)' THEN 4 WHEN 'Lead/Manager (12-20 ans)' THEN 6 ELSE 0 END AS BIGINT) AS seniority_numeric,
  CAST(CASE seniority WHEN 'Stage/Alternance' THEN 1 WHEN 'Junior (1-3 ans)' THEN 3 WHEN 'Mid confirmé (3-5 ans)' THEN 4
       WHEN 'Senior (5-8 ans)' THEN 5 WHEN 'Lead/Manager (12-20 ans)' THEN 7 ELSE 0 END AS BIGINT) AS hierarchy_score,
  CAST(coalesce(CAST(has_teletravail AS INTEGER), 0) + CAST(has_mutuelle AS INTEGER) + CAST(has_tickets AS INTEGER)
       + CAST(has_prime AS INTEGER) AS BIGINT) AS benefits_score,
  CASE telework_label WHEN 'Présentiel' THEN 0.0::DOUBLE WHEN 'Hybride (1-3j)' THEN 0.5::DOUBLE WHEN 'Full remote' THEN 1.0::DOUBLE
       ELSE 0.5::DOUBLE END AS telework_numeric,
  CASE WHEN experience IS NULL THEN NULL WHEN experience < 1 THEN 'Stage/Alternance' WHEN experience <= 3 THEN 'Junior (1-3 ans)'
       WHEN experience <= 5 THEN 'Mid-level' WHEN experience <= 8 THEN 'Senior (5-8 ans)' WHEN experience <= 12 THEN 'Expert (8-12 ans)'
       ELSE 'Lead/Manager (12-20 ans)' END AS seniority_lead
FROM built""")
def q_feature_rules(spark, sf_dir):
    """F1-F5, F9, F11, F14, F17, F18 (lead variant), F24 with labels."""
    raw = built_profiles(spark, sf_dir)
    df = FT.bools_to_int(raw)
    sen, place = F.col("seniority"), F.col("location")
    return finish(df.select(
        "profile_id", "has_mutuelle", FT.missing_indicator(F.col("experience")).alias("experience_missing"),
        FT.final_location(place).alias("location_final"), FT.is_major_city(place).alias("is_grande_ville"),
        FT.is_paris_region(place).alias("is_paris_region"),
        FT.is_high_paying_sector(F.col("sector")).alias("is_high_paying_sector"),
        FT.seniority_ordinal(sen).alias("seniority_numeric"), FT.hierarchy_score(sen).alias("hierarchy_score"),
        FT.benefits_score(df).alias("benefits_score"),
        FT.telework_of_profile(F.col("telework_label")).alias("telework_numeric"),
        FT.seniority_from_experience(F.col("experience"), with_lead=True).alias("seniority_lead")))


_WORDS = "(SELECT CAST(trunc(median(len(regexp_extract_all(text, '\\S+')))) AS INTEGER) FROM documents)"


# Profiles for the serving form: every level of its map, the default one, and an experience that is not a number.
SERVING_SELECT = PROFILE_SELECT.replace("""WHEN 4 THEN 'Lead/Manager (12-20 ans)' WHEN 5 THEN 'Autre' END AS seniority""",
                                        """WHEN 4 THEN 'Lead/Manager (12-20 ans)' WHEN 5 THEN 'Autre' ELSE
    CASE p_partkey % 8 WHEN 0 THEN 'Débutant (<1 an)' WHEN 1 THEN 'Mid-level' WHEN 2 THEN 'Senior' WHEN 3 THEN 'Expert (8-12 ans)'
      WHEN 4 THEN 'Lead/Manager' WHEN 5 THEN 'Directeur/VP (>20 ans)' WHEN 6 THEN 'Freelance/Consultant' END END AS seniority""").replace(
    "CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size AS DOUBLE) / 2 END AS experience",
    "CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 4 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) / 2 END AS experience") + """,
  p_retailprice AS salary"""


@query("profile_defaults", f"""WITH built AS (SELECT {SERVING_SELECT} FROM part), f AS (
  SELECT profile_id, 'Data Analyst' AS job_type, coalesce(seniority, 'Mid-level') AS seniority, 'CDI' AS contract_type, 'Bac+5' AS education,
    CASE WHEN isnan(experience) THEN 8.0 ELSE coalesce(experience, 4.0) END AS experience,
    CAST(coalesce(isnan(experience), FALSE) AS BIGINT) AS experience_missing,
    coalesce(location, 'Paris') AS location, coalesce(sector, 'Non spécifié') AS sector,
    coalesce(CAST(contient_sql AS BIGINT), 1) AS contient_sql, coalesce(CAST(contient_python AS BIGINT), 1) AS contient_python,
    CAST(0 AS BIGINT) AS contient_r, CAST(0 AS BIGINT) AS contient_tableau, CAST(0 AS BIGINT) AS contient_power_bi,
    coalesce(CAST(contient_aws AS BIGINT), 0) AS contient_aws, CAST(0 AS BIGINT) AS contient_azure, CAST(0 AS BIGINT) AS contient_gcp,
    coalesce(CAST(contient_spark AS BIGINT), 0) AS contient_spark, CAST(0 AS BIGINT) AS contient_etl,
    coalesce(CAST(contient_machine_learning AS BIGINT), 0) AS contient_machine_learning, CAST(3 AS BIGINT) AS skills_count,
    CAST(2 AS BIGINT) AS technical_score, CAST(1 AS BIGINT) AS benefits_score, coalesce(CAST(has_teletravail AS BIGINT), 1) AS has_teletravail,
    coalesce(CAST(has_mutuelle AS BIGINT), 0) AS has_mutuelle, coalesce(CAST(has_tickets AS BIGINT), 0) AS has_tickets,
    coalesce(CAST(has_prime AS BIGINT), 0) AS has_prime, 0.5::DOUBLE AS telework_numeric,
    (SELECT CAST(trunc(median(len(regexp_extract_all(text, '\\S+')))) AS BIGINT) FROM documents) AS description_word_count,
    coalesce(CAST(nb_mots_cles_techniques AS BIGINT), (SELECT CAST(trunc(median(nb_mots_cles_techniques)) AS BIGINT) FROM built)) AS nb_mots_cles_techniques
  FROM built),
medians AS (SELECT sector, median(salary) AS m FROM built WHERE sector IS NOT NULL GROUP BY sector)
SELECT *, CAST(location IN (SELECT location FROM built WHERE location IS NOT NULL GROUP BY location ORDER BY count(*) DESC, location LIMIT 3)
            AS BIGINT) AS is_grande_ville,
  round(2 * ln(1 + experience), 4) AS tech_exp_interaction, CAST(location LIKE '%Paris%' AS BIGINT) AS is_paris_region,
  contient_machine_learning + contient_spark + contient_aws AS advanced_data_score,
  CAST(sector IN (SELECT sector FROM medians WHERE m >= (SELECT quantile_cont(m, 0.75) FROM medians)) AS BIGINT) AS is_high_paying_sector,
  CAST(CASE WHEN nb_mots_cles_techniques <= 2 THEN 0 WHEN nb_mots_cles_techniques <= 5 THEN 1
            WHEN nb_mots_cles_techniques <= 10 THEN 2 ELSE 3 END AS BIGINT) AS tech_complexity_encoded,
  CAST(contient_python > 0 AND contient_aws > 0 AND contient_spark > 0 AS BIGINT) AS has_modern_stack,
  CAST(CASE WHEN seniority IN ('Stage/Alternance', 'Débutant (<1 an)') THEN 1 WHEN seniority = 'Junior (1-3 ans)' THEN 2
       WHEN seniority IN ('Mid confirmé (3-5 ans)', 'Freelance/Consultant') THEN 3 WHEN seniority IN ('Mid-level', 'Senior (5-8 ans)') THEN 4
       WHEN seniority IN ('Senior', 'Expert (8-12 ans)') THEN 5 WHEN seniority = 'Lead/Manager (12-20 ans)' THEN 6
       WHEN seniority IN ('Lead/Manager', 'Directeur/VP (>20 ans)') THEN 7 ELSE 0 END AS BIGINT) AS hierarchy_score
FROM f""")
def q_profile_defaults(spark, sf_dir):
    """F22 over built profiles; the lists of A18 and A19 and the default text sizes (A15, A16) come from the data."""
    from offerlake.operators.market import high_paying_groups, top_groups
    from offerlake.operators.quantiles import exact_quantiles
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_retailprice"])
    built = spark.sql(f"SELECT {SERVING_SELECT} FROM {{part}}", part=part)
    docs = spread_for_cpu(read_table(spark, sf_dir, "documents", ["text"]))
    words = exact_quantiles(docs, E.word_count(F.col("text")), [0.5], names=["m"]).select("m").scalar()
    keywords = exact_quantiles(built, "nb_mots_cles_techniques", [0.5], names=["m"]).select("m").scalar()
    cities = top_groups(built, "location", "salary", 3)
    sectors = high_paying_groups(built.where("sector is not null"), "sector", "salary")
    return finish(FT.profile_feature_row(built, words, keywords, cities, sectors))


# --------------------------------------------------------------------- listing and detail pages
# Pages are built from the id; the oracles say what each holds, by the id too, without reading any HTML.
CARDS_HTML = """concat('<!DOCTYPE html><html><head><title>Offres</title></head><body><!-- <li> --><ul>',
  '<li class="offer"><ul><li>Nouveau</li><li>&Agrave; la une</li></ul><h3>Data&nbsp;Scientist (H/F) n&deg;', page_id,
  '</h3><div class="big company-name">Soci&eacute;t&eacute; <b>', page_id % 7, '</b></div><p>Lyon - 69003</p><p>CDI</p>',
  '<p>', 30 + page_id % 60, '&nbsp;000 - ', 40 + page_id % 60, ' 500 &#8364;/an</p><p>Publi&#xe9;e il y a ', page_id % 20, ' jours</p>',
  '<a href="/emplois/', page_id * 10 + 1, '.html">Voir</a></li>',
  CASE page_id % 3 WHEN 0 THEN concat('<article class="job-card"><a class="x" href="https://x.fr/emplois/', page_id * 10 + 2,
      '.html"><b>Analyste BI</b> H/F</a><article><p>Atelier Nord</p></article><p>Île-de-France</p><p>Stage</p></article>')
    WHEN 1 THEN concat('<li><h2>Dev</h2><a href="/emplois/', page_id * 10 + 3, '.html">court</a></li><li>Sans lien</li>',
      '<div data-testid="job-item"><div><div>Hybride</div></div><a href="/emplois/', page_id * 10 + 5,
      '.html">T&eacute;l&eacute;conseiller
  data</a><div>Studio &amp;amp; Co</div></div>')
    ELSE concat('<li><a href="/emplois/', page_id * 10 + 4, '.html">Ingénieur Data</a><ul><li><a href=''/emplois/', page_id * 10 + 6,
      '.html''>Voir l&rsquo;offre</a></li></ul><p>CDD 12 mois</p><p>2500 &euro;/mois</p></li>') END,
  '</ul></body></html>')"""
DETAIL_HTML = """concat('<html><head><title>CDI</title></head><body><h1>Offre n°', page_id, '</h1><script>var x = "CDI <p>";</script>',
  CASE page_id % 5 WHEN 0 THEN '<p>CDI</p><p>Paris&nbsp;- 75009</p><p>45&nbsp;000 - 55&#160;000&nbsp;&euro;</p><p>3 &agrave; 5&nbsp;ans</p><p>Bac + 5</p>'
    WHEN 1 THEN '<p>CDD</p><p>Nantes 44000</p><p>38 500 €</p><p>2&#x202f;ans d&#39;exp&eacute;rience</p><p>Master</p>'
    WHEN 2 THEN '<p>STAGE</p><p>à Lille</p><p>Junior</p><p>Ing&eacute;nieur</p>'
    WHEN 3 THEN '<p>Alter<b>nance</b></p><p>Saint-&Eacute;tienne - 42</p><p>CONFIRM&Eacute;</p>' ELSE '<p>Aucun détail</p>' END,
  CASE page_id % 4 WHEN 0 THEN '<p>T&Eacute;L&Eacute;TRAVAIL : 2 jours par semaine</p>' WHEN 1 THEN '<p>Hybride</p>' WHEN 2 THEN '<p>full remote possible.</p>' ELSE '' END,
  CASE page_id % 3 WHEN 0 THEN '<p>Banque</p><p>50 à 100 salariés</p>' WHEN 1 THEN '<p>SANT&#201;</p><p>PME</p>' ELSE '' END,
  '<p>Publiée le ', 1 + page_id % 28, ' mars</p>',
  CASE WHEN page_id % 2 = 0 THEN concat('<p>Missions&nbsp;: construire ', page_id, ' tables Python, SQL et Spark</p><p>Profil recherch&eacute; : curieux</p><p>Avantages : Mutuelle, RTT</p>')
       ELSE '<p>Vous êtes : autonome</p><p>Nous offrons : Tickets restaurant et Prime, Power BI, Docker</p>' END,
  '</body></html>')"""


def _built_pages(spark, sf_dir, html: str):
    return spread_for_cpu(read_table(spark, sf_dir, "pages", ["page_id"])).select("page_id", F.expr(html).alias("html"))


@query("offer_cards", """
WITH cards AS (
  SELECT page_id, 1 AS ref, 'Data' || chr(160) || 'Scientist (H/F) n°' || page_id AS title, 'Société ' || page_id % 7 AS company,
    'Lyon - 69003' AS location, (30 + page_id % 60) || chr(160) || '000 - ' || (40 + page_id % 60) || ' 500 €/an' AS salary,
    'CDI' AS contract, 'Publiée il y a ' || page_id % 20 || ' jours' AS date_posted FROM pages
  UNION ALL SELECT page_id, 2, 'Analyste BI H/F', 'Atelier Nord', 'Île-de-France', NULL, 'Stage', NULL FROM pages WHERE page_id % 3 = 0
  UNION ALL SELECT page_id, 5, 'Téléconseiller data', 'Studio &amp; Co', 'Non spécifié', NULL, NULL, NULL FROM pages WHERE page_id % 3 = 1
  UNION ALL SELECT page_id, 4, 'Ingénieur Data', 'Voir l’offre', 'Non spécifié', NULL, 'CDD', NULL FROM pages WHERE page_id % 3 = 2
  UNION ALL SELECT page_id, 6, 'Voir l’offre', 'Non spécifié', 'Non spécifié', NULL, NULL, NULL FROM pages WHERE page_id % 3 = 2)
SELECT page_id, CAST(page_id * 10 + ref AS VARCHAR) AS offer_id, title, company, location, salary, contract, date_posted FROM cards""")
def q_offer_cards(spark, sf_dir):
    """One record per offer link of a listing page, with nested elements and entities in its cards."""
    pages = _built_pages(spark, sf_dir, CARDS_HTML)
    return PG.card_fields(PG.listing_cards(pages, ["page_id"]), ["page_id"])


@query("offer_details", """
WITH p AS (SELECT page_id, page_id % 5 AS kind, 1 + page_id % 28 AS day, chr(160) AS nb, chr(10) || chr(10) AS gap FROM pages),
d AS (
  SELECT *, ['Offre n°' || page_id,
      CASE kind WHEN 0 THEN concat_ws(chr(10) || chr(10), 'CDI', 'Paris' || nb || '- 75009', '45' || nb || '000 - 55' || nb || '000' || nb || '€',
                                      '3 à 5' || nb || 'ans', 'Bac + 5')
        WHEN 1 THEN concat_ws(chr(10) || chr(10), 'CDD', 'Nantes 44000', '38 500 €', '2' || chr(8239) || 'ans d''expérience', 'Master')
        WHEN 2 THEN concat_ws(chr(10) || chr(10), 'STAGE', 'à Lille', 'Junior', 'Ingénieur')
        WHEN 3 THEN concat_ws(chr(10) || chr(10), 'Alternance', 'Saint-Étienne - 42', 'CONFIRMÉ') ELSE 'Aucun détail' END,
      CASE page_id % 4 WHEN 0 THEN 'TÉLÉTRAVAIL : 2 jours par semaine' WHEN 1 THEN 'Hybride' WHEN 2 THEN 'full remote possible.' END,
      CASE page_id % 3 WHEN 0 THEN concat_ws(chr(10) || chr(10), 'Banque', '50 à 100 salariés') WHEN 1 THEN concat_ws(chr(10) || chr(10), 'SANTÉ', 'PME') END,
      'Publiée le ' || day || ' mars',
      CASE WHEN page_id % 2 = 0 THEN concat_ws(chr(10) || chr(10), 'Missions' || nb || ': construire ' || page_id || ' tables Python, SQL et Spark',
                                               'Profil recherché : curieux', 'Avantages : Mutuelle, RTT')
           ELSE concat_ws(chr(10) || chr(10), 'Vous êtes : autonome', 'Nous offrons : Tickets restaurant et Prime, Power BI, Docker') END] AS parts,
    CASE kind WHEN 0 THEN 'Paris' || nb || '- 75009' WHEN 1 THEN 'Nantes 44000' WHEN 3 THEN 'Étienne - 42'
      ELSE CASE WHEN page_id % 3 = 0 THEN 'Banque' || gap || '50' WHEN day >= 10 THEN 'Publiée le ' || day END END AS place
  FROM p)
SELECT page_id, CASE kind WHEN 0 THEN 'CDI' WHEN 1 THEN 'CDD' WHEN 2 THEN 'Stage' WHEN 3 THEN 'Alternance' END AS contract_type,
  CASE page_id % 3 WHEN 0 THEN 'Banque' WHEN 1 THEN 'SANTÉ' END AS company_sector,
  CASE page_id % 3 WHEN 0 THEN '50 à 100 salariés' WHEN 1 THEN 'PME' END AS company_size,
  CASE kind WHEN 0 THEN '45' || nb || '000 - 55' || nb || '000' || nb || '€' WHEN 1 THEN '44000' || gap || '38 500 €' END AS salary_text,
  CASE kind WHEN 0 THEN '3 à 5' || nb || 'ans' WHEN 1 THEN '2' || chr(8239) || 'ans d''expérience' WHEN 2 THEN 'Junior' WHEN 3 THEN 'CONFIRMÉ' END
    AS experience_required,
  CASE kind WHEN 0 THEN 'Bac + 5' WHEN 1 THEN 'Master' WHEN 2 THEN 'Ingénieur' END AS education_level,
  CASE page_id % 4 WHEN 0 THEN 'TÉLÉTRAVAIL : 2 jours par semaine' WHEN 2 THEN 'remote possible'
    WHEN 1 THEN 'Hybride' || gap || CASE page_id % 3 WHEN 0 THEN 'Banque' WHEN 1 THEN 'SANTÉ' ELSE 'Publiée le ' || day || ' mars' END
    ELSE 'Non spécifié' END AS telework,
  day || ' mars' AS publication_date,
  CASE kind WHEN 0 THEN '45000€' WHEN 1 THEN '44000€' END AS salary_min, CASE kind WHEN 0 THEN '55000€' WHEN 1 THEN '38500€' END AS salary_max,
  place AS location_full, right(regexp_extract(place, '[0-9]+'), 5)[1:2] AS department,
  array_to_string(list_filter(parts, lambda x: x IS NOT NULL), chr(10) || chr(10)) AS description,
  CASE WHEN page_id % 2 = 0 THEN 'construire ' || page_id || ' tables Python, SQL et Spark' END AS missions,
  CASE WHEN page_id % 2 = 0 THEN 'curieux' ELSE 'autonome' END AS profile_sought,
  CASE WHEN page_id % 2 = 0 THEN 'Python,SQL,R,Spark' ELSE 'R,Power BI,Docker' END AS skills,
  CASE WHEN page_id % 2 = 1 THEN 'Tickets restaurant,Prime' WHEN page_id % 4 = 0 THEN 'Mutuelle,RTT,Télétravail' ELSE 'Mutuelle,RTT' END AS benefits
FROM d""")
def q_offer_details(spark, sf_dir):
    """E21 and E22 over detail pages that hold every kind of field, with entities and odd white space."""
    p = _built_pages(spark, sf_dir, DETAIL_HTML).withColumn("_text", PG.visible_text(F.col("html")))
    text = F.col("_text")
    fields = PG.page_fields(F.lit(""), F.col("html"), text) | PG.detail_fields(text) | PG.page_sections(text)
    names = ("contract_type company_sector company_size salary_text experience_required education_level telework publication_date "
             "salary_min salary_max location_full department description missions profile_sought").split()
    return p.select("page_id", *[fields[k].alias(k) for k in names], F.array_join(E.dictionary_tags(text), ",").alias("skills"),
                    F.array_join(E.dictionary_tags(text, E.TAG_BENEFITS), ",").alias("benefits"))


_FLAG_TEXT = """concat(CASE p_size % 6 WHEN 0 THEN 'Python et SQL, ' WHEN 1 THEN 'langage R ; ' WHEN 2 THEN 'Tableau / Power BI ' WHEN 3 THEN 'AWS ou Azure ou GCP '
  WHEN 4 THEN 'Spark et ETL ' ELSE 'aucune ' END, CASE p_partkey % 3 WHEN 0 THEN 'machine learning' WHEN 1 THEN 'deep learning' ELSE p_name END)"""
_FLAGS_SQL = E.skill_flags_sql("t")


@query("skill_flags_built", "SELECT p_partkey, " + ", ".join(f"CAST({v} AS BIGINT) AS {k}" for k, v in _FLAGS_SQL.items())
       + f" FROM (SELECT p_partkey, {_FLAG_TEXT} AS t FROM part)")
def q_skill_flags_built(spark, sf_dir):
    """E14 over text that names every skill."""
    d = read_table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_name"]).select("p_partkey", F.expr(_FLAG_TEXT).alias("t"))
    return finish(d.select("p_partkey", *[v.cast("long").alias(k) for k, v in E.skill_flags(F.col("t")).items()]))
