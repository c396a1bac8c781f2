"""Truth tables for the extraction and feature rules, including the reference's
quirks kept on purpose (SURVEY 7.3) and the exact values of FIXTURES 1.5."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import features as FT
from offerlake.functions import text as E


def one(spark, expr_fn, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr_fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [
    ("5 ans d'expérience minimum", 5.0),
    ("3-5 ans d'expérience", 4.0),
    ("3 à 5 ans d'exp", 4.0),
    ("Expérience : 7 ans", 7.0),
    ("minimum 2 ans", 2.0),
    ("junior 3 ans", 1.0),            # a seniority word beats the general "N ans" pattern
    ("Poste confirmé", 5.0),
    ("Senior Data Engineer", 8.0),
    ("12 ans", 12.0),
    ("150 ans d'expérience", None),   # invalid specific and general matches
    ("rien", None),
    (None, None),
])
def test_experience_years(spark, text, expected):
    assert one(spark, E.experience_years, text) == expected


@pytest.mark.parametrize("value,expected", [(120.0, None), (60.0, 15.0), (45.0, 22.5), (35.0, 25.0),
                                            (28.0, 28.0), (5.0, 5.0)])
def test_extreme_correction(spark, value, expected):
    # 26..30 is not capped although the limit is 25 (kept)
    assert one(spark, E.correct_extreme, value, "double") == expected


def test_experience_mean_over_sources(spark):
    df = spark.createDataFrame([("3 ans d'expérience", "Senior dev", None)], "a string, b string, c string")
    r = df.select(E.experience_final([F.col("a"), F.col("b"), F.col("c")]).alias("r")).first()["r"]
    assert r == pytest.approx((3.0 + 8.0) / 2)


@pytest.mark.parametrize("raw,expected", [("45k€", 45000.0), ("45,5k", 5000.0), ("45 000 €", 45000.0),
                                          ("45 000", None), ("sans", None), (None, None)])
def test_parse_salary(spark, raw, expected):
    assert one(spark, E.parse_salary, raw) == expected


@pytest.mark.parametrize("title,expected", [
    ("Data Analyst H/F Accenture", "Accenture"),
    ("Data Engineer F/H Capgemini Groupe", "Capgemini"),
    ("Consultant chez Sopra Steria", "Sopra Steria"),
    ("Data Scientist - Thales France", "Thales"),
    ("Ingénieur data (Orange)", "Orange"),
    ("Data Analyst H/F AB", None),       # too short after cleaning
    (None, None),
])
def test_company_from_title(spark, title, expected):
    assert one(spark, E.company_from_title, title) == expected


@pytest.mark.parametrize("text,expected", [("Poste basé à Paris 75008", "Paris"), ("Lyon 3e", "Lyon"),
                                           ("Site 31200 Colomiers", "Toulouse"), ("rien", None)])
def test_city_from_text(spark, text, expected):
    assert one(spark, E.city_from_text, text) == expected


@pytest.mark.parametrize("title,job,seniority", [
    ("Senior Data Scientist", "Data Scientist", "Senior"),
    ("Lead Data Engineer", "Data Engineer", "Lead/Manager"),
    ("Stage Data Analyst", "Data Analyst", "Stage/Alternance"),
    ("Développeur Power BI", "BI/Analytics", "Mid-level"),
    ("Comptable", "Autre", "Mid-level"),
    (None, "Autre", "Non spécifié"),
])
def test_title_rules(spark, title, job, seniority):
    assert one(spark, E.job_type, title) == job
    assert one(spark, E.seniority_from_title, title) == seniority


def test_job_type_via_description(spark):
    df = spark.createDataFrame([("Chargé d'études", "rejoindre une équipe data engineering pipeline")],
                               "t string, d string")
    assert df.select(E.job_type(F.col("t"), F.col("d"))).first()[0] == "Data Engineer (via description)"


@pytest.mark.parametrize("value,expected", [("master 2", "Bac+5"), ("Master 1", "Bac+5"), ("bac+8", "Bac"),
                                            ("BTS SIO", "Bac+2"), ("phd", "Doctorat"),
                                            ("école de commerce", "École De Commerce"), (None, "Non spécifié")])
def test_normalize_education(spark, value, expected):
    # earlier keys win: 'master 1' -> Bac+5 and 'bac+8' -> Bac (kept)
    assert one(spark, E.normalize_education, value) == expected


@pytest.mark.parametrize("value,expected", [("Télétravail partiel", 0.5), ("Full remote", 1.0), ("100%", 1.0),
                                            ("Oui", 0.0), ("Non", 0.0), (None, 0.0)])
def test_telework(spark, value, expected):
    assert one(spark, E.telework_numeric, value) == expected


@pytest.mark.parametrize("value,expected", [("Data Engineer (Senior)", "Data Engineer"),
                                            ("Unknown role", "Autre Data Role"),
                                            ("Spécialiste IA/ML", "Autre Data Role"), (None, "Autre")])
def test_simplify_job_type(spark, value, expected):
    assert one(spark, E.simplify_job_type, value) == expected


@pytest.mark.parametrize("raw,expected", [("['Python', 'SQL']", ["Python", "SQL"]), ("[' a ', '']", ["a"]),
                                          ("[]", []), ("nan", []), ("None", []), ("Python", ["Python"]),
                                          (None, [])])
def test_parse_list(spark, raw, expected):
    assert one(spark, E.parse_list, raw) == expected


def test_clean_description(spark):
    text = "Intro\n\n\nCréez votre compte et postulez candidature Le poste   Réf : 123 fin"
    assert one(spark, E.clean_description, text) == "Intro Le poste"
    assert one(spark, E.clean_description, None) == ""


def test_skill_flags_and_metrics(spark):
    df = spark.createDataFrame([("Python, SQL et machine learning sur AWS",)], "t string")
    flags = df.select(*[v.alias(k) for k, v in E.skill_flags(F.col("t")).items()]).first().asDict()
    assert flags["contient_python"] == 1 and flags["contient_sql"] == 1 and flags["contient_aws"] == 1
    assert flags["contient_machine_learning"] == 1 and flags["contient_spark"] == 0
    m = df.select(*[v.alias(k) for k, v in E.text_metrics(F.col("t")).items()]).first()
    assert m["description_word_count"] == 7 and m["description_length"] == 39


def test_dictionary_tags(spark):
    df = spark.createDataFrame([("We use Spark, Docker and git; mutuelle + RTT",)], "t string")
    tags = df.select(E.dictionary_tags(F.col("t")), E.dictionary_tags(F.col("t"), E.TAG_BENEFITS)).first()
    assert "Spark" in tags[0] and "Docker" in tags[0] and "Git" in tags[0]
    assert tags[1] == ["Mutuelle", "RTT"]


def test_fingerprint_matches_python_md5(spark):
    import hashlib
    df = spark.createDataFrame([("T", None, "Paris", 7)], "a string, b string, c string, d int")
    got = df.select(E.offer_fingerprint(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert got == hashlib.md5("T__Paris_7".encode()).hexdigest()


# ----------------------------------------------------------------------- features
def _profile(session, flags):
    cols = list(FT.SKILL_WEIGHTS) + ["contient_etl"]
    row = tuple(int(flags.get(c.replace("contient_", ""), 0)) for c in cols)
    return session.createDataFrame([row], ", ".join(f"{c} int" for c in cols))


@pytest.mark.parametrize("skills,count,score", [
    ({"python": 1, "sql": 1, "aws": 1, "machine_learning": 1}, 4, 7),
    ({}, 0, 0),
    ({"python": 1, "sql": 1, "machine_learning": 1, "deep_learning": 1, "aws": 1}, 5, 9),
    ({"python": 1, "sql": 1, "tableau": 1}, 3, 5),
])
def test_skill_count_and_technical_score(spark, skills, count, score):
    df = _profile(spark, skills)
    r = df.select(FT.skills_count(df).alias("c"), FT.technical_score(df).alias("s")).first()
    assert (r["c"], r["s"]) == (count, score)


def test_technical_score_cap(spark):
    df = _profile(spark, {k.replace("contient_", ""): 1 for k in FT.SKILL_WEIGHTS})
    assert df.select(FT.technical_score(df)).first()[0] == 15


def test_interpolate_pins_code_not_docstring(spark):
    df = spark.createDataFrame([(3.0,), (-1.0,), (9.0,)], "v double")
    outs = [F.lit(10), F.lit(20), F.lit(30)]
    got = [r[0] for r in df.select(FT.interpolate(F.col("v"), [0, 2, 5], outs)).collect()]
    assert got == [23, 10, 30]


@pytest.mark.parametrize("exp,label", [(0.5, "Stage/Alternance"), (2.5, "Junior (1-3 ans)"), (4.0, "Mid-level"),
                                       (6.0, "Senior (5-8 ans)"), (20.0, "Expert (8-12 ans)")])
def test_seniority_from_experience(spark, exp, label):
    assert one(spark, FT.seniority_from_experience, exp, "double") == label


def test_complexity_band_is_right_closed(spark):
    df = spark.createDataFrame([(2,), (3,), (10,), (11,)], "n int")
    assert [r[0] for r in df.select(FT.complexity_band(F.col("n"))).collect()] == \
        ["Faible", "Moyenne", "Élevée", "Très élevée"]


def test_paris_region_and_major_city(spark):
    df = spark.createDataFrame([("75001",), ("Paris",), ("Lyon 69000",), ("92100",)], "l string")
    got = df.select(FT.is_paris_region(F.col("l")), FT.is_major_city(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [(1, 0), (0, 1), (0, 1), (1, 0)]
