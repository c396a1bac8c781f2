"""Offer-text extraction as native Spark expressions.

Each extractor is a function Column -> Column built from regexp/when/coalesce,
so it runs inside whole-stage codegen with no Python per row. Ordered rule
lists are data: the first rule that yields a valid value wins.

Each builder has a ``*_sql`` twin producing the same expression as DuckDB SQL
text (oracle side). Regexes are written to mean the same in Java and RE2:
no ``\\b`` (engines disagree on it) but explicit letter/digit classes, and no
look-ahead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Experience patterns, in the reference's order.
# (pattern, kind) where kind is "range" (two numbers -> mean) or "single".
EXPERIENCE_SPECIFIC = (
    (r"(\d+)\s*[àa-]\s*(\d+)\s*ans?\s*d['’]?exp[eé]rience", "range"),
    (r"(\d+)\s*[àa-]\s*(\d+)\s*ans?\s*d['’]?exp", "range"),
    (r"(\d+)\s*ans?\s*d['’]?exp[eé]rience", "single"),
    (r"(\d+)ans?\s*d['’]?exp", "single"),
    (r"minimum\s*(\d+)\s*ans?", "single"),
    (r"(\d+)\s*ans?\s*minimum", "single"),
    (r"exp[eé]rience\s*:\s*(\d+)\s*ans?", "single"),
)
EXPERIENCE_GENERAL = (
    (r"(\d+)\s*à\s*(\d+)\s*ans?", "range"),
    (r"(\d+)\s*-\s*(\d+)\s*ans?", "range"),
    (r"(\d+)\s*ans?", "single"),
)
# Seniority words -> years, in order (whole words).
SENIORITY_YEARS = (
    ("junior", 1.0), ("débutant", 1.0), ("jeune diplômé", 1.0), ("entry level", 1.0),
    ("confirmé", 5.0), ("expérimenté", 8.0), ("senior", 8.0), ("sénior", 8.0),
    ("expert", 10.0), ("lead", 10.0), ("manager", 10.0), ("chef", 10.0), ("responsable", 10.0),
)
# Company-from-title patterns and the suffixes stripped from a match.
COMPANY_PATTERNS = (
    r"H/F\s+([A-ZÀ-Ÿ][A-Za-zÀ-Ÿ0-9\s&\.\-]+)(?:\s*Siège|\s*Groupe|$)",
    r"F/H\s+([A-ZÀ-Ÿ][A-Za-zÀ-Ÿ0-9\s&\.\-]+)(?:\s*Siège|\s*Groupe|$)",
    r"chez\s+([A-ZÀ-Ÿ][A-Za-zÀ-Ÿ0-9\s&\.\-]+)(?:\s*Siège|$)",
    r"-\s+([A-ZÀ-Ÿ][A-Za-zÀ-Ÿ0-9\s&\.\-]+)\s*$",
    r"H/F(?:.*H/F)?\s*([A-ZÀ-Ÿ][A-Za-zÀ-Ÿ0-9\s&\.\-]+)\s*$",
    r"\(([A-ZÀ-Ÿ][A-Za-zÀ-Ÿ0-9\s&\.\-]+)\)",
)
COMPANY_SUFFIX = r"\s*(?:Siège|Groupe|ESN|Cabinet|France|Company|Corp|Ltd)$"
# City keywords (substring, in order) and postcode prefixes.
CITY_KEYWORDS = (
    ("Paris", ("paris", "750", "75 ", "île-de-france")),
    ("Lyon", ("lyon", "69000", "69 ", "rhône")),
    ("Marseille", ("marseille", "13000", "13 ")),
    ("Toulouse", ("toulouse", "31000", "31 ")),
    ("Bordeaux", ("bordeaux", "33000", "33 ")),
    ("Lille", ("lille", "59000", "59 ", "nord")),
    ("Nice", ("nice", "06000")),
    ("Nantes", ("nantes", "44000")),
    ("Strasbourg", ("strasbourg", "67000")),
    ("Rennes", ("rennes", "35000")),
    ("Grenoble", ("grenoble", "38000")),
    ("Montpellier", ("montpellier", "34000")),
)
POSTCODE_PREFIX = (
    ("75", "Paris"), ("69", "Lyon"), ("13", "Marseille"), ("31", "Toulouse"), ("33", "Bordeaux"),
    ("59", "Lille"), ("06", "Nice"), ("44", "Nantes"), ("67", "Strasbourg"), ("35", "Rennes"),
    ("38", "Grenoble"), ("34", "Montpellier"),
)
# Job-type categories and their patterns, in order.
JOB_TYPE_PATTERNS = (
    ("Data Analyst", (r"data.*analyst", r"analyste.*data", r"business.*data.*analyst",
                      r"growth.*analyst", r"product.*analyst")),
    ("Data Scientist", (r"data.*scientist", r"scientist.*data", r"machine.*learning.*scientist",
                        r"ai.*scientist", r"research.*scientist")),
    ("Data Engineer", (r"data.*engineer", r"ingénieur.*data", r"big.*data.*engineer",
                       r"etl.*developer", r"data.*pipeline")),
    ("BI/Analytics", (r"bi.*developer", r"business.*intelligence", r"power.*bi",
                      r"tableau", r"analytics.*engineer")),
    ("Data Management", (r"data.*manager", r"chief.*data.*officer", r"head.*of.*data",
                         r"data.*governance", r"data.*architect")),
    ("AI/ML Specialist", (r"ai.*specialist", r"ml.*specialist", r"llm.*engineer",
                          r"nlp.*engineer", r"computer.*vision")),
)
# Seniority level from title substrings, in order.
SENIORITY_LEVELS = (
    ("Junior", ("junior", "jr", "débutant", "entry level", "graduate")),
    ("Senior", ("senior", "sr", "expérimenté", "confirmé", "expert")),
    ("Lead/Manager", ("lead", "principal", "chef", "responsable", "manager", "head of", "director")),
    ("Stage/Alternance", ("stage", "alternance", "intern", "apprenti")),
    ("Freelance/Consultant", ("freelance", "consultant", "independent")),
)
# Boilerplate removed from descriptions (ignore case, dot matches newline).
BOILERPLATE = (
    r"Trouver mon\s*j\s*ob.*?Mon compte\s*",
    r"Créez votre compte.*?candidature",
    r"Ces offres pourraient.*?intéresser",
    r"L'entreprise\s*Qui sommes-nous\?.*?(?=Le job|Détail|$)",
    r"Content missing",
    r"Publiée le \d{2}/\d{2}/\d{4}.*",
    r"Réf\s*:.*",
    r"Job ID:.*",
)
# Skill flags = any of the substrings in the lower-cased text.
SKILL_FLAGS = (
    ("contient_sql", ("sql",)),
    ("contient_python", ("python",)),
    ("contient_r", (" r ", "r,")),
    ("contient_tableau", ("tableau",)),
    ("contient_power_bi", ("power bi", "powerbi")),
    ("contient_aws", ("aws",)),
    ("contient_azure", ("azure",)),
    ("contient_gcp", ("gcp", "google cloud")),
    ("contient_spark", ("spark",)),
    ("contient_machine_learning", ("machine learning", "ml ")),
    ("contient_deep_learning", ("deep learning",)),
    ("contient_etl", ("etl", "elt")),
)
TECH_KEYWORDS = ("sql", "python", "r", "tableau", "power bi", "aws", "azure", "gcp", "spark",
                 "hadoop", "kafka", "docker")
# Education substrings -> level, in order (earlier keys win).
EDUCATION_MAP = (
    ("bac+5", "Bac+5"), ("master", "Bac+5"), ("ingénieur", "Bac+5"),
    ("bac+3", "Bac+3"), ("licence", "Bac+3"), ("bachelor", "Bac+3"),
    ("bac+4", "Bac+4"), ("master 1", "Bac+4"),
    ("bac+2", "Bac+2"), ("dut", "Bac+2"), ("bts", "Bac+2"),
    ("bac", "Bac"),
    ("doctorat", "Doctorat"), ("phd", "Doctorat"), ("bac+8", "Doctorat"),
)
# Simplified job families (substring of the job type), in order.
SIMPLE_JOB_TYPES = ("Data Analyst", "Data Scientist", "Data Engineer", "BI/Analytics",
                    "AI/ML", "Data Consultant", "Data Management")
# Dictionary tags found in page text.
TAG_SKILLS = ("Python", "SQL", "R", "Spark", "TensorFlow", "PyTorch", "AWS", "Azure", "GCP", "Tableau",
              "Power BI", "Machine Learning", "Deep Learning", "Docker", "Kubernetes", "Airflow",
              "Kafka", "Snowflake", "Git", "PostgreSQL", "MongoDB")
TAG_BENEFITS = ("Tickets restaurant", "Mutuelle", "RTT", "Prime", "Bonus", "Intéressement",
                "Télétravail", "Formation", "CSE", "13ème mois", "Stock options")

WORD_EDGE_L = r"(^|[^\pL\pN_])"
WORD_EDGE_R = r"([^\pL\pN_]|$)"
UNSPECIFIED = "Non spécifié"


def _sq(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def _coalesce_sql(parts: list[str]) -> str:
    return parts[0] if len(parts) == 1 else "coalesce(" + ", ".join(parts) + ")"


# --------------------------------------------------------------------- E6
def normalize_text(c: Column) -> Column:
    """lower, CR/LF -> space, collapse whitespace, strip."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\r\n]", " "), r"(?U)\s+", " "))


def normalize_text_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({c}), '[\\r\\n]', ' ', 'g'), '\\s+', ' ', 'g'))"


# --------------------------------------------------------------------- E2-E4
def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` (a lambda
    variable), so a long expression does not repeat it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pattern_years(text: Column, pat: str, kind: str) -> Column:
    def years(a: Column, b: Column | None) -> Column:
        ok_a = (a >= 0) & (a <= 100)
        if b is None:
            return F.when(ok_a, a)
        return F.when(ok_a & (b >= 0) & (b <= 100) & (a <= b), (a + b) / 2)

    if kind == "single":
        return let(F.regexp_extract(text, pat, 1).try_cast("double"), lambda a: years(a, None))
    groups = F.struct(F.regexp_extract(text, pat, 1).try_cast("double").alias("a"),
                      F.regexp_extract(text, pat, 2).try_cast("double").alias("b"))
    return let(groups, lambda g: years(g["a"], g["b"]))


def _pattern_years_sql(text: str, pat: str, kind: str) -> str:
    a = f"TRY_CAST(regexp_extract({text}, {_sq(pat)}, 1) AS DOUBLE)"
    ok_a = f"({a} >= 0 AND {a} <= 100)"
    if kind == "single":
        return f"CASE WHEN {ok_a} THEN {a} END"
    b = f"TRY_CAST(regexp_extract({text}, {_sq(pat)}, 2) AS DOUBLE)"
    return f"CASE WHEN {ok_a} AND {b} >= 0 AND {b} <= 100 AND {a} <= {b} THEN ({a} + {b}) / 2 END"


def _word(w: str) -> str:
    return WORD_EDGE_L + w + WORD_EDGE_R


def experience_years(raw: Column) -> Column:
    """E2 specific patterns, else E3 seniority words, else E4 general patterns."""
    def from_text(t: Column) -> Column:
        specific = [_pattern_years(t, p, k) for p, k in EXPERIENCE_SPECIFIC]
        words = reduce(lambda acc, wy: acc.when(t.rlike("(?iu)" + _word(wy[0])), F.lit(wy[1])),
                       SENIORITY_YEARS[1:],
                       F.when(t.rlike("(?iu)" + _word(SENIORITY_YEARS[0][0])), F.lit(SENIORITY_YEARS[0][1])))
        general = [_pattern_years(t, p, k) for p, k in EXPERIENCE_GENERAL]
        return F.coalesce(*specific, words, *general)

    return F.when(raw.isNotNull(), let(normalize_text(raw), from_text))


def experience_years_sql(raw: str) -> str:
    t = normalize_text_sql(raw)
    specific = [_pattern_years_sql(t, p, k) for p, k in EXPERIENCE_SPECIFIC]
    words = "CASE " + " ".join(
        f"WHEN regexp_matches({t}, {_sq('(?i)' + _word(w))}) THEN {y}" for w, y in SENIORITY_YEARS) + " END"
    general = [_pattern_years_sql(t, p, k) for p, k in EXPERIENCE_GENERAL]
    return f"CASE WHEN {raw} IS NOT NULL THEN {_coalesce_sql(specific + [words] + general)} END"


# --------------------------------------------------------------------- E5
def correct_extreme(v: Column) -> Column:
    """>100 NULL; >50 min(25, v/4); >40 min(25, v/2); >30 -> 25; else unchanged."""
    return (F.when(v > 100, F.lit(None).cast("double"))
            .when(v > 50, F.least(F.lit(25.0), v / 4))
            .when(v > 40, F.least(F.lit(25.0), v / 2))
            .when(v > 30, F.least(F.lit(25.0), v))
            .otherwise(v))


def correct_extreme_sql(v: str) -> str:
    return (f"CASE WHEN {v} > 100 THEN NULL WHEN {v} > 50 THEN least(25.0, {v} / 4) "
            f"WHEN {v} > 40 THEN least(25.0, {v} / 2) WHEN {v} > 30 THEN least(25.0, {v}) ELSE {v} END")


def experience_final(sources: list[Column]) -> Column:
    """Mean over the sources that yield a value, then extreme-value correction."""
    vals = F.filter(F.array(*[experience_years(s) for s in sources]), lambda x: x.isNotNull())
    mean = let(vals, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v)))
    return let(mean, correct_extreme)


# --------------------------------------------------------------------- E7, E8
def parse_salary(raw: Column) -> Column:
    """lower, drop U+0020; with a 'k': first number before k x1000; else first digit run."""
    s = F.regexp_replace(F.lower(raw), " ", "")
    k_num = F.regexp_extract(s, r"(\d+\.?\d*)\s*k", 1)
    # (?U): Python's \s also matches NBSP, so '45\u00a0000' yields no integer (kept)
    digits = F.regexp_extract(s, r"(?U)([\d\s]+)", 1)
    return (F.when(raw.isNull(), F.lit(None).cast("double"))
            .when(s.contains("k") & (k_num != ""), k_num.try_cast("double") * 1000)
            .when(digits != "", digits.try_cast("long").cast("double")))


def parse_salary_sql(raw: str) -> str:
    s = f"replace(lower({raw}), ' ', '')"
    k_num = f"regexp_extract({s}, '(\\d+\\.?\\d*)\\s*k', 1)"
    digits = f"regexp_extract({s}, '([\\d\\s]+)', 1)"
    return (f"CASE WHEN {raw} IS NULL THEN NULL "
            f"WHEN contains({s}, 'k') AND {k_num} <> '' THEN TRY_CAST({k_num} AS DOUBLE) * 1000 "
            f"WHEN {digits} <> '' THEN CAST(TRY_CAST({digits} AS BIGINT) AS DOUBLE) END")


def salary_mid_range(lo: Column, hi: Column) -> tuple[Column, Column]:
    return (lo + hi) / 2, hi - lo


# --------------------------------------------------------------------- E9
def company_from_title(title: Column) -> Column:
    cands = []
    for pat in COMPANY_PATTERNS:
        m = F.trim(F.regexp_extract(title, "(?iu)" + pat, 1))
        cleaned = F.trim(F.regexp_replace(m, "(?iu)" + COMPANY_SUFFIX, ""))
        cands.append(F.when(F.length(cleaned) > 2, cleaned))
    return F.coalesce(*cands)


def company_from_title_sql(title: str) -> str:
    cands = []
    for pat in COMPANY_PATTERNS:
        m = f"trim(regexp_extract({title}, {_sq('(?i)' + pat)}, 1))"
        cleaned = f"trim(regexp_replace({m}, {_sq('(?i)' + COMPANY_SUFFIX)}, ''))"
        cands.append(f"CASE WHEN length({cleaned}) > 2 THEN {cleaned} END")
    return _coalesce_sql(cands)


# --------------------------------------------------------------------- E10
def city_from_text(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for city, kws in CITY_KEYWORDS:
        cond = reduce(lambda a, b: a | b, [low.contains(k) for k in kws])
        out = F.when(cond, F.lit(city)) if out is None else out.when(cond, F.lit(city))
    cp = F.regexp_extract(text, r"(^|[^\pL\pN_])(\d{5})([^\pL\pN_]|$)", 2)
    prefix_map = F.create_map(*[F.lit(x) for kv in POSTCODE_PREFIX for x in kv])
    by_cp = F.when(cp != "", F.try_element_at(prefix_map, F.substring(cp, 1, 2)))
    return F.when(text.isNotNull(), out.otherwise(by_cp))


# --------------------------------------------------------------------- E11
def _job_match(text: Column, suffix: str = "") -> Column:
    out = None
    for cat, pats in JOB_TYPE_PATTERNS:
        cond = text.rlike("(?iu)(" + "|".join(pats) + ")")
        label = F.lit(cat + suffix)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def job_type(title: Column, description: Column | None = None) -> Column:
    """Title first; then the description with the suffix ' (via description)'; else 'Autre'."""
    t = _job_match(F.lower(title))
    if description is not None:
        d = _job_match(F.lower(description), " (via description)")
        t = F.coalesce(t, F.when(F.coalesce(description, F.lit("")) != "", d))
    return F.when(title.isNull(), F.lit("Autre")).otherwise(F.coalesce(t, F.lit("Autre")))


def job_type_sql(title: str, description: str | None = None) -> str:
    def cases(col: str, suffix: str = "") -> str:
        return " ".join(f"WHEN regexp_matches(lower({col}), {_sq('(?i)(' + '|'.join(p) + ')')}) "
                        f"THEN {_sq(c + suffix)}" for c, p in JOB_TYPE_PATTERNS)
    desc = ""
    if description:
        desc = (f" WHEN coalesce({description}, '') <> '' THEN CASE {cases(description, ' (via description)')} "
                f"ELSE 'Autre' END")
    return f"CASE WHEN {title} IS NULL THEN 'Autre' {cases(title)}{desc} ELSE 'Autre' END"


# --------------------------------------------------------------------- E12
def seniority_from_title(title: Column) -> Column:
    low = F.lower(title)
    out = F.when(title.isNull(), F.lit(UNSPECIFIED))
    for level, kws in SENIORITY_LEVELS:
        out = out.when(reduce(lambda a, b: a | b, [low.contains(k) for k in kws]), F.lit(level))
    return out.otherwise(F.lit("Mid-level"))


def seniority_from_title_sql(title: str) -> str:
    cases = " ".join("WHEN " + " OR ".join(f"contains(lower({title}), {_sq(k)})" for k in kws)
                     + f" THEN {_sq(level)}" for level, kws in SENIORITY_LEVELS)
    return f"CASE WHEN {title} IS NULL THEN {_sq(UNSPECIFIED)} {cases} ELSE 'Mid-level' END"


# --------------------------------------------------------------------- E13
def clean_description(desc: Column) -> Column:
    t = desc
    for pat in BOILERPLATE:
        t = F.regexp_replace(t, "(?isu)" + pat, "")
    t = F.regexp_replace(t, r"(?U)\n\s*\n+", "\n\n")
    t = F.regexp_replace(t, r"(?U)\s+", " ")
    return F.coalesce(F.trim(t), F.lit(""))


def clean_description_sql(desc: str) -> str:
    t = desc
    for pat in BOILERPLATE:
        if "(?=" in pat:   # RE2 has no look-ahead: keep the stop word through a group
            body, stop = pat.split("(?=")
            t = f"regexp_replace({t}, {_sq('(?is)' + body + '(' + stop)}, '\\1', 'g')"
        else:
            t = f"regexp_replace({t}, {_sq('(?is)' + pat)}, '', 'g')"
    t = f"regexp_replace({t}, '\\n\\s*\\n+', '\n\n', 'g')"
    t = f"regexp_replace({t}, '\\s+', ' ', 'g')"
    return f"coalesce(trim({t}), '')"


# --------------------------------------------------------------------- E14, E15
def skill_flags(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {name: reduce(lambda a, b: a | b, [low.contains(k) for k in kws]).cast("int")
            for name, kws in SKILL_FLAGS}


def skill_flags_sql(text: str) -> dict[str, str]:
    return {name: "CAST((" + " OR ".join(f"contains(lower({text}), {_sq(k)})" for k in kws) + ") AS INTEGER)"
            for name, kws in SKILL_FLAGS}


def word_count(text: Column) -> Column:
    """Whitespace-separated words (Python's str.split())."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def text_metrics(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    return {
        "description_length": F.length(text),
        "description_word_count": word_count(text),
        "nb_mots_cles_techniques": reduce(lambda a, b: a + b,
                                          [low.contains(k).cast("int") for k in TECH_KEYWORDS]),
    }


def text_metrics_sql(text: str) -> dict[str, str]:
    return {
        "description_length": f"length({text})",
        "description_word_count": f"len(regexp_extract_all({text}, '\\S+'))",
        "nb_mots_cles_techniques": " + ".join(
            f"CAST(contains(lower({text}), {_sq(k)}) AS INTEGER)" for k in TECH_KEYWORDS),
    }


# --------------------------------------------------------------------- E16, E17
def normalize_education(v: Column) -> Column:
    s = F.lower(F.trim(v))
    out = F.when(v.isNull(), F.lit(UNSPECIFIED))
    for key, level in EDUCATION_MAP:
        out = out.when(s.contains(key), F.lit(level))
    return out.otherwise(python_title(s))


def python_title(s: Column) -> Column:
    """str.title(): upper-case a letter that follows a non-letter, lower-case the rest."""
    words = F.regexp_extract_all(s, F.lit(r"(\pL+|[^\pL]+)"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                              F.lower(F.substring(w, 2, 1 << 20)))), "")


def normalize_education_sql(v: str) -> str:
    s = f"lower(trim({v}))"
    cases = " ".join(f"WHEN contains({s}, {_sq(k)}) THEN {_sq(lv)}" for k, lv in EDUCATION_MAP)
    titled = (f"array_to_string(list_transform(regexp_extract_all({s}, '(\\pL+|[^\\pL]+)', 1), "
              f"lambda w: upper(w[1]) || lower(w[2:])), '')")
    return f"CASE WHEN {v} IS NULL THEN {_sq(UNSPECIFIED)} {cases} ELSE {titled} END"


def telework_numeric(v: Column) -> Column:
    s = F.lower(v)
    return (F.when(v.isNull(), F.lit(0.0))
            .when(s.contains("100%") | s.contains("full remote"), F.lit(1.0))
            .when(s.contains("partiel") | s.contains("hybride"), F.lit(0.5))
            .otherwise(F.lit(0.0)))


def telework_numeric_sql(v: str) -> str:
    s = f"lower({v})"
    return (f"CAST(CASE WHEN {v} IS NULL THEN 0.0 WHEN contains({s}, '100%') OR contains({s}, 'full remote') "
            f"THEN 1.0 WHEN contains({s}, 'partiel') OR contains({s}, 'hybride') THEN 0.5 ELSE 0.0 END AS DOUBLE)")


# --------------------------------------------------------------------- E18, E19
def is_data_job(job: Column) -> Column:
    return job != F.lit("Autre")


def simplify_job_type(job: Column) -> Column:
    out = F.when(job.isNull(), F.lit("Autre"))
    for name in SIMPLE_JOB_TYPES:
        out = out.when(job.contains(name), F.lit(name))
    return out.otherwise(F.lit("Autre Data Role"))


def simplify_job_type_sql(job: str) -> str:
    cases = " ".join(f"WHEN contains({job}, {_sq(n)}) THEN {_sq(n)}" for n in SIMPLE_JOB_TYPES)
    return f"CASE WHEN {job} IS NULL THEN 'Autre' {cases} ELSE 'Autre Data Role' END"


# --------------------------------------------------------------------- E1
def parse_list(raw: Column) -> Column:
    """NULL -> []; '[...]' literal -> trimmed non-empty strings; '', '[]', 'nan',
    'NaN', 'None' -> []; anything else -> [value]."""
    s = F.trim(raw)
    # a Python literal: None and booleans are written as JSON strings, so that they stay elements
    literal = F.regexp_replace(s, r"(?<=[\[,\s])(None|True|False)(?=\s*[,\]])", "'$1'")
    parsed = F.from_json(literal, "array<string>", {"allowSingleQuotes": "true"})
    cleaned = F.filter(F.transform(parsed, lambda x: F.trim(x)), lambda x: x != "")
    empty = F.array().cast("array<string>")
    return (F.when(raw.isNull(), empty)
            .when(s.startswith("[") & s.endswith("]") & parsed.isNotNull(), cleaned)
            .when(s.isin("", "[]", "nan", "NaN", "None"), empty)
            .otherwise(F.array(s)))


def split_joined(raw: Column) -> Column:
    """The lists of a collected file, which its sink joined with commas: trimmed non-empty parts."""
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != ""), empty)


# --------------------------------------------------------------------- E22
def dictionary_tags(text: Column, words=TAG_SKILLS) -> Column:
    """Words found in the text, case-insensitive substring, in dictionary order."""
    words_arr = F.array(*[F.lit(w.lower()) for w in words])
    names = F.array(*[F.lit(w) for w in words])
    # lower-case the text once per row, not once per dictionary word
    return let(F.lower(text), lambda low: F.filter(
        F.transform(F.arrays_zip(names.alias("n"), words_arr.alias("l")),
                    lambda z: F.when(low.contains(z["l"]), z["n"])), lambda x: x.isNotNull()))


def dictionary_tags_sql(text: str, words=TAG_SKILLS) -> str:
    lst = "[" + ", ".join(_sq(w) for w in words) + "]"
    return f"list_filter({lst}, lambda w: contains(lower({text}), lower(w)))"


# --------------------------------------------------------------------- E23
def offer_fingerprint(*cols: Column) -> Column:
    """MD5 of 'title_company_location_id' with missing parts as ''."""
    return F.md5(F.concat_ws("_", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
