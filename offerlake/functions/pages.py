"""Offer records from raw HTML pages, as native expressions.

The reference ran JavaScript in a browser per page; here a ``pages(url, html)`` table is
processed whole, without a browser: ``visible_text`` gives the text that a page shows (hidden elements dropped,
blocks on lines of their own, inline tags joined, entities decoded) and a regexp per field reads it.
White space in the patterns is that of JavaScript, non-breaking space included;
``\\b`` is ASCII-only there, so it is written as an explicit ``[^A-Za-z0-9_]`` edge. Java and RE2 read both the same way.

Listing cards are found by matching elements: tags become rows, and the running depth of a
tag's name pairs every start with its end, so elements nested in a card do not end it.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from offerlake.functions.text import _sq, let

JS_L = r"(^|[^A-Za-z0-9_])"
JS_R = r"([^A-Za-z0-9_]|$)"
#: JavaScript's white space, inside and as a character class.
WS = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def js(pattern: str) -> str:
    """A JavaScript pattern with its white space spelt out."""
    inside = False
    out, at = [], 0
    while at < len(pattern):
        if pattern.startswith(r"\s", at):
            out.append(WS if inside else f"[{WS}]")
            at += 2
            continue
        step = 2 if pattern[at] == "\\" else 1
        inside = (inside or pattern[at] == "[") and pattern[at] != "]"
        out.append(pattern[at:at + step])
        at += step
    return "".join(out)


# Contract words (first match wins), sector words, salary,
# experience and education patterns of the detail-page extractor.
CONTRACTS = ("CDI", "CDD", "Stage", "Alternance")
SECTOR_PATTERN = (r"(Banque|Finance|Assurance|E-commerce|Tech|Conseil|Industrie|Santé|Énergie|Transport|"
                  r"Logistique|Retail|Agroalimentaire|Pharmaceutique)")
SALARY_PATTERNS = tuple(map(js, (
    r"(\d{2}\s?\d{3})[\s-]+(\d{2}\s?\d{3})\s*€",
    r"(\d{2}\s?\d{3})\s*€",
)))
EXPERIENCE_PATTERNS = tuple(map(js, (
    r"(\d+)\s*(?:à|-)\s*(\d+)\s*ans?",
    r"(\d+)\s*ans?\s*(?:d')?(?:expérience)",
    r"(?:Junior|Confirmé|Senior|Expert)",
)))
EDUCATION_PATTERNS = tuple(map(js, (r"Bac\s*\+\s*(\d+)", r"(?:Master|M1|M2|Doctorat|Ingénieur)")))
COMPANY_SIZE_PATTERNS = tuple(map(js, (
    r"(\d+)\s*(?:à|-)\s*(\d+)\s*(?:salariés?|employés?|collaborateurs?)",
    r"(\d+)\s*(?:salariés?|employés?)",
    r"(?:TPE|PME|ETI|Grande? entreprise|Startup|Scale-up)",
)))
TELEWORK_PATTERN = r"(télétravail|remote|hybride)"
TELEWORK_PHRASE = js(TELEWORK_PATTERN + r"[\s:]*[^\n.]+")
PUBLICATION_PATTERN = js(r"(?:Publiée?|Postée?)\s*(?:le|il y a)?\s*([^\n]+)")
MISSIONS = js(r"(?:Missions?|Vos missions|Responsabilités)[:\s]+(.*?)")
MISSIONS_END = r"\n\n|Profil|Compétences|$"
PROFILE = js(r"(?:Profil recherché|Profil|Vous êtes)[:\s]+(.*?)")
PROFILE_END = r"\n\n|Nous offrons|Avantages|$"


# Place and card-field patterns of the listing extractor.
LOCATION_PATTERN = js(r"([A-ZÀ-Ÿ][a-zà-ÿ\s-]+(?:\s*-\s*|\s+)\d{2,5})")
CARD_CITY = r"(?iu)Paris|Lyon|Marseille|Toulouse|Lille|Bordeaux|Nantes|Nice|Strasbourg|Montpellier|Rennes|Île-de-France"
CARD_SALARY = js(r"(\d{2}\s?\d{3}(?:[\s-]+\d{2}\s?\d{3})?\s*€(?:/an|/mois)?)")
CARD_DATE = js(r"(?:il y a|Publiée? il y a|Publiée?)\s+([^\n]+)")
NOT_A_COMPANY = r"(?iu)\d{2,5}|CDI|CDD|Stage|Alternance|€|Paris|Lyon|Marseille"
OFFER_LINK = r"/emplois/(\d+)\.html"
UNKNOWN = "Non spécifié"

# Elements that are not shown, that start a line, and that have no end tag.
HIDDEN = ("script", "style", "template", "noscript", "head")
BLOCKS = ("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
          "header hr html legend li main nav ol pre section summary table tbody tfoot thead tr ul").split()
VOID = "area base br col embed hr img input link meta source track wbr".split()
#: A tag, and the pieces that a page is cut into: tags and the text between them.
TAG = r"</?[a-zA-Z][^>]*>"
PIECE = TAG + r"|[^<]+|<"
ENTITY = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
AMPERSAND = ("amp", "#38", "#x26", "#X26")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends (SQL's trim only takes blanks)."""
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def trimmed_sql(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def entity_points() -> dict[str, int]:
    """Code points of the named entities and of the numbers that HTML reads as Windows-1252."""
    named = dict(name2codepoint) | {"apos": 39}
    windows = {f"#{n}": ord(c) for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))}
    return named | windows


def _entity(e: Column) -> Column:
    """The character of an entity's name or number; the entity itself where there is none."""
    table = F.create_map(*[F.lit(x) for pair in sorted(entity_points().items()) for x in pair])
    number = F.when(e.rlike("^#[xX]"), F.conv(F.substring(e, 3, 6), 16, 10).cast("int")).when(
        e.startswith("#"), F.substring(e, 2, 7).cast("int"))
    point = F.coalesce(F.try_element_at(table, e), number)
    bad = (point == 0) | (point > 0x10FFFF) | point.between(0xD800, 0xDFFF)
    whole = F.decode(F.unhex(F.lpad(F.hex(F.when(bad, F.lit(0xFFFD)).otherwise(point)), 8, "0")), "UTF-32")
    return F.coalesce(whole, F.concat(F.lit("&"), e, F.lit(";")))


def decode_entities(text: Column) -> Column:
    """Named and numeric character references as characters, each read once (``&amp;lt;`` gives ``&lt;``)."""
    def decoded(t: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(t, F.lit(ENTITY), 1))
        others = F.filter(found, lambda e: ~e.isin(*AMPERSAND))
        replaced = F.aggregate(others, t, lambda acc, e: F.replace(acc, F.concat(F.lit("&"), e, F.lit(";")), _entity(e)))
        return F.when(t.contains("&"), F.regexp_replace(replaced, f"&({'|'.join(AMPERSAND)});", "&")).otherwise(t)

    return let(text, decoded)


def decode_entities_sql(text: str) -> str:
    table = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in sorted(entity_points().items())) + "}"
    point = (f"coalesce({table}[e], CASE WHEN regexp_matches(e, '^#[xX]') THEN ('0x' || substring(e, 3, 6))::BIGINT "
             f"WHEN starts_with(e, '#') THEN substring(e, 2, 7)::BIGINT END)")
    char = (f"coalesce(list_transform([{point}], lambda n: CASE WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) "
            f"WHEN n IS NOT NULL THEN chr(n::INTEGER) END)[1], '&' || e || ';')")
    others = f"list_filter(list_distinct(regexp_extract_all({text}, {_sq(ENTITY)}, 1)), lambda e: e NOT IN {AMPERSAND})"
    pairs = f"list_transform({others}, lambda e: ['&' || e || ';', {char}])"
    decoded = f"list_reduce(list_prepend([{text}, ''], {pairs}), lambda a, e: [replace(a[1], e[1], e[2]), ''])[1]"
    return f"regexp_replace({decoded}, '&({'|'.join(AMPERSAND)});', '&', 'g')"


#: Steps from HTML without comments to shown text: pattern and replacement. A paragraph leaves an empty
#: line around it and a block a line end, whichever of neighbouring ones is larger.
_SHOWN = (
    (r"[ \t\r\n\f]+", " "), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</?p(?:\s[^>]*)?>", "\ue002"),
    (rf"(?i)</?(?:{'|'.join(BLOCKS)})(?:\s[^>]*)?>", "\ue001"), (r"(?i)</t[dh]\s*>", "\t"), (r"</?[a-zA-Z!?][^>]*>", ""),
)
_LINES = ((r" *[ \x{E001}]*\x{E002}[ \x{E001}\x{E002}]*", "\n\n"), (r" *\x{E001}[ \x{E001}]*", "\n"), (r" *\n *", "\n"),
          (r" {2,}", " "), (r"^[ \t\n]+|[ \t\n]+$", ""))
_COMMENT = r"(?s)<!--.*?-->"


def _hidden(name: str) -> str:
    return rf"(?is)<{name}(?:\s[^>]*)?>.*?</{name}\s*>"


def without_hidden(html: Column) -> Column:
    """HTML without comments and elements that are not shown."""
    t = F.regexp_replace(F.translate(html, "\ue001\ue002", ""), _COMMENT, "")
    for name in HIDDEN:
        t = F.regexp_replace(t, _hidden(name), "")
    return t


def shown(html: Column) -> Column:
    """The text that HTML without hidden elements shows."""
    for pattern, to in _SHOWN:
        html = F.regexp_replace(html, pattern, to)
    html = decode_entities(html)
    for pattern, to in _LINES:
        html = F.regexp_replace(html, pattern, to)
    return html


def visible_text(html: Column) -> Column:
    """The text that a page shows, as a browser's ``innerText`` has it."""
    return shown(without_hidden(html))


def visible_text_sql(html: str) -> str:
    t = f"regexp_replace(translate({html}, '\ue001\ue002', ''), '{_COMMENT}', '', 'g')"
    for name in HIDDEN:
        t = f"regexp_replace({t}, '{_hidden(name)}', '', 'g')"
    for pattern, to in _SHOWN:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    # named once: the decoding reads the text twice
    t = f"list_transform([{t}], lambda shown: {decode_entities_sql('shown')})[1]"
    for pattern, to in _LINES:
        t = f"regexp_replace({t}, '{pattern}', '{to}', 'g')"
    return t


def _first(text: Column, patterns, group: int = 0, flags: str = "(?iu)") -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, flags + p, group), F.lit("")) for p in patterns])


def _first_sql(text: str, patterns, group: int = 0, flags: str = "(?i)") -> str:
    parts = [f"nullif(regexp_extract({text}, {_sq(flags + p)}, {group}), '')" for p in patterns]
    return parts[0] if len(parts) == 1 else "coalesce(" + ", ".join(parts) + ")"


def page_fields(url: Column, html: Column, text: Column | None = None) -> dict[str, Column]:
    """E20 listing fields and E21 detail fields of one page. Pass ``text`` (the
    visible text, computed in an earlier projection) so it is built once."""
    text = visible_text(html) if text is None else text
    contract = None
    for c in CONTRACTS:
        cond = text.rlike("(?iu)" + JS_L + c + JS_R)
        contract = F.when(cond, F.lit(c)) if contract is None else contract.when(cond, F.lit(c))
    salary = _first(text, SALARY_PATTERNS)
    return {
        "title": F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)),
        "h1": F.trim(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)),
        "host": F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1),
        "offer_ref": F.nullif(F.regexp_extract(url, r"/(\d+)", 1), F.lit("")),
        "language": F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\slang=\"([^\"]+)\"", 1), F.lit("")),
        "text_chars": F.length(text),
        "n_links": F.regexp_count(html, F.lit(r"(?i)<a\s")),
        "contract_type": contract,
        "company_sector": _first(text, (SECTOR_PATTERN,)),
        "company_size": _first(text, COMPANY_SIZE_PATTERNS),
        "salary_text": salary,
        "experience_required": _first(text, EXPERIENCE_PATTERNS),
        "education_level": _first(text, EDUCATION_PATTERNS),
        "telework": F.when(text.rlike("(?iu)" + TELEWORK_PATTERN),
                           F.coalesce(F.nullif(trimmed(F.regexp_extract(
                               text, "(?iu)" + TELEWORK_PHRASE, 0)), F.lit("")), F.lit("Oui")))
                    .otherwise(F.lit("Non spécifié")),
        "publication_date": F.nullif(trimmed(F.regexp_extract(text, "(?iu)" + PUBLICATION_PATTERN, 1)), F.lit("")),
    }


def detail_fields(text: Column) -> dict[str, Column]:
    """E21 fields beyond ``page_fields`` from the visible text: salary bounds, place and department."""
    amount = lambda p, g: F.regexp_replace(F.regexp_extract(text, p, g), f"[{WS}]", "")
    euro = lambda c: F.when(c != "", F.concat(c, F.lit("€")))
    place = F.nullif(trimmed(F.regexp_extract(text, LOCATION_PATTERN, 1)), F.lit(""))
    return {
        "salary_min": F.coalesce(euro(amount(SALARY_PATTERNS[0], 1)), euro(amount(SALARY_PATTERNS[1], 1))),
        "salary_max": euro(amount(SALARY_PATTERNS[0], 2)),
        "location_full": place,
        "department": F.substring(F.nullif(F.regexp_extract(place, r"\d{2,5}", 0), F.lit("")), 1, 2),
        "description": trimmed(text),
    }


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    return F.concat(*[F.regexp_extract(tag, pattern, g) for g in (1, 2, 3)])


def _has_class(tag: Column, *names: str) -> Column:
    own = _attribute(tag, "class")
    return own.rlike(r"(^|\s)(" + "|".join(names) + r")(\s|$)")


def listing_cards(pages: DataFrame, keep: list[str], html_col: str = "html") -> DataFrame:
    """A row per offer link of a listing page: the ``keep`` columns, ``href`` and the HTML of the link, of its
    card (the closest element around it that is a list item, an article or marked as a job, else its parent), and of
    the card's title and company elements (null without one).

    Tags are rows of one shuffle by page; a page's pieces meet in one task.
    """
    rows = pages.select(*keep, F.monotonically_increasing_id().alias("_row"), without_hidden(F.col(html_col)).alias("_html"))
    pieces = rows.select("_row", *keep, F.posexplode(F.regexp_extract_all("_html", F.lit(PIECE), 0)).alias("_pos", "_piece"))
    name = F.lower(F.regexp_extract("_piece", r"^</?([a-zA-Z][a-zA-Z0-9]*)", 1))
    step = F.when((F.col("_name") == "") | F.col("_name").isin(VOID), 0).when(F.col("_piece").startswith("</"), -1).otherwise(1)
    tags = pieces.repartition("_row").withColumn("_name", name).withColumn("_step", step)
    depth = F.sum("_step").over(Window.partitionBy("_row", "_name").orderBy("_pos"))
    # a start and its end have the same depth outside and inside it
    level = tags.withColumn("_level", F.when(F.col("_step") == -1, depth + 1).otherwise(depth))
    matched = level.withColumn("_end", F.coalesce(
        F.lead("_pos").over(Window.partitionBy("_row", "_name", F.col("_step") != 0, "_level").orderBy("_pos")), F.lit(1 << 30)))
    tag = F.when(F.col("_step") == 1, F.col("_piece"))
    test_id = _attribute(tag, "data-testid")
    kinds = {
        "link": (F.col("_name") == "a") & _attribute(tag, "href").rlike(OFFER_LINK),
        "card": F.col("_name").isin("li", "article") | ((F.col("_name") == "div") & test_id.contains("job")) | _has_class(tag, "job-card"),
        "title": F.col("_name").isin("h2", "h3") | test_id.contains("title") | _has_class(tag, "job-title"),
        "company": test_id.contains("company") | _has_class(tag, "company", "company-name"),
        "any": F.lit(True),
    }
    span = F.struct(F.col("_pos").alias("pos"), F.col("_end").alias("end"))
    spans = matched.groupBy("_row", *keep).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_piece"))), lambda p: p["_piece"]).alias("_pieces"),
        *[F.sort_array(F.collect_list(F.when((F.col("_step") == 1) & cond, span))).alias(f"_{k}") for k, cond in kinds.items()])

    def closest(around: str) -> Column:
        return F.array_max(F.filter(around, lambda s: (s["pos"] < F.col("_l.pos")) & (s["end"] > F.col("_l.pos"))))

    def inside(kind: str) -> Column:
        return F.array_min(F.filter(kind, lambda s: (s["pos"] > F.col("_c.pos")) & (s["pos"] < F.col("_c.end"))))

    def cut(s: str) -> Column:
        length = F.least(F.col(f"{s}.end"), F.size("_pieces")) - F.col(f"{s}.pos") + 1
        return F.when(F.col(s).isNotNull(), F.array_join(F.slice("_pieces", F.col(f"{s}.pos") + 1, length), ""))

    links = spans.withColumn("_l", F.explode("_link")).withColumn("_c", F.coalesce(closest("_card"), closest("_any"))).where("_c is not null")
    found = links.withColumn("_t", inside("_title")).withColumn("_f", inside("_company"))
    return found.select(*keep, _attribute(F.element_at("_pieces", F.col("_l.pos") + 1), "href").alias("href"), cut("_l").alias("link"),
                        cut("_c").alias("card"), cut("_t").alias("title"), cut("_f").alias("company"))


def card_fields(cards: DataFrame, keep: list[str]) -> DataFrame:
    """E20 records of the rows of :func:`listing_cards`. The title is that of its element or the link's text; the company
    its element's, or the line after the title unless that line is long or looks like another field.
    Records whose title is shorter than 5 or longer than 200 characters are left out."""
    texts = cards.select(*keep, "href", shown(F.col("card")).alias("_text"), trimmed(shown(F.coalesce("title", "link"))).alias("title"),
                         trimmed(shown(F.col("company"))).alias("_company"))
    lines = F.filter(F.transform(F.split("_text", "\n"), trimmed), lambda x: x != "")
    numbered = texts.where(F.length("title").between(5, 200)).withColumn("_lines", lines).withColumn(
        "_at", F.array_position("_lines", F.col("title")))
    after = F.try_element_at("_lines", F.when(F.col("_at") > 0, (F.col("_at") + 1).cast("int")).otherwise(F.lit(1 << 30)))
    text = F.col("_text")
    beside = numbered.withColumn("_after", after)
    return beside.select(
        *keep, F.regexp_extract("href", OFFER_LINK, 1).alias("offer_id"), "title",
        F.when(F.col("_company").isNotNull(), F.col("_company")).when(
            (F.length("_after") < 60) & ~F.col("_after").rlike(NOT_A_COMPANY), F.col("_after")).otherwise(F.lit(UNKNOWN)).alias("company"),
        F.coalesce(F.nullif(trimmed(F.regexp_extract(text, LOCATION_PATTERN, 1)), F.lit("")),
                   F.nullif(F.regexp_extract(text, CARD_CITY, 0), F.lit("")), F.lit(UNKNOWN)).alias("location"),
        F.nullif(trimmed(F.regexp_extract(text, CARD_SALARY, 1)), F.lit("")).alias("salary"),
        F.coalesce(*[F.when(text.rlike("(?iu)" + JS_L + c + JS_R), F.lit(c)) for c in CONTRACTS]).alias("contract"),
        F.nullif(trimmed(F.regexp_extract(text, "(?iu)" + CARD_DATE, 0)), F.lit("")).alias("date_posted"))


def page_fields_sql(url: str, html: str, text: str) -> dict[str, str]:
    contract = "CASE " + " ".join(
        f"WHEN regexp_matches({text}, {_sq('(?i)' + JS_L + c + JS_R)}) THEN {_sq(c)}" for c in CONTRACTS) + " END"
    tele = f"regexp_extract({text}, {_sq('(?i)' + TELEWORK_PHRASE)}, 0)"
    return {
        "title": f"trim(regexp_extract({html}, '(?is)<title[^>]*>(.*?)</title>', 1))",
        "h1": f"trim(regexp_extract({html}, '(?is)<h1[^>]*>(.*?)</h1>', 1))",
        "host": f"regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)",
        "offer_ref": f"nullif(regexp_extract({url}, '/(\\d+)', 1), '')",
        "language": f"nullif(regexp_extract({html}, '(?i)<html[^>]*\\slang=\"([^\"]+)\"', 1), '')",
        "text_chars": f"length({text})",
        "n_links": f"len(regexp_extract_all({html}, '(?i)<a\\s'))",
        "contract_type": contract,
        "company_sector": _first_sql(text, (SECTOR_PATTERN,)),
        "company_size": _first_sql(text, COMPANY_SIZE_PATTERNS),
        "salary_text": _first_sql(text, SALARY_PATTERNS),
        "experience_required": _first_sql(text, EXPERIENCE_PATTERNS),
        "education_level": _first_sql(text, EDUCATION_PATTERNS),
        "telework": (f"CASE WHEN regexp_matches({text}, {_sq('(?i)' + TELEWORK_PATTERN)}) "
                     f"THEN coalesce(nullif({trimmed_sql(tele)}, ''), 'Oui') "
                     f"ELSE 'Non spécifié' END"),
        "publication_date": f"nullif({trimmed_sql(f'''regexp_extract({text}, {_sq('(?i)' + PUBLICATION_PATTERN)}, 1)''')}, '')",
    }


def page_sections(text: Column) -> dict[str, Column]:
    """Mission and profile sections of a page's visible text: what follows the heading word up to a blank
    line or the next heading (whole text, no truncation)."""
    cut = lambda start, end: F.nullif(trimmed(F.regexp_extract(text, f"(?isu){start}(?={end})", 1)), F.lit(""))
    return {"missions": cut(MISSIONS, MISSIONS_END), "profile_sought": cut(PROFILE, PROFILE_END)}


def page_sections_sql(text: str) -> dict[str, str]:
    """Same sections for RE2 (no look-ahead): the stop words are consumed by a
    non-capturing group instead, which leaves capture group 1 unchanged."""
    cut = lambda start, end: f"nullif({trimmed_sql(f'regexp_extract({text}, {_sq(f"(?is){start}(?:{end})")}, 1)')}, '')"
    return {"missions": cut(MISSIONS, MISSIONS_END), "profile_sought": cut(PROFILE, PROFILE_END)}


def multi_card_links(html: Column) -> Column:
    """Listing pages hold many cards: every offer link (/emplois/<id>.html) -> array of ids."""
    return F.regexp_extract_all(html, F.lit(r"/emplois/(\d+)\.html"), 1)
