"""Operator 2: weighted URL vocabulary with domain rules.

An Aho-Corasick automaton finds every vocabulary term of a url in one pass. A hit
counts where no letter or digit stands right before or after it. One strict term, or
``min_soft`` different soft terms, reject the url. A rule (host and path prefix) goes
before the vocabulary: the longest rule that fits decides.

Defined results
    null urls and urls without ``://`` have an empty host and path, so no rule fits; a
    null url holds no term and is allowed. Letters are lower-cased within ASCII only.
    Urls of any length are read whole. Repeated rows give repeated result rows; an empty table gives
    none. Extra columns are not read. Vocabulary rows without a term count for nothing, terms are
    lower-cased within ASCII, and a term that is both strict and soft is strict.

The lists below are small defaults; ``vocabulary`` reads others from a table of (term, weight). They are
broadcast with the query, so they should fit a worker many times over.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terms of which one rejects a url.
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
#: Terms of which several different ones reject a url.
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "crack", "dating", "farm", "free", "gambling", "jackpot", "keygen",
        "loan", "nude", "pills", "poker", "sex", "slots", "track", "win")
MIN_SOFT = 2

#: The rules of the contract, (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits the host (or a parent domain) and the start of the path."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit(f".{domain}"))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def vocabulary(terms: DataFrame, term_col: str = "term", weight_col: str = "weight", strict_weight: float = 1.0) -> tuple[list[str], list[str]]:
    """(strict, soft) terms of a table: strict from ``strict_weight`` on, soft below it. The table is a vocabulary, collected whole."""
    low = F.translate(F.trim(F.col(term_col)), UPPER, LOWER)
    rows = terms.select(low.alias("t"), F.col(weight_col).cast("double").alias("w")).where("t <> ''").groupBy("t").agg(F.max("w").alias("w"))
    found = sorted((r["t"], r["w"] or 0.0) for r in rows.collect())
    return [t for t, w in found if w >= strict_weight], [t for t, w in found if w < strict_weight]


def term_hits(url: Column, strict: Sequence[str], soft: Sequence[str]) -> Column:
    """struct(strict, soft): how many different strict and soft terms a lower-cased text holds."""

    @F.pandas_udf("strict int, soft int")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton, kinds = ahocorasick.Automaton(), set(strict)  # once per task
        for term in {*strict, *soft}:
            automaton.add_word(term, term)
        automaton.make_automaton()
        some = len(automaton) > 0
        alone = lambda t, i: i < 0 or i >= len(t) or not (t[i].isascii() and t[i].isalnum())
        for texts in batches:
            out = []
            for text in texts:
                found = {term for end, term in (automaton.iter(text) if some else ())
                         if alone(text, end + 1) and alone(text, end - len(term))}
                out.append((len(found & kinds), len(found - kinds)))
            yield pd.DataFrame(out, columns=["strict", "soft"], dtype="int32")

    return hits(url)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT,
               soft: Sequence[str] = SOFT, min_soft: int = MIN_SOFT) -> DataFrame:
    """``id_col``, host, path, rule, verdict, strict_hits, soft_hits of every row."""
    url = F.col(url_col)
    host, path = host_and_path(url)
    found = pages.select(F.col(id_col), host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"),
                         term_hits(F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER), strict, soft).alias("_hits"))
    verdicts = F.lit(None).cast("string")
    for rule, verdict in rules:
        verdicts = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(verdicts)
    rejected = (F.col("_hits.strict") >= 1) | (F.col("_hits.soft") >= min_soft)
    return found.select(id_col, "host", "path", "rule",
                        F.coalesce(verdicts, F.when(rejected, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                        F.col("_hits.strict").cast("long").alias("strict_hits"),
                        F.col("_hits.soft").cast("long").alias("soft_hits"))


def oracle(strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, min_soft: int = MIN_SOFT) -> str:
    """DuckDB SQL of the query: each term is looked for by itself, with its borders."""
    held = lambda terms: " + ".join(
        f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])') AS BIGINT)" for t in terms)
    fits = lambda domain, path: f"(host = '{domain}' OR host LIKE '%.{domain}') AND starts_with(path, '{path}')"
    return f"""
WITH cut AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), ruled AS (
  SELECT *, {held(strict)} AS strict_hits, {held(soft)} AS soft_hits,
         CASE WHEN {fits('example.net', '/en/')} THEN 'example.net/en/'
              WHEN {fits('example.com', '/de/')} THEN 'example.com/de/'
              WHEN {fits('org', '/fr/')} THEN 'org/fr/'
              WHEN {fits('net', '/')} THEN 'net/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
            WHEN rule IS NOT NULL THEN 'allow'
            WHEN strict_hits >= 1 OR soft_hits >= {min_soft} THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits
FROM ruled"""
