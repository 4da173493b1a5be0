"""URL filter: allow and block rules, then a weighted vocabulary.

Terms are found by an Aho-Corasick automaton in one pass over the lower-cased url
after `://`; a hit counts only if the characters beside it are no letters or digits.
One strict term, or `soft_needed` distinct soft ones, reject. Repeats of one soft
term count once. A null url, or one without `://`, has empty host and path, fits no
rule and has no terms, so it is allowed. Repeated rows are judged alike; other columns
are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_UPPER, ascii_lower

#: (verdict, rule)
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Terms that a vocabulary table may have: some 10 MB in every task.
MOST_TERMS = 100_000
STRICT = ("casino", "gambling", "hentai", "porn", "porno", "sportsbook", "viagra", "warez", "xxx")
SOFT = (
    "adult", "bet", "bonus", "cash", "cheap", "crack", "dating", "deals", "download", "escort",
    "free", "jackpot", "keygen", "loan", "loans", "lottery", "nude", "pills", "poker", "promo",
    "replica", "sexy", "slots", "torrent", "win", "winner",
)


@lru_cache(maxsize=4)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    if not strict and not soft:
        found.add_word("\0", ("none", ""))  # an automaton needs a word
    for kind, terms in (("strict", strict), ("soft", soft)):
        for term in terms:
            found.add_word(term, (kind, term))
    found.make_automaton()
    return found


def _alnum(char: str) -> bool:
    return "a" <= char <= "z" or "0" <= char <= "9"


_LOWER = str.maketrans(ASCII_UPPER, ASCII_UPPER.lower())


def term_hits(text: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand alone in the text, A-Z lower-cased."""
    text = text.translate(_LOWER)
    hits: dict[str, set[str]] = {"strict": set(), "soft": set(), "none": set()}
    for last, (kind, term) in _automaton(strict, soft).iter(text):
        first = last - len(term) + 1
        if (first == 0 or not _alnum(text[first - 1])) and (last + 1 == len(text) or not _alnum(text[last + 1])):
            hits[kind].add(term)
    return hits["strict"], hits["soft"]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host with A-Z lower-cased, path, and all that follows `://`; empty where there is none."""
    pattern = r"(?s)^.*?://(([^/?#]*)([^?#]*).*)$"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(2)), part(3), part(1)


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        on_host = (host == name) | host.endswith("." + name)
        fits.append((on_host & path.startswith(slash + rest), rule, verdict))
    pick = lambda k: F.coalesce(*[F.when(f[0], F.lit(f[k])) for f in fits])
    return pick(1), pick(2)


def judge_urls(
    pages: DataFrame,
    rules: tuple[tuple[str, str], ...] = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: tuple[str, ...] = SOFT,
    soft_needed: int = 2,
) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft for every row."""

    @F.pandas_udf("n_strict long, n_soft long")
    def hits(texts: pd.Series) -> pd.DataFrame:
        found = [term_hits(t, strict, soft) for t in texts]
        return pd.DataFrame({"n_strict": [len(a) for a, _ in found], "n_soft": [len(b) for _, b in found]}, dtype="int64")

    host, path, rest = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), hits(rest).alias("hits"))
    rule, ruled = matching_rule(F.col("host"), F.col("path"), rules)
    bad = (F.col("hits.n_strict") > 0) | (F.col("hits.n_soft") >= soft_needed)
    return parts.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(ruled, F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("hits.n_strict").alias("n_strict"),
        F.col("hits.n_soft").alias("n_soft"),
    )


def judge_by_table(
    pages: DataFrame, vocabulary: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, soft_needed: int = 2
) -> DataFrame:
    """judge_urls with the terms of a table, in any language: term (as it stands in lower case), kind (strict or soft).

    At most MOST_TERMS distinct terms, over which it is an error: the automaton goes to every task. A term of both kinds is strict; rows
    without a term or of another kind count nothing. Letters beside a term bound it as they stand, A-Z in lower case.
    """
    known = vocabulary.filter("term is not null and term <> '' and kind in ('strict', 'soft')")
    found = known.groupBy(ascii_lower(F.col("term")).alias("term")).agg(F.max("kind").alias("kind")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms")
    strict, soft = (tuple(sorted(r.term for r in found if r.kind == kind)) for kind in ("strict", "soft"))
    return judge_urls(pages, rules, strict, soft, soft_needed)


def oracle() -> str:
    """The same in DuckDB, terms by regular expression."""
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND path LIKE '/{rest}%' THEN '{{}}'".format(f"{verdict} {h}/{rest}")
        for verdict, r in sorted(RULES, key=lambda r: -len(r[1]))
        for h, _, rest in [r.partition("/")]
    )
    count = lambda terms: " + ".join(
        f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS BIGINT)" for t in terms
    )
    lower = f"translate({{}}, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}')"
    return f"""
WITH cut AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {lower.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, {lower.format("rest")} AS low FROM cut),
ruled AS (
  SELECT *, {rule} END AS hit, {count(STRICT)} AS n_strict, {count(SOFT)} AS n_soft FROM parts)
SELECT page_id, host, path, split_part(hit, ' ', 2) AS rule,
       CASE WHEN hit IS NOT NULL THEN split_part(hit, ' ', 1)
            WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM ruled"""
