"""URL filter: pattern rules indexed by their rarest literal token.

A rule names literal tokens (runs of ASCII letters and digits, lower-cased) that every URL it fits
must have, and a regular expression over `host#rest` (no host has a "#"). Tokens are counted over all URLs; each rule is
filed under the one of its tokens that the URLs have least often. A URL's tokens fetch the rules filed
under them, and only those rules' expressions run. Of the path rules that fit, the longest wins; where
none fits, the word rules decide: block if one fits, else allow.

The rule list is a parameter of at most MAX_RULES rules; it and its counts are all that the driver
sees. Rows are never shuffled or exploded.

Null urls and urls without "://" have an empty host and path, and fit no rule (allow). Long urls are
whole. Repeated rows give repeated results; a null id stays null; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RULES = 5000
TOKEN = "[a-z0-9]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Verdict, host, path.
PATH_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Words of URLs that the filter blocks where no path rule fits.
BLOCKED_WORDS = ("adult", "bet", "bets", "betting", "bingo", "casino", "escort", "gambling", "jackpot", "lottery", "porn", "poker", "roulette", "sex", "slots", "torrent", "viagra", "warez", "xxx")


@dataclass(frozen=True)
class Rule:
    name: str | None  # of a path rule
    verdict: str
    tokens: tuple[str, ...]
    pattern: str

    @classmethod
    def of_path(cls, verdict: str, host: str, path: str) -> Rule:
        tokens = re.findall(TOKEN, host.translate(str.maketrans(UPPER, LOWER)))
        # the last segment of a path may go on in the url, the others end there
        tokens += re.findall(TOKEN, re.sub(r"[A-Za-z0-9]+$", "", path).translate(str.maketrans(UPPER, LOWER)))
        return cls(host + path, verdict, tuple(tokens), rf"(?s)^(?:[^#]*\.)?{re.escape(host)}#{re.escape(path)}")

    @classmethod
    def of_word(cls, word: str, verdict: str = "block") -> Rule:
        return cls(None, verdict, (word,), rf"(?is)(?:^|[^a-zA-Z0-9]){re.escape(word)}(?:[^a-zA-Z0-9]|$)")


RULES = (*(Rule.of_path(*r) for r in PATH_RULES), *(Rule.of_word(w) for w in BLOCKED_WORDS))

PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def with_parts(pages: DataFrame, id: str, url: str) -> DataFrame:
    whole = F.coalesce(F.col(url), F.lit(""))
    return pages.select(
        F.col(id).alias("page_id"),
        ascii_lower(F.regexp_extract(whole, PARTS, 1)).alias("host"),
        F.regexp_extract(whole, PARTS, 2).alias("path"),
        F.regexp_extract(whole, PARTS, 3).alias("query"),
    ).withColumn("subject", F.concat("host", F.lit("#"), "path", "query"))


def tokens_of(subject: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(ascii_lower(subject), F.lit(f"({TOKEN})"), 1))


def token_counts(urls: DataFrame, rules: tuple[Rule, ...]) -> dict[str, int]:
    """How many URLs have each of the rules' tokens."""
    known = F.array(*(F.lit(t) for t in sorted({t for r in rules for t in r.tokens})))
    rows = urls.select(F.explode(F.array_intersect(tokens_of(F.col("subject")), known)).alias("token")).groupBy("token").count().collect()  # the rules' tokens at most
    return {r["token"]: r["count"] for r in rows}


def filed(rules: tuple[Rule, ...], counts: dict[str, int]) -> Callable[[Column], Column]:
    """From a token to the rules filed under it, by the token's hash: buckets of a rule or two in an array."""
    n = len(rules)
    buckets: list[list[tuple[str, Rule]]] = [[] for _ in range(n)]
    for rule in rules:
        token = min(rule.tokens, key=lambda t: (counts.get(t, 0), t))
        buckets[zlib.crc32(token.encode()) % n].append((token, rule))
    entry = lambda t, r: F.struct(F.lit(t).alias("token"), F.lit(r.name).cast("string").alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
    kind = "array<struct<token:string,name:string,verdict:string,pattern:string>>"
    index = F.array(*(F.array(*(entry(t, r) for t, r in own)).cast(kind) for own in buckets))
    return lambda token: F.filter(F.get(index, (F.crc32(token.cast("binary")) % n).cast("int")), lambda e: e["token"] == token)


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    if not 0 < len(rules) <= MAX_RULES or not all(r.tokens for r in rules):
        raise ValueError(f"1 to {MAX_RULES} rules with a literal token each are needed")
    urls = with_parts(pages, id, url)
    index = filed(rules, token_counts(urls, rules))
    fits = F.filter(F.flatten(F.transform(tokens_of(F.col("subject")), index)), lambda r: F.rlike(F.col("subject"), r["pattern"]))
    named = F.filter(F.col("fits"), lambda r: r["name"].isNotNull())
    longest = F.array_max(F.transform(named, lambda r: F.struct(F.length(r["name"]).alias("n"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
    blocked = F.exists(F.col("fits"), lambda r: r["verdict"] == "block")
    return (
        urls.withColumn("fits", fits)
        .withColumn("best", longest)
        .select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce(F.col("best.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"))
    )


ORACLE = rf"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path, regexp_extract(coalesce(url, ''), '{PARTS}', 3) AS query
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host || '#' || path || query, '(?is)(^|[^a-zA-Z0-9])({"|".join(BLOCKED_WORDS)})([^a-zA-Z0-9]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
