"""URL filters: pattern rules indexed by their rarest literal token.

A rule has a regular expression over ``host || path`` and the whole tokens (runs of letters and digits)
that every url it fits must hold. The tokens' document frequencies over the judged urls choose each
rule's rarest token; a url's tokens fetch the rules filed under them, and only those rules' expressions
run. Urls are judged once each, however many pages share them.

Two kinds of rules: host/path rules (the longest that fits decides) and, where none fits, blocking
patterns. What nothing fits is allowed. A null url or one without ``://`` has an empty host and path and
is thus allowed without a rule. Repeated pages each get a row. Other columns are not used.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskrank.llm.common import ascii_lower

# Fixed rules of the result contract.
HOST_RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
# Hosts and paths with one of these tokens or token groups are blocked where no host rule fits.
BLOCKED_TOKENS = (
    "spam", "spam-farm", "cheap-pills", "casino", "viagra", "porn", "xxx", "malware", "phishing", "adserver",
    "free-money", "payday-loan", "click-bait", "link-farm", "warez", "torrent",
)


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    tokens: tuple[str, ...]
    verdict: str
    tier: int  # of several rules that fit, the highest tier and then the longest name decides


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits ``host`` and its subdomains where the url's path starts with ``path``."""
    pattern = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    whole = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", f"{host}{path}")  # a token at the end may go on
    return Rule(host + path, pattern, tuple(whole), verdict, 1)


def token_rule(tokens: str) -> Rule:
    """Blocks where the tokens, joined as given, stand between delimiters of the host or path."""
    return Rule(tokens, rf"(?:^|[^A-Za-z0-9]){re.escape(tokens)}(?:[^A-Za-z0-9]|$)", tuple(tokens.split("-")), "block", 0)


RULES = tuple(host_rule(*r) for r in HOST_RULES) + tuple(token_rule(t) for t in BLOCKED_TOKENS)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    for r in rules:
        if not r.tokens:
            raise ValueError(f"rule {r.name} has no literal token to be filed under")
    rows = [
        F.struct(
            F.lit(r.name).alias("name"),
            F.lit(r.pattern).alias("pattern"),
            F.array(*map(F.lit, r.tokens)).alias("tokens"),
            F.lit(r.verdict).alias("verdict"),
            F.lit(r.tier).alias("tier"),
        )
        for r in rules
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per url that a rule fits: url, name, verdict, tier. ``urls`` has distinct values in ``url``."""
    subject = F.concat(host_of(F.col("url")), path_of(F.col("url")))
    tokens = urls.select("url", F.explode(F.array_distinct(F.split(subject, "[^A-Za-z0-9]+"))).alias("token"))
    literals = rules.select("name", F.explode(F.array_distinct("tokens")).alias("token"))
    counted = tokens.join(literals.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarity = F.struct(F.coalesce("count", F.lit(0)), "token")
    filed = literals.join(counted, "token", "left").groupBy("name").agg(F.min_by("token", rarity).alias("token"))
    index = filed.join(rules.select("name", "pattern", "verdict", "tier"), "name")
    fits = tokens.join(index, "token").withColumn("_subject", subject).filter(F.expr("_subject RLIKE pattern"))
    best = F.max(F.struct("tier", F.length("name").alias("length"), "name", "verdict")).alias("best")
    return fits.groupBy("url").agg(best).select("url", "best.name", "best.verdict", "best.tier")


def filter_pages(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule (a host/path rule's name), verdict, pattern (a blocking pattern's name)."""
    pages = pages.select("page_id", "url")
    judged = judge(pages.select("url").filter("url IS NOT NULL").distinct(), rule_table(pages.sparkSession, rules))
    return pages.join(judged, "url", "left").select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.when(F.col("tier") == 1, F.col("name")).alias("rule"),
        F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("tier") == 0, F.col("name")).alias("pattern"),
    )


def _sql() -> str:
    host_rules = ", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for h, p, v in HOST_RULES)
    blocked = ", ".join(f"('{t}')" for t in BLOCKED_TOKENS)
    return f"""
WITH hosts(name, host, path, verdict) AS (VALUES {host_rules}),
blocked(name) AS (VALUES {blocked}),
judged AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *,
    (SELECT max(struct_pack(n := length(r.name), name := r.name, verdict := r.verdict)) FROM hosts r
     WHERE (j.host = r.host OR ends_with(j.host, '.' || r.host)) AND starts_with(j.path, r.path)) AS h,
    (SELECT max(struct_pack(n := length(b.name), name := b.name)) FROM blocked b
     WHERE regexp_matches(j.host || j.path, '(^|[^A-Za-z0-9])' || b.name || '([^A-Za-z0-9]|$)')) AS b
  FROM judged j)
SELECT page_id, host, path, h.name AS rule,
       CASE WHEN h.name IS NOT NULL THEN h.verdict WHEN b.name IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN h.name IS NULL THEN b.name END AS pattern
FROM ruled
"""


SQL = _sql()
