"""Verdicts on URLs by rules that are looked up by their rarest literal token.

A rule's literal tokens are the runs of a-z and 0-9 that any matching URL must
hold as whole tokens. Each rule is filed under the one that the fewest URLs
hold; the tokens of a URL fetch its candidate rules, and only those run their
regular expression.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOKEN = "[a-z0-9]+"


class SiteRule(NamedTuple):
    """Fits a host, its subdomains and all paths that begin with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def regex(self) -> str:
        return rf"\A(?:[^#]*\.)?{quote(self.host)}#{quote(self.path)}"

    @property
    def tokens(self) -> list[str]:
        # What ends the path may go on in the URL, so it is no whole token.
        return re.findall(TOKEN, self.host) + re.findall(rf"(?<![a-z0-9]){TOKEN}(?=[^A-Za-z0-9])", self.path.translate(str.maketrans(UPPER, LOWER)))


class PatternRule(NamedTuple):
    """Literal text with ``^`` for an edge or any one character but a-z and 0-9, and ``*`` for anything."""

    pattern: str
    verdict: str

    @property
    def regex(self) -> str:
        each = {"^": "(?:[^a-z0-9]|\\A|\\z)", "*": "[\\s\\S]*"}
        return "(?i)" + "".join(each.get(c) or quote(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        return re.findall(rf"(?<=[^a-z0-9*]){TOKEN}(?=[^a-z0-9*])", self.pattern.lower())


#: Rules of the site lists, and patterns for the urls that no site rule fits.
SITE_RULES = (
    SiteRule("org", "/", "allow"),
    SiteRule("example.org", "/es/", "block"),
    SiteRule("example.org", "/en/1", "block"),
    SiteRule("com", "/fr/", "allow"),
    SiteRule("com", "/de/", "block"),
)
PATTERN_RULES = (
    *(PatternRule(f"^{word}^", "block") for word in ("ads", "adserver", "adult", "bets", "casino", "pills", "porn", "spam", "viagra", "xxx")),
    PatternRule("^spam^farm^", "block"),
    PatternRule("^free^*^download^", "block"),
    PatternRule("^anti^spam^", "allow"),
)


def quote(text: str) -> str:
    return "".join(c if re.match(r"[\w/]", c, re.ASCII) else f"\\x{{{ord(c):x}}}" for c in text)


def lower(c: Column) -> Column:
    """A-Z only, unlike the built-in function."""
    return F.translate(c, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or holds no ``://``."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    return lower(F.regexp_extract(rest, r"\A[^/?#]*", 0)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def _rules(spark: SparkSession, sites: Sequence[SiteRule], patterns: Sequence[PatternRule]) -> DataFrame:
    rows = []
    for k, rule in enumerate([*sites, *patterns]):
        tokens = sorted(set(rule.tokens))
        if not tokens:
            raise ValueError(f"a rule needs a whole literal token: {rule}")
        name = rule.name if isinstance(rule, SiteRule) else None
        rows.append((k, name, rule.regex, tokens, rule.verdict))
    return spark.createDataFrame(rows, "_rule int, _name string, _regex string, _tokens array<string>, _verdict string")


def _tokens(subject: Column) -> Column:
    return F.filter(F.array_distinct(F.split(lower(subject), "[^a-z0-9]+")), lambda t: t != "")


def file_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule with its token that the fewest rows of ``urls`` (column _subject) hold; ties by the token."""
    spread = rules.select("_rule", F.explode("_tokens").alias("_token"))
    held = urls.select(F.explode(_tokens(F.col("_subject"))).alias("_token"))
    counts = held.join(spread.select("_token").distinct(), "_token").groupBy("_token").agg(F.count("*").alias("_n"))
    rare = spread.join(counts, "_token", "left").groupBy("_rule").agg(
        F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_token").alias("token")))["token"].alias("_token")
    )
    return rules.join(rare, "_rule").drop("_tokens")


def judge_urls(
    pages: DataFrame, sites: Sequence[SiteRule] = SITE_RULES, patterns: Sequence[PatternRule] = PATTERN_RULES, default: str = "allow"
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule and verdict.

    Among the site rules that fit, the longest name wins, then the longer host,
    then block. If none fits, rule is null and the patterns decide: an allowing
    one before a blocking one, else ``default``. A null url, or one without
    ``://``, has an empty host and path. Equal urls are judged once; repeated
    rows all come back. An empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url").cast("string"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_subject", F.concat("host", F.lit("#"), "path"))
    distinct = rows.select("_subject").distinct()
    index = file_rules(distinct, _rules(spark, sites, patterns))
    fits = (
        distinct.select("_subject", F.explode(_tokens(F.col("_subject"))).alias("_token"))
        .join(index, "_token")
        .where(F.expr("_subject rlike _regex"))
    )
    site = F.col("_name").isNotNull()
    best = F.struct(
        F.length("_name").alias("size"), F.length(F.substring_index("_name", "/", 1)).alias("host"),
        (F.col("_verdict") == "block").alias("block"), F.col("_name").alias("name"), F.col("_verdict").alias("verdict"),
    )
    judged = fits.groupBy(F.col("_subject").alias("_judged")).agg(
        F.max(F.when(site, best)).alias("_best"),
        F.min(F.when(~site, F.col("_verdict"))).alias("_pattern"),  # "allow" sorts first
    )
    return rows.join(judged, rows["_subject"] == judged["_judged"], "left").select(
        "page_id", "host", "path", F.col("_best.name").alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.col("_pattern"), F.lit(default)).alias("verdict"),
    )
