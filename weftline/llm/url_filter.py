"""URL filters: pattern rules indexed by their rarest literal token.

The tokens of a URL fetch the candidate rules, and only those run their
regular expressions. Built of DataFrame expressions alone; the pages are only
shuffled where the rules are too many to be part of the plan.
"""

from __future__ import annotations

import re
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import packed, text_of

#: The literal index of so many rules is part of the plan; more rules are a table, broadcast up to the second number.
RULES_IN_PLAN, RULES_BROADCAST = 2000, 100_000


@dataclass(frozen=True)
class UrlRule:
    """``pattern``: Java regular expression over host followed by path.

    ``literals``: whole tokens (maximal runs of ASCII letters and digits) that
    each match of the pattern has. ``length`` and ``tier`` order the rules
    that fit a URL: the highest tier wins, then the greatest length.
    """

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    length: int = 0
    tier: int = 0


def host_path_rule(verdict: str, host: str, path: str) -> UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""
    quoted = lambda s: re.sub(r"([^A-Za-z0-9/])", r"\\\1", s)
    whole = host + path[: path.rfind("/") + 1]  # what follows the last slash may go on in the URL
    literals = tuple(dict.fromkeys(t for t in re.split(r"[^A-Za-z0-9]+", whole) if t))
    return UrlRule(host + path, verdict, rf"^(?:[^/]*\.)?{quoted(host)}{quoted(path)}", literals, len(host) + len(path), 1)


def pattern_rule(name: str, verdict: str, pattern: str, *literals: str) -> UrlRule:
    return UrlRule(name, verdict, pattern, literals)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; only A-Z are lowered; empty without ``://`` and for null."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _tokens(subject: Column) -> Column:
    return F.array_remove(F.split(subject, "[^A-Za-z0-9]+"), "")


def rarest_literals(urls: DataFrame, tokens: str, rules: Sequence[UrlRule]) -> dict[str, list[UrlRule]]:
    """The rules by their rarest literal, counted over all rows of ``urls``.

    At most one count for each literal of the rules comes to the driver.
    """
    vocabulary = sorted({t for r in rules for t in r.literals})
    known = F.array(*map(F.lit, vocabulary))
    counts = urls.select(F.explode(F.array_intersect(tokens, known)).alias("t")).groupBy("t").count().collect() if vocabulary else []
    count = {r["t"]: r["count"] for r in counts}
    index: dict[str, list[UrlRule]] = {}
    for rule in rules:
        if not rule.literals:
            raise ValueError(f"rule {rule.name} has no literal")
        index.setdefault(min(rule.literals, key=lambda t: (count.get(t, 0), t)), []).append(rule)
    return index


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` packed in a struct ``row`` with host, path, rule, tier and verdict.

    ``rules``: a list, or a table of the fields of UrlRule with their order
    ``no``; any number of them. Null urls and those without ``://`` have empty
    host and path, fit no rule and get ``default``. Rows are judged each for
    itself, repeated or not, urls of any length; of fitting rules equal in tier
    and length the later in ``rules`` wins. An empty table or rule list is fine.
    """
    u = text_of("row", url)
    df = packed(pages, "row").withColumns({"host": host_of(u), "path": path_of(u)}).withColumn("__subject", F.concat("host", "path"))
    if isinstance(rules, DataFrame) or len(rules) > RULES_IN_PLAN:
        df = _with_best(df, rules if isinstance(rules, DataFrame) else rule_table(pages.sparkSession, rules))
    elif not rules:
        return df.select("row", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("int").alias("tier"), F.lit(default).alias("verdict"))
    else:
        df = df.withColumn("__tokens", _tokens(F.col("__subject")))
        index = rarest_literals(df.select("__tokens"), "__tokens", rules)
        number = {id(r): i for i, r in enumerate(rules)}
        entry = lambda r: F.struct(F.lit(r.tier).alias("tier"), F.lit(r.length).alias("length"), F.lit(number[id(r)]).alias("no"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"))
        by_token = F.create_map(*[x for t, found in sorted(index.items()) for x in (F.lit(t), F.array(*map(entry, found)))])
        keys = F.array(*map(F.lit, sorted(index)))
        df = df.withColumn("__candidates", F.flatten(F.transform(F.array_intersect("__tokens", keys), lambda t: F.element_at(by_token, t))))
        df = df.withColumn("__best", F.array_max(F.filter("__candidates", lambda r: F.rlike(F.col("__subject"), r["pattern"]))))
    return df.select("row", "host", "path", F.col("__best.name").alias("rule"), F.col("__best.tier").alias("tier"), F.coalesce("__best.verdict", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[UrlRule]) -> DataFrame:
    """The rules as a table."""
    rows = [(no, r.name, r.verdict, r.pattern, list(r.literals), r.length, r.tier) for no, r in enumerate(rules)]
    return spark.createDataFrame(rows, "no int, name string, verdict string, pattern string, literals array<string>, length int, tier int")


def _with_best(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` with ``__best``, by joins of the distinct subjects' tokens with the rules' rarest literals."""
    small = rules.count() <= RULES_BROADCAST
    few = F.broadcast if small else (lambda t: t)
    if not rules.where(F.size(F.coalesce("literals", F.array().cast("array<string>"))) == 0).isEmpty():
        raise ValueError("a rule has no literal")
    words = df.select("__subject").distinct().select("__subject", F.explode(F.array_distinct(_tokens(F.col("__subject")))).alias("literal"))
    wanted = rules.select(F.explode("literals").alias("literal")).distinct()
    counts = words.join(few(wanted), "literal", "left_semi").groupBy("literal").agg(F.count("*").alias("n"))
    by_literal = rules.select("no", F.explode("literals").alias("literal")).join(counts, "literal", "left")
    rarest = by_literal.groupBy("no").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "literal")).alias("m")).select("no", F.col("m.literal").alias("literal"))
    fitting = words.join(few(rules.join(rarest, "no").drop("literals")), "literal").where(F.rlike(F.col("__subject"), F.col("pattern")))
    best = fitting.groupBy("__subject").agg(F.max(F.struct("tier", "length", "no", "name", "verdict")).alias("__best"))
    return df.join(best, "__subject", "left")
