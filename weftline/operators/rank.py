"""Weighted relevance of files to a goal, and the assistant's scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .search import match_count

#: The weights of the components.
WEIGHTS = {"domain": 10.0, "usage": 8.0, "policy": 5.0, "symbol": 4.0, "path": 3.0, "word": 1.0}


def _tokens(c) -> Column:
    return T.identifier_tokens(F.coalesce(c, F.lit("")))


def _occurrences(token: str) -> Column:
    return F.size(F.filter("bag", lambda x: x == token))


def relevance(files: DataFrame, goal: str, symbols: DataFrame | None = None, annotations: DataFrame | None = None, categorised: DataFrame | None = None, weights: dict[str, float] | None = None, top_n: int | None = None) -> DataFrame:
    """path, the components and their weighted sum ``score``, for all files.

    A component counts how often the goal's tokens occur: once each, and 0.2
    for each repeat. The goal is part of the plan, so each row is scored where
    it lies; only per-file sums are shuffled. ``symbols``: path, name, kind,
    exported; ``annotations``: path, type, message; ``categorised``: path,
    category, ann_path, value.
    """
    query, w = T.query_tokens(goal), WEIGHTS | (weights or {})
    zero = F.lit(0.0)
    parts = [files.select("path", zero.alias("domain"), zero.alias("usage"), zero.alias("policy"), zero.alias("symbol"), match_count(_tokens(F.col("path")), query).alias("path_score"), _tokens(F.col("path")).alias("bag"))]

    def part(df, bag, **scores):
        columns = [scores.get(c, zero).alias(c) for c in ("domain", "usage", "policy", "symbol")]
        parts.append(df.select("path", *columns, zero.alias("path_score"), F.filter(bag, lambda t: t.isin(query) if query else F.lit(False)).alias("bag")))

    if symbols is not None:
        m = match_count(_tokens(F.col("name")), query)
        kind = T.any_of([F.lower("kind").contains(t) for t in query])
        part(symbols, _tokens(F.col("name")), symbol=m + F.when(F.col("exported"), m * 0.3).otherwise(0.0) + F.when(kind, 0.5).otherwise(0.0))
    if annotations is not None:
        m = match_count(_tokens(F.col("message")), query)
        part(annotations, _tokens(F.col("message")), policy=F.when(F.col("type").isin("policy", "systempolicy"), m * 0.8).otherwise(0.0))
    if categorised is not None:
        value, ann_path = match_count(_tokens(F.col("value")), query), match_count(_tokens(F.col("ann_path")), query)
        usage = (F.col("category") == "meta") & F.col("ann_path").rlike("usage|keyword|tag")
        part(categorised, F.concat(_tokens(F.col("ann_path")), _tokens(F.col("value"))), domain=F.when(F.col("category") == "domain", value + 0.5 * ann_path).otherwise(0.0), usage=F.when(usage, value * 1.5).otherwise(0.0))
    rows = reduce(DataFrame.unionByName, parts)
    # Occurrences of each goal token are summed per file, not the tokens themselves gathered.
    occurs = {f"__n{i}": _occurrences(t) for i, t in enumerate(dict.fromkeys(query))}
    sums = rows.withColumns(occurs).groupBy("path").agg(*[F.sum(c).alias(c) for c in ("domain", "usage", "policy", "symbol", "path_score", *occurs)])
    sums = sums.join(files.select("path"), "path", "left_semi")
    index = {t: i for i, t in enumerate(dict.fromkeys(query))}
    word = reduce(lambda a, b: a + b, [F.when(F.col(f"__n{index[t]}") > 0, 1 + 0.2 * (F.col(f"__n{index[t]}") - 1)).otherwise(0.0) for t in query], F.lit(0.0))
    scored = sums.withColumn("word", word)
    total = reduce(lambda a, b: a + b, [w[c] * F.col("path_score" if c == "path" else c) for c in WEIGHTS])
    out = scored.select("path", "domain", "usage", "policy", "symbol", "path_score", "word", total.alias("score"))
    return out if top_n is None else out.orderBy(F.desc("score"), "path").limit(top_n)


def static_scores(files: DataFrame, symbols: DataFrame, goal: str) -> DataFrame:
    """5 * keyword overlap of the path and 3 * that of each symbol's name, for all files."""
    words = T.keywords(F.lit(goal), T.STOP_WORDS_SHORT)
    score = lambda c, w: w * T.overlap(words, T.keywords(F.col(c), T.STOP_WORDS_SHORT))
    both = files.select("path", score("path", 5.0).alias("s")).unionByName(symbols.select("path", score("name", 3.0).alias("s")).join(files.select("path"), "path", "left_semi"))
    return both.groupBy("path").agg(F.sum("s").alias("static"))


def assist(static: DataFrame, goal: str, metrics: DataFrame | None = None, history: DataFrame | None = None, usages: DataFrame | None = None, penalties: DataFrame | None = None, bias: list[tuple[str, dict[str, float]]] = (), top: int | None = None) -> DataFrame:
    """path, raw and confidence, with a warning below 3.

    ``static``: path, static. ``metrics``: path, total_ops, success_rate,
    days_since, heat; ``history`` and ``usages``: path, n; ``penalties``: path,
    penalty. ``bias``: (text in the goal, {text in the path: boost}).
    """
    df, raw = static, F.col("static")
    for when, boosts in bias:
        if when in goal:
            for part, boost in boosts.items():
                raw = raw + F.when(F.col("path").contains(part), float(boost)).otherwise(0.0)
    for other, column, value in ((history, "n_history", F.least(3 * F.coalesce("n_history", F.lit(0)), F.lit(12))), (usages, "n_usages", F.least(4 * F.coalesce("n_usages", F.lit(0)), F.lit(16))), (penalties, "penalty", F.col("penalty"))):
        if other is not None:
            source = "penalty" if column == "penalty" else "n"
            df = df.join(other.select("path", F.col(source).alias(column)), "path", "left")
            raw = raw + F.coalesce(value, F.lit(0)).cast("double")
    if metrics is not None:
        df = df.join(metrics.select("path", "total_ops", "success_rate", "days_since", "heat"), "path", "left")
        times = F.when(F.col("success_rate") < 0.5, 0.5).when(F.col("success_rate") > 0.75, 1.5).otherwise(1.0)
        times = times + F.when(F.col("days_since") < 7, 0.3).otherwise(0.0) + F.col("heat") * 0.5
        raw = raw * F.when(F.coalesce("total_ops", F.lit(0)) > 0, times).otherwise(1.0)
    df = df.select("path", raw.alias("raw"))
    best = df.agg(F.greatest(F.max("raw"), F.lit(1.0)).alias("best"))  # one row
    out = df.crossJoin(best).select("path", "raw", F.least(F.col("raw") / F.col("best"), F.lit(1.0)).alias("confidence"), F.when(F.col("raw") < 3, "Low confidence match").otherwise("").alias("warning"))
    return out if top is None else out.orderBy(F.desc("confidence"), "path").limit(top)


def insights(counts: DataFrame) -> DataFrame:
    """``counts``: category, n, best. A category is strong with two hits, or a best score of 3."""
    strong = (F.col("n") >= 2) | (F.col("best") >= 3.0)
    return counts.select("category", "n", strong.alias("strong"), F.concat_ws(" ", F.when(strong, "strong").otherwise("weak"), "category").alias("insight"))


def confidence(df: DataFrame, score: str = "score") -> DataFrame:
    best = df.agg(F.greatest(F.max(score), F.lit(1.0)).alias("__best"))
    return df.crossJoin(best).withColumn("confidence", F.least(F.col(score) / F.col("__best"), F.lit(1.0))).drop("__best")


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Rows of one page with their rank; ``order`` must be total. Only the rows up to the page's end are ranked."""
    top = df.orderBy(*order).limit(number * size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > (number - 1) * size)
