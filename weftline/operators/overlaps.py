"""Many requests against many phrases by the overlap of their keywords, as a join of sets.

Two sets overlap by their common members over the larger size. Where that is ``least`` or
more, they share a member of their prefixes, the rarest members up to a length that
follows from ``least``; so rows meet by rare words only, and sizes too far apart don't meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import FEW


def _sets(rows: DataFrame, phrase: str) -> DataFrame:
    return rows.withColumn("words", F.array_sort(T.keywords(F.col(phrase), T.STOP_WORDS_SHORT))).where(F.size("words") > 0)


def _prefixes(sets: DataFrame, frequency: DataFrame, least: float) -> DataFrame:
    """words and prefix: their rarest ones as (frequency, word), enough that sets of ``least`` overlap share one."""
    each = sets.select("words", F.explode("words").alias("word")).join(frequency, "word")
    ordered = each.groupBy("words").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("ordered"))
    needed = F.ceil(F.size("words") * F.lit(least) - 1e-9)
    return ordered.select("words", F.slice("ordered", F.lit(1), (F.size("words") - needed + 1).cast("int")).alias("prefix"))


def _ratio(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, ratio) of the sets (``words``, distinct rows) of two tables that overlap by ``least`` or more, each pair once."""
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    frequency = left.unionByName(right).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    if frequency.limit(FEW + 1).count() <= FEW:
        frequency = F.broadcast(frequency)
    side = lambda sets, name: _prefixes(sets, frequency, least).select(F.col("words").alias(name), F.col("prefix").alias(f"{name}_prefix"), F.explode("prefix").alias("member"))
    met = side(left, "left").join(side(right, "right"), "member")
    # A pair that shares several members of its prefixes counts where the rarest meets.
    first = F.array_min(F.array_intersect("left_prefix", "right_prefix")) == F.col("member")
    near = F.least(F.size("left"), F.size("right")) >= F.greatest(F.size("left"), F.size("right")) * F.lit(least) - 1e-9
    return met.where(near & first).select("left", "right", _ratio(F.col("left"), F.col("right")).alias("ratio")).where(F.col("ratio") >= least)


def phrase_matches(requests: DataFrame, phrases: DataFrame, least: float) -> DataFrame:
    """(request_id, path, n, ratio): for each request (request_id, query) and path of ``phrases``
    (path, phrase), how many of its phrases overlap with the request by ``least`` or more, and the best overlap.

    Equal sets of keywords are compared once. A request or phrase without keywords, or null, matches nothing; repeated
    phrases count as often as they come. Same as ``experience.phrase_matches`` for one request.
    """
    asked, known = _sets(requests, "query"), _sets(phrases, "phrase").groupBy("words", "path").agg(F.count("*").alias("n"))
    pairs = similar_sets(asked.select("words").distinct(), known.select("words").distinct(), least)
    found = asked.select("request_id", F.col("words").alias("left")).join(pairs, "left").join(known.withColumnRenamed("words", "right"), "right")
    return found.groupBy("request_id", "path").agg(F.sum("n").alias("n"), F.max("ratio").alias("ratio"))


def query_history(requests: DataFrame, phrases: DataFrame, least: float = 0.5) -> DataFrame:
    """(request_id, path, n, score): a fifth for each matching query of the past, 1 at most."""
    return phrase_matches(requests, phrases, least).select("request_id", "path", "n", F.least(F.col("n") / 5, F.lit(1.0)).alias("score"))


def usage_matches(requests: DataFrame, usages: DataFrame) -> DataFrame:
    """(request_id, path, n, score): a third for each matching usage, 1 at most."""
    return phrase_matches(requests, usages, 0.4).select("request_id", "path", "n", F.least(F.col("n") / 3, F.lit(1.0)).alias("score"))


def anti_penalty(requests: DataFrame, anti: DataFrame) -> DataFrame:
    """(request_id, path, penalty): -3 for each similar query whose result was read but abandoned, -1 for others, -10 at least."""
    points = F.when(F.col("reason") == "read_but_abandoned", -3).otherwise(-1)
    parted = anti.select(F.struct("path", points.alias("points")).alias("path"), "phrase")
    found = phrase_matches(requests, parted, 0.5)
    return found.groupBy("request_id", F.col("path.path").alias("path")).agg(F.greatest(F.sum(F.col("path.points") * F.col("n")), F.lit(-10)).cast("int").alias("penalty"))
