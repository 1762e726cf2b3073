"""Metrics of past use: success, heat, history, usages and anti-results.

Each works on whole tables, all files at once. ``now`` is a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

RECENT_DAYS = 7


def file_metrics(events: DataFrame, now: Column) -> DataFrame:
    """``events``: path, ts, outcome. path, total_ops, successes, success_rate, last_ts, days_since, heat."""
    recent = F.count_if(F.col("ts") > now - F.expr(f"INTERVAL {RECENT_DAYS} DAYS"))
    out = events.groupBy("path").agg(
        F.count("*").alias("total_ops"), F.count_if(F.col("outcome") == "success").alias("successes"),
        F.avg((F.col("outcome") == "success").cast("double")).alias("success_rate"), F.max("ts").alias("last_ts"), F.least(0.1 * recent, F.lit(1.0)).alias("heat"),
    )
    return out.withColumn("days_since", F.datediff(now, F.col("last_ts")))


def symbol_metrics(events: DataFrame) -> DataFrame:
    """``events``: symbol_ref, outcome. Edits, success rate and the name's keywords."""
    words = F.array_join(F.array_distinct(F.flatten(F.transform(F.split("symbol_ref", "/"), lambda p: T.identifier_tokens(p)))), ",")
    return events.groupBy("symbol_ref").agg(F.count("*").alias("edits"), F.avg((F.col("outcome") == "success").cast("double")).alias("success_rate")).withColumn("keywords", words)


def phrase_matches(phrases: DataFrame, query: str, least: float) -> DataFrame:
    """Rows of ``phrases`` (path, phrase) whose keyword overlap with the query is ``least`` or more, with ``ratio``."""
    ratio = T.overlap(T.keywords(F.lit(query), T.STOP_WORDS_SHORT), T.keywords(F.col("phrase"), T.STOP_WORDS_SHORT))
    return phrases.withColumn("ratio", ratio).where(F.col("ratio") >= least)


def query_history(phrases: DataFrame, query: str, least: float = 0.5) -> DataFrame:
    return phrase_matches(phrases, query, least).groupBy("path").agg(F.count("*").alias("n")).withColumn("score", F.least(F.col("n") / 5, F.lit(1.0)))


def usage_matches(usages: DataFrame, query: str) -> DataFrame:
    return phrase_matches(usages, query, 0.4).groupBy("path").agg(F.count("*").alias("n")).withColumn("score", F.least(F.col("n") / 3, F.lit(1.0)))


def anti_penalty(anti: DataFrame, query: str) -> DataFrame:
    """``anti``: path, phrase, reason. -3 for read_but_abandoned, else -1, each for similar failed queries; -10 at least."""
    points = F.when(F.col("reason") == "read_but_abandoned", -3).otherwise(-1)
    return phrase_matches(anti, query, 0.5).groupBy("path").agg(F.greatest(F.sum(points), F.lit(-10)).cast("int").alias("penalty"))


def operation_durations(events: DataFrame) -> DataFrame:
    """Pairs a completed operation with the start before it, per session and tool."""
    w = Window.partitionBy("session_id", "tool").orderBy("ts", "event_id")
    out = events.withColumns({"start_ts": F.lag("ts").over(w), "before": F.lag("phase").over(w)})
    return out.where("phase = 'complete' AND before = 'start'").select("session_id", "tool", "ts", (F.unix_millis("ts") - F.unix_millis("start_ts")).alias("duration_ms"))


def journeys(events: DataFrame) -> DataFrame:
    """Steps of search journeys from ordered events (session_id, seq, kind, query, results, path).

    A search opens a journey or extends the open one, a read selects the file
    in the latest step that listed it and thereby rejects the step's others,
    and a write closes the journey. Rows:
    session_id, journey (from 1), step, query, selected, rejected, target.
    """
    w = Window.partitionBy("session_id").orderBy("seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    marked = events.withColumn("journey", F.coalesce(F.sum((F.col("kind") == "write").cast("int")).over(before), F.lit(0)) + 1)
    each = Window.partitionBy("session_id", "journey").orderBy("seq")
    marked = marked.withColumn("step", F.sum((F.col("kind") == "search").cast("int")).over(each))
    searches = marked.where("kind = 'search'").select("session_id", "journey", "step", "query", "results")
    listed = searches.select("session_id", "journey", F.col("step").alias("listed_step"), F.explode("results").alias("path"))
    reads = marked.where("kind = 'read'").select("session_id", "journey", "path", "seq", "step")
    chosen = reads.join(listed, ["session_id", "journey", "path"]).where(F.col("listed_step") <= F.col("step"))
    chosen = chosen.groupBy("session_id", "journey", "path", "seq").agg(F.max("listed_step").alias("step"))
    selected = chosen.groupBy("session_id", "journey", "step").agg(F.sort_array(F.collect_set("path")).alias("selected"))
    targets = marked.where("kind = 'write'").select("session_id", "journey", F.col("path").alias("target"))
    out = searches.join(selected, ["session_id", "journey", "step"], "left").join(targets, ["session_id", "journey"], "left")
    picked = F.coalesce("selected", F.array().cast("array<string>"))
    rejected = F.when(F.size(picked) > 0, F.array_except("results", picked)).otherwise(F.array().cast("array<string>"))
    return out.select("session_id", "journey", "step", "query", picked.alias("selected"), rejected.alias("rejected"), "target")


def anti_results(steps: DataFrame) -> DataFrame:
    """(correct_file, incorrect_file, query, reason) of closed journeys: files that a
    step of them listed or read and that weren't the target. ``steps``: as of journeys."""
    closed = steps.where("target is not null")
    wrong = lambda c, reason: closed.select(F.col("target").alias("correct_file"), F.explode(c).alias("incorrect_file"), "query", F.lit(reason).alias("reason"))
    both = wrong("rejected", "appeared_in_results_but_rejected").unionByName(wrong("selected", "read_but_abandoned"))
    return both.where(F.col("incorrect_file") != F.col("correct_file")).distinct()


def journeys_for(steps: DataFrame, path: str) -> DataFrame:
    """Steps of the journeys that ended at this file."""
    return steps.where(F.col("target") == path)


def anti_results_for(anti: DataFrame, path: str) -> DataFrame:
    return anti.where(F.col("incorrect_file") == path)


def add_usages(store: DataFrame, more: DataFrame) -> DataFrame:
    """(target, usages): both lists of a target as one without repeats, in the order of their first mention."""
    both = store.select("target", "usages", F.lit(0).alias("n")).unionByName(more.select("target", "usages", F.lit(1).alias("n")))
    lists = F.transform(F.sort_array(F.collect_list(F.struct("n", "usages"))), lambda x: x["usages"])
    return both.groupBy("target").agg(F.array_distinct(F.flatten(lists)).alias("usages"))
