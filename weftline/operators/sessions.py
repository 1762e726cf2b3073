"""Session logs, file history, retention and display throttling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(history: DataFrame, key: str, order: list) -> DataFrame:
    return history.withColumn("version", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def latest(history: DataFrame, key: str, order: list) -> DataFrame:
    """The last row of each key by ``order``; by a maximum, not a sort."""
    return history.groupBy(key).agg(F.max_by(F.struct(*history.columns), F.struct(*order)).alias("r")).select("r.*")


def restore(history: DataFrame, path: str, version: int | None = None) -> DataFrame:
    numbered = versions(history.where(F.col("path") == path), "path", ["ts"])
    return numbered.orderBy(F.desc("version")).limit(1) if version is None else numbered.where(F.col("version") == version)


def retain(rows: DataFrame, keys: list[str], newest_first: list, most: int) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned): the newest ``most`` of each key, and the rest."""
    numbered = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first)))
    return numbered.where(F.col("__rank") <= most).drop("__rank"), numbered.where(F.col("__rank") > most).drop("__rank")


def history_stats(history: DataFrame) -> DataFrame:
    return history.agg(F.count("*").alias("total"), F.countDistinct("path").alias("files"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def session_summary(log: DataFrame, prefix: str = "annotation:add") -> DataFrame:
    """One row for each session of ``log`` (session_id, ts, action, target, to):
    sorted distinct targets created, updated (less the created), deleted;
    renames as from->to, groups, annotations added, seconds from first to last."""
    of = lambda condition, value="target": F.sort_array(F.collect_set(F.when(condition, F.col(value) if isinstance(value, str) else value)))
    a = F.col("action")
    out = log.groupBy("session_id").agg(
        of(a == "file:create").alias("created"), of(a == "file:write").alias("written"), of(a == "file:delete").alias("deleted"),
        of(a == "file:rename", F.concat(F.col("target"), F.lit("->"), F.col("to"))).alias("renamed"), of(a.startswith("group:")).alias("groups"),
        of(a.startswith(prefix)).alias("annotations"), (F.max("ts").cast("bigint") - F.min("ts").cast("bigint")).alias("seconds"),
    )
    return out.withColumn("updated", F.array_except("written", "created")).drop("written")


def last_transaction(log: DataFrame) -> DataFrame:
    """The last row of the log, by time, then session."""
    return log.orderBy(F.desc("ts"), F.desc("session_id")).limit(1)


def last_session(log: DataFrame, prefix: str = "annotation:add") -> DataFrame:
    """The summary of the last session that wasn't closed, else of the last one, with ``orphaned``.

    A session's id sorts as its start; one without a session:close is open.
    """
    of = log.groupBy("session_id").agg((F.count_if(F.col("action") == "session:close") == 0).alias("orphaned"))
    last = of.orderBy(F.desc("orphaned"), F.desc("session_id")).limit(1)
    own = log.join(F.broadcast(last.select("session_id")), "session_id", "left_semi")  # of one row
    return session_summary(own, prefix).join(last, "session_id")


def history_of(history: DataFrame, path: str | None = None) -> DataFrame:
    """Versions, the newest first."""
    return (history if path is None else history.where(F.col("path") == path)).orderBy(F.desc("ts"), "path")


def throttled(hints: DataFrame, key: str, order: list, every: int = 10) -> DataFrame:
    """The 1st, 11th, 21st ... row of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return hints.withColumn("n", n).where((F.col("n") - 1) % every == 0)


def by_priority(items: DataFrame, column: str = "priority") -> list[Column]:
    c = F.col(column)
    return [F.when(c == "high", 0).when(c == "medium", 1).otherwise(2)]


def backup_names(names: DataFrame) -> DataFrame:
    """kind and stamp of backup file names ``<kind>-YYYYMMDD[-HHMMSS].json``."""
    p = r"^(daily|turn)-(\d{8}(?:-\d{6})?)\.json$"
    return names.select("name", F.regexp_extract("name", p, 1).alias("kind"), F.regexp_extract("name", p, 2).alias("stamp")).where("kind <> ''")
