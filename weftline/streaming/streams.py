"""Change feeds, recency windows and journeys as structured streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from ..operators.graph import written
from ..sources import parsers
from ..storage import by_count


def first_seen(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``created``: whether a row is the first of its keys. For a batch."""
    return events.withColumn("created", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def recent(events: DataFrame, now, days: int = 7) -> DataFrame:
    """Events of the last ``days`` before ``now``. For a batch."""
    return events.where(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS"))


def recent_counts(events: DataFrame, key: str, days: int = 7, late: str = "1 hour") -> DataFrame:
    """Counts for each key in windows of ``days`` that advance by a day; ``ts`` must be a timestamp."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", f"{days} days", "1 day").alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def activity_sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def tool_telemetry(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls, failures and mean duration of each tool by the hour."""
    w = F.window("ts", "1 hour").alias("w")
    return events.withWatermark("ts", late).groupBy(w, "tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("success")).alias("failures"), F.avg("duration_ms").alias("mean_ms")).select(F.col("w.start").alias("hour"), "tool", "calls", "failures", "mean_ms")


def deduplicated(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def first_seen_stream(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first event of each key, of a stream: what creates rather than updates. Keys are kept as long as the watermark holds them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _last_changes(changes: DataFrame) -> DataFrame:
    """(path, op, content): the last change of each path; a rename deletes one path and writes another."""
    moved = changes.where("op = 'rename'")
    flat = changes.where("op <> 'rename'").select("path", "op", "content", "ts")
    flat = flat.unionByName(moved.select("path", F.lit("delete").alias("op"), F.lit(None).cast("string").alias("content"), "ts")).unionByName(moved.select(F.col("to").alias("path"), F.lit("write").alias("op"), "content", "ts"))
    order = F.struct("ts", (F.col("op") != "delete").cast("int"))
    return flat.groupBy("path").agg(F.max_by(F.struct("op", "content"), order).alias("c")).select("path", "c.*")


def apply_changes(tables: dict[str, DataFrame], changes: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """The graph's tables after a batch of changes (path, op, to, content, ts): the
    last change of a path counts, of those at one time a writing one.

    Rows of changed, deleted and renamed paths go, and those that ``parse``
    makes of the written ones (path, content) come: of ``files``, ``symbols``,
    ``imports``, ``annotations`` and any other table with a path. ``edges`` and
    ``calls`` are made anew for the files that changed and for those that may
    import a changed one, from the new imports, and from the calls that
    ``parse`` finds in the contents; those of all other files stay. Changed
    paths are broadcast only if they are few by count.
    """
    last = written(_last_changes(changes))
    changed = by_count(last.select("path"))
    fresh = parse(last.where("op <> 'delete'").select("path", "content"))
    out = {}
    for name, df in tables.items():
        if name not in ("edges", "calls"):
            kept = df.join(changed, "path", "left_anti")
            out[name] = kept.unionByName(fresh[name], allowMissingColumns=True).select(*df.columns) if name in fresh else kept
    if "edges" not in tables or "imports" not in out:
        return out | {n: tables[n] for n in ("edges", "calls") if n in tables}
    near = graph.import_candidates(out["imports"]).join(changed.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"))
    old = tables["edges"].join(changed.withColumnRenamed("path", "dst"), "dst", "left_semi").select(F.col("src").alias("path"))
    touched = by_count(written(near.union(old).union(last.select("path")).distinct()))
    new = graph.resolve_imports(out["imports"].join(touched, "path", "left_semi"), out["files"])
    out["edges"] = written(tables["edges"].join(touched.withColumnRenamed("path", "src"), "src", "left_anti").unionByName(new))
    if "calls" in tables:
        own = out["files"].join(touched, "path", "left_semi").select("path", "content")
        calls = graph.resolve_calls(parse(own)["raw_calls"], out["edges"].join(touched.withColumnRenamed("path", "src"), "src", "left_semi"), out["symbols"])
        out["calls"] = tables["calls"].join(touched.withColumnRenamed("path", "src_path"), "src_path", "left_anti").unionByName(calls)
    return out


def watch_events(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(event, path, lines) for those who watch the graph, of the last change of each
    path: node:add of a new file, file:change of a known one, node:remove of a deleted
    one that was known; lines of what was written. The transport is the sink's."""
    known = files.select("path", F.lit(True).alias("known"))
    seen = _last_changes(changes).join(known, "path", "left")
    gone = F.col("op") == "delete"
    event = F.when(gone & F.col("known"), "node:remove").when(~gone & F.col("known"), "file:change").when(~gone, "node:add")
    return seen.select(event.alias("event"), "path", F.when(~gone, F.size(F.split("content", "\n"))).alias("lines")).where("event is not null")


def parse_files(tag: str = "@note", known: dict | None = None) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """What apply_changes needs of the parsers: each call parses the files that it is given."""

    def parse(files: DataFrame) -> dict[str, DataFrame]:
        rows = files.select("path", T.base_name(F.col("path")).alias("name"), T.directory(F.col("path")).alias("dir_path"), parsers.summary(F.col("path"), F.col("content")).alias("summary"), "content", F.sha2("content", 256).alias("content_hash"), F.octet_length("content").cast("bigint").alias("size"))
        return {"files": rows, "symbols": parsers.symbols(files, known), "imports": parsers.imports(files), "annotations": parsers.annotations(files, tag), "raw_calls": parsers.raw_calls(files, known)}

    return parse


def follow(changes: DataFrame, load: Callable[[], dict[str, DataFrame]], save: Callable[[dict[str, DataFrame]], None], parse: Callable[[DataFrame], dict[str, DataFrame]], checkpoint: str, every: str = "15 minutes"):
    """Starts a query that applies each micro-batch of a change feed to the stored tables.

    ``catalog.update`` as ``save`` rewrites only the partitions that a batch changed.
    """

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            save(apply_changes(load(), df, parse))

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
