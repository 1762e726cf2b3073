"""Live tracking of sessions: journeys, first sights and operations, as streams with state.

The state machines need a state store of column families: ``use_rocksdb`` sets it for a
session. They keep one small state for each key, which goes when its time is over, and take
up where they stopped when a query restarts from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STEPS = "session_id {key}, journey int, step int, query string, selected array<string>, rejected array<string>, target string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def step_rows(session, journey: int, steps: list[dict], target: str | None) -> Iterator[Row]:
    """The rows that ``experience.journeys`` has for a journey."""
    for k, s in enumerate(steps, 1):
        selected = sorted(s["selected"])
        rejected = [x for x in dict.fromkeys(s["results"]) if x not in s["selected"]] if selected else []
        yield Row(session_id=session, journey=journey, step=k, query=s["query"], selected=selected, rejected=rejected, target=target)


class Journeys(StatefulProcessor):
    """One session: a search adds a step to the open journey, a read selects its file in
    the latest step that listed it, a write closes the journey and emits it. A session without
    events for ``idle_ms`` of event time is over: its open journey comes out without a target."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.number = handle.getValueState("number", "n int")
        self.steps = handle.getListState("steps", "query string, results array<string>, selected array<string>")

    def _load(self) -> tuple[int, list[dict]]:
        steps = [{"query": q, "results": list(r or []), "selected": set(s or [])} for q, r, s in self.steps.get()] if self.steps.exists() else []
        return (self.number.get()[0] if self.number.exists() else 1), steps

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        number, steps = self._load()
        latest = 0
        for r in sorted(rows, key=lambda r: r["seq"]):
            latest = max(latest, int(r["ts"].timestamp() * 1000))
            if r["kind"] == "search":
                steps.append({"query": r["query"], "results": list(r["results"] or []), "selected": set()})
            elif r["kind"] == "read":
                listed = next((s for s in reversed(steps) if r["path"] in s["results"]), None)
                if listed:
                    listed["selected"].add(r["path"])
            elif r["kind"] == "write":
                yield from step_rows(key[0], number, steps, r["path"])
                number, steps = number + 1, []
        self.number.update((number,))
        if steps:
            self.steps.put([(s["query"], s["results"], sorted(s["selected"])) for s in steps])
        else:
            self.steps.clear()
        for timer in self.handle.listTimers():
            latest = max(latest, timer - self.idle_ms)
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        number, steps = self._load()
        yield from step_rows(key[0], number, steps, None)
        self.number.clear()
        self.steps.clear()

    def close(self) -> None:
        pass


def journeys(events: DataFrame, idle: int = 24 * 3600, late: str = "1 hour") -> DataFrame:
    """Steps of journeys of a stream of (session_id, seq, kind, query, results, path, ts), as
    ``experience.journeys`` has them of a batch.

    A session's rows of one micro-batch are taken in the order of ``seq``, batches as they come.
    Sessions without events for ``idle`` seconds end. An event that comes later than ``late`` after the watermark is dropped; other
    columns aren't read. A key's state is its open journey.
    """
    rows = events.select("session_id", "seq", "kind", "query", "results", "path", "ts").withWatermark("ts", late)
    out = STEPS.format(key=events.schema["session_id"].dataType.simpleString())
    return rows.groupBy("session_id").transformWithState(statefulProcessor=Journeys(idle * 1000), outputStructType=StructType.fromDDL(out), outputMode="Append", timeMode="EventTime")


class FirstSight(StatefulProcessor):
    """Tells the first row of a key, by the columns ``order`` in a micro-batch, from those after it.

    The key stays known for ``days`` of processing time after its last row, for ever if that is None. Columns of another key go with the rows.
    """

    def __init__(self, order: list[str], days: int | None):
        self.order, self.days = order, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "yes boolean", ttlDurationMs=None if self.days is None else self.days * 86_400_000)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.seen.exists()
        for r in sorted(rows, key=lambda r: [r[c] for c in self.order]):
            yield Row(**dict(zip(r.__fields__, r, strict=True)), created=not known)
            known = True
        self.seen.update((True,))

    def close(self) -> None:
        pass


def first_seen(events: DataFrame, keys: list[str], order: list[str], days: int | None = None) -> DataFrame:
    """``events``, a stream, with ``created``: whether a row is the first of its keys ever; else it updates.

    Unlike a deduplication within a watermark it never forgets a key, or not before ``days`` without a row of it.
    """
    out = events.withColumn("created", F.lit(True)).schema
    return events.groupBy(*keys).transformWithState(statefulProcessor=FirstSight(order, days), outputStructType=out, outputMode="Append", timeMode="None" if days is None else "ProcessingTime")


def _halves(events: DataFrame, late: str) -> tuple[DataFrame, DataFrame]:
    own = lambda phase, to: events.where(F.col("phase") == phase).select("session_id", "tool", F.col("event_id").alias(f"{to}_id"), F.col("ts").alias(f"{to}_ts")).withWatermark(f"{to}_ts", late)
    return own("start", "start"), own("complete", "complete")


def _paired(events: DataFrame, within: str, late: str, how: str) -> DataFrame:
    starts, completes = _halves(events, late)
    completes = completes.withColumnsRenamed({"session_id": "__session", "tool": "__tool"})
    same = F.col("session_id").eqNullSafe(F.col("__session")) & F.col("tool").eqNullSafe(F.col("__tool"))
    near = (F.col("complete_ts") >= F.col("start_ts")) & (F.col("complete_ts") <= F.col("start_ts") + F.expr(f"interval {within}"))
    return starts.join(completes, same & near, how)


def durations(events: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """session_id, tool, complete_id, ts and duration_ms of completed operations of a stream of (event_id, session_id, tool, phase, ts).

    A complete is joined with the starts of its session and tool up to ``within``
    before it, and the latest of those is its own. The watermark is the lesser one of both
    halves: a pair comes out when starts and completes have passed it, and a half that comes later than ``late`` is lost.
    """
    pairs = _paired(events, within, late, "inner").groupBy("session_id", "tool", "complete_id", "complete_ts").agg(F.max("start_ts").alias("start_ts"))
    return pairs.select("session_id", "tool", "complete_id", F.col("complete_ts").alias("ts"), (F.unix_millis("complete_ts") - F.unix_millis("start_ts")).alias("duration_ms"))


def unfinished(events: DataFrame, within: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """session_id, tool, start_id, ts of starts that nothing completed ``within`` their time, once the watermark has passed it."""
    return _paired(events, within, late, "left_outer").where("complete_id is null").select("session_id", "tool", "start_id", F.col("start_ts").alias("ts"))
