"""Live tracking against the batch operators, in several batches and across restarts."""

import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import experience
from weftline.streaming import streams, tracking

T0 = dt.datetime(2026, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def store(spark):
    before = spark.conf.get(STORE)
    tracking.use_rocksdb(spark)
    yield
    spark.conf.set(STORE, before)


def fed(spark, folder, schema, batches, build, mode="append"):
    """What a query has put out after each batch, with a new query from the same checkpoint for each."""
    feed, out = folder / "feed", folder / "out"
    feed.mkdir()
    for k, batch in enumerate(batches):
        (folder / "new.json").write_text("\n".join(json.dumps(r, default=str) for r in batch))
        (folder / "new.json").rename(feed / f"{k}.json")
        changes = spark.readStream.schema(schema).json(str(feed))
        query = build(changes).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(folder / "checkpoint")).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    return spark.read.parquet(str(out))


EVENTS = "session_id string, seq int, kind string, query string, results array<string>, path string, ts timestamp"


def journey_events():
    rng = random.Random(8)
    files = list("abcde")
    rows = []
    for session in ("s1", "s2", "s3", "s4"):
        for seq in range(30):
            kind = rng.choice(["search", "search", "read", "read", "write", "other"])
            rows.append({
                "session_id": session, "seq": seq, "kind": kind, "query": f"q{seq}" if kind == "search" else None, "results": rng.choices(files, k=3) if kind == "search" else None,
                "path": rng.choice(files) if kind != "search" else None, "ts": T0 + dt.timedelta(minutes=seq),
            })
    return rows


def test_journeys_of_a_stream_equal_those_of_a_batch(spark, store, tmp_path):
    rows = journey_events()
    batches = [[r for r in rows if a <= r["seq"] < b] for a, b in ((0, 7), (7, 8), (8, 22), (22, 30))]
    far = {"session_id": "end", "seq": 0, "kind": "read", "path": "a", "ts": T0 + dt.timedelta(days=9)}
    got = fed(spark, tmp_path, EVENTS, [*batches, [far], [far | {"seq": 1}]], lambda e: tracking.journeys(e, idle=3600))
    batch = experience.journeys(spark.createDataFrame([tuple(r.values()) for r in rows], EVENTS))
    shown = lambda df: Counter(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in df.select("session_id", "journey", "step", "query", F.sort_array("selected"), F.sort_array("rejected"), "target").collect())
    assert shown(got) == shown(batch)
    assert got.where("target is null").count() > 0


def test_a_key_stays_known(spark, store, tmp_path):
    batches = [[{"path": p, "ts": T0 + dt.timedelta(days=d)} for p, d in b] for b in ([("a", 0), ("a", 1), ("b", 1)], [("c", 400)], [("a", 401), ("d", 402), ("b", 403)])]
    got = fed(spark, tmp_path, "path string, ts timestamp", batches, lambda e: tracking.first_seen(e, ["path"], ["ts"]))
    batch = streams.first_seen(spark.createDataFrame([tuple(r.values()) for b in batches for r in b], "path string, ts timestamp"), ["path"], ["ts"])
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, batch.collect()))
    assert got.where("created").count() == 4


OPERATIONS = "event_id int, session_id string, tool string, phase string, ts timestamp"


def operation(k, session, tool, phase, minute):
    return {"event_id": k, "session_id": session, "tool": tool, "phase": phase, "ts": T0 + dt.timedelta(minutes=minute)}


def test_durations_of_a_stream(spark, tmp_path):
    batches = [
        [operation(1, "s", "read", "start", 0), operation(2, "s", "edit", "start", 1), operation(3, "s", "read", "complete", 2), operation(4, "t", "read", "start", 3)],
        [operation(5, "s", "edit", "complete", 9), operation(6, "s", "read", "start", 10), operation(7, "s", "read", "start", 12), operation(8, "s", "read", "complete", 13)],
        [operation(9, "u", "read", "complete", 14), operation(10, "u", "read", "start", 15), operation(11, "t", "read", "complete", 200)],
        [operation(12, "end", "x", "start", 900)],
        [operation(13, "end", "x", "complete", 901)],
    ]
    later = [[operation(k, "end", "y", "start", minute), operation(k + 1, "end", "y", "complete", minute + 1)] for k, minute in ((20, 2000), (30, 3000))]
    later[1].append(operation(14, "s", "read", "complete", 20))  # too late
    for name in ("pairs", "open"):
        (tmp_path / name).mkdir()
    done = fed(spark, tmp_path / "pairs", OPERATIONS, batches + later, tracking.durations).where("session_id <> 'end'")
    every = spark.createDataFrame([tuple(r.values()) for b in batches for r in b], OPERATIONS)
    batch = experience.operation_durations(every).where("duration_ms <= 3600000 and session_id <> 'end'")
    shown = lambda df: Counter(map(tuple, df.select("session_id", "tool", "ts", "duration_ms").collect()))
    assert shown(done) == shown(batch)
    never = fed(spark, tmp_path / "open", OPERATIONS, batches + later, tracking.unfinished)
    assert {r["start_id"] for r in never.collect()} == {4, 10}
