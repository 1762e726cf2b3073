"""Change feeds, streams, plugins' contributions and the entry point."""

import asyncio
import json
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

from weftline import storage
from weftline.api import CodeGraph
from weftline.operators import categories, edits, search
from weftline.plugins import EVENTS, Registry
from weftline.sources import catalog, documents
from weftline.streaming import streams

FILES = [("src/a.ts", "import { b } from './b';\nexport function a() { return b(); }\n"), ("src/b.ts", "export function b() {}\n"), ("src/c.ts", "import { x } from './late';\nexport const c = 1;\n")]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_follow_keeps_all_tables_up_to_date(spark, tmp_path):
    files = spark.createDataFrame(FILES, "path string, content string")
    graph = CodeGraph(streams.parse_files()(files)["files"])
    path, names = str(tmp_path / "graph"), list(graph.tables())
    catalog.save_parted(graph.tables(), path)
    assert rows(graph.edges, "src", "dst") == [("src/a.ts", "src/b.ts")]
    feed = tmp_path / "feed"
    feed.mkdir()
    touched = []

    def load():
        return {n: df.drop("part") for n, df in catalog.load_parted(spark, path, names).items()}

    def save(new):
        touched.append(catalog.update(catalog.load_parted(spark, path, names), new, path))

    changes = spark.readStream.schema(edits.CHANGES).json(str(feed))
    query = streams.follow(changes, load, save, streams.parse_files(), str(tmp_path / "checkpoint"), "1 second")
    try:
        batches = [
            [{"path": "src/late.ts", "op": "create", "content": "export function x() {}\n", "ts": "2026-01-01T00:00:00"}],
            [{"path": "src/b.ts", "op": "rename", "to": "src/d.ts", "content": FILES[1][1], "ts": "2026-01-01T00:00:01"}, {"path": "src/c.ts", "op": "delete", "ts": "2026-01-01T00:00:02"}],
        ]
        want = [[("src/a.ts", "src/b.ts"), ("src/c.ts", "src/late.ts")], []]
        for k, batch in enumerate(batches):
            (tmp_path / "new.json").write_text("\n".join(map(json.dumps, batch)))
            (tmp_path / "new.json").rename(feed / f"{k}.json")
            query.processAllAvailable()
            assert rows(load()["edges"], "src", "dst") == want[k]
    finally:
        query.stop()
    assert rows(load()["files"], "path") == [("src/a.ts",), ("src/d.ts",), ("src/late.ts",)]
    assert rows(load()["symbols"], "path", "name") == [("src/a.ts", "a"), ("src/d.ts", "b"), ("src/late.ts", "x")]
    assert load()["calls"].count() == 0 and load()["imports"].count() == 1
    assert all(len(parts) < catalog.PARTITIONS for done in touched for parts in done.values())


def test_graph_after_changes_equals_a_fresh_one(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    graph, at = CodeGraph(streams.parse_files()(files)["files"]), F.lit("2026-01-01").cast("timestamp")
    changes = edits.move(graph.files, "src/b.ts", "src/b/index.ts", at).unionByName(edits.write(graph.files, "src/c.ts", F.lit("import './a';\n"), at))
    after = graph.after(changes)
    fresh = CodeGraph(streams.parse_files()(spark.createDataFrame([FILES[0], ("src/b/index.ts", FILES[1][1]), ("src/c.ts", "import './a';\n")], "path string, content string"))["files"])
    for name, df in fresh.tables().items():
        assert rows(after.tables()[name], *sorted(df.columns)) == rows(df, *sorted(df.columns)), name
    more = graph.with_dependencies(spark.createDataFrame([("src/c.ts", "src/b.ts")], "src string, dst string"))
    assert more.edges.count() == 2 and more.symbols.count() == graph.symbols.count()


def test_many_changes_are_not_broadcast(spark, monkeypatch):
    files = spark.createDataFrame(FILES, "path string, content string")
    graph, at = CodeGraph(streams.parse_files()(files)["files"]), F.lit("2026-01-01").cast("timestamp")
    changes = edits.write(graph.files, "src/c.ts", F.lit("import './a';\n"), at)
    made = lambda: streams.apply_changes(graph.tables(), changes, streams.parse_files())
    few = made()
    monkeypatch.setattr(storage, "FEW", 0)
    many = made()
    for name in ("files", "symbols", "imports", "edges", "calls"):
        assert rows(many[name], *sorted(many[name].columns)) == rows(few[name], *sorted(few[name].columns)), name
        assert "BroadcastHashJoin" not in many[name]._jdf.queryExecution().executedPlan().toString(), name


def test_streams_of_events(spark, tmp_path):
    events = [{"id": i // 2, "tool": "t", "ts": f"2026-01-01T00:{i:02}:00", "success": i % 3 > 0, "duration_ms": i} for i in range(40)]
    (tmp_path / "events.json").write_text("\n".join(map(json.dumps, events)))
    stream = lambda: spark.readStream.schema("id int, tool string, ts timestamp, success boolean, duration_ms long").json(str(tmp_path / "*.json"))

    def ran(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name)

    assert ran(streams.deduplicated(stream(), "id"), "once", "append").count() == 20
    assert ran(streams.first_seen_stream(stream(), ["tool"]), "first", "append").count() == 1
    r = ran(streams.tool_telemetry(stream()), "telemetry", "complete").first()
    assert (r["calls"], r["failures"], r["mean_ms"]) == (40, 14, 19.5)
    assert ran(streams.recent_counts(stream(), "tool"), "recent", "complete").agg(F.max("n")).first()[0] == 40


def test_a_rule_of_hot_keys_gives_the_same_join(spark, monkeypatch):
    table = spark.createDataFrame([(i % 7 if i % 2 else 0, i) for i in range(400)], "k int, v int")
    lookup = spark.createDataFrame([(k, k * 10, 400) for k in range(5)], "k int, w int, often int")
    for few, hot in ((0, 1), (0, 10_000), (50_000, 1)):
        monkeypatch.setattr(storage, "FEW", few)
        monkeypatch.setattr(storage, "HOT", hot)
        inner = storage.spread_join(table, lookup, "k", "often", 400)
        assert rows(inner, "k", "v", "w") == rows(table.join(lookup.drop("often"), "k"), "k", "v", "w")
        left = storage.spread_join(table, lookup, "k", "often", 400, "left")
        assert left.count() == 400 and left.where("w is null").count() == table.where("k > 4").count()


def test_stores_are_read_as_they_are_written(spark, tmp_path):
    (tmp_path / "annotations.json").write_text(json.dumps({"a.ts": {"inline": [], "meta": [{"type": "note", "text": "k: v", "severity": "info", "attachedAt": "2026-01-01T00:00:00Z", "source": "meta"}]}}))
    got = documents.load_annotations(spark, str(tmp_path / "annotations.json"))
    assert rows(got, "path", "source", "ord", "text") == [("a.ts", "meta", 0, "k: v")]
    (tmp_path / "macros").mkdir()
    (tmp_path / "macros" / "build.json").write_text(json.dumps({"name": "Build", "command": "make"}))
    (tmp_path / "macros" / "odd.json").write_text("no document")
    got = documents.load_documents(spark, str(tmp_path / "macros"), "name string, command string")
    assert rows(got.where("name is not null"), "id", "name", "command") == [("build", "Build", "make")]
    (tmp_path / "topic.md").write_text("# Topic")
    assert rows(documents.load_topics(spark, str(tmp_path)), "name", "content", "size") == [("topic", "# Topic", 7)]
    (tmp_path / "bad.json").write_text("{")
    assert documents.load_groups(spark, str(tmp_path / "bad.json"))["groups"].count() == 0


def test_category_search_by_regular_expression(spark):
    groups = spark.createDataFrame([("g1", "Login", "users", ["asks twice", None]), ("g2", "Pay", None, None), ("g3", "Log", "x", ["login"])], "id string, name string, description string, notations array<string>")
    found = lambda q, **how: [(r["id"], r["matched_in"]) for r in categories.search_category(groups, "groups", categories.CategoryRequest(q, scored=False, **how)).collect()]
    assert found("LOGIN") == [("g1", ["name"]), ("g3", ["notations"])]
    assert found("^log$", use_regex=True) == [("g3", ["name"])] and found("(", use_regex=True) == []
    assert found("LOGIN", case_sensitive=True) == [] and found("twice") == [("g1", ["notations"])]
    assert categories.parse_categories(None) == ["files"] and categories.parse_categories("help, nothing,GROUPS") == ["groups", "help"]


def test_pages_of_a_search_cover_all_hits_once(spark):
    files = spark.createDataFrame([(f"src/f{i:03}.ts", "", "") for i in range(37)], "path string, summary string, content string").repartition(5)
    symbols = spark.createDataFrame([], "path string, ord int, name string, kind string")
    pages = [search.search(files, symbols, search.SearchRequest("src", mode="text", page=p)).collect() for p in range(1, 10)]
    assert [r["path"] for p in pages for r in sorted(p, key=lambda r: r["rank"])] == [f"src/f{i:03}.ts" for i in range(37)]
    assert {r["total"] for p in pages for r in p} == {37}


def test_registry_contributions_and_events():
    registry = Registry()
    registry.contribute("later", 1)
    registry.contribute("first", 5)
    assert registry.orientation() == ["first", "later"]


def test_a_graph_emits_its_events(spark):
    registry, seen = Registry(), []
    registry.events.on("*", seen.append)
    names = []
    for name in EVENTS:
        registry.events.on(name, lambda _, n=name: names.append(n))
    graph = CodeGraph(streams.parse_files()(spark.createDataFrame(FILES, "path string, content string"))["files"], events=registry.events)
    graph.search("login")
    graph.read("src/a.ts:1-1")
    changes = [("src/a.ts", "update", None, "x", "2026-01-01"), ("src/c.ts", "delete", None, None, "2026-01-01"), ("src/n.ts", "create", None, "a\nb", "2026-01-01")]
    graph.tell_changes(spark.createDataFrame(changes, "path string, op string, to string, content string, ts string"))
    assert names[:2] == ["search:executed", "read:result:after"] and sorted(names[2:]) == ["file:change", "node:add", "node:remove"]
    assert {"path": "src/n.ts", "lines": 2} in seen


def test_a_plugin_goes_with_all_that_it_added(spark):
    registry = Registry()
    old = dict(registry.parsers)

    class Plugin:
        name = "p"

        def register(self, r):
            r.add_parser(".ts", lambda text: [])
            r.add_parser(".new", lambda text: [])
            r.add_tool("t", lambda df: df)
            r.contribute("line")
            r.rules.append("rule")
            r.hooks.append(len)

    registry.rules.append("own")
    registry.add(Plugin())
    assert ".new" in registry.parsers and registry.parsers[".ts"] is not old[".ts"]
    registry.remove("p")
    assert (registry.parsers, registry.tools, registry.rules, registry.hooks, registry.orientation()) == (old, {}, ["own"], [], [])
    registry.add(Plugin())


def test_handlers_are_awaited_in_turn():
    events, seen = Registry().events, []

    async def slow(payload):
        await asyncio.sleep(0.01)
        seen.append(("slow", payload))

    events.on("x", slow)
    events.on("x", lambda p: 1 / 0)
    events.on("x", lambda p: seen.append(("plain", p)))
    asyncio.run(events.emit_async("x", 1))
    assert seen == [("slow", 1), ("plain", 1)]


def test_entry_without_the_training_data_folder(tmp_path):
    root = Path(__file__).resolve().parents[1]
    for leftover in (False, True):
        at = tmp_path / str(leftover)
        subprocess.run([sys.executable, "-c", f"import shutil; shutil.copytree({str(root / 'weftline')!r}, {str(at / 'weftline')!r}, ignore=shutil.ignore_patterns('llm', '__pycache__')); shutil.copy({str(root / '__spark_entry__.py')!r}, {str(at)!r})"], check=True)
        if leftover:
            (at / "weftline" / "llm").mkdir()
        code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=at, check=True)
