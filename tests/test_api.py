"""The facade, targets, placement, hints and plugins."""

import pytest
from pyspark.sql import functions as F

from weftline.api import CodeGraph
from weftline.functions import targets
from weftline.operators import audit, hints, placement
from weftline.plugins import Events, Registry

SOURCES = {
    "src/a.ts": "import { b } from './b';\n\n/**\n * @note.policy Keep the shop open\n */\nexport function openShop() {\n  return b();\n}\n",
    "src/b.ts": "export function b() { return 1 }\n\nexport class Till {\n  ring() { return b() }\n}\n",
    "doc/readme.md": "The shop.\n",
}


@pytest.fixture(scope="module")
def code(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for p, text in SOURCES.items():
        (root / p).parent.mkdir(exist_ok=True)
        (root / p).write_text(text)
    return CodeGraph.scan(spark, str(root)), root


def paths(df, column="path"):
    return sorted(r[column] for r in df.collect())


def test_graph(code):
    g, _ = code
    assert [tuple(r) for r in g.edges.collect()] == [("src/a.ts", "src/b.ts")]
    assert [tuple(r) for r in g.calls.collect()] == [("src/a.ts", "openShop", "src/b.ts", "b")]
    assert paths(g.impact("src/b.ts$b")) == ["src/a.ts$openShop"] and paths(g.impact("src/b.ts")) == ["src/a.ts"]
    assert paths(g.traverse("src/a.ts")) == ["src/a.ts", "src/b.ts"] and paths(g.related("src/a.ts")) == ["src/b.ts"]
    assert paths(g.dependencies("src/a.ts"), "name") == ["src/b.ts"]
    r = g.stats().first()
    assert (r["files"], r["directories"], r["dependencies"], r["call_edges"], r["call_symbols"]) == (3, 3, 1, 1, 2)


def test_searches(code):
    g, _ = code
    assert g.search("openShop").first()["path"] == "src/a.ts"
    assert g.find_relevant("shop policy", 1).first()["path"] == "src/a.ts"
    hit = g.search_in_files("return").orderBy("rank").first()
    assert (hit["path"], hit["symbol"]) == ("src/b.ts", "b")
    assert paths(g.find_by_name("*.MD")) == ["doc/readme.md"] and paths(g.files_by_directory("src")) == ["src/a.ts", "src/b.ts"]
    r = g.peek("src/a.ts").first()
    assert (r["imports"], r["importers"], len(r["symbols"]), len(r["annotations"]), r["n_lines"]) == (["src/b.ts"], [], 1, 1, 9)
    assert g.read("src/b.ts:1-1").first()["content"] == SOURCES["src/b.ts"].split("\n")[0]
    assert g.read("src/a.ts$openShop").first()["content"] == "export function openShop() {\n  return b();\n}"
    assert g.audit([audit.Rule("t", "t", "text-pattern", config={"pattern": "shop", "exemptToken": "no"})]).count() == 2


def test_save_and_load(code, spark, tmp_path):
    g, root = code
    g.save(str(tmp_path / "graph"), str(root))
    assert paths(CodeGraph.load(spark, str(tmp_path / "graph"), str(root)).symbols, "name") == ["Till", "b", "openShop", "ring"]
    assert CodeGraph.load(spark, str(tmp_path / "graph"), "other") is None


def test_targets():
    assert targets.parse("src.parts.Card.vue:3-9") == targets.Target("src/parts/Card.vue", 3, 9, type="range")
    assert targets.parse("/a.b.c/x.ts").path == "/a.b.c/x.ts" and targets.parse("a/*.ts").wildcard
    for bad in ("", "a.ts:0", "a.ts:5-2", "a*.ts:1"):
        with pytest.raises(ValueError):
            targets.parse(bad)
    assert targets.resolve("./src/a.ts:2-3") == targets.Target("src/a.ts", 2, 3, type="range")
    assert targets.resolve("src").type == "directory" and targets.resolve(".").type == "directory"
    assert targets.resolve("src/a.ts$f", symbol_range=lambda p, s: (4, 6)) == targets.Target("src/a.ts", 4, 6, "f", type="symbol")


@pytest.mark.parametrize(
    ("strategy", "how", "want"),
    [("append", {}, "import x\nclass A {\n}\nNEW"), ("prepend", {}, "import x\nNEW\nclass A {\n}"), ("atLine", {"line": 1}, "NEW\nimport x\nclass A {\n}"), ("afterSymbol", {"name": "A"}, "import x\nclass A {\n}\nNEW"), ("beforeSymbol", {"name": "A"}, "import x\nNEW\nclass A {\n}"), ("endOfClass", {"name": "A"}, "import x\nclass A {\nNEW\n}")],
)
def test_placement(spark, strategy, how, want):
    files = spark.createDataFrame([("f", "import x\nclass A {\n}")], "path string, content string")
    symbols = spark.createDataFrame([("f", 0, "A", "class", 2, 3)], "path string, ord int, name string, kind string, start_line int, end_line int")
    assert placement.place(files, symbols, "f", "NEW", strategy, **how).first()["content"] == want


def test_hints():
    assert [h.id for h in hints.hints(hints.Outcome(0, r"a\|b", True))] == ["no-results-orientation", "regex-escaped-pipe", "no-results-alternatives"]
    assert [h.id for h in hints.hints(hints.Outcome(2))] == ["few-results-broaden"] and [h.id for h in hints.hints(hints.Outcome(51))] == ["many-results-narrow"]


def test_plugins_and_events():
    seen, events = [], Events()
    events.once("x", lambda p: seen.append(("once", p)))
    events.on("*", lambda p: seen.append(("all", p)))
    off = events.on("x", lambda p: 1 / 0)
    events.emit("x", 1)
    off()
    events.emit("x", 2)
    assert seen == [("all", 1), ("once", 1), ("all", 2)]

    class Plugin:
        name = "p"

        def register(self, registry):
            registry.add_tool("count", lambda df: df.agg(F.count("*").alias("n")))

    r = Registry()
    r.add(Plugin())
    with pytest.raises(ValueError):
        r.add(Plugin())
    assert "count" in r.tools
