"""Operators of the code graph on hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import audit, experience, fuzzy, graph, lines, rank, search, sessions, stores
from weftline.plans import registry


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, T.identifier_tokens(F.col("a")), a="getUserById XMLParser my_file-name.ts") == ["get", "user", "xml", "parser", "file", "name"]
    assert one(spark, F.round(T.similarity(F.col("a"), F.col("b")), 9), a="kitten", b="sitting") == round(1 - 3 / 7, 9)
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="", b="x") == 0.0
    assert one(spark, T.inline_diff(F.col("a"), F.col("b")), a="the old way", b="the new way") == "the {-old-}{+new+} way"
    assert one(spark, T.inline_diff(F.col("a"), F.col("b")), a="aa", b="aaa") == "aa{+a+}"
    assert one(spark, T.aggressive(F.col("a")), a=" x \r\n\r\n  y") == "x\ny"
    assert one(spark, T.common_lines(F.col("a"), F.col("b")), a="a\nb\nc", b="a\r\nx\r\nc\r\nd") == 2
    assert one(spark, T.duration(F.lit(200)), a=1) == "3m 20s"
    assert one(spark, T.duration(F.lit(7500)), a=1) == "2h 5m"
    assert one(spark, T.canonical(F.col("a")), a=".\\src\\\\a/") == "src/a"
    assert one(spark, T.slug(F.col("a")), a=" My Label! 2 ") == "my-label-2"
    assert one(spark, T.indent(F.col("a"), 2), a="a\n\nb") == "  a\n\n  b"
    assert [one(spark, T.target_type(F.col("a")), a=x) for x in ("a/b.ts$f", "a/b.ts", "a.b/c")] == ["symbol", "file", "directory"]


def test_snippet(spark):
    long = "x" * 100 + "needle" + "y" * 100
    assert one(spark, T.snippet(F.col("a"), ["needle"]), a=long) == "..." + long[23:183] + "..."
    assert one(spark, T.snippet(F.col("a"), ["none"]), a="z" * 170) == "z" * 160 + "..."
    assert one(spark, T.snippet(F.col("a"), []), a="short") == "short"
    assert one(spark, T.snippet(F.col("a"), ["short"]), a="short") == "short"


def test_globs():
    import re

    assert re.match(T.glob_name_pattern("SRC/*.ts"), "src/a/b.ts") and not re.match(T.glob_name_pattern("a?b"), "axb")
    assert re.search(T.audit_glob_pattern("src/**/x.ts"), "src/a/b/x.ts") and not re.search(T.audit_glob_pattern("src/*/x.ts"), "src/a/b/x.ts")
    assert re.match(T.path_glob_pattern("src/**/*.ts"), "src/x.ts") and not re.match(T.path_glob_pattern("src/*.ts"), "src/a/x.ts")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "gone")], "src string, dst string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_traversal(spark, edges):
    assert rows(graph.traverse(edges, "a", max_depth=3)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("gone", 3)]
    assert rows(graph.traverse(edges, "d", "importers", 2)) == [("a", 2), ("b", 1), ("c", 1), ("d", 0)]
    assert rows(graph.traverse(edges, "a", include_start=False, max_depth=1)) == [("b", 1), ("c", 1)]
    files = spark.createDataFrame([("a",)], "path string")
    assert rows(graph.traverse(edges, "nowhere", known=files)) == []


def test_traversal_equals_a_plain_search(spark):
    random.seed(4)
    pairs = [(f"n{random.randrange(15)}", f"n{random.randrange(15)}") for _ in range(30)]
    edges = spark.createDataFrame(pairs, "src string, dst string")
    depth, level = {"n0": 0}, ["n0"]
    for d in range(1, 4):
        level = sorted({y for x, y in pairs if x in level} - set(depth))
        depth |= dict.fromkeys(level, d)
    assert rows(graph.traverse(edges, "n0", max_depth=3)) == sorted(depth.items())


def test_import_resolution(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/x.ts", "src/dir/index.ts", "src/deep/in.ts", "src/lib.vue", "src/lib/index.js")], "path string")
    imports = [("src/a.ts", "./x.js"), ("src/a.ts", "./dir"), ("src/a.ts", "react"), ("src/deep/in.ts", "@/x"), ("src/deep/in.ts", "../lib"), ("src/a.ts", "./none"), ("src/a.ts", "./x")]
    got = graph.resolve_imports(spark.createDataFrame(imports, "path string, spec string"), files)
    assert rows(got) == [("src/a.ts", "src/dir/index.ts"), ("src/a.ts", "src/x.ts"), ("src/deep/in.ts", "src/lib.vue"), ("src/deep/in.ts", "src/x.ts")]


def test_call_resolution_and_impact(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, dst string")
    symbols = spark.createDataFrame([("b", "run"), ("c", "run"), ("a", "local"), ("c", "lonely")], "path string, name string")
    raw = spark.createDataFrame([("a", "main", "run"), ("a", "main", "local"), ("a", "main", "run")], "path string, sym string, callee string")
    calls = graph.resolve_calls(raw, edges, symbols)
    assert rows(calls) == [("a", "main", "b", "run"), ("a", "main", "c", "run")]
    assert rows(graph.impact(edges, calls, "b$run")) == [("a$main", 1)]
    assert rows(graph.impact(edges, calls, "c$lonely")) == [("a", 1)]
    assert rows(graph.dependencies(edges, calls, symbols.select("path").distinct(), "c$lonely")) == [("a", "imported by")]
    assert rows(graph.dead_symbols(symbols, calls)) == [("a", "local"), ("c", "lonely")]


def test_search_modes(spark):
    files = spark.createDataFrame([("src/user.ts", "handles login", "x\nUser here\nend"), ("src/login.ts", "", "login"), ("doc/a.md", "nothing", "")], "path string, summary string, content string")
    symbols = spark.createDataFrame([("src/user.ts", 0, "login", "function", 1, 2), ("src/user.ts", 1, "doLogin", "function", 2, 3), ("doc/a.md", 0, "lxoxgxixn", "class", 1, 1)], "path string, ord int, name string, kind string, start_line int, end_line int")
    assert rows(search.text_search(files, "login src")) == [("src/login.ts", 1.0), ("src/user.ts", 0.8)]
    assert rows(search.text_search(files, "x")) == [] and rows(search.text_search(files, "(", use_regex=True)) == []
    got = {r["path"]: (round(r["relevance"], 9), len(r["matched"])) for r in search.symbol_search(symbols, "login").collect()}
    assert got == {"src/user.ts": (0.85, 2), "doc/a.md": (0.3, 1)}
    merged = {r["path"]: r["relevance"] for r in search.merge_hits(search.text_search(files, "login"), search.symbol_search(symbols, "login")).collect()}
    assert merged == {"src/login.ts": 1.0, "src/user.ts": 0.85, "doc/a.md": 0.3}
    found = search.search(files, symbols, search.SearchRequest("login", max_results=2)).orderBy("rank").collect()
    assert [(r["rank"], r["path"], r["total"]) for r in found] == [(1, "src/login.ts", 3), (2, "src/user.ts", 3)]
    hit = search.symbol_context(search.match_lines(files, "user"), symbols).first()
    assert (hit["line_no"], hit["column"], hit["before"], hit["after"], hit["symbol"]) == (2, 1, "x", "end", "login")
    edge = search.match_lines(files, "login").first()
    assert edge["before"] is None and edge["after"] is None


def test_relevance_pools_frequencies(spark):
    files = spark.createDataFrame([("src/user.ts",), ("zero.md",)], "path string")
    symbols = spark.createDataFrame([("src/user.ts", "userUser", "function", True), ("src/user.ts", "other", "userKind", False)], "path string, name string, kind string, exported boolean")
    got = {r["path"]: r for r in rank.relevance(files, "user", symbols).collect()}
    r = got["src/user.ts"]
    assert (round(r["symbol"], 9), r["path_score"], round(r["word"], 9)) == (round(1.2 * 1.3 + 0.5, 9), 1.0, 1.4)
    assert round(r["score"], 9) == round(4 * 2.06 + 3 + 1.4, 9) and got["zero.md"]["score"] == 0


def test_audit(spark):
    files = spark.createDataFrame([("src/a/BadService.ts", "x\ntodo\ntodo"), ("services/GoodService.ts", ""), ("src/n.ts", "todo")], "path string, content string")
    notes = spark.createDataFrame([("src/n.ts", "note", "exempt: T1"), ("src/n.ts", "policy", "p")], "path string, type string, message string")
    catalog = audit.Catalog(files, annotations=notes)
    rules = [
        audit.Rule("a", "A", "file-location", config={"pattern": "*Service.ts", "allowedPaths": ["services/"]}), audit.Rule("b", "B", "text-pattern", "error", config={"pattern": "todo", "exemptToken": "T1"}),
        audit.Rule("c", "C", "required-annotation", config={"annotations": ["policy", "note"], "filePattern": "src/**.ts", "all": True}), audit.Rule("d", "D", "script", "info", script=lambda c: c.files.where("content = ''").select("path", F.lit(1).alias("line"), F.lit("empty").alias("what"))),
    ]
    got = sorted((r["rule_id"], r["file"], r["line"]) for r in audit.audit(catalog, rules).collect())
    assert got == [("a", "src/a/BadService.ts", None), ("b", "src/a/BadService.ts", 2), ("c", "src/a/BadService.ts", None), ("d", "services/GoodService.ts", 1)]
    assert tuple(audit.summary(audit.audit(catalog, rules, "b")).first()) == (1, 0, 0, False)
    with pytest.raises(ValueError):
        audit.audit(catalog, rules, "none")


def test_line_edits(spark):
    c = F.col("a")
    assert one(spark, lines.replace_lines(c, F.lit(2), F.lit(3), F.lit("X\nY\nZ")), a="1\n2\n3\n4") == "1\nX\nY\nZ\n4"
    assert one(spark, lines.insert_lines(c, F.lit(1), F.lit("X")), a="1\n2") == "1\nX\n2"
    assert one(spark, lines.line_range(c, -2), a="1\n2\n3") == "2\n3"
    assert one(spark, lines.exact_range(c, 2, 3), a="1\n2\n3") == "2\n3"
    with pytest.raises(Exception, match="out of range"):
        one(spark, lines.exact_range(c, 2, 4), a="1\n2\n3")
    assert one(spark, lines.append(c, "new"), a="old") == "old\nnew"


def test_symbol_content_and_nesting(spark):
    files = spark.createDataFrame([("f", "ab function\n  in();\n} cd")], "path string, content string")
    symbols = spark.createDataFrame([("f", 0, "outer", 1, 4, 3, 2), ("f", 1, "inner", 2, 1, 3, 1), ("f", 2, "outside", 3, 1, 9, 1)], "path string, ord int, name string, start_line int, start_col int, end_line int, end_col int")
    assert lines.symbol_content(files, symbols, "f", "outer").first()["content"] == "function\n  in();\n} "
    assert [r["name"] for r in lines.nested_symbols(symbols, "f", "outer").collect()] == ["inner"]


def test_fuzzy(spark):
    files = spark.createDataFrame([("f", "alpha\nbeta\ngamma\nbeta")], "path string, content string")
    assert tuple(fuzzy.best_block(files, "beta\ngamna").first())[:2] == ("f", 2)
    numbered = search.lines_of(files)
    assert tuple(fuzzy.best_line(numbered, "beta", 3).first()) == ("f", 2, 1.0)
    assert tuple(fuzzy.best_line(numbered, "   gamma ", 3).first()) == ("f", 3, 0.95)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_block_over_all_files(spark, tmp_path):
    texts = {5: "Of be\nthe thing\nand the", 7: "Öf be\nthe thing\nänd the\nof", 200: "x\nOf be\nthe thing\nand tho", 9000: "é\nß\nof be\nthe\nthing\nand the", 9001: "two\nlines"}
    rows = [(i, t, "en", "src1", len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for i, t in texts.items():
        lines_ = t.split("\n")
        blocks = [(k + 1, "\n".join(lines_[k : k + 3])) for k in range(len(lines_) - 2)]
        scores = [(1 - distance(b, registry._N6) / max(len(b), len(registry._N6)), -k) for k, b in blocks]
        want |= {(i, -max(scores)[1], round(max(scores)[0], 6))} if scores else set()
    files = registry.Model(spark, str(tmp_path)).files().select("path", "doc_id")
    got = registry.QUERIES["n6_best_block"](spark, str(tmp_path)).join(files, "path")
    assert {(r["doc_id"], r["start"], r["score"]) for r in got.collect()} == want and len(want) == 4


def test_blocks_reach_the_last_line(spark, tmp_path):
    text = "\n".join("a license" if n in (1, 11, 402, 403, 1000) else "x" for n in range(1, 1001))
    spark.createDataFrame([(1, text, "en", "src1", 1), (2, None, "en", "src1", 1), (3, "License", "en", "src1", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["path"][-5], r["line_no"]): r["symbol"] for r in registry.QUERIES["j7_symbol_context"](spark, str(tmp_path)).collect()}
    assert got == {("1", 1): "block0", ("1", 11): "block0", ("1", 402): "block39", ("1", 403): "block40", ("1", 1000): "block99", ("3", 1): "block0"}


def test_keywords_of_the_whole_content(spark, tmp_path):
    text = "alpha " * 12 + "lateword\nsecond line éa keyword9"
    spark.createDataFrame([(1, text, "en", "src1", 1), (2, None, "en", "src1", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["path"][-5]: r["words"] for r in registry.QUERIES["n9_keywords"](spark, str(tmp_path)).collect()}
    assert got == {"1": "alpha keyword9 lateword line second", "2": ""}


def test_sessions(spark):
    log = spark.createDataFrame(
        [("s", 0, "file:create", "a", None), ("s", 60, "file:write", "a", None), ("s", 90, "file:write", "b", None), ("s", 99, "file:rename", "b", "c"), ("s", 120, "annotation:add:meta", "a", None), ("s", 130, "group:notate", "g", None)],
        "session_id string, t long, action string, target string, to string",
    ).withColumn("ts", F.timestamp_seconds("t"))
    r = sessions.session_summary(log).first()
    assert (r["created"], r["updated"], r["renamed"], r["annotations"], r["groups"], r["seconds"]) == (["a"], ["b"], ["b->c"], ["a"], ["g"], 130)
    backups = spark.createDataFrame([("daily", i) for i in range(6)] + [("turn", i) for i in range(11)], "kind string, ts int")
    kept, pruned = sessions.retain(backups, ["kind"], [F.desc("ts")], 5)
    assert kept.count() == 10 and rows(pruned.where("kind = 'daily'")) == [("daily", 0)]


def test_journeys(spark):
    events = spark.createDataFrame(
        [("s", 1, "search", "q1", ["a", "b"], None), ("s", 2, "search", "q2", ["b", "c"], None), ("s", 3, "read", None, None, "b"), ("s", 4, "write", None, None, "b"), ("s", 5, "search", "q3", ["z"], None)],
        "session_id string, seq int, kind string, query string, results array<string>, path string",
    )
    got = [(r["journey"], r["step"], r["selected"], r["rejected"], r["target"]) for r in experience.journeys(events).orderBy("journey", "step").collect()]
    assert got == [(1, 1, [], [], "b"), (1, 2, ["b"], ["c"], "b"), (2, 1, [], [], None)]  # a step without a read rejects nothing


def test_durations(spark):
    events = spark.createDataFrame([(1, "s", "t", 1, "start"), (2, "s", "t", 3, "complete"), (3, "s", "t", 9, "complete")], "event_id int, session_id string, tool string, at long, phase string").withColumn("ts", F.timestamp_seconds("at"))
    assert [r["duration_ms"] for r in experience.operation_durations(events).collect()] == [2000]


def test_stores(spark):
    labels = spark.createDataFrame([("l1", "one"), ("l2", "two")], "id string, name string")
    given = spark.createDataFrame([("l1", "a.ts", "file"), ("gone", "a.ts", "file")], "label_id string, target string, target_type string")
    more = spark.createDataFrame([("l1", "a.ts", "file"), ("l2", "a.ts", "file"), ("l2", "a.ts", "file")], given.schema)
    both = stores.assign(given, more)
    assert both.count() == 3 and [r["name"] for r in stores.labels_of(given, labels, "a.ts").collect()] == ["one"]
    assert stores.migrate(both, "l2", "l1").count() == 2
    with pytest.raises(ValueError):
        stores.delete_label(labels, both, "l2")
    assert stores.delete_label(labels, both, "l2", force=True)[0].count() == 1
    files = spark.createDataFrame([("a", "old"), ("b", "old")], "path string, summary string")
    given = spark.createDataFrame([("a", "new"), ("b", "")], "path string, summary string")
    assert rows(stores.overlay_summaries(files, given).select("path", "summary")) == [("a", "new"), ("b", "old")]
    items = spark.createDataFrame([("c", "open", "7", "x", "low"), ("c", "open", "2", "y", "high")], "checklist_id string, trigger string, item_id string, text string, priority string")
    assert stores.add_item(items, checklist_id="c", trigger="open", text="z", priority="medium").where("text = 'z'").first()["item_id"] == "8"
    assert [r["text"] for r in stores.checklist(items, "open").orderBy("rank").collect()] == ["y", "x"]
    a = one(spark, F.struct(*[v.alias(k) for k, v in stores.parse_annotation(F.col("a")).items()]), a="@note.gate [high] be careful")
    assert tuple(a) == ("gate", "high", "be careful")
