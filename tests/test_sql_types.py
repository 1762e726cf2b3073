"""Parsers as table functions, metadata of any type, order by locale."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weftline.operators import search, stores
from weftline.sources import catalog, functions, parsers

FILES = [("a.ts", "export function a() { return b(); }\nclass C { m() {} }\n"), ("b.php", "<?php\nfunction q() { return 1; }\n"), ("none.txt", "function x() {}"), ("null.ts", None), ("noext", "function y() {}"), (None, "function z() {}")]


def test_table_functions_give_the_parsers_rows(spark):
    files = spark.createDataFrame(FILES, "path string, content string")
    functions.register(spark)
    files.createOrReplaceTempView("sources")
    got = spark.sql("select f.path, s.* from sources f, lateral source_symbols(f.path, f.content) s")
    want = parsers.symbols(files.where("path is not null"))
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 3
    calls = spark.sql("select f.path, c.* from sources f, lateral source_calls(f.path, f.content) c")
    assert sorted(map(str, calls.collect())) == sorted(map(str, parsers.raw_calls(files.where("path is not null")).collect()))
    with pytest.raises(AnalysisException):
        spark.sql("select * from source_symbols(1, 2)").collect()
    functions.register(spark, {".txt": parsers.script_symbols})
    assert [r["path"] for r in spark.sql("select f.path, s.name from sources f, lateral source_symbols(f.path, f.content) s").collect()] == ["none.txt"]


def test_metadata_of_any_type(spark):
    as_rows = lambda rows: spark.createDataFrame(rows, "path string, plugin string, json string").select("path", "plugin", F.parse_json("json").alias("values"))
    old = as_rows([("a", "p", '{"n": 1, "deep": {"x": [1, {"y": null}]}, "s": "1"}'), ("b", "p", '{"n": 2}'), ("a", "q", '{"n": 9}'), ("c", "p", None)])
    new = as_rows([("a", "p", '{"n": 1.5, "s": [true]}'), ("c", "p", '{"z": 3}'), ("d", "p", '{"k": "v"}')]).drop("plugin")
    got = {(r["path"], r["plugin"]): r["j"] for r in stores.merge_variants(old, "p", new).select("path", "plugin", F.to_json("values").alias("j")).collect()}
    assert got == {("a", "p"): '{"deep":{"x":[1,{"y":null}]},"n":1.5,"s":[true]}', ("b", "p"): '{"n":2}', ("a", "q"): '{"n":9}', ("c", "p"): '{"z":3}', ("d", "p"): '{"k":"v"}'}
    kinds = stores.merge_variants(old, "p", new).where("path = 'a' and plugin = 'p'").select(F.schema_of_variant("values")).first()[0]
    assert "n: DECIMAL(2,1)" in kinds and "s: ARRAY<BOOLEAN>" in kinds


def test_pages_by_locale(spark):
    names = ["zebra", "Äpfel", "apple", "Apple", "éclair", "Eclair", "Zulu", "eclair", "Öl", "oak", "ångström", "banana"]
    labels = spark.createDataFrame([(f"id{k}", n) for k, n in enumerate(names)], "id string, name string").repartition(3)
    pages = [[r["name"] for r in stores.labels_by_name(labels, k, 5).orderBy("rank").collect()] for k in (1, 2, 3)]
    assert pages == [["ångström", "Äpfel", "Apple", "apple", "banana"], ["Eclair", "eclair", "éclair", "oak", "Öl"], ["zebra", "Zulu"]]


def test_tables_of_aligned_columns(spark):
    df = spark.createDataFrame([("a", 10, True, "0"), ("long name", 0, False, ""), (None, None, None, "é")], "n string, number int, yes boolean, `x y` string")
    assert [r["value"] for r in catalog.as_table(df).orderBy("line", F.desc("value")).collect()] == [
        "n         | number | yes  | x y", "----------+--------+------+----", "long name |        |      |    ", "a         | 10     | true | 0  ", "          |        |      | é  ",
    ]
    assert [tuple(r) for r in catalog.as_table(df.limit(0)).collect()] == [(0, "No results")]


def test_groups_of_hits(spark):
    hits = spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    members = spark.createDataFrame([("g2", "a"), ("g1", "a$f"), ("g1", "a"), ("g3", "b"), ("gone", "c"), ("g1", "z")], "name string, path string")
    groups = spark.createDataFrame([("g1", "one"), ("g2", "two"), ("g3", None)], "name string, description string")
    notations = spark.createDataFrame([("g1", 2, "later"), ("g1", 1, "first")], "name string, ord int, text string")
    got = {r["path"]: r["groups"] and [tuple(g) for g in r["groups"]] for r in search.hits_with_group_details(hits, members, groups, notations).collect()}
    assert got == {"a": [("g1", "one", "first"), ("g2", "two", "two")], "b": [("g3", None, None)], "c": None}
