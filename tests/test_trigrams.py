"""The index of trigrams: plans, candidates and what is read, against scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import search, trigrams

CONTENTS = [
    "", None, "ab", "Licensed under the Apache License\nsecond line", "released under MIT License.", "LICENSE", "licens\ned", "naïve café über", "straße STRASSE", "KKelvin sign", "foo bar baz\nfoobarbaz", "foo(bar)", "x" * 100,
    "aaa aab aba", "tab\there", "the quick brown fox", "QUICK BROWN", "a.b.c", "日本語 text 日本語", "İstanbul",
]


@pytest.fixture(scope="module")
def files(spark):
    rows = [(f"src/f{k}.ts", c, (c or "")[:20]) for k, c in enumerate(CONTENTS)]
    return spark.createDataFrame(rows, "path string, content string, summary string").cache()


def holds(plan, text):
    lower = text.lower()
    grams = {lower[i : i + 3] for i in range(len(lower) - 2)}
    return plan.holds(lambda g: g in grams)


PATTERNS = [
    "licens", "foo.*baz", "foo|quick", "(foo|bar)baz", "f(oo|uu) bar", "qu+ick", "(quick )+brown", "(quick)?brown", "a{2,3}b", r"\bfoo\b", "[fg]oo bar", "foo[(]bar", "^the", "fox$", "(?i)QUICK", "(?x) quick \\s brown", "über", "str(a|b)ße", "x{50}", "", "a.b.c", r"a\.b\.c",
    r"\Qa.b\E", "(?=foo)f", "(?<!x)quick", "(?:under) (?P<x>MIT|the)", "日本語 text", "foo(bar", "k", "ab|", "(ab|ba)a", r"\x66oo", "second|third|", "(a)(b)(c)", "stanbul", "elvin",
]


def test_plans_never_lose_a_match():
    for pattern in PATTERNS:
        plan = trigrams.of_regex(pattern)
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            assert plan.everything
            continue
        for text in CONTENTS:
            if text and compiled.search(text):
                assert holds(plan, text), (pattern, text)
    assert trigrams.of_regex("foo|quick") == trigrams.Plan("any", (trigrams.of_literal("foo"), trigrams.of_literal("quick")))
    assert trigrams.of_regex("(foo|b)ar").everything is True and not trigrams.of_regex("abcd.*xyz").everything
    assert trigrams.of_glob("SRC*.test.ts").grams() >= {"src", ".te", ".ts"}


def test_random_patterns():
    rng = random.Random(3)
    for _ in range(500):
        pattern = "".join(rng.choice(["ab", "a", "b", "abc", "(", ")", "|", ".", "*", "+", "?", "[ab]", "(abc|bca)", "cab"]) for _ in range(rng.randrange(1, 7)))
        try:
            compiled = re.compile(pattern, re.I)
        except re.error:
            continue
        plan = trigrams.of_regex(pattern)
        for _ in range(20):
            text = "".join(rng.choices("abcAB ", k=rng.randrange(12)))
            assert not compiled.search(text) or holds(plan, text), (pattern, text)


def test_searches_over_the_index_equal_scans(spark, files):
    index = trigrams.build(files).cache()
    shown = lambda df: sorted(map(str, df.collect()))
    for query in ("licens", "QUICK", "fo", "über", "foo bar", "nowhere", "日本語"):
        assert shown(search.match_lines(trigrams.narrowed(files, index, trigrams.of_literal(query)), query)) == shown(search.match_lines(files, query)), query
    for pattern in ("licens|quick", "foo.*baz", "(MIT|Apache) License", "straße", "foo(bar"):
        assert shown(search.match_lines(trigrams.narrowed(files, index, trigrams.of_regex(pattern)), pattern, use_regex=True)) == shown(search.match_lines(files, pattern, use_regex=True)), pattern
    names = trigrams.build(files, "path", "summary")
    for query in ("f1 quick", "src", "license f3", "zz"):
        assert shown(search.text_search(trigrams.narrowed(files, names, trigrams.of_search(query)), query)) == shown(search.text_search(files, query))
    for glob in ("*f1*.ts", "SRC/f?.ts", "nothing*"):
        assert shown(search.find_by_name(trigrams.narrowed(files, names, trigrams.of_glob(glob)), glob)) == shown(search.find_by_name(files, glob))


def test_many_candidates_are_joined(spark, files, monkeypatch):
    monkeypatch.setattr(trigrams, "FEW_PATHS", 1)
    index = trigrams.build(files)
    assert search.match_lines(trigrams.narrowed(files, index, trigrams.of_literal("license")), "license").count() == 3


def test_an_index_follows_changes(spark, files):
    written = spark.createDataFrame([("src/f3.ts", "something else"), ("src/new.ts", "a license")], "path string, content string")
    gone = spark.createDataFrame([("src/f5.ts",)], "path string")
    now = files.join(written.unionByName(gone, allowMissingColumns=True), "path", "left_anti").select("path", "content").unionByName(written)
    index = trigrams.updated(trigrams.build(files), written, gone)
    assert sorted(map(tuple, index.collect())) == sorted(map(tuple, trigrams.build(now).collect()))


def test_only_the_candidates_are_read(spark, tmp_path):
    """The scan of the texts, of files in small parts by path, reads the rows of the candidates' parts."""
    texts = spark.range(2000).select(F.format_string("f%05d", "id").alias("path"), F.when(F.col("id") == 777, "the needle here").otherwise(F.concat(F.lit("hay "), F.col("id").cast("string"))).alias("content"))
    texts.repartitionByRange(40, "path").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    trigrams.save(trigrams.build(files), str(tmp_path / "index"))
    found = search.match_lines(trigrams.narrowed(files, spark.read.parquet(str(tmp_path / "index")), trigrams.of_literal("needle")), "needle")
    assert [r["path"] for r in found.collect()] == ["f00777"]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 100

