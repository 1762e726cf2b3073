"""The tree source: links, parts, filters, streams."""

import os
import time

import pytest

from weftline.sources import ingest, walk


@pytest.fixture
def root(spark, tmp_path):
    walk.register(spark)
    root, outside = tmp_path / "root", tmp_path / "outside"
    for path in ("a/x.ts", "a/b/y.ts", "a/b/c/z.ts", "d/e/w.ts", "top.ts", ".git/config", "node_modules/m.js", "d/skip.log", "é/ü.ts"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(f"text of {path}\r\n")
    (outside / "in").mkdir(parents=True)
    (outside / "o.ts").write_text("outside")
    os.symlink(root, root / "a/b/up")  # a cycle
    os.symlink(root / "d", root / "a/to_d")
    os.symlink(outside, root / "link")
    os.symlink(outside, outside / "in/again")  # a cycle out of the root
    os.symlink(root / "nowhere", root / "dangling")
    return root


def load(spark, root, **options):
    reader = spark.read.format("source_tree").option("root", str(root))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def paths(df):
    return sorted(r["path"] for r in df.select("path").collect())


ALL = ["a/b/c/z.ts", "a/b/y.ts", "a/x.ts", "d/e/w.ts", "d/skip.log", "link/o.ts", "top.ts", "é/ü.ts"]


@pytest.mark.parametrize("splits", [1, 2, 3, 100])
def test_a_tree_with_cycles_ends(spark, root, splits):
    df = load(spark, root, splits=splits)
    assert paths(df) == ALL
    assert splits == 1 or df.rdd.getNumPartitions() > 1
    assert {r["path"]: r["content"] for r in df.collect()}["é/ü.ts"] == "text of é/ü.ts\r\n"
    assert load(spark, root, contents="false").where("content is not null").count() == 0
    assert paths(load(spark, root, ignores="*.log\na/b/**", splits=splits)) == [p for p in ALL if p != "d/skip.log" and not p.startswith("a/b/")]


def test_filters_leave_out_folders(root, monkeypatch):
    opened = []
    real = walk.Tree.entries
    monkeypatch.setattr(walk.Tree, "entries", lambda self, folder: (opened.append(folder), real(self, folder))[1])
    for filters, want, never in (
        ([walk.StringStartsWith(("path",), "a/b/")], ["a/b/c/z.ts", "a/b/y.ts"], {"d", "d/e", "é"}),
        ([walk.EqualTo(("path",), "d/e/w.ts")], ["d/e/w.ts"], {"a/b", "a/b/c"}),
        ([walk.In(("path",), ("top.ts", "a/x.ts")), walk.GreaterThan(("mtime",), 0)], ["a/x.ts", "top.ts"], {"a/b", "d/e"}),
        ([walk.GreaterThan(("mtime",), 1 << 61)], [], set()),
    ):
        opened.clear()
        reader = walk.TreeReader(walk.Tree(str(root), splits=2))
        assert list(reader.pushFilters(filters)) == []
        assert sorted(r[0] for p in reader.partitions() for r in reader.read(p)) == want
        assert not never & set(opened)


def test_filters_in_queries(spark, root):
    assert paths(load(spark, root).where("path like 'a/b/%' and size > 0")) == ["a/b/c/z.ts", "a/b/y.ts"]
    assert paths(load(spark, root).where("path in ('top.ts', 'nothing') and mtime > 5")) == ["top.ts"]


def test_a_stream_takes_changed_files_only(spark, root, tmp_path, monkeypatch):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def batch():
        time.sleep(1.2)  # until what was written has settled
        query = spark.readStream.format("source_tree").option("root", str(root)).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(once=True).start()
        query.awaitTermination(60)
        return paths(spark.read.parquet(out))

    assert batch() == ALL
    (root / "d/e/w.ts").write_text("changed")
    (root / "new.ts").write_text("new")
    assert batch() == sorted([*ALL, "d/e/w.ts", "new.ts"])
    assert batch() == sorted([*ALL, "d/e/w.ts", "new.ts"])


def test_ignores_are_those_of_the_scan(spark):
    from pyspark.sql import functions as F

    patterns = ("node_modules/**", "**/d", "*.log", "a*b", "x/y", "**/gen/**")
    for p in ("node_modules/m", "a/node_modules/m", "d", "q/d", "d/q", "q/d/r", "z.log", "a*b", "aXb", "x/y", "x/y/z", "q/x/y/z", "gen/a", "q/gen/a", "plain.ts"):
        assert walk.is_ignored(p, patterns) == spark.range(1).select(ingest.ignored(F.lit(p), patterns)).first()[0], p
