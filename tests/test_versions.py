"""Versions of stored tables: whole commits, readers, concurrent writers."""

import threading

import pytest
from pyspark.sql import functions as F

from weftline.sources.versions import Conflict, Store

KEYS = {"files": ["path"], "edges": ["src"]}


def shown(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.versions() == [] and s.read() == {}
    files = spark.createDataFrame([(f"f{k}", k) for k in range(20)], "path string, n int")
    edges = spark.createDataFrame([("f1", "f2"), ("f3", "f4")], "src string, dst string")
    assert s.create({"files": files, "edges": edges}, KEYS, parts=8) == 0
    return s


def changed(df, path, n):
    return df.withColumn("n", F.when(F.col("path") == path, n).otherwise(F.col("n")))


def test_a_reader_keeps_its_version(spark, store):
    first = store.snapshot()
    old = store.read(first)
    version, done = store.update(first, {"files": changed(old["files"], "f7", -1).where("path <> 'f9'"), "edges": old["edges"].limit(0)})
    assert version == 1 and 1 <= len(done["files"]) <= 2 and len(done["edges"]) >= 1
    now = store.read()
    assert (old["files"].count(), old["edges"].count(), now["files"].count(), now["edges"].count()) == (20, 2, 19, 0)
    assert now["files"].where("path = 'f7'").first()["n"] == -1 and now["edges"].columns == ["src", "dst"]
    assert shown(store.read(store.snapshot(0))["files"]) == shown(old["files"])
    same = store.read()
    assert store.update(store.snapshot(), same) == (1, {"files": [], "edges": []})
    assert store.vacuum(keep=1, older_than=0) >= 2 and store.versions() == [1] and shown(store.read()["files"]) == shown(now["files"])


def test_a_crash_between_tables_leaves_the_old_version(store, monkeypatch):
    base = store.snapshot()
    before = {n: shown(df) for n, df in store.read().items()}
    real, calls = Store._add, []

    def failing(self, df):
        calls.append(1)
        if len(calls) == 2:
            raise OSError("the disk is gone")
        return real(self, df)

    monkeypatch.setattr(Store, "_add", failing)
    tables = store.read()
    with pytest.raises(OSError):
        store.update(base, {"files": changed(tables["files"], "f1", 99), "edges": tables["edges"].withColumn("dst", F.lit("zz"))})
    monkeypatch.undo()
    assert store.snapshot() == base and {n: shown(df) for n, df in store.read().items()} == before
    assert store.vacuum(older_than=0) >= 1 and {n: shown(df) for n, df in store.read().items()} == before


def test_two_writers(store):
    base = store.snapshot()
    files = store.read(base)["files"]
    part = lambda p: files.where(F.col("path") == p).select(F.pmod(F.xxhash64("path"), F.lit(8))).first()[0]
    other = next(f"f{k}" for k in range(20) if part(f"f{k}") != part("f1"))
    store.update(base, {"files": changed(files, "f1", 100)})
    assert store.update(base, {"files": changed(files, other, 200)})[0] == 2  # another part: both changes stay
    now = {r["path"]: r["n"] for r in store.read()["files"].collect()}
    assert (now["f1"], now[other], len(now)) == (100, 200, 20)
    with pytest.raises(Conflict):
        store.update(base, {"files": changed(files, "f1", 300)})
    assert store.snapshot().version == 2


def test_appends_of_many_writers(spark, store):
    rows = [spark.createDataFrame([(f"w{w}r{r}", r) for r in range(5)], "path string, n int") for w in range(4)]
    threads = [threading.Thread(target=lambda df=df: [store.append("files", df), store.append("files", df)]) for df in rows]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.snapshot().version == 8 and store.read()["files"].count() == 20 + 4 * 2 * 5


def test_nulls_repeated_rows_and_no_rows(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", None)], "path string, n int")
    s.create({"files": df, "none": df.limit(0)}, {"files": ["path"], "none": ["path"]})
    assert s.read()["files"].count() == 4 and s.read()["none"].count() == 0
    _, done = s.update(s.snapshot(), {"files": df.distinct()})
    assert s.read()["files"].count() == 2 and done["files"]
