"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_root: list[str] = []
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys of more than one in so many rows are hot: there are at most so many of them.
HOT = 10_000
#: Rows of a lookup that is broadcast whole.
FEW = 50_000


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent or empty and the master is local, as in
    tests, is a temporary folder made for this process.
    """
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="weftline-"))
    return "file://" + _own_root[0]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a full URI, which goes when the driver process ends."""
    parent = f"{shared_root(spark)}/weftline-{uuid.uuid4().hex}"
    atexit.register(_quietly_remove, spark, parent)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{parent}/{name}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends: its result is in a table."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def stage(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Writes ``df`` to a table in the shared folder and returns it reread.

    Cuts the lineage: a lost executor costs a reread, not a recomputation. The
    table goes with ``discard``, or when the driver process ends, as the
    result may be read lazily.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/weftline-{uuid.uuid4().hex}/{name}"
    with _shuffles_removed(spark):
        df.write.option("compression", codec).parquet(path)
    atexit.register(_quietly_remove, spark, path.rsplit("/", 1)[0])
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stage_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stage`` that nothing will read again."""
    for df in tables:
        remove(df.sparkSession, df.stage_path.rsplit("/", 1)[0])


def _quietly_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone at interpreter exit
        pass


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted rather than broadcast, whatever size Spark expects.

    That size is of compressed files, and of a parser's rows it is a guess: a
    table of paths may be twenty times as large in the driver's memory.
    """
    return df.hint("merge")


def by_count(lookup: DataFrame) -> DataFrame:
    """``lookup``, a table, as a side of a join: broadcast if it has at most FEW rows, else sorted."""
    return F.broadcast(lookup) if lookup.count() <= FEW else unbroadcast(lookup)


def spread_join(rows: DataFrame, lookup: DataFrame, on: str, often: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``lookup``, which is unique in ``on`` and whose column
    ``often`` (dropped) is at least the number of rows that have the key.

    ``total`` is at least the sum of ``often``. A lookup of up to FEW rows is
    broadcast. Of a larger one the keys of more than a share of 1 / HOT of all
    rows, of which there are fewer than HOT, are broadcast, so that their rows
    stay where they are; only the rows of other keys are shuffled. Both sides
    may be read several times: let them be tables.
    """
    if lookup.count() <= FEW:
        return rows.join(F.broadcast(lookup.drop(often)), on, how)
    cut = max(total // HOT, 1000)
    hot = F.broadcast(lookup.where(F.col(often) > cut).drop(often))
    rest = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(lookup.where(F.col(often) <= cut).drop(often), on, how)
    return rows.join(hot, on).unionByName(rest)
