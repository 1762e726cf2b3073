"""A store of tables with versions: whole commits over all tables at once, and readers that keep theirs.

Data files are never changed. A version is one small file that names, for each table and
part, the folders with its rows; it comes to be by a rename that fails if another writer
was first. So a crash before the rename leaves the old version whole, and a reader of a version
isn't disturbed by later ones until ``vacuum`` takes what is out of use.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import stage

#: Bytes of a table for each of its parts, and the most parts of a table.
PART_BYTES, MOST_PARTS = 256 << 20, 20_000


class Conflict(Exception):
    """Another writer has changed the same parts since the version that this one began with."""


@dataclass(frozen=True)
class Snapshot:
    """``tables``: name: {schema, key, parts, folders: {part: [folder]}}."""

    version: int
    tables: dict


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # -- versions ------------------------------------------------------------

    def versions(self) -> list[int]:
        log = self._at("log")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(log) if s.getPath().getName().isdigit()) if self._fs.exists(log) else []

    def snapshot(self, version: int | None = None) -> Snapshot:
        """Of the given version, or the latest; -1 and no tables where nothing was committed."""
        if version is None:
            version = max(self.versions(), default=-1)
            if version < 0:
                return Snapshot(-1, {})
        stream = self._fs.open(self._at(f"log/{version:020}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(version, json.loads(text))

    def _publish(self, version: int, tables: dict) -> bool:
        """Whether the version came to be; not if there is one of that number."""
        temp, to = self._at(f"log/.{uuid.uuid4().hex}"), self._at(f"log/{version:020}")
        stream = self._fs.create(temp, False)
        stream.write(bytearray(json.dumps(tables).encode()))
        stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        none = self.spark.sparkContext._gateway.new_array(options, 1)
        none[0] = options.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("").toUri(), self._conf).rename(temp, to, none)
        except Py4JJavaError as e:
            self._fs.delete(temp, False)
            if self._fs.exists(to):
                return False
            raise e
        return True

    # -- reads ---------------------------------------------------------------

    def read(self, snapshot: Snapshot | None = None) -> dict[str, DataFrame]:
        """The tables of a snapshot, by default the latest."""
        snapshot = snapshot or self.snapshot()
        return {name: self._table(t) for name, t in snapshot.tables.items()}

    def _table(self, table: dict) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        folders = sorted({f"{self.path}/{f}" for of in table["folders"].values() for f in of})
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    # -- writes --------------------------------------------------------------

    def _part(self, df: DataFrame, table: dict) -> DataFrame:
        return df.withColumn("__part", F.pmod(F.xxhash64(*table["key"]), F.lit(table["parts"])).cast("int"))

    def _add(self, df: DataFrame) -> dict[str, str]:
        """Writes rows with their ``__part`` to a new folder: {part: folder}."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.partitionBy("__part").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(folder))]
        return {n.partition("=")[2]: f"{folder}/{n}" for n in names if n.startswith("__part=")}

    def _commit(self, base: Snapshot, change: Callable[[dict], dict], touches: dict[str, set[str]] | None) -> int:
        """Publishes the next version. ``touches``: the parts, by table, that are replaced from ``base``; None for what is only added."""
        latest = base
        while True:
            if self._publish(latest.version + 1, change(latest.tables)):
                return latest.version + 1
            latest = self.snapshot(latest.version + 1)
            if touches is None:
                continue
            for name, parts in touches.items():
                was, now = base.tables.get(name), latest.tables.get(name)
                if (was is None) != (now is None) or was and (was["schema"], was["parts"]) != (now["schema"], now["parts"]):
                    raise Conflict(name)
                if was and any(was["folders"].get(p) != now["folders"].get(p) for p in parts):
                    raise Conflict(f"{name}: parts {sorted(parts)}")

    def create(self, tables: dict[str, DataFrame], keys: dict[str, list[str]], parts: int | None = None) -> int:
        """The first version of these tables, in parts by a hash of their key; how many follows from Spark's estimate of their bytes."""
        new = {}
        for name, df in tables.items():
            n = parts or min(MOST_PARTS, max(1, int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // PART_BYTES))
            table = {"schema": df.schema.jsonValue(), "key": keys[name], "parts": n, "folders": {}}
            table["folders"] = {p: [f] for p, f in self._add(self._part(df, table)).items()}
            new[name] = table
        return self._commit(self.snapshot(), lambda old: old | new, {name: set() for name in new})

    def update(self, base: Snapshot, new: dict[str, DataFrame]) -> tuple[int, dict[str, list[int]]]:
        """Commits ``new`` tables in place of those of ``base``: the version, and the parts, by table, that differ and were written.

        A part differs if the number or the sum of its rows' hashes does. If
        another writer has changed one of these parts meanwhile, Conflict is raised and nothing is changed;
        changes to other parts are kept.
        """
        folders, done = {}, {}
        for name, df in new.items():
            table = base.tables[name]
            after = stage(self._part(df.select(*StructType.fromJson(table["schema"]).names), table), "store")
            columns = sorted(c for c in after.columns if c != "__part")
            sums = lambda t: t.groupBy("__part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))  # noqa: E731, B023
            a, b = sums(self._part(self._table(table), table)), sums(after)
            rows = a.join(b.withColumnsRenamed({"n": "n2", "h": "h2"}), "__part", "full").where("not (n <=> n2 and h <=> h2)").select("__part", "n2").collect()  # at most MOST_PARTS
            full = [r["__part"] for r in rows if r["n2"]]
            added = self._add(after.where(F.col("__part").isin(full))) if full else {}
            folders[name] = {str(r["__part"]): [added[str(r["__part"])]] if r["n2"] else [] for r in rows}
            done[name] = sorted(r["__part"] for r in rows)

        def change(tables: dict) -> dict:
            return tables | {n: tables[n] | {"folders": {p: f for p, f in (tables[n]["folders"] | own).items() if f}} for n, own in folders.items()}

        if not any(done.values()):
            return base.version, done
        return self._commit(base, change, {n: set(own) for n, own in folders.items()}), done

    def append(self, name: str, rows: DataFrame) -> int:
        """Commits more rows of a table. Writers that append don't wait for each other and lose nothing."""
        base = self.snapshot()
        table = base.tables[name]
        added = self._add(self._part(rows.select(*StructType.fromJson(table["schema"]).names), table))

        def change(tables: dict) -> dict:
            old = tables[name]["folders"]
            return tables | {name: tables[name] | {"folders": old | {p: [*old.get(p, []), f] for p, f in added.items()}}}

        return self._commit(base, change, None)

    def vacuum(self, keep: int = 2, older_than: float = 24 * 3600) -> int:
        """Deletes all but the last ``keep`` versions, and the data that none of those name and that
        is ``older_than`` so many seconds, so that what writers haven't published yet stays. The number of folders that went."""
        versions = self.versions()
        kept = [self.snapshot(v) for v in versions[-keep:]]
        for v in versions[:-keep]:
            self._fs.delete(self._at(f"log/{v:020}"), False)
        used = {f for s in kept for t in s.tables.values() for of in t["folders"].values() for f in of}
        gone, before = 0, (time.time() - older_than) * 1000
        for folder in self._fs.listStatus(self._at("data")):
            for part in self._fs.listStatus(folder.getPath()):
                name = f"data/{folder.getPath().getName()}/{part.getPath().getName()}"
                if part.isDirectory() and name not in used and part.getModificationTime() <= before:
                    self._fs.delete(part.getPath(), True)
                    gone += 1
        return gone
