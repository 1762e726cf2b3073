"""The graph's tables on disk, and their exports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import stage

VERSION = 1


def written(df: DataFrame) -> DataFrame:
    return stage(df, "catalog")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save(tables: dict[str, DataFrame], path: str, root: str) -> None:
    """Writes the tables and a manifest beside ``path`` and renames them there, so that readers see all or
    nothing; what was there is put aside first and deleted last."""
    spark = next(iter(tables.values())).sparkSession
    temp = f"{path}.{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{temp}/{name}")
    spark.createDataFrame([(json.dumps({"version": VERSION, "root": root, "tables": sorted(tables)}),)], "value string").coalesce(1).write.text(f"{temp}/manifest")
    new, fs = _fs(spark, temp)
    here, aside = _fs(spark, path)[0], _fs(spark, f"{path}.{uuid.uuid4().hex}.old")[0]
    fs.mkdirs(here.getParent())
    replaced = fs.exists(here) and fs.rename(here, aside)
    if not fs.rename(new, here):
        if replaced:
            fs.rename(aside, here)
        raise OSError(f"could not rename to {path}")
    if replaced:
        fs.delete(aside, True)


PARTITIONS = 64
_KEY = {"edges": "src", "calls": "src_path"}


def _parted(name: str, df: DataFrame) -> DataFrame:
    return df.withColumn("part", F.pmod(F.xxhash64(_KEY.get(name, "path")), F.lit(PARTITIONS)).cast("int"))


def save_parted(tables: dict[str, DataFrame], path: str) -> None:
    """Writes the tables in PARTITIONS parts by a hash of the file, for ``update``, and their schemas, as a table may be empty."""
    schemas = {}
    for name, df in tables.items():
        parted = _parted(name, df)
        parted.write.mode("overwrite").partitionBy("part").parquet(f"{path}/{name}")
        schemas[name] = parted.schema.jsonValue()
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(schemas),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schemas")


def load_parted(spark: SparkSession, path: str, names=None) -> dict[str, DataFrame]:
    schemas = json.loads(spark.read.text(f"{path}/schemas").first()[0])
    return {name: spark.read.schema(StructType.fromJson(schemas[name])).parquet(f"{path}/{name}") for name in names or schemas}


def update(old: dict[str, DataFrame], new: dict[str, DataFrame], path: str) -> dict[str, list[int]]:
    """Rewrites only the parts of the tables in which ``old`` (of load_parted) and ``new`` differ, and names them.

    A part differs if the number or the sum of its rows' hashes does. New rows
    are written aside before a part is replaced as a whole.
    """
    done = {}
    # All are written aside first, as a new table may be made of any old one.
    for name, after in {name: written(_parted(name, df.drop("part"))) for name, df in new.items()}.items():
        columns = sorted(c for c in after.columns if c != "part")
        sums = lambda t: t.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h"))  # noqa: E731, B023
        a, b = sums(old[name].select(*after.columns)), sums(after)
        differ = a.join(b.withColumnsRenamed({"n": "n2", "h": "h2"}), "part", "full").where("not (n <=> n2 and h <=> h2)").select("part", "n2").collect()  # at most PARTITIONS
        full = [r["part"] for r in differ if r["n2"]]
        if full:
            after.where(F.col("part").isin(full)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")
        fs = _fs(after.sparkSession, path)[1]
        for r in differ:
            if not r["n2"]:
                fs.delete(_fs(after.sparkSession, f"{path}/{name}/part={r['part']}")[0], True)
        done[name] = sorted(r["part"] for r in differ)
    return done


def load(spark: SparkSession, path: str, root: str) -> dict[str, DataFrame] | None:
    """The tables, or None if there are none of this version and root."""
    p, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        return None
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if (manifest["version"], manifest["root"]) != (VERSION, root):
        return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in manifest["tables"]}


def nodes_and_edges(files: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    return files.select(F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("label")), edges.select(F.col("src").alias("source"), F.col("dst").alias("target"))


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def compact(df: DataFrame) -> DataFrame:
    """A line for each row: its values, tab-separated."""
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))


def as_table(df: DataFrame) -> DataFrame:
    """Lines (line, value) of aligned columns: the names at line 0, a rule at 1, the rows at 2; ``No results`` without rows.

    A column is as wide as its name or its longest value, found in one pass beforehand. Null, zero and false are blank.
    """
    kinds = dict(df.dtypes)
    blank = lambda c: F.col(f"`{c}`").isNull() | (F.col(f"`{c}`").cast("string").isin("0", "0.0", "false") & F.lit(kinds[c] != "string"))
    shown = {c: F.when(blank(c), "").otherwise(F.col(f"`{c}`").cast("string")) for c in df.columns}
    rows = df.select(*[v.alias(f"c{k}") for k, v in enumerate(shown.values())])
    found = rows.agg(F.count("*").alias("n"), *[F.max(F.length(f"c{k}")).alias(f"w{k}") for k in range(len(shown))]).first()  # one row
    if not found["n"]:
        return df.sparkSession.createDataFrame([(0, "No results")], "line int, value string")
    widths = [max(len(c), found[f"w{k}"]) for k, c in enumerate(df.columns)]
    head = [(0, " | ".join(c.ljust(w) for c, w in zip(df.columns, widths, strict=True))), (1, "-+-".join("-" * w for w in widths))]
    lines = rows.select(F.lit(2).alias("line"), F.concat_ws(" | ", *[F.rpad(f"c{k}", w, " ") for k, w in enumerate(widths)]).alias("value"))
    return df.sparkSession.createDataFrame(head, "line int, value string").unionByName(lines)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
