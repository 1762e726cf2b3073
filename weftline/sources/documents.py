"""JSON store documents to tables: groups, labels, annotations, summaries, and named documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The layout of the store documents.
_GROUP = "struct<name:string,description:string,members:array<struct<type:string,path:string>>,notations:array<struct<text:string,file:string,line:int,timestamp:bigint>>,createdAt:bigint,updatedAt:bigint>"
_LABEL = "struct<id:string,emoji:string,name:string,description:string,bgColor:string,fgColor:string,createdAt:bigint,updatedAt:bigint>"
_ASSIGNMENT = "struct<labelId:string,target:string,targetType:string,recursive:boolean,assignedAt:bigint>"
_NOTE = "struct<type:string,text:string,severity:string,attachedAt:string,source:string>"
_SCHEMAS = {
    "groups": f"version int, groups map<string,{_GROUP}>",
    "labels": f"version int, labels map<string,{_LABEL}>, assignments array<{_ASSIGNMENT}>",
    "annotations": f"map<string,struct<inline:array<{_NOTE}>,meta:array<{_NOTE}>>>",
    "summaries": "version int, summaries map<string,struct<summary:string,updatedAt:bigint,source:string>>",
}


def _document(spark: SparkSession, path: str, store: str) -> DataFrame:
    """One row a file with its document as ``d``; a text that isn't one gives a null."""
    schema = _SCHEMAS[store]
    schema = schema if schema.startswith("map") else "struct<" + ", ".join(c.replace(" ", ":", 1) for c in schema.split(", ")) + ">"
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))


def load_groups(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """groups, group_members and group_notations."""
    rows = _document(spark, path, "groups").select(F.explode("d.groups").alias("name", "g"))
    members = rows.select("name", F.explode("g.members").alias("m")).select("name", F.col("m.type").alias("member_type"), "m.path")
    notes = rows.select("name", F.posexplode("g.notations").alias("ord", "n")).select("name", "ord", "n.text", "n.file", "n.line", F.col("n.timestamp").alias("ts"))
    groups = rows.select("name", "g.description", F.col("g.createdAt").alias("created_at"), F.col("g.updatedAt").alias("updated_at"))
    return {"groups": groups, "group_members": members, "group_notations": notes}


def load_labels(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """labels and label_assignments, the latter with their order."""
    doc = _document(spark, path, "labels")
    labels = doc.select(F.explode("d.labels").alias("k", "l")).select("l.id", "l.emoji", "l.name", "l.description", F.col("l.bgColor").alias("bg_color"), F.col("l.fgColor").alias("fg_color"), F.col("l.createdAt").alias("created_at"), F.col("l.updatedAt").alias("updated_at"))
    rows = doc.select(F.posexplode("d.assignments").alias("ord", "a"))
    assignments = rows.select("ord", F.col("a.labelId").alias("label_id"), "a.target", F.col("a.targetType").alias("target_type"), F.coalesce("a.recursive", F.lit(False)).alias("recursive"), F.col("a.assignedAt").alias("assigned_at"))
    return {"labels": labels, "label_assignments": assignments}


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, ord, type, text, severity, attached_at) of both kinds."""
    sets = _document(spark, path, "annotations").select(F.explode("d").alias("path", "s"))
    of = lambda c: sets.select("path", F.lit(c).alias("source"), F.posexplode(f"s.{c}").alias("ord", "a")).select("path", "source", "ord", "a.type", "a.text", "a.severity", F.col("a.attachedAt").cast("timestamp").alias("attached_at"))
    return of("inline").unionByName(of("meta"))


def load_summaries(spark: SparkSession, path: str) -> DataFrame:
    rows = _document(spark, path, "summaries").select(F.explode("d.summaries").alias("path", "s"))
    return rows.select("path", "s.summary", F.col("s.updatedAt").alias("updated_at"), "s.source")


def load_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A store of one JSON document a file, such as macros, routines, templates or
    checklists: its fields by ``schema``, and the file's name as ``id``."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("f"), F.from_json("value", schema).alias("d"))
    return rows.where("d is not null").select(F.regexp_replace("f", r"\.json$", "").alias("id"), "d.*")


def load_topics(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, size, last_modified) of a folder of Markdown files."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    return rows.select(name.alias("name"), F.col("content").cast("string").alias("content"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("last_modified"))


def document(df: DataFrame, key: str, into: str) -> DataFrame:
    """A table as the JSON document of a small store: one row ``value`` with a map from ``key`` to the other columns."""
    entry = F.struct(F.col(key), F.struct(*[c for c in df.columns if c != key]))
    return df.agg(F.to_json(F.struct(F.lit(1).alias("version"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias(into))).alias("value"))
