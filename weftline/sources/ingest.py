"""Scanning a tree of files into tables, and keeping them up to date."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import parsers

# What is never scanned, and the patterns that are ignored by default.
SKIPPED_DIRECTORIES = ("node_modules", "dist", "out", "build")
DEFAULT_IGNORES = ("node_modules/**", ".git/**", "dist/**", "build/**", "out/**", ".next/**", ".nuxt/**", "coverage/**", ".DS_Store", "Thumbs.db")


def ignored(path: Column, patterns) -> Column:
    """Whether a pattern takes the path: itself, ``**/x/**``, ``x/**``, ``**/x``, ``*.ext`` or a bare name with what is below it; other patterns with a * take nothing."""

    def one(p: str) -> Column:
        p = p.replace("\\", "/")
        below = lambda d: (path == d) | path.startswith(d + "/")
        if p.startswith("**/") and p.endswith("/**") and len(p) > 5:
            return below(p[3:-3]) | path.contains("/" + p[3:-3] + "/")
        if p.endswith("/**"):
            return below(p[:-3])
        if p.startswith("**/"):
            return (path == p[3:]) | path.endswith("/" + p[3:]) | path.contains("/" + p[3:] + "/")
        if p.startswith("*."):
            return path.endswith(p[1:])
        return path == p if "*" in p else below(p)

    return reduce(lambda a, b: a | b, map(one, patterns), F.lit(False))


def gitignore_patterns(text: str) -> list[str]:
    """The patterns of an ignore file: no blanks or comments, slashes at the ends dropped, what has no * with all below it."""
    out = []
    for line in map(str.strip, text.split("\n")):
        if line and not line.startswith("#"):
            p = line.strip("/")
            out.append(p if "*" in p else p + "/**")
    return list(dict.fromkeys(out))


def gitignore_pattern(line: Column) -> Column:
    """The pattern of one line of an ignore file, as gitignore_patterns has it; null of a blank or a comment."""
    line = F.regexp_replace(line, r"^\s+|\s+$", "")
    p = F.regexp_replace(line, "^/+|/+$", "")
    return F.when((line != "") & ~line.startswith("#"), F.when(p.contains("*"), p).otherwise(F.concat(p, F.lit("/**"))))


def hidden(path: Column) -> Column:
    folders = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.startswith(".") | d.isin(*SKIPPED_DIRECTORIES))


def listing(spark: SparkSession, root: str, ignores=DEFAULT_IGNORES, all_folders: bool = False, max_bytes: int | None = None, max_depth: int = 50) -> DataFrame:
    """(path, uri, mtime, size) of the files below ``root``, in any store of Spark's; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub("^[a-z0-9]+:/*", "/", root).rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    df = files.select(F.substring_index(plain, base, -1).alias("path"), F.col("path").alias("uri"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    df = df.where(~ignored(F.col("path"), ignores) & (F.size(F.split("path", "/")) <= max_depth + 1))
    if not all_folders:
        df = df.where(~hidden(F.col("path")))
    return df if max_bytes is None else df.where(F.col("size") <= max_bytes)


def read_files(spark: SparkSession, root: str, tag: str | None = None, **how) -> DataFrame:
    """The files table with contents, hashes and heuristic summaries; with ``tag``, that
    of the project's annotations, their tags and domain too."""
    files = _rows(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root), listing(spark, root, **how))
    return files if tag is None else with_annotations(files, tag)


def _rows(raw: DataFrame, kept: DataFrame) -> DataFrame:
    df = raw.select(F.col("path").alias("uri"), "content").join(kept, "uri").withColumn("content", F.col("content").cast("string"))
    p = F.col("path")
    return df.select(
        "path", T.base_name(p).alias("name"), T.directory(p).alias("dir_path"), parsers.summary(p, F.col("content")).alias("summary"),
        "content", F.sha2("content", 256).alias("content_hash"), F.col("mtime").alias("last_modified"), "size",
    )


def with_annotations(files: DataFrame, tag: str) -> DataFrame:
    """The files with the tags of their annotations and their domain (null without one)."""
    tags = parsers.annotations(files, tag).where("tags is not null").select("path", F.explode("tags").alias("tag"))
    tags = tags.groupBy("path").agg(F.sort_array(F.collect_set("tag")).alias("tags"))
    domain = parsers.domains(parsers.categorised(files, tag)).select("path", F.struct("name", "relevance", "message", "searchable").alias("domain"))
    return files.join(tags, "path", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).join(domain, "path", "left")


#: Changed files that are read by their names; more are read with all others and joined.
BY_NAME = 10_000


def rescan(spark: SparkSession, root: str, cached: DataFrame, **how) -> DataFrame:
    """The files table brought up to date from ``cached``, one of read_files: rows of
    files that are as they were stay, new and changed files are read and gone ones go."""
    now = listing(spark, root, **how)
    what = incremental(now, cached.select("path", F.col("last_modified").alias("mtime")))
    kept = cached.join(what.where("what = 'keep'").select("path"), "path", "left_semi")
    fresh = now.join(what.where("what = 'parse'").select("path"), "path", "left_semi")
    names = [r["uri"] for r in fresh.select("uri").limit(BY_NAME + 1).collect()]
    if not names:
        return kept
    raw = spark.read.format("binaryFile")
    raw = raw.load(names) if len(names) <= BY_NAME else raw.option("recursiveFileLookup", "true").load(root)
    return kept.unionByName(_rows(raw, fresh).select(*kept.columns))


def incremental(listing: DataFrame, cached: DataFrame) -> DataFrame:
    """(path, what): parse what is new or has another mtime, keep the rest, evict what is gone."""
    both = listing.select("path", F.col("mtime").alias("now")).join(cached.select("path", F.col("mtime").alias("then")), "path", "full")
    what = F.when(F.col("now").isNull(), "evict").when(F.col("now") == F.col("then"), "keep").otherwise("parse")
    return both.select("path", what.alias("what"))


def stale(cached: DataFrame, listing: DataFrame) -> DataFrame:
    """Cached files that changed later or are gone."""
    joined = cached.join(listing.select("path", F.col("mtime").alias("__now")), "path", "left")
    return joined.where(F.col("__now").isNull() | (F.col("__now") > F.col("mtime"))).drop("__now")
