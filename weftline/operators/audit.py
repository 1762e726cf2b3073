"""Architecture rules compiled to filters; violations are rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


@dataclass(frozen=True)
class Rule:
    """``type``: file-location, forbidden-import, text-pattern, required-annotation or script."""

    id: str
    name: str
    type: str
    severity: str = "warning"
    enabled: bool = True
    config: dict = field(default_factory=dict)
    script: Callable[["Catalog"], DataFrame] | None = None


@dataclass
class Catalog:
    """files: path, content; imports: path, spec; edges: src, dst; annotations: path, type, message."""

    files: DataFrame
    imports: DataFrame | None = None
    edges: DataFrame | None = None
    annotations: DataFrame | None = None


def _file_location(c: Catalog, config: dict) -> DataFrame:
    wrong = T.base_name(F.col("path")).rlike(T.audit_name_pattern(config["pattern"])) & ~T.any_of([F.col("path").contains(p) for p in config["allowedPaths"]])
    return c.files.where(wrong).select("path", F.lit(None).cast("int").alias("line"), F.lit("outside its allowed paths").alias("what"))


def _forbidden_import(c: Catalog, config: dict) -> DataFrame:
    raw = c.imports.select("path", "spec")
    if c.edges is not None:
        raw = raw.unionByName(c.edges.select(F.col("src").alias("path"), F.col("dst").alias("spec")))
    bad = F.col("spec").isin(list(config["forbiddenImports"])) & ~T.any_of([F.col("path").contains(p) for p in config.get("exemptFiles", ())])
    return raw.where(bad).select("path", F.lit(None).cast("int").alias("line"), F.concat(F.lit("imports "), F.col("spec")).alias("what"))


def _text_pattern(c: Catalog, config: dict) -> DataFrame:
    lines = F.split("content", "\n")
    hit = (lambda x: x.rlike(config["pattern"])) if config.get("regex") else (lambda x: x.contains(config["pattern"]))
    first = F.array_position(F.transform(lines, hit), F.lit(True)).cast("int")
    return c.files.select("path", first.alias("line")).where("line > 0").select("path", "line", F.lit("has the pattern").alias("what"))


def _required_annotation(c: Catalog, config: dict) -> DataFrame:
    wanted = F.array(*map(F.lit, config["annotations"]))
    have = c.annotations.groupBy("path").agg(F.collect_set("type").alias("have"))
    files = c.files.where(F.col("path").rlike(T.audit_glob_pattern(config["filePattern"]))).select("path").join(have, "path", "left").withColumn("have", F.coalesce("have", F.array().cast("array<string>")))
    fine = F.size(F.array_except(wanted, "have")) == 0 if config.get("all") else F.arrays_overlap("have", wanted)
    return files.where(~fine).select("path", F.lit(None).cast("int").alias("line"), F.lit("lacks annotations").alias("what"))


_TYPES = {"file-location": _file_location, "forbidden-import": _forbidden_import, "text-pattern": _text_pattern, "required-annotation": _required_annotation}


def _script(script: Callable, catalog: Catalog) -> DataFrame:
    """Rows (path, line, what) of a script's result: a table of them (line and what may lack), a
    condition on files, paths, or true or false for the project as a whole."""
    found = script(catalog)
    spark = catalog.files.sparkSession
    if isinstance(found, bool):
        found = spark.createDataFrame([] if found is False else [(".",)], "path string")
    elif isinstance(found, (list, tuple)):
        found = spark.createDataFrame([(str(p),) for p in found], "path string")
    elif isinstance(found, Column):
        found = catalog.files.where(found)
    line = F.col("line").cast("int") if "line" in found.columns else F.lit(None).cast("int")
    what = F.col("what") if "what" in found.columns else F.lit("breaks the rule")
    return found.select("path", line.alias("line"), what.alias("what"))


def check(rule: Rule, catalog: Catalog) -> DataFrame:
    """rule_id, rule_name, file, line, severity, message; files with a note that holds the rule's exempt token are left out."""
    found = _script(rule.script, catalog) if rule.type == "script" else _TYPES[rule.type](catalog, rule.config)
    token = rule.config.get("exemptToken")
    if token and catalog.annotations is not None:
        notes = catalog.annotations.where((F.col("type") == "note") & F.col("message").contains(token)).select("path")
        found = found.join(notes, "path", "left_anti")
    return found.select(F.lit(rule.id).alias("rule_id"), F.lit(rule.name).alias("rule_name"), F.col("path").alias("file"), "line", F.lit(rule.severity).alias("severity"), F.col("what").alias("message"))


def audit(catalog: Catalog, rules: list[Rule], rule_id: str | None = None) -> DataFrame:
    chosen = [r for r in rules if r.enabled and rule_id in (None, r.id)]
    if not chosen:
        raise ValueError("no rule to check")
    return reduce(DataFrame.unionByName, [check(r, catalog) for r in chosen])


def summary(violations: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return violations.agg(count("error").alias("errors"), count("warning").alias("warnings"), count("info").alias("infos"), (F.count("*") == 0).alias("clean"))
