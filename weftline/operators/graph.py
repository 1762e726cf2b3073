"""Import and call graph: resolution, neighbours, traversal, impact.

``edges``: src, dst; ``calls``: src_path, src_sym, dst_path, dst_sym.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import stage, unbroadcast

# The extensions in the order in which they are tried.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".vue", ".mjs", ".cjs")


def written(df: DataFrame) -> DataFrame:
    """``df`` kept in the shared folder until the driver ends, and reread, to end its lineage."""
    return stage(df, "graph")


def normal_path(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; what leaves the root is dropped."""
    empty = F.array().cast("array<string>")
    step = lambda acc, s: F.when((s == "") | (s == "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def import_candidates(imports: DataFrame) -> DataFrame:
    """(src, spec, prio, dst): the paths that an import (path, spec) may mean, the first one that exists being it.

    Only specs from ``.`` (relative to the importer) or ``@/`` (src/ of the
    root) have any: the path itself, then its stem with each extension, then
    its index file with each.
    """
    spec = F.col("spec")
    local = imports.where(spec.startswith(".") | spec.startswith("@/"))
    joined = F.when(spec.startswith("@/"), F.concat(F.lit("src/"), F.substring(spec, 3, 1 << 20))).otherwise(F.concat_ws("/", T.directory(F.col("path")), spec))
    based = local.select("path", "spec", normal_path(joined).alias("base"))
    known = r"\.(ts|tsx|js|jsx|vue|mjs|cjs)$"
    stem = F.regexp_replace("base", known, "")
    candidates = [F.col("base"), *[F.concat(stem, F.lit(e)) for e in EXTENSIONS], *[F.concat(F.col("base"), F.lit("/index" + e)) for e in EXTENSIONS]]
    return based.select(F.col("path").alias("src"), "spec", F.posexplode(F.array(*candidates)).alias("prio", "dst"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct edges from imports (path, spec): the first of their candidates that is a file."""
    found = import_candidates(imports).join(unbroadcast(files.select(F.col("path").alias("dst"))), "dst", "left_semi")
    return found.groupBy("src", "spec").agg(F.min_by("dst", "prio").alias("dst")).select("src", "dst").distinct()


def importers(edges: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("dst") == path).select(F.col("src").alias("path")).join(files.select("path"), "path", "left_semi")


def imports(edges: DataFrame, files: DataFrame, path: str) -> DataFrame:
    return edges.where(F.col("src") == path).select(F.col("dst").alias("path")).join(files.select("path"), "path", "left_semi")


def related(edges: DataFrame, files: DataFrame, path: str, most: int = 20) -> DataFrame:
    one = lambda df, d: df.orderBy("path").limit(most).select("path", F.lit(d).alias("direction"))
    return one(imports(edges, files, path), "imports").unionByName(one(importers(edges, files, path), "importers"))


def shared_imports(edges: DataFrame, path: str) -> DataFrame:
    """Files that import what ``path`` imports, with the number of shared imports.

    Seeded by one file, so the join is by its own imports, never by all pairs.
    """
    mine = edges.where(F.col("src") == path).select("dst").distinct()
    return edges.join(mine, "dst", "left_semi").where(F.col("src") != path).groupBy("src").agg(F.countDistinct("dst").alias("shared"))


def shared_importers(edges: DataFrame, path: str) -> DataFrame:
    """Files that are imported where ``path`` is, with the number of shared importers; by its own importers, never by all pairs."""
    mine = edges.where(F.col("dst") == path).select("src").distinct()
    return edges.join(mine, "src", "left_semi").where(F.col("dst") != path).groupBy("dst").agg(F.countDistinct("src").alias("shared"))


def resolve_calls(raw: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Calls (path, sym, callee) to symbols of that name in imported files; all matching files, no self edge.

    The names that each file's imports offer are found first, so a call only
    meets those of its own name. No side is broadcast: all grow with the files.
    """
    named = symbols.select(F.col("path").alias("dst"), F.col("name").alias("callee")).distinct()
    offered = edges.select(F.col("src").alias("path"), "dst").distinct().join(unbroadcast(named), "dst")
    found = raw.select("path", "sym", "callee").join(unbroadcast(offered), ["path", "callee"]).where((F.col("path") != F.col("dst")) | (F.col("sym") != F.col("callee")))
    return found.select(F.col("path").alias("src_path"), F.col("sym").alias("src_sym"), F.col("dst").alias("dst_path"), F.col("callee").alias("dst_sym")).distinct()


def calls_of(calls: DataFrame, path: str, sym: str) -> DataFrame:
    return calls.where((F.col("src_path") == path) & (F.col("src_sym") == sym)).select(F.col("dst_path").alias("path"), F.col("dst_sym").alias("sym"))


def callers_of(calls: DataFrame, path: str, sym: str) -> DataFrame:
    return calls.where((F.col("dst_path") == path) & (F.col("dst_sym") == sym)).select(F.col("src_path").alias("path"), F.col("src_sym").alias("sym"))


def traverse(edges: DataFrame, start: str, direction: str = "imports", max_depth: int = 3, include_start: bool = True, known: DataFrame | None = None) -> DataFrame:
    """(path, depth) breadth-first, each path once at its least depth.

    ``known``: the start must be among its paths. The frontier is joined with
    the edges level by level and written, so that plans don't grow with depth.
    """
    step = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if direction == "imports" else edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))
    spark = edges.sparkSession
    seen = frontier = spark.range(1).select(F.lit(start).alias("path"), F.lit(0).alias("depth"))
    if known is not None:
        seen = frontier = seen.join(known.select("path"), "path", "left_semi")
    for depth in range(1, max_depth + 1):
        found = step.join(frontier.select(F.col("path").alias("a")), "a", "left_semi").select(F.col("b").alias("path")).distinct()
        found = found.join(seen.select("path"), "path", "left_anti").withColumn("depth", F.lit(depth))
        frontier = written(found)
        seen = seen.unionByName(frontier)
        if depth < max_depth and frontier.isEmpty():
            break
    return seen if include_start else seen.where("depth > 0")


def symbol_edges(calls: DataFrame) -> DataFrame:
    """Call edges between ``path$symbol`` names."""
    return calls.select(F.concat_ws("$", "src_path", "src_sym").alias("src"), F.concat_ws("$", "dst_path", "dst_sym").alias("dst"))


def impact(edges: DataFrame, calls: DataFrame, target: str, depth: int = 2) -> DataFrame:
    """What a change reaches: callers of ``path$symbol``, or importers of the file; of the file too where a symbol has no caller."""
    if "$" in target:
        found = written(traverse(symbol_edges(calls), target, "importers", depth, include_start=False))
        if not found.isEmpty():
            return found
        target = target.split("$")[0]
    return traverse(edges, target, "importers", min(depth, 3), include_start=False)


def dependencies(edges: DataFrame, calls: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """(name, direction) of a file or symbol; a symbol without calls and callers gets its file's."""
    if "$" in target:
        path, sym = target.split("$", 1)
        named = lambda df, d: df.select(F.concat_ws("$", "path", "sym").alias("name"), F.lit(d).alias("direction"))
        found = written(named(calls_of(calls, path, sym), "calls").unionByName(named(callers_of(calls, path, sym), "called by")))
        if not found.isEmpty():
            return found
        target = path
    named = lambda df, d: df.select(F.col("path").alias("name"), F.lit(d).alias("direction"))
    return named(imports(edges, files, target), "imports").unionByName(named(importers(edges, files, target), "imported by"))


def dead_symbols(symbols: DataFrame, calls: DataFrame) -> DataFrame:
    called = calls.select(F.col("dst_path").alias("path"), F.col("dst_sym").alias("name")).distinct()
    return symbols.join(called, ["path", "name"], "left_anti")


def hot_spots(edges: DataFrame, k: int) -> DataFrame:
    return edges.groupBy("dst").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "dst").limit(k)


def without_file(edges: DataFrame, path: str) -> DataFrame:
    return edges.where((F.col("src") != path) & (F.col("dst") != path))


def with_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more).distinct()


def without_calls_of(calls: DataFrame, path: str) -> DataFrame:
    return calls.where((F.col("src_path") != path) & (F.col("dst_path") != path))


def stats(files: DataFrame, directories: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of counts; symbols that call and are called count in both roles."""
    one = lambda df, c, n: df.agg(c.alias(n))
    parts = [
        one(files, F.count("*"), "files"), one(directories, F.count("*"), "directories"), one(symbols, F.count("*"), "symbols"), one(edges.distinct(), F.count("*"), "dependencies"),
        one(calls.distinct(), F.count("*"), "call_edges"),
        one(calls, F.countDistinct("src_path", "src_sym") + F.countDistinct("dst_path", "dst_sym"), "call_symbols"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


def export(files: DataFrame, directories: DataFrame, symbols: DataFrame, edges: DataFrame, calls: DataFrame) -> dict[str, DataFrame]:
    """The parts of an export: stats, files (path, size, modified), symbols (name, kind, file, line) and imports."""
    size = F.octet_length("content") if "size" not in files.columns else F.col("size")
    modified = F.col("last_modified") if "last_modified" in files.columns else F.lit(None).cast("bigint")
    return {
        "stats": stats(files, directories, symbols, edges, calls),
        "files": files.select("path", size.cast("bigint").alias("size"), modified.alias("modified")),
        "symbols": symbols.select("name", "kind", F.col("path").alias("file"), F.col("start_line").alias("line")),
        "imports": adjacency(edges),
    }


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("dst")), ",").alias("imports"))
