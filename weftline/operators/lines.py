"""Reading, slicing and editing texts by lines and positions (all from 1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_range(content: Column, offset: int = 1, length: int = 250) -> Column:
    """``length`` lines from ``offset``; a negative offset counts from the end."""
    all_ = F.split(content, "\n")
    first = F.lit(offset) if offset > 0 else F.greatest(F.size(all_) + offset + 1, F.lit(1))
    return F.array_join(F.slice(all_, first, F.lit(length)), "\n")


def exact_range(content: Column, start: int, end: int) -> Column:
    """Lines ``start`` to ``end``; an error where the text has no such lines."""
    if not 1 <= start <= end:
        raise ValueError(f"no such range: {start}-{end}")
    all_ = F.split(content, "\n")
    return F.when(F.size(all_) >= end, F.array_join(F.slice(all_, start, end - start + 1), "\n")).otherwise(F.raise_error(F.lit(f"line {end} is out of range")))


def head(files: DataFrame, paths: list[str], most: int = 1000) -> DataFrame:
    lines = F.split("content", "\n")
    return files.where(F.col("path").isin(paths)).select("path", F.array_join(F.slice(lines, 1, most), "\n").alias("content"), (F.size(lines) > most).alias("truncated"))


def listing(files: DataFrame, directories: DataFrame, target: str, depth: int = 1) -> DataFrame:
    """Files and directories below ``target`` down to ``depth`` levels."""
    prefix = "" if target in ("", ".") else target.rstrip("/") + "/"
    both = files.select("path", F.lit("file").alias("type")).unionByName(directories.where("path <> '.'").select("path", F.lit("directory").alias("type")))
    below = F.substring("path", len(prefix) + 1, 1 << 20)
    return both.where(F.col("path").startswith(prefix) & (F.size(F.split(below, "/")) <= depth))


def directories(files: DataFrame) -> DataFrame:
    """path, file_count (own files) of each directory above a file; the root is ``.``."""
    parts = F.split("path", "/")
    own = F.size(parts) - 1
    above = files.select(F.explode(F.sequence(F.lit(0), own)).alias("k"), parts.alias("parts"), own.alias("own"))
    path = F.when(F.col("k") == 0, ".").otherwise(F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"))
    return above.groupBy(path.alias("path")).agg(F.count_if(F.col("k") == F.col("own")).alias("file_count"))


def symbol_content(files: DataFrame, symbols: DataFrame, path: str, name: str) -> DataFrame:
    """The text of the first symbol of that name, cut at its start and end columns."""
    symbol = symbols.where((F.col("path") == path) & (F.col("name") == name)).orderBy("ord").limit(1).select("path", "start_line", "start_col", "end_line", "end_col")
    lines = F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1)
    text = F.array_join(lines, "\n")
    last = F.try_element_at(lines, F.lit(-1))
    cut = F.greatest(F.length(last) - F.col("end_col"), F.lit(0))
    whole = F.substring(text, F.col("start_col"), F.length(text) - F.col("start_col") + 1 - cut)
    return files.join(symbol, "path").select("path", whole.alias("content"))


def nested_symbols(symbols: DataFrame, path: str, name: str) -> DataFrame:
    """Symbols of the file that start after the named one does, end within it, and are called otherwise."""
    own = symbols.where(F.col("path") == path)
    outer = own.where(F.col("name") == name).orderBy("ord").limit(1).select("path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    return own.join(outer, "path").where((F.col("start_line") > F.col("s")) & (F.col("end_line") <= F.col("e")) & (F.col("name") != name)).drop("s", "e")


def replace_lines(content: Column, start: Column, end: Column, new: Column) -> Column:
    all_ = F.split(content, "\n")
    return F.array_join(F.concat(F.slice(all_, F.lit(1), start - 1), F.split(new, "\n"), F.slice(all_, end + 1, F.greatest(F.size(all_) - end, F.lit(0)))), "\n")


def insert_lines(content: Column, after: Column, new: Column) -> Column:
    return replace_lines(content, after + 1, after, new)


def append(content: Column, new: str) -> Column:
    return F.concat(content, F.when((content == "") | content.endswith("\n"), "").otherwise("\n"), F.lit(new))


def replace_many(content: Column, pairs: list[tuple[str, str]], regex: bool = False) -> Column:
    for old, new in pairs:
        content = F.regexp_replace(content, old, new) if regex else F.replace(content, F.lit(old), F.lit(new))
    return content
