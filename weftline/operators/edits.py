"""Edits of the files table as change rows; nothing is written to the scanned tree.

A change is (path, op, to, content, ts): op is create, write, copy, rename or
delete. ``streams.apply_changes`` puts changes into the graph's tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import append, exact_range, replace_lines

CHANGES = "path string, op string, to string, content string, ts timestamp"


def _change(df: DataFrame, path, op: str, content, ts: Column, to=None) -> DataFrame:
    return df.select(path.alias("path"), F.lit(op).alias("op"), (F.lit(None).cast("string") if to is None else to).alias("to"), content.alias("content"), ts.cast("timestamp").alias("ts"))


def create(files: DataFrame, path: str, content: str, ts: Column) -> DataFrame:
    """A new file; an error where there is one."""
    if not files.where(F.col("path") == path).isEmpty():
        raise ValueError(f"{path} exists")
    return _change(files.sparkSession.range(1), F.lit(path), "create", F.lit(content), ts)


def write(files: DataFrame, path: str, content: Column, ts: Column) -> DataFrame:
    """New content of an existing file, from an expression on the old one; no row without such a file."""
    return _change(files.where(F.col("path") == path), F.col("path"), "write", content, ts)


def append_to(files: DataFrame, path: str, text: str, ts: Column) -> DataFrame:
    return write(files, path, append(F.col("content"), text), ts)


def copy(files: DataFrame, path: str, to: str, ts: Column, start: int | None = None, end: int | None = None) -> DataFrame:
    """The file, or its lines ``start`` to ``end``, as another."""
    content = F.col("content") if start is None else exact_range(F.col("content"), start, end)
    return _change(files.where(F.col("path") == path), F.lit(to), "copy", content, ts)


def move(files: DataFrame, path: str, to: str, ts: Column) -> DataFrame:
    """The file under another path; moving and renaming are one."""
    return _change(files.where(F.col("path") == path), F.col("path"), "rename", F.col("content"), ts, F.lit(to))


def delete(files: DataFrame, path: str, ts: Column) -> DataFrame:
    return _change(files.where(F.col("path") == path), F.col("path"), "delete", F.lit(None).cast("string"), ts)


def _symbol_lines(files: DataFrame, symbols: DataFrame, path: str, symbol: str) -> DataFrame:
    """The file with the first line and the last line of the first symbol of that name."""
    at = symbols.where((F.col("path") == path) & (F.col("name") == symbol)).orderBy("ord").limit(1)
    return files.join(F.broadcast(at.select("path", F.col("start_line").alias("__a"), F.col("end_line").alias("__b"))), "path")  # of one row


def write_symbol(files: DataFrame, symbols: DataFrame, path: str, symbol: str, text: str, ts: Column) -> DataFrame:
    """The whole lines of a symbol replaced."""
    own = _symbol_lines(files, symbols, path, symbol)
    return _change(own, F.col("path"), "write", replace_lines(F.col("content"), F.col("__a"), F.col("__b"), F.lit(text)), ts)


def delete_symbol(files: DataFrame, symbols: DataFrame, path: str, symbol: str, ts: Column) -> DataFrame:
    """The whole lines of a symbol taken out."""
    own = _symbol_lines(files, symbols, path, symbol)
    lines = F.split("content", "\n")
    rest = F.concat(F.slice(lines, F.lit(1), F.col("__a") - 1), F.slice(lines, F.col("__b") + 1, F.greatest(F.size(lines) - F.col("__b"), F.lit(0))))
    return _change(own, F.col("path"), "write", F.array_join(rest, "\n"), ts)


def copy_symbol(files: DataFrame, symbols: DataFrame, path: str, symbol: str, to: str, ts: Column) -> DataFrame:
    """The whole lines of a symbol as a file, or after the last line of one that is there."""
    own = _symbol_lines(files, symbols, path, symbol)
    text = F.array_join(F.slice(F.split("content", "\n"), F.col("__a"), F.col("__b") - F.col("__a") + 1), "\n")
    there = files.where(F.col("path") == to).select(F.lit(1).alias("__one"), F.col("content").alias("__old"))  # at most one row
    both = own.select(F.lit(1).alias("__one"), text.alias("__text")).join(there, "__one", "left")
    joined = F.when(F.col("__old").isNull() | (F.col("__old") == ""), F.col("__text")).otherwise(F.concat("__old", F.when(F.col("__old").endswith("\n"), "").otherwise("\n"), "__text"))
    return _change(both, F.lit(to), "write", joined, ts)
