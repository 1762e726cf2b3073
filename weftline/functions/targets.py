"""Names of what a request is about: a file, a directory, a symbol or a line range."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Target:
    path: str
    start: int | None = None
    end: int | None = None
    symbol: str | None = None
    wildcard: bool = False
    type: str = "file"


def parse(target: str) -> Target:
    """``path``, ``path:n`` or ``path:a-b``. Dots of a relative path but its last are slashes."""
    text = target.strip()
    if not text:
        raise ValueError("empty target")
    m = re.fullmatch(r"(.+):(\d+)(?:-(\d+))?", text, re.DOTALL)
    base, start, end = (m[1], int(m[2]), int(m[3] or m[2])) if m else (text, None, None)
    if m and not 1 <= start <= end:
        raise ValueError(f"no such range: {text}")
    if not re.match(r"[A-Za-z]:[\\/]|[\\/]", base) and base.count(".") > 1:
        stem, _, last = base.rpartition(".")
        base = stem.replace(".", "/") + "." + last
    wildcard = "*" in base or "?" in base
    if wildcard and m:
        raise ValueError(f"wildcards and a range: {text}")
    return Target(base, start, end, wildcard=wildcard, type="range" if m else "file")


def resolve(target: str, root: str = "/", symbol_range: Callable[[str, str], tuple[int, int]] | None = None) -> Target:
    """What ``target`` is, with its path relative to ``root``. Only ``a-b`` is a
    range here; a path without extension is a directory. ``symbol_range`` gives
    the lines of (path, symbol) or raises, and wins over a range."""
    m = re.fullmatch(r"(.{2,}):(\d+)-(\d+)", target, re.DOTALL)
    text, start, end = (m[1], int(m[2]), int(m[3])) if m else (target, None, None)
    text, _, symbol = text.partition("$")
    path = posixpath.relpath(posixpath.normpath(posixpath.join(root, text.replace("\\", "/"))), root)
    directory = not re.search(r"\.[^./]+$", posixpath.basename(path)) if path != "." else True
    if symbol and symbol_range and not directory:
        start, end = symbol_range(path, symbol)
    kind = "directory" if directory else "symbol" if symbol else "range" if start else "file"
    return Target(path, start, end, symbol or None, type=kind)


def parsed(target: Column) -> Column:
    """``parse`` of a column: a struct of path, start, end, wildcard and type, null where parse raises."""
    text = F.regexp_replace(target, r"^\s+|\s+$", "")
    ranged = r"(?s)^(.+):(\d+)(?:-(\d+))?$"
    has = text.rlike(ranged)
    base = F.when(has, F.regexp_extract(text, ranged, 1)).otherwise(text)
    start = F.when(has, F.regexp_extract(text, ranged, 2).try_cast("int"))
    end = F.when(has, F.coalesce(F.nullif(F.regexp_extract(text, ranged, 3), F.lit("")).try_cast("int"), start))
    dotted = ~base.rlike(r"^(?:[A-Za-z]:[\\/]|[\\/])") & (F.length(base) - F.length(F.replace(base, F.lit("."), F.lit(""))) > 1)
    last = F.substring_index(base, ".", -1)
    path = F.when(dotted, F.concat(F.replace(F.substring(base, F.lit(1), F.length(base) - F.length(last) - 1), F.lit("."), F.lit("/")), F.lit("."), last)).otherwise(base)
    wildcard = path.contains("*") | path.contains("?")
    good = (text != "") & (~has | ((start >= 1) & (start <= end))) & ~(wildcard & has)
    return F.when(good, F.struct(path.alias("path"), start.alias("start"), end.alias("end"), wildcard.alias("wildcard"), F.when(has, "range").otherwise("file").alias("type")))


def resolved(target: Column) -> Column:
    """``resolve`` of a column, below the root and without symbols' lines: a struct of path, start, end, symbol and type."""
    ranged = r"(?s)^(.{2,}):(\d+)-(\d+)$"
    has = target.rlike(ranged)
    text = F.when(has, F.regexp_extract(target, ranged, 1)).otherwise(target)
    own = F.substring_index(text, "$", 1)
    symbol = F.when(text.contains("$"), F.nullif(F.substring(text, F.length(own) + 2, F.length(text)), F.lit("")))
    step = lambda acc, s: F.when(s.isin("", "."), acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s)))
    segments = F.aggregate(F.split(F.replace(own, F.lit("\\"), F.lit("/")), "/"), F.array().cast("array<string>"), step)
    path = F.when(F.size(segments) == 0, ".").otherwise(F.array_join(segments, "/"))
    directory = ~F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("")).rlike(r"\.[^.]+$")
    number = lambda k: F.when(has, F.regexp_extract(target, ranged, k).try_cast("int"))
    kind = F.when(directory, "directory").when(symbol.isNotNull(), "symbol").when(has, "range").otherwise("file")
    return F.struct(path.alias("path"), number(2).alias("start"), number(3).alias("end"), symbol.alias("symbol"), kind.alias("type"))
