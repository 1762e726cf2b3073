"""The parsers as table functions of SQL.

    register(spark)
    select s.* from files, lateral source_symbols(path, content) s
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import parsers


def _checked(schema: StructType, path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
    for name, a in (("path", path), ("content", content)):
        if a.isTable or a.dataType.typeName() not in ("string", "void"):
            raise ValueError(f"{name} must be a string")
    return AnalyzeResult(schema)


def _without_path(schema: str) -> StructType:
    return StructType(StructType.fromDDL(schema).fields[1:])


def _parser(path: str | None, known: dict) -> Callable | None:
    return known.get("." + path.rsplit(".", 1)[-1]) if path and "." in path else None


def symbol_function(known: dict):
    """A table function (path, content) of a file's symbols, by the parsers ``known`` by extension."""

    schema = _without_path(parsers.SYMBOLS)  # here, as workers have no session to read it with

    class Symbols:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            return _checked(schema, path, content)

        def eval(self, path: str, content: str) -> Iterator[tuple]:
            if parse := _parser(path, known):
                yield from ((k, *s) for k, s in enumerate(parse(content or "")))

    return udtf(Symbols)


def call_function(known: dict):
    """A table function (path, content) of a file's calls."""

    schema = _without_path(parsers.CALLS)

    class Calls:
        @staticmethod
        def analyze(path: AnalyzeArgument, content: AnalyzeArgument) -> AnalyzeResult:
            return _checked(schema, path, content)

        def eval(self, path: str, content: str) -> Iterator[tuple]:
            if parse := _parser(path, known):
                yield from parsers.calls(content or "", parse(content or ""))

    return udtf(Calls)


def register(spark: SparkSession, known: dict | None = None) -> None:
    """``source_symbols`` and ``source_calls``; ``known``: parsers by extension, as those of a plugin registry. A file of
    another extension or without a path has no rows, a null content is an empty one."""
    known = dict(parsers.PARSERS if known is None else known)
    spark.udtf.register("source_symbols", symbol_function(known))
    spark.udtf.register("source_calls", call_function(known))
