"""Where new symbols go in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import insert_lines

STRATEGIES = ("append", "prepend", "atLine", "afterSymbol", "beforeSymbol", "endOfClass", "endOfInterface")


def after_imports(content: Column) -> Column:
    """The number of the last import line; 0 without one."""
    numbers = F.transform(F.split(content, "\n"), lambda x, i: F.when(x.rlike(r"^\s*(import|use)\s"), i + 1).otherwise(0))
    return F.array_max(numbers)


def place(files: DataFrame, symbols: DataFrame, path: str, code: str, strategy: str, name: str | None = None, line: int | None = None) -> DataFrame:
    """path and content with ``code`` put in. afterSymbol and beforeSymbol go by
    the first symbol called ``name``; endOfClass and endOfInterface put it
    before that symbol's last line. No row where there is no such symbol."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    own = files.where(F.col("path") == path).select("path", "content")
    if strategy in ("append", "prepend", "atLine"):
        if strategy == "atLine" and not line:
            raise ValueError("atLine needs a line")
        after = {"append": F.size(F.split("content", "\n")), "prepend": after_imports(F.col("content")), "atLine": F.lit((line or 1) - 1)}[strategy]
        return own.select("path", insert_lines(F.col("content"), after, F.lit(code)).alias("content"))
    if not name:
        raise ValueError(f"{strategy} needs a symbol")
    kind = {"endOfClass": "class", "endOfInterface": "interface"}.get(strategy)
    wanted = symbols.where((F.col("path") == path) & (F.col("name") == name))
    wanted = (wanted.where(F.col("kind") == kind) if kind else wanted).orderBy("ord").limit(1)
    after = {"afterSymbol": F.col("end_line"), "beforeSymbol": F.col("start_line") - 1}.get(strategy, F.col("end_line") - 1)
    return own.join(wanted.select("path", "start_line", "end_line"), "path").select("path", insert_lines(F.col("content"), after, F.lit(code)).alias("content"))
