"""Lines in symbol ranges by disjoint segments, without comparing each line with each range.

The ranges of a file are swept once into segments that don't overlap, each with
the first symbol, by ``ord``, of those that cover it. Lines and segments are then
merged in the order of the lines.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Lines in a stretch of a file that is merged by one task; segments are cut at its ends.
STRETCH = 4096


def disjoint(ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first, last, number of the range): where the earliest range in the list that covers a line changes.

    A heap holds the ranges that are open, the earliest at the top; ended ones go when they come up.
    """
    starts = sorted((first, k) for k, (first, last) in enumerate(ranges) if first <= last)
    points = sorted({x for k, (first, last) in enumerate(ranges) if first <= last for x in (first, last + 1)})
    out: list[list[int]] = []
    is_open: list[int] = []
    at = 0
    for point, following in zip(points, points[1:], strict=False):
        while at < len(starts) and starts[at][0] <= point:
            heapq.heappush(is_open, starts[at][1])
            at += 1
        while is_open and ranges[is_open[0]][1] < point:
            heapq.heappop(is_open)
        if not is_open:
            continue
        if out and out[-1][2] == is_open[0] and out[-1][1] == point - 1:
            out[-1][1] = following - 1
        else:
            out.append([point, following - 1, is_open[0]])
    return [tuple(x) for x in out]


def segments(symbols: DataFrame) -> DataFrame:
    """path and ``segments``, one array a file: disjoint (first, last, symbol) in the order of lines.

    The lines of a segment lie in the symbol of the least ``ord`` that covers
    them, of equal ones the first by name. Symbols without a path or a line, or that end before they
    start, cover nothing. A file's symbols are held together: no more than its text has room for.
    """
    usable = symbols.where("path is not null and start_line <= end_line")
    own = usable.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "name", F.col("start_line").cast("bigint").alias("first"), F.col("end_line").cast("bigint").alias("last")))).alias("own"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("symbol", pa.string())]))
        for b in batches:
            found = []
            for own in b.column(1).to_pylist():
                cut = disjoint([(s["first"], s["last"]) for s in own])
                found.append([{"first": first, "last": last, "symbol": own[k]["name"]} for first, last, k in cut])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["path", "segments"])

    return own.mapInArrow(sweep, "path string, segments array<struct<first:bigint,last:bigint,symbol:string>>")


def with_symbol(lines: DataFrame, symbols: DataFrame, line: str = "line_no") -> DataFrame:
    """``lines`` (path, the column ``line`` and others) with ``symbol``: the first symbol
    whose lines hold the line, null if none does. Repeated rows stay."""
    stretch = lambda c: F.floor(c / STRETCH)
    cut = segments(symbols).select("path", F.explode("segments").alias("s"))
    cut = cut.select("path", "s", F.explode(F.sequence(stretch(F.col("s.first")), stretch(F.col("s.last")))).alias("stretch"))
    cut = cut.select("path", "stretch", F.greatest(F.col("s.first"), F.col("stretch") * STRETCH).alias("at"), F.lit(0).alias("kind"), "s")
    row = F.struct(*[lines[f"`{c}`"] for c in lines.columns])
    own = lines.select(row.alias("row")).select(F.col("row.path").alias("path"), stretch(F.col(f"row.`{line}`")).alias("stretch"), F.col(f"row.`{line}`").cast("bigint").alias("at"), F.lit(1).alias("kind"), "row")
    order = Window.partitionBy("path", "stretch").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = own.unionByName(cut, allowMissingColumns=True).withColumn("s", F.last("s", ignorenulls=True).over(order)).where("row is not null")
    return merged.select("row.*", F.when(F.col("at") <= F.col("s.last"), F.col("s.symbol")).alias("symbol"))

