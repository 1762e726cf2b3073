"""Lines in symbol ranges and best blocks, against brute force."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import fuzzy, intervals, search


def covering(ranges, line):
    return next((k for k, (a, b) in enumerate(ranges) if a <= line <= b), None)


def test_disjoint_segments():
    rng = random.Random(2)
    for _ in range(300):
        ranges = [(a, a + rng.randrange(-2, 12)) for a in (rng.randrange(1, 30) for _ in range(rng.randrange(0, 12)))]
        found = intervals.disjoint(ranges)
        assert all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False)) and all(a <= b for a, b, _ in found)
        assert [next((k for a, b, k in found if a <= line <= b), None) for line in range(50)] == [covering(ranges, line) for line in range(50)]


def test_lines_in_nested_and_overlapping_symbols(spark, monkeypatch):
    monkeypatch.setattr(intervals, "STRETCH", 7)
    rng = random.Random(4)
    symbols = [(rng.choice("fgh"), k, f"s{k % 40}", a, a + rng.choice([-1, 0, 3, 50])) for k, a in enumerate(rng.choices(range(1, 90), k=60))]
    symbols += [("f", None, "no ord", 5, 6), (None, 1, "x", 1, 90), ("f", 99, "no end", 1, None), ("only symbols", 1, "y", 1, 9)]
    lines = [(rng.choice([*"fghi", None]), rng.choice([*range(1, 150), None]), "clash") for _ in range(300)]
    lines += lines[:3]
    got = intervals.with_symbol(spark.createDataFrame(lines, "path string, line_no int, segments string"), spark.createDataFrame(symbols, "path string, ord int, name string, start_line int, end_line int"))

    def first(path, line):
        of = sorted((o is not None, o or 0, n) for p, o, n, a, b in symbols if None not in (p, b, line) and p == path and a <= line <= b)
        return of[0][2] if of else None

    assert Counter(map(tuple, got.collect())) == Counter((*x, first(x[0], x[1])) for x in lines)
    assert intervals.with_symbol(spark.createDataFrame([], "path string, line_no int"), spark.createDataFrame(symbols, "path string, ord int, name string, start_line int, end_line int")).count() == 0


def test_a_file_of_many_symbols(spark):
    """10^5 ranges, each within the last, and as many lines of one file; no join compares ranges with lines."""
    n = 100_000
    symbols = spark.range(n).select(F.lit("f").alias("path"), (-F.col("id")).alias("ord"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("name"), (F.col("id") + 1).alias("start_line"), (2 * n - F.col("id")).alias("end_line"))
    lines = spark.range(1, n + 1).select(F.lit("f").alias("path"), F.col("id").alias("line_no"))
    found = search.symbol_context(lines, symbols)
    began = time.time()
    assert found.where(F.col("symbol") == F.concat(F.lit("s"), (F.col("line_no") - 1).cast("string"))).count() == n
    assert time.time() - began < 60
    assert "Join" not in found._jdf.queryExecution().toString()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def best_of(text, target, least):
    """The earliest best run, by full distances."""
    lines, size, best = text.split("\n"), len(target.split("\n")), None
    for i in range(len(lines) - size + 1):
        block = "\n".join(lines[i : i + size])
        longest = max(len(block), len(target))
        score = 1 - distance(block, target) / longest if longest else 1.0
        if score >= least and (best is None or score > best[1]):
            best = i + 1, score
    return best


@pytest.mark.parametrize("alphabet", ["ab\n", "abcdé中😀 \n", "ab"])
def test_best_blocks(alphabet):
    rng = random.Random(alphabet)
    for _ in range(200):
        target, text = ("".join(rng.choices(alphabet, k=rng.randrange(k))) for k in (15, 60))
        for least in (0.0, 0.4, 1.0):
            assert fuzzy.BlockSearch(target, least).best(text) == best_of(text, target, least)
        most = rng.randrange(30)
        d = distance(target, text)
        assert fuzzy.BlockSearch(target, 0.0).distance(text, most) == (d if d <= most else None)


def test_bounds_are_never_too_low():
    rng = random.Random(6)
    for _ in range(100):
        target, text = ("".join(rng.choices("abcdefghijklmnopqrst\n", k=k)) for k in (20, 300))
        search_ = fuzzy.BlockSearch(target, 0.0)
        lines = text.split("\n")
        if len(lines) >= search_.lines:
            bounds, longest = search_.bounds(text, len(lines))
            for k in range(len(bounds)):
                block = "\n".join(lines[k : k + search_.lines])
                assert longest[k] == max(len(block), len(target))
                assert bounds[k] >= 1 - distance(block, target) / longest[k] - 1e-12


def test_best_block_of_files(spark):
    rows = [("a", "x\ny\nx\ny"), ("b", ""), ("c", None), ("d", "y\r\nx\r\ny "), ("e", "long line " * 20_000 + "\nx\ny\n" + "z\n" * 5000)]
    got = {r["path"]: (r["start"], r["score"]) for r in fuzzy.best_block(spark.createDataFrame(rows, "path string, content string"), "x\ny", 0.5).collect()}
    assert got["a"] == (1, 1.0) and got["e"] == (2, 1.0) and "b" not in got and "c" not in got
    assert np.isclose(got["d"][1], 0.75) or got["d"][1] == 1.0
