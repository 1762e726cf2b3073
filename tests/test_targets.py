"""Targets as columns against the same by hand, and lines of ignore files."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import targets
from weftline.sources import ingest

TARGETS = [
    "a/b.ts", "a/b.ts:7", "a/b.ts:3-9", "a/b.ts:9-3", "a/b.ts:0", "src.core.Scan.ts:3-9", "src.core.Scan.ts", "a/*.ts", "a/?.ts", "a/*.ts:3", "", "  ", " a.ts ", "/abs/a.b.ts", "C:\\a.b.ts", "a/b.ts$run", "a/b.ts$", "a/c", "./a//b.ts",
    "a/../../b.ts", "..", ".", "a\\b.ts:2-4", "x:1-2", "a$b$c", "dir/.hidden", "a/b.ts:12-", "naïve/é.ts:1", "a.ts:5:6",
]


def test_targets_as_columns(spark):
    rows = spark.createDataFrame([(t,) for t in [*TARGETS, None]], "t string").select("t", targets.parsed(F.col("t")).alias("p"), targets.resolved(F.col("t")).alias("r")).collect()
    for row in rows[:-1]:
        try:
            want = targets.parse(row["t"])
            assert row["p"] is not None and (want.path, want.start, want.end, want.wildcard, want.type) == tuple(row["p"]), row["t"]
        except ValueError:
            assert row["p"] is None, row["t"]
        want = targets.resolve(row["t"])
        assert (want.path, want.start, want.end, want.symbol, want.type) == tuple(row["r"]), row["t"]
    assert rows[-1]["p"] is None


@pytest.mark.parametrize("line", ["/a/", "*.log", "  b/c ", "# no", "", "**/d/", "//x//", "a b", "\t"])
def test_lines_of_ignore_files(spark, line):
    assert ([spark.range(1).select(ingest.gitignore_pattern(F.lit(line))).first()[0]] if line.strip() and line[0] != "#" else []) == ingest.gitignore_patterns(line)
