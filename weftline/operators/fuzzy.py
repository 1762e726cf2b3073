"""Best matching lines and blocks by edit distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def best_line(lines: DataFrame, target: str, center: int, tolerance: int = 1) -> DataFrame:
    """path, line_no, score of the best line near ``center``, per file.

    Equal lines score 1. Where the best is under 0.8, trimmed lines are tried:
    equal ones score 0.95, others 0.9 of their similarity. Ties go to the line
    nearest the centre, then to the first.
    """
    near = lines.where(F.abs(F.col("line_no") - center) <= tolerance)
    plain = T.similarity(T.gentle(F.col("line")), F.lit(target.replace("\r\n", "\n")))
    trimmed, want = F.trim("line"), target.strip()
    second = F.when(trimmed == want, 0.95).otherwise(0.9 * T.similarity(trimmed, F.lit(want)))
    first = near.withColumn("plain", plain).withColumn("best", F.max("plain").over(Window.partitionBy("path")))
    scored = first.withColumn("score", F.when(F.col("best") >= 0.8, F.col("plain")).otherwise(F.greatest("plain", second)))
    order = F.struct("score", -F.abs(F.col("line_no") - center), -F.col("line_no"))
    return scored.groupBy("path").agg(F.max_by(F.struct("line_no", "score"), order).alias("b")).select("path", "b.line_no", "b.score")


#: Classes of characters that are counted for bounds: the most frequent ones of the target, one each.
CLASSES = 12


class BlockSearch:
    """The best run of lines of a text for one target, by bounds and then by distances that stop early."""

    def __init__(self, target: str, least: float):
        self.target, self.least = target, least
        self.lines = len(target.split("\n"))
        often = Counter(target.replace("\n", ""))
        classes = sorted(often, key=lambda c: (-often[c], c))[:CLASSES]
        self.codes = np.sort(np.array([ord(c) for c in classes], np.uint32))
        self.counts = self._counts(np.frombuffer(target.replace("\n", "").encode("utf-32-le"), np.uint32), None, 1)[0]

    def _counts(self, codes: np.ndarray, line: np.ndarray | None, n: int) -> np.ndarray:
        """For each line how many characters are of each class, and last of none."""
        kinds = len(self.codes)
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool) if not kinds else self.codes[np.minimum(at, kinds - 1)] == codes
        at = np.where(known, at, kinds)
        return np.bincount(at if line is None else line * (kinds + 1) + at, minlength=n * (kinds + 1)).reshape(n, kinds + 1)

    def bounds(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of lines: the most that its score can be, and the longer length.

        An edit changes the count of one class up and of another down by one at most, so the
        distance is at least what the run has more, or the target has, of all classes.
        """
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = codes == 10
        sums = np.vstack([np.zeros((1, len(self.counts)), np.int64), np.cumsum(self._counts(codes[~ends], np.cumsum(ends)[~ends], n), axis=0)])
        differ = sums[self.lines :] - sums[: -self.lines] - self.counts
        above, below = np.maximum(differ, 0).sum(axis=1), np.maximum(-differ, 0).sum(axis=1)
        longest = len(self.target) + np.maximum(above - below, 0)
        return np.where(longest > 0, 1 - np.maximum(above, below) / np.maximum(longest, 1), 1.0), longest

    def distance(self, block: str, most: int) -> int | None:
        """The edit distance, or None if it is above ``most``.

        A column of the table is two whole numbers, with a bit for each place of the longer text; there are as many columns as the other has characters.
        """
        short, long = sorted((self.target, block), key=len)
        if not long:
            return 0
        wanted, places = set(short), {}
        for k, c in enumerate(long):
            if c in wanted:
                places[c] = places.get(c, 0) | 1 << k
        full, top = (1 << len(long)) - 1, 1 << (len(long) - 1)
        up, down, score = full, 0, len(long)
        for left, c in zip(range(len(short) - 1, -1, -1), short, strict=True):
            same = places.get(c, 0)
            cross = (((same & up) + up) ^ up) | same
            ups, downs = down | ~(cross | up) & full, up & cross
            score += bool(ups & top) - bool(downs & top)
            if score - left > most:
                return None
            ups = ups << 1 & full | 1
            same |= down
            up, down = downs << 1 & full | ~(same | ups) & full, ups & same
        return score if score <= most else None

    def best(self, text: str) -> tuple[int, float] | None:
        lines = text.split("\n")
        if len(lines) < self.lines:
            return None
        bounds, longest = self.bounds(text, len(lines))
        score, start = self.least, None
        for k in np.lexsort((np.arange(len(bounds)), -bounds)):
            if bounds[k] < score:
                break
            of = max(int(longest[k]), 1)
            d = self.distance("\n".join(lines[k : k + self.lines]), int((1 - score) * of + 1e-6) + 1)
            if d is None:
                continue
            found = 1 - d / of if longest[k] else 1.0
            if found > score or found == score and (start is None or k < start):
                score, start = found, int(k)
        return None if start is None else (start + 1, float(score))


def best_block(files: DataFrame, target: str, least: float = 0.0) -> DataFrame:
    """path, start (line), score of the earliest best run of as many lines as ``target`` has.

    Counts of characters bound the score of each run from above. Runs are tried by
    their bounds, and the edit distance of each stops as soon as it can't reach
    the best score so far; once a bound is under that, the rest are not tried. A file without
    a run of ``least`` or more is left out. No row leaves its task.
    """
    search = BlockSearch(target, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(path, *found) for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text is not None and (found := search.best(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.float64()))], ["path", "start", "score"])

    return files.select("path", T.gentle(F.col("content"))).mapInArrow(run, "path string, start int, score double")
