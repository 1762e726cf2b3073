"""Filter interaction audit: what each of five filters removes, in every order.

Texts go through a fingerprint-routed RDD. A task keeps the distinct texts that
it has read in chains by their xxhash, with the least id of each, and settles at
once what can't be the least; only one row for each text of a task is routed with
its text. The tasks that a fingerprint is routed to do the same with those rows. So a
text that a third of all documents share is routed once by each task. Then
``combineByKey`` adds up vectors of counts by the mask of failed filters, one
for each part, from which the counts of all orders follow.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)
#: Bytes of texts that a task that reads documents holds before it routes them, and that a task gets by its fingerprints, on average.
HELD, ROUTED = 32 << 20, 64 << 20

# The least words, the symbols that are not allowed, the upper-case letters.
LEAST_WORDS = 200
SYMBOLS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failed_alone(text: str, data: bytes) -> int:
    """The mask of the filters A to D that a text fails; ``data`` is its UTF-8.

    ``bytes.split`` parts at the six separators 0x20 and 0x09 to 0x0D.
    """
    words = data.split()
    a = len(words) < LEAST_WORDS
    b = 100 * len(set(words)) < 50 * len(words)
    c = 100 * (len(data) - len(data.translate(None, UPPER))) > 2 * len(text)
    d = len(data.translate(None, SYMBOLS)) < len(data)
    return a | b << 1 | c << 2 | d << 3


class Chains:
    """Distinct texts by fingerprint: [text, least id, {part: rows with that id}, mask].

    Texts of one fingerprint are told apart by their bytes. ``add`` yields
    the rows (id, part, mask, n) that a smaller id makes duplicates.
    """

    def __init__(self):
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def add(self, fingerprint: int, data: bytes, doc_id, parts: dict[str, int], mask: int) -> Iterator[tuple]:
        chain = self.by_print.setdefault(fingerprint, [])
        entry = next((e for e in chain if e[0] == data), None)
        if entry is None:
            chain.append([data, doc_id, dict(parts), mask])
            self.held += len(data)
            return
        if doc_id == entry[1]:
            for part, n in parts.items():
                entry[2][part] = entry[2].get(part, 0) + n
            return
        lost_id, lost = (doc_id, parts) if doc_id > entry[1] else (entry[1], entry[2])
        if doc_id < entry[1]:
            entry[1:3] = [doc_id, dict(parts)]
        for part, n in lost.items():
            yield lost_id, part, mask | DUPLICATE, n

    def drain(self) -> Iterator[tuple[int, list]]:
        found, self.by_print, self.held = self.by_print, {}, 0
        for fingerprint, chain in found.items():
            for entry in chain:
                yield fingerprint, entry


def fingerprint_of(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def _route(rows: Iterable, held: int) -> Iterator[tuple[int, tuple]]:
    """Of rows (id, part, text): settled rows by their id, the others with their texts by fingerprint."""
    chains, nameless = Chains(), {}
    settled = lambda row: (fingerprint_of(str(row[0]).encode()), row)
    for doc_id, part, text in rows:
        data = text.encode()
        mask = failed_alone(text, data)
        if doc_id is None:
            nameless[part, mask] = nameless.get((part, mask), 0) + 1
            continue
        yield from map(settled, chains.add(fingerprint_of(data), data, doc_id, {part: 1}, mask))
        if chains.held > held:
            yield from ((k, tuple(e)) for k, e in chains.drain())
    yield from ((k, tuple(e)) for k, e in chains.drain())
    for (part, mask), n in nameless.items():
        yield fingerprint_of(f"{part} {mask}".encode()), (None, part, mask, n)


def _settle(routed: Iterable) -> Iterator[tuple]:
    """Rows (id, part, mask, n): settled ones as they came, then the others by the least ids of all tasks."""
    chains = Chains()
    for fingerprint, row in routed:
        if isinstance(row[0], bytes):
            yield from chains.add(fingerprint, *row)
        else:
            yield row
    for _, (_, doc_id, parts, mask) in chains.drain():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def failed_filters(docs: DataFrame, text: str = "text", part: str = "source", doc_id: str = "doc_id", held: int = HELD) -> DataFrame:
    """Rows (doc_id, part, mask, n): the filters that n documents of that id and part fail, one bit each, A the lowest.

    A null text counts as empty, a null part as an empty string. E is failed by a
    document whose text one of a smaller id has; documents of the same id don't
    make each other fail, and those without an id neither fail it nor make
    others do. Ids are of any type that Python orders as Spark does. Texts of any
    length are held whole, ``held`` bytes of them in a task that reads documents; the
    bytes of all texts are summed first, so that each task that they are routed to gets ROUTED bytes or less on average.
    An empty table gives one without rows, and other columns are not read. Rows
    are read once, in the order of the input: of one whose order changes from
    read to read, keep a table first.
    """
    spark = docs.sparkSession
    key = F.col(f"`{doc_id}`")
    rows = docs.select(key, F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))).rdd
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // ROUTED))
    settled = rows.mapPartitions(lambda it: _route(it, held)).partitionBy(tasks, lambda k: k).mapPartitions(_settle)
    kind = docs.select(key).schema[0].dataType.simpleString()
    return spark.createDataFrame(settled, f"doc_id {kind}, part string, mask int, n bigint", verifySchema=False)


def orders() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(filter_order, step) of all rows of a part, and for each count a matrix of zeros and ones over the masks (``shapley``: how many orders)."""
    masks = np.arange(MASKS)
    steps, found = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    bits = np.array([bin(m).count("1") for m in masks])
    every = len(list(permutations(FILTERS)))
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = masks & bit > 0, masks & before > 0
            before |= bit
            steps.append(("".join(order), step))
            for k, v in zip(found, (masks & before == 0, fails & ~gone, fails & gone, masks == bit, fails * (every // np.maximum(bits, 1))), strict=True):
                found[k].append(v)
    return steps, {k: np.array(v).astype(np.int64) for k, v in found.items()}


def _rows_of(part: str, counts: np.ndarray, steps: list, by: dict[str, np.ndarray]) -> Iterator[tuple]:
    documents, good, toxic = counts
    columns = [by[k] @ documents for k in ("kept", "removed", "redundant", "unique_fails")] + [by["removed"] @ good, by["removed"] @ toxic, by["shapley"] @ documents]
    for (order, step), values in zip(steps, np.array(columns).T.tolist(), strict=True):
        yield part, order, step, *values


SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def audit_filters(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "source", doc_id: str = "doc_id", held: int = HELD) -> DataFrame:
    """A row for each part, order of the filters and step, with counts of documents.

    ``labels``: doc_id, quality and toxic; a document is good, or toxic, if any
    row of its id has a 1 there, and neither without a row. The rest is as
    in ``failed_filters``; a repeated document counts as often as it comes.
    """
    failed = failed_filters(docs, text, part, doc_id, held)
    is_one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    told = failed.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(False)), F.coalesce("toxic", F.lit(False)))

    def counted(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        counts[:, mask] += (n, n * good, n * toxic)
        return counts

    start = lambda row: counted(np.zeros((3, MASKS), np.int64), row)
    by_part = told.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(start, counted, lambda a, b: a + b, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), fingerprint_of_part)
    steps, by = orders()
    return docs.sparkSession.createDataFrame(by_part.flatMap(lambda x: _rows_of(*x, steps, by)), SCHEMA, verifySchema=False)


def fingerprint_of_part(part: str) -> int:
    return fingerprint_of(part.encode())
