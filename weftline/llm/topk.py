"""Exact top-k search by a three-phase uniform threshold.

The components of the vectors are dealt to a few score lists: the score of a
pair is the sum of its entries in the lists. (1) One block of candidates, a
random share of them, gathers the top k of each list and resolves those pairs;
the k-th best is a safe cutoff of a query. (2) The cutoff goes to all blocks,
which collect the pairs with an entry of at least cutoff / lists, as only they
can reach it. The lists are multiplied one after the other: what a pair can
still get in the lists to come is bounded by the norms of both, and rows and
columns of which no pair can reach the cutoff drop out before the next list.
(3) Scores of the remaining pairs are resolved exactly, and the best k leave
the block.

Entries are 64-bit floats while they are exact; where components are too large
for that, entries have error bounds, and what may be among the best is resolved
in whole numbers. Queries and candidates meet in groups of bounded size, keyed
by the numbers of both; nothing is broadcast and no group grows with the input.
A candidate is sent once for many blocks of queries, which a task takes one by
one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

LISTS = 4
QUERIES_IN_BLOCK = 512
#: Blocks of queries that go to a task together.
BLOCKS_AT_ONCE = 16
CANDIDATES_IN_BLOCK = 16384
#: Components are whole multiples of 1 / UNIT.
UNIT = 256
_EXACT = 2.0**53


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(UNIT * x) / UNIT of each component, taken as double,
    which is exact for all finite ones.

    Left out: vectors null or holding null or non-finite components, and rows
    without an id. An empty vector takes part, with those like it.
    """
    v = F.col(f"`{embedding}`")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    ok = v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.col(f"`{vec_id}`").isNotNull()
    # Beyond 2 ** 45 a double is a multiple of 1 / UNIT already.
    floored = lambda x: F.when(F.abs(x) >= 2.0**45, x).otherwise(F.floor(x * UNIT) / UNIT)
    return df.where(ok).select(F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.transform(v, lambda x: floored(x.cast("double"))).alias("v"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), len(flat) // max(1, len(column)))


def _scaled(m: np.ndarray) -> tuple[np.ndarray, int]:
    """``m`` divided by a power of two so that no component is over 1, and its exponent."""
    e = int(np.frexp(np.abs(m).max(initial=0.0))[1])
    return np.ldexp(m, -e), e


class _Block:
    """The pairs of one block of queries and one of candidates, in the order of their row numbers."""

    def __init__(self, q: pa.Table, c: pa.Table, lists: int):
        q, c = q.sort_by("qrid"), c.sort_by("rid")
        num = lambda t, n: t.column(n).to_numpy()
        self.qrid, self.query_id, self.rid, self.vec_id = num(q, "qrid"), num(q, "query_id"), num(c, "rid"), num(c, "vec_id")
        self.q, self.c = _matrix(q.column("qv")), _matrix(c.column("v"))
        self.cutoff = num(q, "cutoff") if "cutoff" in q.column_names else np.full(len(self.qrid), -np.inf)
        dims = self.q.shape[1]
        most = float(np.abs(self.q).max(initial=0.0)), float(np.abs(self.c).max(initial=0.0))
        with np.errstate(over="ignore"):
            self.exact = np.float64(most[0]) * UNIT * most[1] * UNIT * max(1, dims) < _EXACT
        if self.exact:
            x, y, self.exponent = self.q * UNIT, self.c * UNIT, 0
        else:
            (x, a), (y, b) = _scaled(self.q), _scaled(self.c)
            self.exponent = a + b
            # Rounding of the products and their sums, by norms, and of products and squares that are too small.
            self.error = np.outer(np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))) * (dims + 4) * 2.0**-51 + (dims + 4) * 2.0**-500
        edges = np.linspace(0, dims, max(1, min(lists, dims)) + 1).astype(int)
        self.lists = [(x[:, a:b], y[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def entries(self) -> list[np.ndarray]:
        return [x @ y.T for x, y in self.lists]

    def reaching(self, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row numbers of queries and candidates, their scores, and which of
        them may reach ``cut``, a cutoff of each query.

        A pair goes once its entries so far and the norms of the rest stay
        under the cutoff, so one with each entry under cutoff / lists goes.
        """
        norms = [(np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))) for x, y in self.lists]
        i, j = np.arange(len(self.qrid)), np.arange(len(self.rid))
        total, slack = np.zeros((len(i), len(j))), 2.0**-40
        for k, (x, y) in enumerate(self.lists):
            total += x[i] @ y[j].T
            bound = total + (0.0 if self.exact else self.error[np.ix_(i, j)])
            for a, b in norms[k + 1 :]:
                bound += np.outer(a[i] * (1 + slack), b[j])
            with np.errstate(invalid="ignore"):  # no pair of these blocks reaches a cutoff of infinity
                may = bound >= (cut[i] - np.abs(cut[i]) * slack)[:, None]
            if not may.all():
                rows, columns = may.any(axis=1), may.any(axis=0)
                i, j, total, may = i[rows], j[columns], total[np.ix_(rows, columns)], may[np.ix_(rows, columns)]
        return i, j, total, may

    def whole(self, m: np.ndarray, i: int) -> list[int]:
        return [int(x) * UNIT if abs(x) >= 2.0**45 else int(x * UNIT) for x in m[i].tolist()]

    def best(self, i: int, at: np.ndarray, total: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(score, vec_id) of the best k among the candidates ``at`` of query ``i`` with these scores, ties to the smaller vec_id."""
        if self.exact:
            order = np.lexsort((self.vec_id[at], -total))[:k]
            return [(int(total[j]), int(self.vec_id[at[j]])) for j in order]
        low, high = total - self.error[i, at], total + self.error[i, at]
        if len(at) > k:
            may = high >= np.partition(low, len(low) - k)[len(low) - k]
            at = at[may]
        query, seen, out = self.whole(self.q, i), {}, []
        for j in at.tolist():
            key = self.c[j].tobytes()
            if key not in seen:
                seen[key] = sum(a * b for a, b in zip(query, self.whole(self.c, j), strict=True))
            out.append((-seen[key], int(self.vec_id[j])))
        return [(-s, v) for s, v in sorted(out)[:k]]

    def others(self, i: int, at: np.ndarray) -> np.ndarray:
        return at[self.rid[at] != self.qrid[i]]


_CUT = pa.schema([("qrid", pa.int64()), ("cutoff", pa.float64())])


def _each(f, size: int):
    """``f`` for a group of queries, ``size`` of them at once."""

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        return pa.concat_tables([f(q.slice(at, size), c) for at in range(0, max(1, q.num_rows), size)])

    return run


def _gather(k: int, lists: int):
    """Phase 1: a cutoff that at least k candidates of the block reach."""

    def first(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return _CUT.empty_table()
        b = _Block(q, c, lists)
        entries = b.entries()
        take = min(k + 1, len(b.rid))  # one more, as the query's own row may be among them
        tops = np.concatenate([np.argpartition(-e, take - 1, axis=1)[:, :take] for e in entries], axis=1)
        rows = []
        for i in range(len(b.qrid)):
            seen = b.others(i, np.unique(tops[i]))
            if len(seen) >= k:
                low = sum(e[i, seen] for e in entries) - (0 if b.exact else b.error[i, seen])
                with np.errstate(over="ignore"):
                    rows.append((int(b.qrid[i]), float(np.ldexp(np.sort(low)[-k], b.exponent) * (1 if b.exact else UNIT * UNIT))))
        # Not finite: beyond the doubles, so no cutoff.
        rows = [(r, x if b.exact else float(np.nextafter(x, -np.inf))) for r, x in rows if math.isfinite(x)]
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate(_CUT.types)], schema=_CUT)

    return first


def _resolve(k: int, lists: int, width: int):
    """Phases 2 and 3: the best k of the block that may reach the cutoff. Scores are numbers of ``width`` bytes that sort as bytes."""
    out = pa.schema([("qrid", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.binary())])

    def second(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return out.empty_table()
        b, rows = _Block(q, c, lists), []
        cut = b.cutoff if b.exact else np.ldexp(b.cutoff / (UNIT * UNIT), -b.exponent)
        queries, columns, total, may = b.reaching(cut)
        for row, i in enumerate(queries.tolist()):
            left = may[row] & (b.rid[columns] != b.qrid[i])
            found = b.best(i, columns[left], total[row, left], k)
            rows += [(int(b.qrid[i]), int(b.query_id[i]), v, (s + (1 << (8 * width - 1))).to_bytes(width, "big")) for s, v in found]
        return pa.table([pa.array([r[j] for r in rows], t) for j, t in enumerate(out.types)], schema=out)

    return second


def _as_numbers(found: DataFrame, width: int) -> DataFrame:
    """The scores as bigint; the nearest one where a score is beyond them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [int.from_bytes(s, "big") - (1 << (8 * width - 1)) for s in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(3)], pa.array([max(-(1 << 63), min((1 << 63) - 1, s)) for s in scores], pa.int64())], ["query_id", "rank", "vec_id", "score"])

    return found.select("query_id", "rank", "vec_id", "score").mapInArrow(run, "query_id bigint, rank int, vec_id bigint, score bigint")


def exact_top_k(vectors: DataFrame, is_query, k: int = 5, lists: int = LISTS, queries_in_block: int = QUERIES_IN_BLOCK, candidates_in_block: int = CANDIDATES_IN_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the best k of each query.

    ``vectors``: vec_id and ``v`` in units of 1 / UNIT, as integer_vectors
    gives them; the score is the inner product of the whole numbers UNIT * v.
    ``is_query``: a condition on vec_id. Candidates of a query are all rows of
    its number of components but its own row; a repeated row is a row of its
    own, as query and as candidate. Ties go to the smaller vec_id. A query
    with fewer candidates gets them all; an empty table gives none; other
    columns are ignored. Order is exact for all finite components; a score
    beyond the bigints is given as the nearest of them.
    """
    rows = stage(vectors.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v"), "vectors")
    most = F.max(F.array_max(F.transform("v", F.abs)))
    n = rows.agg(F.count_if(is_query).alias("q"), F.count("*").alias("c"), most.alias("most"), F.max(F.size("v")).alias("dims")).first()
    largest = int(n["most"] or 0) * UNIT + UNIT
    width = ((largest * largest * ((n["dims"] or 0) + 1)).bit_length() + 9) // 8
    q_blocks, c_blocks = max(1, math.ceil(n["q"] / (queries_in_block * BLOCKS_AT_ONCE))), max(1, math.ceil(n["c"] / candidates_in_block))
    block = lambda count: F.pmod(F.xxhash64("rid"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    queries = rows.where(is_query).select(F.col("rid").alias("qrid"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.size("v").alias("dims"), block(q_blocks).alias("qb"))
    candidates = rows.select("rid", "vec_id", "v", F.size("v").alias("dims"), block(c_blocks).alias("cb"))
    keys = ("qb", "cb", "dims")

    def meet(queries: DataFrame, candidates: DataFrame, f, schema: str) -> DataFrame:
        return queries.groupBy(*keys).cogroup(candidates.select("*", every(q_blocks).alias("qb")).groupBy(*keys)).applyInArrow(f, schema)

    share = meet(queries.withColumn("cb", F.lit(0)), candidates.where("cb = 0"), _each(_gather(k, lists), queries_in_block), "qrid bigint, cutoff double")
    cutoffs = stage(share, "cutoffs")
    bounded = queries.join(cutoffs, "qrid", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf"))))
    found = meet(bounded.select("*", every(c_blocks).alias("cb")), candidates, _each(_resolve(k, lists, width), queries_in_block), "qrid bigint, query_id bigint, vec_id bigint, score binary")
    order = Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id")
    return _as_numbers(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), width)
