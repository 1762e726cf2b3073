"""Best-fit packing by a configuration linear program.

Only the histogram of the piece lengths comes to the driver: at most one count
for each length up to the capacity, whatever the input. There the program over
ways to fill a sequence is solved by multiplicative weights, each way priced by
a knapsack dynamic program; it is rounded down, and what is left is packed
best-fit, longest first, by counts. The plan says, for the n-th piece of a
length, its sequence and offset; numbering the pieces needs no sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import codec
from .common import stage

CAPACITY, END = 1024, 2
ROUNDS, RATE = 300, 4.0
#: A length's weight starts as (its share of the capacity) ** PRIOR: above 1, long pieces are placed before short ones are used up.
PRIOR = 1.2
#: Ways of the program that fill less of a sequence are dropped at rounding; best fit serves their pieces better.
FULL = 0.998
#: Shares of the program's solution that are tried at rounding; the plan with the fewest sequences stays.
SHARES = (1.0, 0.75, 0.5, 0.25)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids, part, local): the ids of each row's
    text, then ``end``, in pieces of ``capacity`` tokens of which the first may
    be shorter. With ``digest``, ids_crc32 in place of ids.

    Null texts count as empty: a lone ``end``. Strings of added tokens become
    their ids, as the library has it unless told otherwise. Repeated rows are
    documents of their own; texts of any length are read whole. doc_id must be
    null or castable to bigint. Other columns are ignored, also those named as
    one of the result; an empty table gives none. ``local`` numbers the pieces
    of one length within the task ``part`` that made them; keep the result in a
    table before use.
    """
    last = ("ids_crc32", pa.int64(), zlib.crc32) if digest else ("ids", pa.binary(), bytes)
    names = ["doc_id", "piece", "start", "length", last[0], "part", "local"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), last[1], pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen, stop = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([end], "<u4").tobytes()
        for b in batches:
            c, rows = codec(path), []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = (c.encode(t) if t else b"") + stop
                n = len(ids) // 4
                at = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    rows.append((i, k, x, y - x, last[2](ids[4 * x : 4 * y]), part, int(seen[y - x])))
                    seen[y - x] += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names)

    schema = f"doc_id bigint, piece int, start bigint, length bigint, {'ids_crc32 bigint' if digest else 'ids binary'}, part int, local bigint"
    return docs.select(F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`")).mapInArrow(run, schema)


def _price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> dict[int, int]:
    """The fullest-valued way to fill a sequence: {length: how often}."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    usable = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        with_item = best[c - lengths[: usable[c]]] + values[: usable[c]]
        k = int(with_item.argmax())
        best[c], choice[c] = (with_item[k], k) if with_item[k] > best[c - 1] else (best[c - 1], -1)
    way: dict[int, int] = {}
    c = capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            n = int(lengths[choice[c]])
            way[n] = way.get(n, 0) + 1
            c -= n
    return way


def _by_weights(counts: dict[int, int], capacity: int, rounds: int, rate: float) -> list[tuple[dict[int, int], int]]:
    """Ways with how often each is used, never beyond the counts.

    A length's weight is multiplied by exp(-rate * share of it that is
    covered): ways that serve lengths lagging behind are priced up.
    """
    total = sum(n * c for n, c in counts.items())
    covered = dict.fromkeys(counts, 0.0)
    used: dict[tuple, float] = {}
    step = total / capacity / rounds
    for _ in range(2 * rounds):
        lengths = np.array(sorted(n for n in counts if counts[n] - covered[n] >= 1), dtype=np.int64)
        if not len(lengths):
            break
        demand = np.array([counts[n] for n in lengths], float)
        done = np.array([covered[n] for n in lengths]) / demand
        way = _price((lengths / capacity) ** PRIOR * np.exp(rate * (done.mean() - done)), lengths, capacity)
        room = min((counts[n] - covered[n]) / a for n, a in way.items())
        if room < 1:  # a scarce length more than once: as often as there is left of it
            way = {n: min(a, int(counts[n] - covered[n])) for n, a in way.items()}
            room = 1.0
        amount = min(max(step, 1.0), room)
        key = tuple(sorted(way.items()))
        used[key] = used.get(key, 0.0) + amount
        for n, a in way.items():
            covered[n] += a * amount
    return [(dict(k), int(x)) for k, x in used.items() if x >= 1]


def _best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on counts: equal open sequences are one group."""
    open_: dict[int, list[list]] = {}  # room: groups [way, how many]
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = min((r for r in open_ if r >= n and open_[r]), default=None)
            if room is None:
                per = capacity // n
                for k, a in ((per, left // per), (left % per, 1)):
                    if k and a:
                        open_.setdefault(capacity - n * k, []).append([{n: k}, a])
                break
            way, many = open_[room].pop()
            per = min(room // n, left)
            take = min(many, left // per)
            if many > take:
                open_[room].append([way, many - take])
            open_.setdefault(room - n * per, []).append([way | {n: way.get(n, 0) + per}, take])
            left -= per * take
    return [(way, many) for groups in open_.values() for way, many in groups]


def pack_plan(counts: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS, rate: float = RATE) -> list[tuple[dict[int, int], int]]:
    """Ways to fill a sequence ({length: how often}) with their number of
    sequences, which together hold ``counts`` exactly."""
    counts = {int(n): int(c) for n, c in counts.items() if c}
    full = [({capacity: 1}, counts.pop(capacity))] if capacity in counts else []
    if not counts:
        return full
    program = [(w, m) for w, m in _by_weights(counts, capacity, rounds, rate) if sum(n * a for n, a in w.items()) >= FULL * capacity]

    def rounded(share: float) -> list[tuple[dict[int, int], int]]:
        taken = [(w, int(m * share)) for w, m in program if m * share >= 1]
        left = dict(counts)
        for way, many in taken:
            for n, a in way.items():
                left[n] -= a * many
        return taken + _best_fit({n: c for n, c in left.items() if c}, capacity)

    return full + min(map(rounded, SHARES), key=lambda plan: sum(m for _, m in plan))


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs: for each length up to half of the capacity, pieces
    of over the rest need one of their own, those of over half one each, and shorter ones
    down to that length what the latter leave over."""
    lengths = np.array(sorted(n for n, c in counts.items() if c), np.int64)
    if not len(lengths):
        return 0
    many = np.array([counts[int(n)] for n in lengths], np.int64)
    best = 0
    for least in [0, *lengths[2 * lengths <= capacity].tolist()]:
        alone, half = lengths > capacity - least, 2 * lengths > capacity
        small = (lengths >= least) & ~half
        room = int(((capacity - lengths) * many)[half & ~alone].sum())
        over = int((lengths * many)[small].sum()) - room
        best = max(best, int(many[half].sum()) + max(0, -(-over // capacity)))
    return best


def _slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first piece, first sequence, pieces in a sequence, offset of the first)."""
    rows: dict[int, list[tuple]] = {}
    number: dict[int, int] = {}
    sequence = 0
    for way, many in plan:
        offset = 0
        for n, a in sorted(way.items(), reverse=True):
            rows.setdefault(n, []).append((number.get(n, 0), sequence, a, offset))
            number[n] = number.get(n, 0) + a * many
            offset += a * n
        sequence += many
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset in place of part and local.

    ``pieces`` is a table with length, part and local as of cut_pieces, and
    any other columns but those two new ones. Equal rows are pieces of their
    own; an empty table stays empty.
    """
    kept = [c for c in pieces.columns if c not in ("part", "local")]
    per_task = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(pack_plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    rows = pieces.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), "part", "length", "local")
    numbered = rows.join(first, ["part", "length"]).select("row", "length", (F.col("local") + F.col("first")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, number = b.column(1).to_numpy(), b.column(2).to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                row = slots[int(n)][np.searchsorted(slots[int(n)][:, 0], number[at], side="right") - 1]
                nth = number[at] - row[:, 0]
                sequence[at] = row[:, 1] + nth // row[:, 2]
                offset[at] = row[:, 3] + nth % row[:, 2] * n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    schema = rows.select("row").withColumns({"sequence_id": F.lit(0).cast("bigint"), "offset": F.lit(0).cast("bigint")}).schema
    return numbered.mapInArrow(run, schema).select("row.*", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of all rows with their ids (unsigned 32-bit, little-endian),
    sequence_id and offset.

    Rows are read as by cut_pieces: null, empty and very long texts, repeated
    rows, empty tables and clashing columns are as there. Pieces of one length
    are alike to the packing: which of them goes where follows the tasks that
    cut them.
    """
    return place_pieces(stage(cut_pieces(docs, path, capacity, end), "pieces", "zstd"), capacity)


def pack_digests(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """As pack_documents, with ids_crc32 of the ids instead, so that no ids are written."""
    return place_pieces(stage(cut_pieces(docs, path, capacity, end, digest=True), "pieces"), capacity)
