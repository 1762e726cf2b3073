"""Fill-in-middle: texts cut in three and put in another order, by one numpy kernel over whole Arrow batches.

Bytes are looked up in a table of classes, pairs of neighbouring classes tell
where a unit begins, sums of these marks that start anew at each document number
the units, and one search over the sums finds the cuts of all rows. The pieces
are slices of the batch's own buffer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Bytes of rows that the kernel takes at once; a longer text is taken alone.
BYTES = 4 << 20

_CONTINUES, _SPACE, _NEWLINE, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x80:0xC0] = _CONTINUES
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _SPACE
_CLASS[0x0A] = _NEWLINE

#: unit: whether one begins between two bytes, by the class of the first and of the second.
UNITS = {
    "characters": np.array([[second != _CONTINUES for second in range(4)] for _ in range(4)]),
    "words": np.array([[first in (_SPACE, _NEWLINE) and second == _OTHER for second in range(4)] for first in range(4)]),
    "lines": np.array([[first == _NEWLINE for _ in range(4)] for first in range(4)]),
}


def unit_starts(data: np.ndarray, starts: np.ndarray, unit: str) -> np.ndarray:
    """Which bytes begin a unit, where documents begin at ``starts`` (of those that aren't empty)."""
    kinds = _CLASS[data]
    marks = np.empty(len(data), bool)
    marks[1:] = UNITS[unit].ravel()[(kinds[:-1] << 2) | kinds[1:]]
    marks[starts] = True
    return marks


def cut_rows(texts: pa.LargeStringArray, draws: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
    """Units of each text, the units before its two cuts (a row each), and all pieces in order, three a text.

    ``draws``: for each text two whole numbers, of which the remainders by units + 1 are the cuts.
    """
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = offsets[0], offsets[-1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[first:last]
    at = offsets - first
    filled = at[1:] > at[:-1]
    marks = unit_starts(data, at[:-1][filled], unit) if len(data) else np.zeros(0, bool)
    sums = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
    np.cumsum(marks, out=sums[1:])
    before = sums[at].astype(np.int64)
    n = before[1:] - before[:-1]
    cuts = np.sort(draws % (n + 1)[:, None], axis=1)
    places = np.where(cuts == n[:, None], at[1:, None], np.searchsorted(sums[1:], before[:-1, None] + cuts + 1))
    ends = np.append(np.column_stack([at[:-1], places]).ravel(), at[-1]) + first
    pieces = pa.LargeStringArray.from_buffers(3 * len(texts), pa.py_buffer(np.ascontiguousarray(ends)), texts.buffers()[2])
    return n, cuts, pieces


def rearranged(texts: pa.Array, draws: np.ndarray, unit: str, plain_from: int, spm_to: int) -> list[pa.Array]:
    """n, form, units of the prefix and of the middle, and output of a batch; ``draws`` has four numbers a row."""
    n, cuts, pieces = cut_rows(texts, draws[:, :2], unit)
    marked = pc.or_(pc.or_(*(pc.match_substring(texts, m) for m in MARKS[:2])), pc.match_substring(texts, MIDDLE)).to_numpy(zero_copy_only=False)
    plain = pa.array((n == 0) | marked | (draws[:, 2] % 100 >= plain_from))
    spm = pa.array(draws[:, 3] % 100 < spm_to)
    prefix, middle, suffix = (pieces.take(pa.array(np.arange(k, len(pieces), 3))) for k in range(3))
    join = lambda *x: pc.binary_join_element_wise(*x, pa.scalar("", pa.large_string()))
    marks = [pa.scalar(m, pa.large_string()) for m in MARKS]
    output = pc.if_else(plain, texts, pc.if_else(spm, join(marks[1], suffix, marks[0], prefix, marks[2], middle), join(marks[0], prefix, marks[1], suffix, marks[2], middle)))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    some = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pa.array(x))
    return [pa.array(n), form, some(cuts[:, 0]), some(cuts[:, 1] - cuts[:, 0]), output]


def _groups(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to ``most`` bytes together, or of one row."""
    begin = held = 0
    for i, size in enumerate(sizes.tolist()):
        if i > begin and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def draws_of(key: Column, seed: int = 1) -> list[Column]:
    """Four numbers of 32 bits from the sha256 of the seed, a colon and the key; a null key counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), unit: str = "characters", seed: int = 1, share: int = 90, spm: int = 20, most: int = BYTES) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, with n, form, prefix_units, middle_units and output.

    ``n``: units of the text, code points, words or lines as ``unit`` says; a
    word has the separators after it, those that a text begins with are a unit of
    their own, and a line ends with its line feed. ``share`` of 100 texts
    are cut, ``spm`` of 100 of those have the suffix first. Texts that are empty or
    null, or contain one of MARKS, stay as they are, and so does a share of the others;
    their form is plain and prefix and middle are null. Rows are cut each for itself by the
    hash of the key alone: repeated ones alike. Texts of any length are cut
    whole, with memory of about ten times the longest. An empty table gives one, and columns of
    any name may be kept.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {', '.join(UNITS)}")
    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *[d.alias(f"h{k}") for k, d in enumerate(draws_of(F.col(f"`{key}`"), seed))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.large_string())
            draws = np.column_stack([b.column(k).to_numpy() for k in range(2, 6)])
            for i, j in _groups(pc.binary_length(texts).to_numpy(), most):
                found = rearranged(texts.slice(i, j - i), draws[i:j], unit, share, spm)
                found[-1] = found[-1].cast(pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *found], ["row", "n", "form", "prefix_units", "middle_units", "output"])

    more = {"n": "bigint", "form": "string", "prefix_units": "bigint", "middle_units": "bigint", "output": "string"}
    return rows.mapInArrow(run, rows.select("row").withColumns({k: F.lit(None).cast(v) for k, v in more.items()}).schema)


def restore_text(output: Column, form: Column) -> Column:
    """The text that an output of ``fill_in_middle`` was made from. No piece holds a mark, so each mark stands once."""
    parts = F.split(F.substring(output, len(PREFIX) + 1, 2**31 - 1), "|".join(MARKS), -1)
    order = lambda *at: F.concat(*[F.element_at(parts, k) for k in at])
    return F.when(form == "psm", order(1, 3, 2)).when(form == "spm", order(2, 3, 1)).otherwise(output)
