"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks that are pre-tokenised apart; where the
boundaries of two neighbours agree in the overlap, they are stitched, as from
a common boundary on both scans give the same pieces. The pieces are then
encoded, each distinct one once while the cache holds it. Decoding
concatenates the raw bytes of the ids. Very long texts have their chunks dealt
to tasks and stitched between them.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

CHUNK, OVERLAP = 16384, 256
#: Longer texts are dealt to tasks in chunks of this many characters.
LONG = 1 << 20
#: Pieces kept with their ids in a Python worker, and the longest of them.
CACHED, LONGEST = 100_000, 64


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class(pattern: str, flags) -> str:
    """The Latin-1 characters that match, as the inside of a character class."""
    return "".join(re.escape(chr(c)) for c in range(256) if flags(pattern, chr(c)))


@lru_cache(None)
def _scanners() -> tuple:
    """(for texts of Latin-1 characters, for all others, characters that only the library itself classes as needed)."""
    import public_tokenizers
    import regex

    pattern = public_tokenizers.PATTERN
    # White space by the Unicode property; \s of this engine may differ on control characters.
    exact = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    letters, numbers, spaces = (_class(p, regex.fullmatch) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    latin = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{spaces}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\s", f"[{spaces}]").replace(r"\S", f"[^{spaces}]")
    return re.compile(latin), exact


def _scanner(text: str):
    if text.isascii():
        return _scanners()[0]
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _scanners()[1]
    return _scanners()[0]


def _ends(scanner, text: str, start: int, stop: int) -> list[int]:
    """Ends of the pieces of text[start:stop] that don't hang on what follows ``stop``."""
    found = [m.end() for m in scanner.finditer(text, start, stop)]
    if stop < len(text):
        while found and found[-1] >= stop:
            found.pop()
    return found


def pre_tokenise(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The pieces of ``text``, the same as of one scan over all of it."""
    scanner = _scanner(text)
    if len(text) <= chunk:
        return scanner.findall(text)
    starts = range(0, len(text), chunk)
    scans = [_ends(scanner, text, max(0, s - overlap), min(len(text), s + chunk + overlap)) for s in starts]
    ends = scans[0]
    for s, scan in zip(starts[1:], scans[1:], strict=True):
        last = ends[-1] if ends else 0
        mine, common = set(scan), None
        for e in ends[bisect_left(ends, s - overlap) :]:
            if e in mine:
                common = e
                break
        if common is None:  # no common boundary in the overlap: go on from the last sure one until there is
            stop = min(len(text), s + chunk + overlap)
            for m in scanner.finditer(text, last):
                ends.append(m.end())
                if m.end() in mine:
                    common = m.end()
                    break
                if m.end() >= stop:
                    break
            if common is None:
                continue
        else:
            del ends[bisect_left(ends, common) + 1 :]
        ends += scan[bisect_left(scan, common) + 1 :]
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class _Cache(dict):
    def __init__(self, encode, dtype):
        self.encode, self.form = encode, {"<u2": "<%dH", "<u4": "<%dI"}[dtype]

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        ids = struct.pack(self.form % len(ids), *ids)
        if len(self) < CACHED and len(piece) <= LONGEST:
            self[piece] = ids
        return ids


def read_ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Bytes and ids of a vocabulary, and its added tokens: lines of base64 and
    rank, or a JSON file whose strings stand for bytes by the usual byte-level
    alphabet: printable Latin-1 characters for themselves, the other bytes as
    U+0100 and on."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}
    added = {x["content"]: x["id"] for x in whole.get("added_tokens", ())}
    if any(x[k] for x in whole.get("added_tokens", ()) for k in ("lstrip", "rstrip", "single_word", "normalized")):
        raise ValueError("added tokens that take in what is around them aren't read")
    return {bytes(byte_of[c] for c in s): i for s, i in whole["model"]["vocab"].items() if s not in added}, added


class Codec:
    """Encodes texts to little-endian ids of ``dtype`` and back. The strings of
    added tokens become their ids, the leftmost and longest first; a file of
    ranks has none."""

    def __init__(self, path: str, dtype: str = "<u4"):
        import public_tokenizers
        import tiktoken

        ranks, added = read_ranks(path)
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cache = _Cache(self.encoding.encode_ordinary, dtype)
        self.dtype = np.dtype(dtype)
        self.bytes_of = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for b, i in [*ranks.items(), *((t.encode(), i) for t, i in added.items())]:
            self.bytes_of[i] = b
        self.added = {t: np.array([i], self.dtype).tobytes() for t, i in added.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        if any(t in text for t in self.added):
            parts = enumerate(self.split(text))
            return b"".join(self.added[p] if k % 2 else self.encode_ordinary(p, chunk, overlap) for k, p in parts)
        return self.encode_ordinary(text, chunk, overlap)

    def encode_ordinary(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return b"".join(map(self.cache.__getitem__, pre_tokenise(text, chunk, overlap)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, self.dtype).tolist()))


@lru_cache(2)
def codec(path: str, dtype: str = "<u4") -> Codec:
    """One for each Python worker."""
    return Codec(path, dtype)


def _added(df: DataFrame, column: str, added: list[tuple[str, T.DataType]], f) -> DataFrame:
    """``df`` with columns from f(values of ``column``), which yields one tuple for each."""
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in added]])
    kinds = {T.BinaryType(): pa.binary(), T.LongType(): pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows = list(f(b.column(b.schema.get_field_index(column)).to_pylist()))
                new = [pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *[n for n, _ in added]])

    return df.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP, long: int = LONG) -> DataFrame:
    """The columns ``keep`` in a struct ``row``, and ``ids``: unsigned 32-bit
    little-endian numbers, as binary. Null texts count as empty; an empty one
    has no ids. Rows stay as they are, repeated or not; an empty table gives
    one; other columns are dropped. Texts of more than ``long`` characters are
    cut, and their chunks dealt to tasks of their own.
    """

    def ids(texts):
        c = codec(path)
        return ((c.encode(t, chunk, overlap) if t else b"",) for t in texts)

    rows = docs.select(F.struct(*[F.col(f"`{k}`") for k in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    is_long = F.coalesce(F.length("text") > long, F.lit(False))
    dealt = rows.where(is_long)
    whole = _added(rows.where(~is_long), "text", [("ids", T.BinaryType())], ids).drop("text")
    return whole if dealt.isEmpty() else whole.unionByName(_encode_dealt(dealt, path, long, max(overlap, long // 16)))


def _encode_dealt(rows: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, ids) of (row, text): chunks are pre-tokenised in tasks of their own
    and stitched at common boundaries, then each encodes from its boundary to
    the next one's. Chunks without a common boundary between them go on as one."""
    kept = rows.select("row").schema.fields[0]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        text_no = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, s in enumerate(range(0, len(t), chunk)):
                    a = max(0, s - overlap)
                    part = [b.column(0).slice(i, 1), *[pa.array([x]) for x in (text_no, k, a, s + chunk >= len(t), t[a : s + chunk + overlap])]]
                    yield pa.RecordBatch.from_arrays(part, ["row", "no", "k", "at", "last", "part"])
                text_no += 1

    schema = T.StructType([kept, *T.StructType.fromDDL("no bigint, k bigint, at bigint, last boolean, part string").fields])
    parts = stage(rows.mapInArrow(cut, schema), "parts", "zstd")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The boundaries in both overlaps of each chunk."""
        for b in batches:
            no, ks, ats, lasts, texts = (b.column(i).to_pylist() for i in range(5))
            heads, tails = [], []
            for k, at, last, t in zip(ks, ats, lasts, texts, strict=True):
                found = [m.end() + at for m in _scanner(t).finditer(t)]
                if not last:
                    while found and found[-1] >= at + len(t):
                        found.pop()
                heads.append([e for e in found if e <= k * chunk + overlap])
                tails.append([e for e in found if e >= (k + 1) * chunk - overlap])
            zones = [pa.array(z, pa.list_(pa.int64())) for z in (heads, tails)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *zones], ["no", "k", "head", "tail"])

    spread = parts.select("no", "k", "at", "last", "part").repartition("no", "k")
    zones = spread.mapInArrow(scan, "no bigint, k bigint, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("no").orderBy("k")
    met = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    stitched = zones.withColumn("start", F.when(F.col("k") == 0, F.lit(0)).otherwise(met)).select("no", "k", "start")
    # A chunk is sure of its boundaries only if all before it are; what follows one that isn't goes on with it.
    sure = F.min(F.col("start").isNotNull()).over(order)
    stitched = stitched.withColumn("start", F.when(sure, F.col("start"))).withColumn("first", F.max(F.when(F.col("start").isNotNull(), F.col("k"))).over(order))
    groups = stitched.groupBy("no", "first").agg(F.max("start").alias("start"))
    groups = groups.withColumn("stop", F.lead("start").over(Window.partitionBy("no").orderBy("first")))
    together = stage(stitched.select("no", "k", "first").join(groups, ["no", "first"]), "stitched")

    def encode(t: pa.Table) -> pa.Table:
        t = t.sort_by("k")
        no, first, start, stop = (t.column(c)[0].as_py() for c in ("no", "first", "start", "stop"))
        text, at = "", t.column("at")[0].as_py()
        for a, part in zip(t.column("at").to_pylist(), t.column("part").to_pylist(), strict=True):
            text = text[: a - at] + part  # each chunk ends beyond the start of the next
        c, out, stop = codec(path), [], None if stop is None else stop - at
        for m in _scanner(text).finditer(text, start - at):
            if stop is not None and m.end() > stop:
                break
            out.append(c.cache[m[0]])
        return pa.table([pa.array([x], k) for x, k in ((no, pa.int64()), (first, pa.int64()), (b"".join(out), pa.binary()))], names=["no", "k", "ids"])

    encoded = parts.select("no", "k", "at", "part").join(together, ["no", "k"]).groupBy("no", "first").applyInArrow(encode, "no bigint, k bigint, ids binary")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [b"".join(p["ids"] for p in ps) for ps in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["no", "ids"])

    lists = encoded.groupBy("no").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts")).mapInArrow(join, "no bigint, ids binary")
    return parts.where("k = 0").select("no", "row").join(lists, "no").select("row", "ids")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """Adds ``bytes`` to the columns of encode_texts."""

    def raw(ids):
        c = codec(path)
        return ((c.decode(i),) for i in ids)

    return _added(encoded, "ids", [("bytes", T.BinaryType())], raw)
