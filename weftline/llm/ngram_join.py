"""Similarity join on word n-grams by the chosen-path method.

Documents are sets of n-grams. In each run a set picks a few of its tokens by
their hashes, so that similar sets pick a shared one; each token so picked is a
bucket, and a bucket that is too large is split by picking again within it,
along the path of picks so far. Small buckets, and those at the end of the
longest paths, are compared by brute force. The number of runs follows from the
recall to reach. All this is on sketches; candidates that it links form groups,
whose sets are fetched once and compared exactly.

Sets that links connect need not meet again, since all sets of a group are
compared in the end. So before a large bucket is split, each of its sets is
compared with the bucket's least one, and the groups that all links so far form
are looked up: a bucket of one group ends there; one where few sets lie outside
its main group has those compared with all its sets, block by block; only
others are split, and of their paths only those go on that join several groups.
What most sets of a bucket share, such as a frequent passage, splits nothing:
paths go on by the other n-grams, picked as much more often as are left out.

Sets that are equal count as one, with the number of their documents. Groups of
any size are compared block by block, so that no task holds a whole one; blocks
hold sets of like sizes, bounded in sets and in tokens, and only those of the
same or neighbouring sizes meet, as others can't be similar. Rows of very
frequent buckets and groups are joined by broadcast of those few.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, digest_of, discard, packed, spread_join, stage, unpacked
from .graph import connected_components

WORDS, SIMILAR, RECALL = 5, 0.8, 0.999
#: Sets in a bucket that is compared rather than split; sets outside its main group that are compared with a larger one; sets in a block.
BUCKET, OUTSIDE, BLOCK = 256, 512, 512
#: Tokens in a block of whole sets, on average (4 MB); a larger set is a block of its own or with few others.
BLOCK_TOKENS = 1 << 19
#: Picks that a pair at the threshold shares on average at each level after the first, and the most levels.
PICKS, DEPTH = 1.5, 8
#: Sets of different groups in which the common hashes of a bucket are looked for; the least share of a sketch left at the threshold without picking common ones too.
SEEN, LEFT = 8, 0.2
#: Least hashes kept of a set, and the share of them that similar sets have in common, at least, but for a chance of under 1 in 1000.
SKETCH, SHARED = 64, 0.6
#: Keys that are broadcast at once (under 100 MB); more are joined by a shuffle.
BROADCAST_KEYS = 500_000

_MASK = (1 << 64) - 1
_FIRST = np.uint64(0xD6E8FEB86659FD93)


def runs_for(recall: float, picks: float = PICKS, depth: int = DEPTH) -> int:
    """Runs for a pair at the threshold: it shares one first pick a run on
    average, and ``picks`` at each level after it."""
    alive = 1.0
    for _ in range(depth - 1):
        alive = 1 - math.exp(-picks * alive)
    return math.ceil(-math.log(1 - recall) / alive)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Words to their 64-bit hashes, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word.encode())
        if len(self) < 100_000 and len(word) <= 64:
            self[word] = h
        return h


_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space by Unicode that doesn't part words here.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _split(text: str) -> list[str]:
    """Maximal runs of other characters than the space and U+0009 to U+000D."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


class Shingler:
    """Texts to sorted 64-bit hashes of their distinct n-grams of words."""

    def __init__(self, words: int = WORDS):
        self.words, self.hashes = words, _Hashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = _split(text or "")
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        k = min(self.words, len(words))
        out = np.zeros(len(words) - k + 1, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(out)])
        return np.unique(out)


def key_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def sketch_of(tokens: np.ndarray, size: int = SKETCH) -> np.ndarray:
    h = (_mix(tokens ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    return np.sort(np.partition(h, size - 1)[:size] if len(h) > size else h)


def _limit(picks: float, size: int) -> np.uint64:
    return np.uint64(min(_MASK, int(2**64 * picks / size)))


def first_picks(tokens: np.ndarray, runs: int, similar: float = SIMILAR) -> np.ndarray:
    """The buckets of the first level.

    A run picks a token with chance 1 / (similar * size): a set at the
    threshold shares at least ``similar`` of the larger set's tokens, so one
    pick on average. The first picks of all runs are one draw by one hash.
    """
    h = _mix(tokens ^ _FIRST)
    return np.unique(_mix(tokens[h <= _limit(runs / similar, len(tokens))] + _FIRST))


def next_picks(sketch: np.ndarray, bucket: int, similar: float = SIMILAR, picks: float = PICKS, common: np.ndarray | None = None) -> np.ndarray:
    """The buckets that a set picks within ``bucket``, from its sketch, which similar sets share as they do the whole.

    Hashes that are ``common`` in the bucket are passed over. Sets at the
    threshold share ``similar`` of the larger one's, so of the others still that
    less the common ones of either; picked with a chance of ``picks`` to that
    number, they meet as often, whatever is common. A set of which too little is
    left picks among all hashes besides, to meet others like it.
    """
    parent = np.uint64(bucket & _MASK)
    h = _mix(_mix(sketch.astype(np.uint64) + parent) ^ parent)
    chosen = h <= _limit(picks / similar, len(sketch))
    if common is not None and len(common):
        held = np.isin(sketch, common)
        left = similar * len(sketch) - held.sum()
        others = ~held & (h <= _limit(picks, max(left, picks)))
        chosen = others if left >= LEFT * len(sketch) else others | chosen
    return np.unique(_mix(h[chosen] + parent))


def _scan(docs: DataFrame, text: str, doc_id: str, runs: int, words: int, similar: float) -> DataFrame:
    """A row for each document: doc_id, hash of its text, key (null without words), size of its set, sketch and first picks."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("hash"), F.col(f"`{text}`").alias("text"))
    names = ["doc_id", "hash", "key", "size", "sketch", "picks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part, found = b.slice(at, 500), []
                for t in part.column(2).to_pylist():
                    tokens = shingles(t)
                    found.append((key_of(tokens), len(tokens), sketch_of(tokens).tobytes(), first_picks(tokens, runs, similar).view(np.int64)) if len(tokens) else (None, 0, None, []))
                kinds = [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array([f[j] for f in found], k) for j, k in enumerate(kinds)]], names)

    schema = rows.select("doc_id", "hash").withColumns({"key": F.lit(None).cast("binary"), "size": F.lit(None).cast("bigint"), "sketch": F.lit(None).cast("binary"), "picks": F.array().cast("array<bigint>")}).schema
    return rows.mapInArrow(run, schema)


def _meet_least(rows: DataFrame) -> DataFrame:
    """(bucket, key, sketch, n, least) with ``linked``: whether the sketch is similar to that of the bucket's least set."""
    names = ["bucket", "key", "sketch", "n", "least", "linked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sketches, least = ([np.frombuffer(x, np.uint32).astype(np.uint64) for x in b.column(i).to_pylist()] for i in (2, 5))
            row = lambda parts: np.concatenate([p + (np.uint64(i) << np.uint64(32)) for i, p in enumerate(parts)]) if parts else np.empty(0, np.uint64)
            both = np.intersect1d(row(sketches), row(least), assume_unique=True)
            common = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=b.num_rows)
            sizes = np.array([min(len(x), len(y)) for x, y in zip(sketches, least, strict=True)], float)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], pa.array(common >= SHARED * sizes)], names)

    return rows.select("bucket", "key", "sketch", "n", "least", "least_sketch").mapInArrow(run, "bucket bigint, key binary, sketch binary, n bigint, least binary, linked boolean")


def _common_of(rows: DataFrame) -> DataFrame:
    """(bucket, common, often): the hashes that two or more of SEEN sets of different groups have in a bucket; any choice is right."""
    one = rows.groupBy("bucket", "component").agg(F.min_by("sketch", "key").alias("sketch"), F.first("n").alias("n"))
    seen = one.groupBy("bucket").agg(F.array_distinct(F.array(*[F.min_by("sketch", F.xxhash64("component", F.lit(i))) for i in range(SEEN)])).alias("seen"), F.first("n").alias("often"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(np.concatenate([np.frombuffer(x, np.uint32) for x in sketches]), return_counts=True) for sketches in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([h[n > 1].tobytes() for h, n in found], pa.binary()), b.column(2)], ["bucket", "common", "often"])

    return seen.mapInArrow(run, "bucket bigint, common binary, often bigint")


def _children(rows: DataFrame, similar: float) -> DataFrame:
    """(bucket, key, component) of the next level, from (bucket, key, sketch, component, common)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            picks = [next_picks(np.frombuffer(s, np.uint32), p, similar, common=np.frombuffer(c, np.uint32)) for p, s, c in zip(*(b.column(i).to_pylist() for i in (0, 2, 4)), strict=True)]
            at = pa.array(np.repeat(np.arange(len(picks)), [len(p) for p in picks]))
            flat = np.concatenate(picks).view(np.int64) if picks else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), b.column(1).take(at), b.column(3).take(at)], ["bucket", "key", "component"])

    return rows.select("bucket", "key", "sketch", "component", "common").mapInArrow(run, "bucket bigint, key binary, component binary")


def _groups(sets: DataFrame, similar: float) -> DataFrame:
    """(node, component) of the sets that links of similar sketches connect."""
    sketches = sets.select("key", "sketch")
    level, groups = sets.select(F.explode("picks").alias("bucket"), "key"), None
    links, waiting = sets.select(F.col("key").alias("a"), F.col("key").alias("b")).limit(0), []

    def add(*more: DataFrame) -> None:
        nonlocal links, groups
        merged = stage(reduce(DataFrame.unionByName, [links, *more, *waiting]).distinct(), "links")
        discard(*waiting, *(t for t in (links, groups) if hasattr(t, "stage_path")))
        waiting.clear()
        links, groups = merged, connected_components(merged)

    for depth in range(1, DEPTH + 1):
        several = "true" if depth == 1 else "min_component < max_component"
        within = [] if depth == 1 else [F.min("component").alias("min_component"), F.max("component").alias("max_component")]
        sizes = stage(level.groupBy("bucket").agg(F.count("*").alias("n"), *within).where("n > 1").where(several).select("bucket", "n"), "sizes")
        rows = sizes.agg(F.sum("n")).first()[0] or 0
        if not rows:
            add()
            discard(sizes, *([level] if depth > 1 else []))
            return groups
        # Buckets to compare, each a list of at most BUCKET keys; those with the same keys are one.
        hot = sizes.where(F.col("n") > max(rows // HOT, BUCKET)).select("bucket")  # fewer than HOT
        small = level.select("bucket", "key").join(F.broadcast(hot), "bucket", "left_anti").join(sizes.where(F.col("n") <= BUCKET).select("bucket"), "bucket")
        small = small.groupBy("bucket").agg(F.sort_array(F.collect_list("key")).alias("keys"))
        lists = stage(small.groupBy("keys").agg(F.min("bucket").alias("bucket")), "lists")
        members = lists.select("bucket", F.size("keys").cast("bigint").alias("n"), F.explode("keys").alias("key"))
        compared = stage(_compared(members.join(sketches, "key")), "compared")
        discard(lists)
        large = stage(sizes.where(F.col("n") > BUCKET).withColumn("often", F.col("n")), "large")
        discard(sizes)
        if large.isEmpty():
            add(compared)
            discard(compared, large, *([level] if depth > 1 else []))
            return groups
        held = stage(spread_join(level.select("bucket", "key"), large, "bucket", "often", rows).join(sketches, "key"), "held")
        least = held.groupBy("bucket").agg(F.min_by(F.struct("key", "sketch"), "key").alias("s"), F.first("n").alias("often"))
        least = stage(least.select("bucket", F.col("s.key").alias("least"), F.col("s.sketch").alias("least_sketch"), "often"), "least")
        met = stage(_meet_least(spread_join(held, least, "bucket", "often", rows)), "met")
        add(compared, met.where("linked and key <> least").select(F.col("key").alias("a"), F.col("least").alias("b")))
        discard(compared, large, held, least, *([level] if depth > 1 else []))

        grouped = met.select("bucket", "key", "sketch", "n").join(groups.withColumnRenamed("node", "key"), "key", "left")
        grouped = stage(grouped.withColumn("component", F.coalesce("component", "key")), "grouped")
        discard(met)
        parts = grouped.groupBy("bucket", "component").agg(F.count("*").alias("c"))
        main = parts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("c"), F.sum("c").alias("often"))
        main = stage(main.where("c < often").select("bucket", "main", (F.col("often") - F.col("c")).alias("outside"), "often"), "main")
        mixed = stage(spread_join(grouped, main, "bucket", "often", rows), "mixed")
        discard(grouped, main)
        if depth == DEPTH:  # the ends of the paths
            add(_compared(mixed))
            discard(mixed)
            return groups
        waiting.append(stage(_outside(mixed.where(F.col("outside") <= OUTSIDE)), "outside"))  # added with the next links
        split = mixed.where(F.col("outside") > OUTSIDE).select("bucket", "key", "sketch", "n", "component")
        common = stage(_common_of(split), "common")
        level = stage(_children(spread_join(split, common, "bucket", "often", rows), similar), "level")
        discard(mixed, common)
    return groups


def _outside(rows: DataFrame) -> DataFrame:
    """Links between the sets outside the main group of a bucket, at most OUTSIDE of them, and all its sets, dealt to blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    inside = rows.select("bucket", "key", "sketch", F.lit(1).alias("own"), own.alias("i"))
    outside = rows.where(F.col("component") != F.col("main")).select("bucket", "key", "sketch", F.lit(0).alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))

    def compare(rows: list[tuple]) -> list[tuple]:
        left, right = ([(0, 0, own, key, sketch) for _, own, key, sketch in rows if own == side] for side in (0, 1))
        return _linked(left, right)

    return _by_group(inside.unionByName(outside), ["bucket", "i"], ["own", "key", "sketch"], compare, "a binary, b binary", [pa.binary()] * 2, ["a", "b"])


def _compared(rows: DataFrame) -> DataFrame:
    """Links of buckets: (bucket, key, n, sketch)."""
    return _by_group(_blocked(rows, "bucket", BLOCK), ["bucket", "i", "j"], ["own", "key", "sketch"], _candidates, "a binary, b binary", [pa.binary()] * 2, ["a", "b"])


def _blocked(rows: DataFrame, group: str, block: int) -> DataFrame:
    """``rows`` (group, key, n, ...) dealt to pairs of blocks: columns i <= j,
    and side: whether a row belongs to block i, to j, or to both (i = j)."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks).cast("int")
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "n")


def _size_class(size: Column, similar: float) -> Column:
    """Sets at the threshold have sizes in the same or neighbouring classes, as the smaller has at least ``similar`` of the larger's tokens."""
    return F.floor(F.log(size) / (math.log(1 / similar) + 1e-6))


def _size_blocks(rows: DataFrame) -> DataFrame:
    """(component, blocks, often) of rows (component, class, size): the number
    of blocks of each class of sizes, of at most BLOCK sets and BLOCK_TOKENS
    tokens on average. A component has as many classes as sizes differ in
    powers of 1 / similar, so their map is small."""
    cells = rows.groupBy("component", "class").agg(F.count("*").alias("n"), F.sum("size").alias("tokens"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("tokens") / BLOCK_TOKENS))
    return cells.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("class", blocks))).alias("blocks"), F.sum("n").alias("often"))


def _blocked_by_size(rows: DataFrame) -> DataFrame:
    """``rows`` (component, class, blocks, key, ...) dealt to pairs of blocks as
    by ``_blocked``, but only of the same or neighbouring classes of sizes."""
    name = lambda k, b: F.shiftleft(k, 32) + b
    count = lambda k: F.coalesce(F.element_at("blocks", k), F.lit(0))
    of = lambda k: F.when(count(k) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), count(k) - 1), lambda b: name(k, b))).otherwise(F.array().cast("array<bigint>"))
    k = F.col("class")
    dealt = rows.withColumn("own", name(k, F.pmod(F.xxhash64("key"), count(k)))).withColumn("other", F.explode(F.concat(of(k - 1), of(k), of(k + 1))))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other", "blocks")


def _by_group(rows: DataFrame, keys: list[str], columns: list[str], f: Callable[[list[tuple]], list[tuple]], schema: str, kinds: list, names: list[str]) -> DataFrame:
    """f over the rows of each group, each without the first of ``keys``, streamed from sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def made():
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in (*keys, *columns)]
            for row in zip(*cols, strict=True):
                if row[: len(keys)] != now:
                    if held:
                        out += f(held)
                    now, held = row[: len(keys)], []
                held.append(row[1:])
            if len(out) > 20_000:
                yield made()
                out = []
        if held:
            out += f(held)
        if out:
            yield made()

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of each pair of sets, by products of incidence matrices over slices of the tokens."""
    sizes = [len(x) for x in (*left, *right)]
    _, code, often = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    shared = often[code] > 1
    code, row = code[shared], row[shared]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    _, code = np.unique(code, return_inverse=True)
    out = np.zeros((len(left), len(right)))
    width = 4096
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [at, at + width])
        x = np.zeros((len(sizes), min(width, int(code[-1]) + 1 - at)), np.float32)
        x[row[a:b], code[a:b] - at] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out


def _sides(rows: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Rows (i, j, own, ...) of one pair of blocks, each once on its side; the same list for a block with itself."""
    i, j = rows[0][:2]
    rows = sorted({r[3]: r for r in rows}.values(), key=lambda r: r[3]) if i == j else rows
    return ([r for r in rows if r[2] == i], [r for r in rows if r[2] == j]) if i != j else (rows, rows)


def _candidates(rows: list[tuple]) -> list[tuple]:
    """Links that span what the sketches of a pair of blocks connect."""
    return _linked(*_sides(rows))


def _linked(left: list[tuple], right: list[tuple]) -> list[tuple]:
    if not left or not right:
        return []
    a, b = ([np.frombuffer(r[4], np.uint32) for r in side] for side in (left, right))
    least = np.minimum.outer([len(x) for x in a], [len(x) for x in b])
    return _spanning(left, right, _common(a, b) >= SHARED * least)


def _spanning(left: list[tuple], right: list[tuple], linked: np.ndarray) -> list[tuple]:
    """(key, least key) of each connected part of a pair of blocks: as groups
    that meet in many buckets have the same least key there, their links repeat
    and become one."""
    parent: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i in np.flatnonzero(linked.any(axis=1)):
        x = left[i][3]
        for j in np.flatnonzero(linked[i]):
            p, q = root(x), root(right[j][3])
            if p != q:
                parent[max(p, q)] = min(p, q)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def _exact(similar: float):
    def compare(rows: list[tuple]) -> list[tuple]:
        """(key, documents linked by links within the pair of blocks, a linked key or null)."""
        left, right = _sides(rows)
        if not left or not right:
            return []
        a, b = ([np.frombuffer(r[4], np.uint64) for r in side] for side in (left, right))
        common = _common(a, b)
        union = np.add.outer([len(x) for x in a], [len(x) for x in b]) - common
        linked = common >= similar * union - 1e-9
        if left is right:
            np.fill_diagonal(linked, False)
        found: dict[bytes, int] = {}
        for side, other, m in ((left, right, linked), *(((right, left, linked.T),) if left is not right else ())):
            weight = np.array([r[5] for r in other], np.int64)
            for r, n in zip(side, m @ weight, strict=True):
                if n:
                    found[r[3]] = int(n)
        return [(k, n, None) for k, n in found.items()] + [(x, 0, y) for x, y in _spanning(left, right, linked)]

    return compare


def similar_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", similar: float = SIMILAR, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) of each row.

    Links join documents whose sets of distinct n-grams of ``words`` words have
    a Jaccard similarity of ``similar`` or more; a text of fewer words is one
    n-gram of all its words. ``n_links`` counts the other documents linked,
    equal texts included; ``class_id`` is the least doc_id of the connected
    group. A null or wordless text has no n-gram: no link, its own doc_id as
    class. Repeated rows are documents of their own, which link; a null doc_id
    is no class_id while the group has another. doc_id may have any type that
    is ordered. Texts of any length are read whole; an empty table gives one;
    other columns are ignored.
    """
    whole = stage(_scan(docs, text, doc_id, runs_for(recall), words, similar), "scanned")
    sets = whole.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("doc_id").alias("least"), F.min("hash").alias("hash"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("picks").alias("picks"))
    sets, ids = stage(sets, "sets"), stage(whole.select("doc_id", "key"), "ids")
    discard(whole)
    groups = _groups(sets, similar)

    members = groups.withColumnRenamed("node", "key").join(sets.select("key", "weight", "hash", "size"), "key")
    members = stage(members.withColumn("class", _size_class(F.col("size"), similar)), "members")
    sizes = stage(_size_blocks(members), "sizes")
    discard(groups)
    tokens = _tokens_of(docs, text, words, members.select("hash"))
    rows = spread_join(members.drop("hash", "size"), sizes, "component", "often", members.count()).join(tokens, "key")
    compared = _by_group(_blocked_by_size(rows), ["component", "i", "j"], ["own", "key", "tokens", "weight"], _exact(similar), "key binary, n bigint, other binary", [pa.binary(), pa.int64(), pa.binary()], ["key", "n", "other"])
    compared = stage(compared, "compared")
    discard(members, sizes)

    counts = compared.groupBy("key").agg(F.sum("n").alias("n"))
    classes = connected_components(compared.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    named = sets.select("key", "weight", "least").join(counts, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left")
    named = stage(named.withColumn("component", F.coalesce("component", "key")), "named")
    discard(sets, compared, classes)
    least = stage(named.groupBy("component").agg(F.min("least").alias("class_id"), F.count("*").alias("often")), "least")
    total = named.count()
    result = spread_join(named, least, "component", "often", total).select("key", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("often"))
    result = stage(result, "result")
    discard(named, least)
    alone = ids.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    worded = ids.where("key is not null")
    return spread_join(worded, result, "key", "often", worded.count()).select("doc_id", "class_id", "n_links").unionByName(alone)


def _tokens_of(docs: DataFrame, text: str, words: int, hashes: DataFrame) -> DataFrame:
    """(key, tokens) of the texts with these hashes, made anew from the texts.

    One text of each set is enough; texts whose hash is that of another merely
    add sets that no one asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                found = [shingles(t) for t in b.slice(at, 500).column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([key_of(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "tokens"])

    if hashes.count() <= BROADCAST_KEYS:
        hashes = F.broadcast(hashes)
    texts = docs.select(F.col(f"`{text}`").alias("text")).withColumn("hash", F.xxhash64("text")).join(hashes, "hash", "left_semi")
    return texts.select("text").mapInArrow(run, "key binary, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens"))


def keep_one_of_each(docs: DataFrame, text: str = "text", first: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs``, with their columns, less all but one of each group
    of similar documents: that of the least ``first`` (nulls before others; a
    column that is lacking decides nothing), then of the least hash of the row.

    Values of ``first`` may be null or repeat. Rows that are the same in all
    columns are one document, so one of them stays if its text has words;
    wordless texts all stay. Texts are not written: a row is known by its hash.
    """
    rows = packed(docs, "row").withColumn("digest", digest_of("row"))
    order = [F.col(f"row.`{first}`").alias("first")] if first in docs.columns else []
    judged = similar_documents(rows.select(F.struct(*order, "digest").alias("id"), F.col(f"row.`{text}`").alias("text")), "text", "id", **how)
    kept = judged.groupBy(F.col("doc_id.digest").alias("digest")).agg(F.min(F.col("doc_id") == F.col("class_id")).alias("stays"), F.max("n_links").alias("n_links"), F.count("*").alias("n"))
    # Only rows that go, and those of which several are the same and linked, are named; all others pass.
    named = stage(kept.where("not stays or n > 1 and n_links > 0").select("digest", "stays"), "named")
    few = (lambda df: F.broadcast(df)) if named.count() <= BROADCAST_KEYS else (lambda df: df)
    plain = rows.join(few(named.select("digest")), "digest", "left_anti").select("row")
    if named.where("stays").isEmpty():
        return unpacked(plain, "row")
    repeated = rows.join(few(named.where("stays").select("digest")), "digest", "left_semi").groupBy("digest").agg(F.first("row").alias("row")).select("row")
    return unpacked(plain.unionByName(repeated), "row")
