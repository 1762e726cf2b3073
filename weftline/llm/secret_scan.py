"""Secret scans with corpus-wide ownership frequency.

Patterns find candidates in each text. Their values' hashes are counted over
the corpus by distinct repositories and owners: values that many owners have
are copied examples, those of few look live. Spans of the fixed kinds always
stay; the broader kind ``key`` is a candidate whose spans stay only if its
value looks live.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, packed, spread_join, stage, text_of, unpacked

# The patterns of the kinds, in their order.
ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "key")

#: A run of 32 or more characters that has upper and lower case and digits.
KEY = re.compile(r"[A-Za-z0-9+/_-]{32,}")
#: Values of at least so many distinct owners, or repositories, are examples.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 6

PLACEHOLDER = "<SECRET>"
#: Live spans that are broadcast at once, of under 100 bytes each; more are joined by a shuffle.
BROADCAST_SPANS = 300_000
#: What each text with a span of any kind has.
ANY_SPAN = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|[A-Za-z0-9+/_-]{32}"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start and kind, leftmost non-overlapping in each kind.

    The patterns of access and hex ask for their least length at once: a run
    that is too short has no long one inside, so the matches are the same.
    """
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def key_spans(text: str, base: list[tuple]) -> list[tuple[int, int, int, str]]:
    """Runs that look random and overlap no span of ``base``."""
    found, starts = [], [b[0] for b in base]
    reach = list(accumulate((b[2] for b in base), max))  # the furthest end so far
    for m in KEY.finditer(text):
        v, before = m[0], bisect_left(starts, m.end())
        if re.search("[0-9]", v) and re.search("[A-Z]", v) and re.search("[a-z]", v) and not (before and reach[before - 1] > m.start()):
            found.append((m.start(), 3, m.end(), v))
    return found


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def _found(docs: DataFrame, text: str, doc_id: str, owner: str, repository: Column) -> DataFrame:
    names = ["doc_id", "owner", "repository", "rid", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.binary())])
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid = TaskContext.get().partitionId() << 33
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                base = base_spans(t or "")
                n = [sum(s[1] == k for s in base) for k in range(3)]
                spans = sorted(base + key_spans(t or "", base))
                spans = [{"start": a, "kind": k, "end": e, "value": hashlib.blake2b(v.encode(), digest_size=16).digest()} for a, k, e, v in spans]
                rows.append((rid, *n, hashlib.sha256(joined(base).encode()).hexdigest(), spans))
                rid += 1
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *[pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)]], names)

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{owner}`").cast("string").alias("owner"), repository.cast("string").alias("repository"))
    added = T.StructType.fromDDL("rid bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans array<struct<start:bigint,kind:int,end:bigint,value:binary>>")
    return rows.mapInArrow(run, T.StructType([*rows.select("doc_id", "owner", "repository").schema.fields, *added.fields]))


def ownership(spans: DataFrame) -> DataFrame:
    """(value, owners, repositories, often): distinct ones of each value, unknown
    (null) ones counting together as one, and its spans. Pairs are made
    distinct before they are counted."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), c), F.lit("?"))
    of = lambda c, n: spans.select("value", known(F.col(c)).alias("o")).groupBy("value", "o").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias(n), F.sum("n").alias("often"))
    return of("owner", "owners").join(of("repository", "repositories").drop("often"), "value")


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source", repository: Column | None = None) -> DataFrame:
    """For each row: doc_id, rid, counts and digest of the spans of the fixed
    kinds, and ``spans``: (start, kind, end, live) by start and kind, in code
    points.

    ``repository`` is a column of ``docs`` (the owner, if None). A null text
    counts as empty and has no span. Equal rows are documents of their own;
    copies with one owner don't make a value an example. Texts of any length
    are read whole; an empty table gives one; other columns are ignored.
    """
    found = stage(_found(docs, text, doc_id, owner, F.col(f"`{owner}`") if repository is None else repository), "secrets")
    spans = found.where(F.size("spans") > 0).select("rid", "owner", "repository", F.explode("spans").alias("s")).select("rid", "owner", "repository", "s.*")
    examples = stage(ownership(spans).where((F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repositories") >= EXAMPLE_REPOSITORIES)).select("value", "often", F.lit(True).alias("example")), "examples")
    judged = spread_join(spans.drop("owner", "repository"), examples, "value", "often", spans.count(), "left").withColumn("live", F.col("example").isNull())
    judged = judged.where(F.col("live") | (F.col("kind") < KINDS.index("key")))
    judged = judged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("judged"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    plain = ("doc_id", "rid", "n_assign", "n_access", "n_hex", "base_sha256")
    some = found.where(F.size("spans") > 0).join(judged, "rid", "left").select(*plain, F.coalesce("judged", empty).alias("spans"))
    whole = some.unionByName(found.where(F.size("spans") == 0).select(*plain, empty.alias("spans")))
    whole.tables = (found, examples)
    return whole


def render(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", owner: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with each live-looking span replaced by PLACEHOLDER and
    ``n_chars``, where there is such a column, set anew for changed texts.

    Overlapping spans are replaced as one. Values that are copied examples
    stay, and so do null texts and all rows, repeated ones too. A text is known
    by its hash and goes by its own spans; only texts that may have some are
    moved, and none where the live spans are few enough to be broadcast.
    """
    rows = packed(docs, "row").withColumn("digest", F.unhex(F.md5(text_of("row", text).cast("binary"))))
    found = scan_secrets(rows.select("digest", text_of("row", text).alias("text"), F.col(f"row.`{owner}`").alias("owner")), "text", "digest", "owner")
    live = found.select(F.col("doc_id").alias("digest"), F.filter("spans", lambda s: s["live"]).alias("spans")).where(F.size("spans") > 0)
    live = stage(live.groupBy("digest").agg(F.first("spans").alias("spans"), F.count("*").alias("often")), "live")
    discard(*found.tables)
    n = live.agg(F.sum(F.size("spans")).alias("spans"), F.sum("often").alias("rows")).first()
    if (n["spans"] or 0) <= BROADCAST_SPANS:
        both = rows.join(F.broadcast(live.drop("often")), "digest", "left").select("row", "spans")
    else:
        may = F.coalesce(text_of("row", text).rlike(ANY_SPAN), F.lit(False))
        some = spread_join(rows.where(may), live, "digest", "often", n["rows"], "left").select("row", "spans")
        both = some.unionByName(rows.where(~may).select("row", F.lit(None).cast(some.schema["spans"].dataType).alias("spans")))
    t = text_of("row", text)
    # (text so far, end of the last span): what lies between spans is kept.
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        part = F.concat(acc["done"], F.substring(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(PLACEHOLDER))
        return F.struct(F.when(fresh, part).otherwise(acc["done"]).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    cut = F.aggregate("spans", start, step)
    new = F.when(F.col("spans").isNull(), t).otherwise(F.concat(cut["done"], F.substring(t, (cut["at"] + 1).cast("int"), F.length(t))))
    both = both.withColumn("text", new)
    changed = {text: F.col("text")}
    if n_chars in docs.columns:
        changed[n_chars] = F.when(F.col("spans").isNull(), F.col(f"row.`{n_chars}`")).otherwise(F.length("text").cast(docs.schema[n_chars].dataType))
    return unpacked(both.select(F.struct(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]).alias("row")), "row")
