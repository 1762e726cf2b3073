"""Views of one file or of the whole graph: peek, enriched reading, orientation, changes of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import graph, sessions, stores


def file_row(files: DataFrame, path: str) -> DataFrame:
    """The row of one file, or none; a filter on the key, which the source prunes by."""
    return files.where(F.col("path") == path)


def find_symbols(symbols: DataFrame, condition, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Symbols where a condition holds, in the order of files and lines."""
    found = symbols.where(condition)
    found = found if name is None else found.where(F.col("name") == name)
    found = found if kind is None else found.where(F.col("kind") == kind)
    return found.orderBy("path", "ord")


def first_symbol(symbols: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    return find_symbols(symbols, F.lit(True), name, kind).limit(1)


def _listed(df: DataFrame, value, into: str, on: str = "path", order=None) -> DataFrame:
    """(on, into): the values of each key in order, gathered before any join."""
    entry = F.struct((order if order is not None else value).alias("o"), value.alias("v"))
    return df.groupBy(on).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["v"]).alias(into))


def _values(row: DataFrame, lists: list[DataFrame]) -> DataFrame:
    for l in lists:
        into = l.columns[-1]
        row = row.join(l, "path", "left").withColumn(into, F.coalesce(into, F.array().cast(l.schema[into].dataType)))
    return row


def peek(files: DataFrame, path: str, edges: DataFrame, symbols: DataFrame, calls: DataFrame, groups: DataFrame | None = None, members: DataFrame | None = None, notations: DataFrame | None = None,
         labels: DataFrame | None = None, assignments: DataFrame | None = None, elements: DataFrame | None = None, annotations: DataFrame | None = None, categorised: DataFrame | None = None,
         domains: DataFrame | None = None, content: bool = False) -> DataFrame:
    """One row on a file, or none: its columns, imports and importers (paths),
    symbols with the calls and callers of each, and, of the tables that are
    given, groups with their numbers of members and notations, labels,
    elements, both kinds of annotations and the domain, its numbers of lines
    and characters and, with ``content``, its text. Each list is of this file's rows alone.
    """
    own = file_row(files, path)
    row = own.withColumns({"n_lines": F.size(F.split("content", "\n")), "n_chars": F.length("content")})
    row = row if content else row.drop("content")
    at = lambda df, c="path": df.where(F.col(c) == path)
    here = lambda df: df.withColumn("path", F.lit(path))
    lists = [
        _listed(here(graph.imports(edges, files, path).withColumnRenamed("path", "other")), F.col("other"), "imports"),
        _listed(here(graph.importers(edges, files, path).withColumnRenamed("path", "other")), F.col("other"), "importers"),
    ]
    ref = lambda p, s: F.concat_ws("$", p, s)
    out = _listed(at(calls, "src_path").select(F.col("src_sym").alias("name"), ref("dst_path", "dst_sym").alias("ref")).distinct(), F.col("ref"), "calls", "name")
    back = _listed(at(calls, "dst_path").select(F.col("dst_sym").alias("name"), ref("src_path", "src_sym").alias("ref")).distinct(), F.col("ref"), "called_by", "name")
    with_calls = at(symbols).join(out, "name", "left").join(back, "name", "left")
    none = F.array().cast("array<string>")
    symbol = F.struct("name", "kind", "start_line", "end_line", "exported", F.coalesce("calls", none).alias("calls"), F.coalesce("called_by", none).alias("called_by"))
    lists.append(_listed(with_calls, symbol, "symbols", order=F.col("ord")))
    if groups is not None and members is not None:
        lists.append(_listed(here(_groups_of(groups, members, notations, path)), F.struct("name", "description", "n_members", "n_notations"), "groups"))
    if labels is not None and assignments is not None:
        lists.append(_listed(here(stores.labels_of(assignments, labels, path)), F.struct("id", "name"), "labels"))
    if elements is not None:
        lists.append(_listed(at(elements), F.struct("name", "tag"), "elements", order=F.col("ord")))
    if annotations is not None:
        lists.append(_listed(at(annotations), F.struct("line", "type", "message"), "annotations", order=F.struct("line", "type", "message")))
    if categorised is not None:
        lists.append(_listed(at(categorised), F.struct("line", "category", "ann_path", "value"), "categorised", order=F.struct("line", "category", "ann_path", "value")))
    row = _values(row, lists)
    if domains is not None:
        row = row.join(at(domains).select("path", F.struct("name", "relevance", "message", "searchable").alias("domain")), "path", "left")
    return row


def _groups_of(groups: DataFrame, members: DataFrame, notations: DataFrame | None, path: str) -> DataFrame:
    """(name, description, n_members, n_notations) of the groups with this file."""
    mine = members.where((F.col("member_type") == "file") & (F.col("path") == path)).select("name").distinct()
    count = lambda df, n: df.join(mine, "name", "left_semi").groupBy("name").agg(F.count("*").alias(n))
    found = groups.join(mine, "name", "left_semi").join(count(members, "n_members"), "name")
    found = found.join(count(notations, "n_notations"), "name", "left") if notations is not None else found.withColumn("n_notations", F.lit(None).cast("bigint"))
    return found.select("name", "description", "n_members", F.coalesce("n_notations", F.lit(0).cast("bigint")).alias("n_notations"))


def read_enriched(files: DataFrame, path: str, content, edges: DataFrame, groups: DataFrame, members: DataFrame, notations: DataFrame, labels: DataFrame, assignments: DataFrame, shown: tuple[str, ...] = ()) -> DataFrame:
    """One row: path, ``content`` (an expression on the file's text), the names of
    its labels, how many files import it, and its groups, each with the
    notations on this file or on none; of groups in ``shown``, which the reader
    has seen before, only the numbers are given.
    """
    row = file_row(files, path).select("path", content.alias("content"))
    found = _groups_of(groups, members, notations, path)
    texts = notations.where(F.col("file").isNull() | (F.col("file") == path)).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("n"))
    seen = F.col("name").isin(*shown) if shown else F.lit(False)
    whole = found.join(texts, "name", "left").withColumn("path", F.lit(path))
    said = F.transform(F.coalesce("n", F.array().cast("array<struct<ord:int,text:string>>")), lambda x: x["text"])
    group = F.struct("name", F.when(~seen, F.col("description")).alias("description"), "n_members", "n_notations", F.when(~seen, said).alias("notations"))
    row = _values(row, [_listed(whole, group, "groups", order=F.col("name")), _listed(stores.labels_of(assignments, labels, path).withColumn("path", F.lit(path)), F.col("name"), "labels")])
    importers = graph.importers(edges, files, path).agg(F.count("*").alias("dependents"))  # one row
    return row.crossJoin(importers)


def counts_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each count of two rows of ``graph.stats``: name, before, after, change."""
    rows = lambda df, n: df.unpivot([], df.columns, "name", n)
    return rows(before, "before").join(rows(after, "after"), "name").withColumn("change", F.col("after") - F.col("before"))


def orient(stats: DataFrame, labels: DataFrame, assignments: DataFrame, help_topics: DataFrame, items: DataFrame, log: DataFrame, contributions: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(part, ord, text) of a report to start work with: the counts, the labels
    with their assignments, the first help topics by name, the checklist for the
    start by priority, what plugins contribute (text, priority; the highest
    first), and the last session's changes."""
    parts = [stats.unpivot([], stats.columns, "k", "n").select(F.lit("counts").alias("part"), F.col("k").alias("by"), F.concat_ws(": ", "k", F.col("n").cast("string")).alias("text"))]
    totals = labels.agg(F.count("*").alias("l")).crossJoin(assignments.agg(F.count("*").alias("a")))  # one row
    parts.append(totals.select(F.lit("labels"), F.lit(""), F.concat(F.col("l").cast("string"), F.lit(" labels, "), F.col("a").cast("string"), F.lit(" assignments"))))
    parts.append(help_topics.orderBy("name").limit(most).select(F.lit("help"), "name", "name"))
    order = sessions.by_priority(items)[0]
    parts.append(items.where(F.col("trigger") == "session:start").select(F.lit("checklist"), F.concat_ws(" ", order.cast("string"), F.lpad("item_id", 12, "0")), "text"))
    if contributions is not None:
        parts.append(contributions.select(F.lit("plugins"), F.lpad((1_000_000 - F.col("priority")).cast("string"), 12, "0"), "text"))
    last = sessions.last_session(log)
    n = lambda c: F.size(c).cast("string")
    parts.append(last.select(F.lit("last session"), F.lit(""), F.concat(F.col("session_id"), F.lit(": "), n("created"), F.lit(" created, "), n("updated"), F.lit(" updated, "), n("deleted"), F.lit(" deleted"))))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.select("part", F.row_number().over(Window.partitionBy("part").orderBy("by", "text")).alias("ord"), "text")


def help_topics(topics: DataFrame, id_: str | None = None, source: str | None = None, tag: str | None = None) -> DataFrame:
    """Topics (id, source, tags) by any of these, sorted by id; tools by category and tag too, where ``source`` is their category."""
    found = topics if id_ is None else topics.where(F.col("id") == id_)
    found = found if source is None else found.where(F.col("source") == source)
    found = found if tag is None else found.where(F.array_contains("tags", tag))
    return found.orderBy("id")


def sample_symbols(calls: DataFrame, most: int = 10) -> DataFrame:
    """The first names of the call graph."""
    return graph.symbol_edges(calls).select(F.explode(F.array("src", "dst")).alias("ref")).distinct().orderBy("ref").limit(most)


def similar_names(files: DataFrame, path: str, most: int = 20) -> DataFrame:
    """(path, shared): files whose base name has tokens of this one's, by their number."""
    own = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    words = sorted(set(T.query_tokens(own)))
    stem = F.regexp_replace(T.base_name(F.col("path")), r"\.[^.]*$", "")
    shared = F.size(F.array_intersect(F.array_distinct(T.identifier_tokens(stem)), F.array(*map(F.lit, words)))) if words else F.lit(0)
    return files.where(F.col("path") != path).select("path", shared.alias("shared")).where("shared > 0").orderBy(F.desc("shared"), "path").limit(most)
