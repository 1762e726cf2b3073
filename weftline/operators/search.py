"""Keyword, symbol, hybrid and content search over the code graph's tables.

``files``: path, content, summary; ``symbols``: path, ord, name, kind,
start_line, end_line, exported. Each operator returns a lazy DataFrame.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import with_symbol


def valid_pattern(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def text_search(files: DataFrame, query: str, use_regex: bool = False) -> DataFrame:
    """path and relevance: keywords in the path count 1, those in the summary alone 0.6, over the number of keywords."""
    if use_regex:
        hit = F.col("path").rlike("(?i)" + query) if valid_pattern(query) else F.lit(False)
        return files.where(hit).select("path", F.lit(1.0).alias("relevance"))
    words = T.query_keywords(query)
    if not words:
        return files.where(F.lit(False)).select("path", F.lit(0.0).alias("relevance"))
    path, summary = F.lower("path"), F.lower(F.coalesce("summary", F.lit("")))
    hits = [F.when(path.contains(w), 1.0).when(summary.contains(w), 0.6).otherwise(0.0) for w in words]
    score = reduce(lambda a, b: a + b, hits) / len(words)
    return files.select("path", score.alias("relevance")).where("relevance > 0")


def symbol_search(symbols: DataFrame, query: str, kinds: list[str] | None = None, use_regex: bool = False) -> DataFrame:
    """path, relevance (mean over the matched symbols) and matched (names in order)."""
    if kinds:
        symbols = symbols.where(F.col("kind").isin(kinds))
    if use_regex:
        score = F.when(F.col("name").rlike("(?i)" + query), 1.0) if valid_pattern(query) else F.lit(None).cast("double")
    else:
        score = T.name_score(F.col("name"), query)
    found = symbols.select("path", "ord", "name", "kind", score.alias("score")).where("score is not null")
    matched = F.transform(F.sort_array(F.collect_list(F.struct("ord", "name", "kind"))), lambda s: F.struct(s["name"], s["kind"]))
    return found.groupBy("path").agg(F.avg("score").alias("relevance"), matched.alias("matched"))


def merge_hits(text: DataFrame, symbols: DataFrame) -> DataFrame:
    """The better hit of each path; the text hit where they tie."""
    none = F.lit(None).cast("array<struct<name:string,kind:string>>")
    both = text.select("path", "relevance", none.alias("matched"), F.lit(1).alias("first")).unionByName(symbols.select("path", "relevance", "matched", F.lit(0).alias("first")))
    best = F.max_by(F.struct("relevance", "matched"), F.struct("relevance", "first"))
    return both.groupBy("path").agg(best.alias("b")).select("path", "b.relevance", "b.matched")


@dataclass(frozen=True)
class SearchRequest:
    query: str
    mode: str = "hybrid"
    max_results: int = 5
    max_symbols_per_file: int = 5
    include_full: bool = False
    use_regex: bool = False
    extensions: tuple[str, ...] = ()
    path_prefix: str = ""
    symbol_kinds: tuple[str, ...] = ()
    page: int = 1
    hooks: tuple = field(default=())


def compact_symbols(matched: Column, most: int) -> Column:
    """``name (kind), ...`` of the first ``most``, and how many more there are."""
    shown = F.transform(F.slice(matched, 1, most), lambda s: F.concat(s["name"], F.lit(" ("), s["kind"], F.lit(")")))
    more = F.size(matched) - most
    return F.array_join(F.when(more > 0, F.concat(shown, F.array(F.concat(F.lit("+"), more.cast("string"), F.lit(" more"))))).otherwise(shown), ", ")


def _page_with_total(hits: DataFrame, after: int, last: int) -> DataFrame:
    """Rows ``after`` + 1 to ``last`` by relevance with rank and total: each task keeps
    its best ``last`` rows, and what is counted never leaves a task."""
    order = (F.desc("relevance"), F.col("path"))
    page = hits.orderBy(*order).limit(last)
    page = page.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > after)
    return page.crossJoin(F.broadcast(hits.agg(F.count("*").alias("total"))))


def search(files: DataFrame, symbols: DataFrame, request: SearchRequest, members: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """The whole search: rank, path, relevance, total, symbols, snippet, and the
    names of groups and labels of the file where those tables are given.

    ``members``: name, path (``file`` or ``file$symbol``); ``labels``: target, label.
    """
    r = request
    text = text_search(files, r.query, r.use_regex) if r.mode != "symbol" else None
    found = symbol_search(symbols, r.query, list(r.symbol_kinds), r.use_regex) if r.mode != "text" else None
    if text is not None and found is not None:
        hits = merge_hits(text, found)
    else:
        hits = found if found is not None else text.withColumn("matched", F.lit(None).cast("array<struct<name:string,kind:string>>"))
    if r.extensions:
        hits = hits.where(T.any_of([F.col("path").endswith(e) for e in r.extensions]))
    if r.path_prefix:
        hits = hits.where(F.col("path").startswith(r.path_prefix))
    size = 9999 if r.include_full else r.max_results
    ranked = _page_with_total(hits, size * (r.page - 1), size * r.page)
    out = ranked.join(files.select("path", "summary"), "path", "left").select(
        "rank", "path", F.col("relevance"), "total",
        F.coalesce(compact_symbols(F.col("matched"), r.max_symbols_per_file), F.lit("")).alias("symbols"),
        T.snippet(F.coalesce("summary", F.lit("")), T.query_keywords(r.query)).alias("snippet"),
    )
    if members is not None:
        out = hits_with_groups(out, members)
    if labels is not None:
        out = hits_with_labels(out, labels)
    return reduce(lambda df, f: df.transform(f), r.hooks, out)


def _named(hits: DataFrame, names: DataFrame, into: str) -> DataFrame:
    joined = names.join(hits.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias(into))
    return hits.join(joined, "path", "left").withColumn(into, F.coalesce(into, F.lit("")))


def hits_with_groups(hits: DataFrame, members: DataFrame) -> DataFrame:
    return _named(hits, members.select(F.substring_index("path", "$", 1).alias("path"), "name"), "groups")


def hits_with_group_details(hits: DataFrame, members: DataFrame, groups: DataFrame, notations: DataFrame) -> DataFrame:
    """``hits`` with ``groups``: name, description and first notation of each group of the file or of a symbol of it, by name.

    ``members``: name, path (``file`` or ``file$symbol``); ``groups``: name, description; ``notations``: name, ord, text. A
    group without a notation has its description in its place.
    """
    first = notations.groupBy("name").agg(F.min_by("text", "ord").alias("text"))
    known = groups.join(first, "name", "left").select("name", "description", F.coalesce("text", "description").alias("first_notation"))
    own = members.select(F.substring_index("path", "$", 1).alias("path"), "name").distinct().join(hits.select("path").distinct(), "path", "left_semi")
    told = own.join(known, "name").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("name", "description", "first_notation"))).alias("groups"))
    return hits.join(told, "path", "left")


def hits_with_labels(hits: DataFrame, labels: DataFrame) -> DataFrame:
    return _named(hits, labels.select(F.col("target").alias("path"), F.col("label").alias("name")), "labels")


def find_by_name(files: DataFrame, glob: str) -> DataFrame:
    return files.where(F.col("path").rlike(T.glob_name_pattern(glob))).select("path")


def search_elements(elements: DataFrame, query: str, tag: str | None = None, has_id: bool | None = None, most: int = 5) -> DataFrame:
    """Elements whose name or tag contains the query, in scan order."""
    q = query.lower()
    found = elements.where(F.lower("name").contains(q) | F.lower("tag").contains(q))
    if tag is not None:
        found = found.where(F.col("tag") == tag)
    if has_id is not None:
        found = found.where(F.col("has_id") == has_id)
    return found.orderBy("path", "ord").limit(most)


def lines_of(files: DataFrame) -> DataFrame:
    """(path, line_no from 1, line); a trailing newline leaves an empty last line."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("k", "line")).select("path", (F.col("k") + 1).alias("line_no"), "line")


def match_lines(files: DataFrame, query: str, use_regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """The first match of each line: path, line_no, column (from 1), line, before and after.

    The neighbours of a line come from the file's own array of lines, so no
    window or shuffle is needed.
    """
    if use_regex and not valid_pattern(query):
        files = files.where(F.lit(False))
    lines = files.select("path", F.split("content", "\n").alias("all")).select("path", "all", F.posexplode("all").alias("k", "line"))
    if use_regex:
        at = F.regexp_instr("line", F.lit(query if case_sensitive else "(?i)" + query))
    else:
        at = F.instr("line", query) if case_sensitive else F.instr(F.lower("line"), query.lower())
    near = lambda d: F.get("all", F.col("k") + d)
    found = lines.select("path", (F.col("k") + 1).alias("line_no"), at.alias("column"), "line", near(-1).alias("before"), near(1).alias("after"))
    return found.where(F.col("column") > 0)


def symbol_context(matches: DataFrame, symbols: DataFrame) -> DataFrame:
    """Adds the first symbol whose lines hold the match, null if none does."""
    return with_symbol(matches, symbols)


def content_search(files: DataFrame, symbols: DataFrame, query: str, scores: DataFrame | None = None, scope: str = "", kind: str = "", use_regex: bool = False, case_sensitive: bool = False, page: int = 1, size: int = 5) -> DataFrame:
    """One page of matching lines, files of the best score first, then by line.

    ``scores``: path, score, from the relevance operator; equal scores without.
    ``scope``: a part of the path, or ``part$symbol`` for the lines of each
    file's first symbol of that name.
    """
    inside = scope.partition("$")
    if inside[0]:
        files = files.where(F.lower("path").contains(inside[0].lower()))
    if kind:
        files = files.join(symbols.where(F.col("kind") == kind).select("path"), "path", "left_semi")
    found = match_lines(files, query, use_regex, case_sensitive)
    if inside[2]:
        own = symbols.where(F.col("name") == inside[2]).groupBy("path").agg(F.min_by(F.struct("start_line", "end_line"), "ord").alias("__at"))
        found = found.join(own, "path").where(F.col("line_no").between(F.col("__at.start_line"), F.col("__at.end_line"))).drop("__at")
    if scores is not None:
        found = found.join(scores.select("path", "score"), "path", "left")
    found = found.withColumn("score", F.coalesce("score", F.lit(0.0)) if scores is not None else F.lit(0.0))
    order = (F.desc("score"), F.col("line_no"), F.col("path"))
    top = found.orderBy(*order).limit(size * page)
    top = top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") > size * (page - 1))
    return symbol_context(top, symbols)


def keyword_hits(files: DataFrame, symbols: DataFrame, query: str) -> DataFrame:
    """Exact keyword equality: 5 for each in the path, 3 for each in a symbol's name."""
    words = F.array_distinct(T.keywords(F.lit(query)))
    path = files.select("path", (5.0 * F.size(F.array_intersect(T.keywords(F.col("path")), words))).alias("score"))
    names = symbols.select("path", (3.0 * F.size(F.array_intersect(T.keywords(F.col("name")), words))).alias("score"))
    both = path.unionByName(names.join(files.select("path"), "path", "left_semi"))
    return both.groupBy("path").agg(F.sum("score").alias("score")).where("score > 0")


#: What a symbol's kind adds.
KIND_BOOST = {"function": 3.0, "class": 3.0, "interface": 2.0, "type": 2.0, "const": 1.0, "let": 1.0, "var": 1.0}


def symbol_hits(symbols: DataFrame, query: str, kinds: list[str] | None = None) -> DataFrame:
    if kinds:
        symbols = symbols.where(F.col("kind").isin(kinds))
    boost = F.create_map(*[F.lit(x) for kv in KIND_BOOST.items() for x in kv])
    score = 10 * T.name_score(F.col("name"), query, 0.4) + F.coalesce(F.element_at(boost, F.lower("kind")), F.lit(0.0))
    return symbols.select("path", score.alias("s")).where("s is not null").groupBy("path").agg(F.sum("s").alias("score"), F.count("*").alias("n_symbols"))


def match_count(tokens: Column, query: list[str]) -> Column:
    """Sum over the query's tokens that occur of 1 + 0.2 * (occurrences - 1)."""
    def one(t):
        n = F.size(F.filter(tokens, lambda x: x == t))
        return F.when(n > 0, 1 + 0.2 * (n - 1)).otherwise(0.0)

    return reduce(lambda a, b: a + b, [one(t) for t in query], F.lit(0.0))
