"""Search over groups, help topics, annotations, routines and symbols, and the composed search for a goal."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import rank
from .search import match_count, valid_pattern

# The categories in their order, each with its fields and their weights; a field of many texts counts their sum.
WEIGHTS = {
    "groups": {"name": 2.0, "description": 1.0, "notations": 0.8},
    "routines": {"name": 2.0, "description": 1.0, "message": 0.8, "checklist": 0.6},
    "symbols": {"name": 2.0, "kind": 0.5},
    "help": {"name": 2.0, "content": 1.0},
    "annotations": {"text": 1.5, "type": 1.0},
}
#: Fields that only the scored search reads.
SCORED_ONLY = {"symbols": ("kind",)}
#: The field that an excerpt is taken from.
EXCERPT = {"help": "content"}
MOST = 3


@dataclass(frozen=True)
class CategoryRequest:
    """``scored``: by tokens and weights; else the first rows in which a field holds the query."""

    query: str
    scored: bool = True
    most: int = MOST
    use_regex: bool = False
    case_sensitive: bool = False


def parse_categories(text: str | None) -> list[str]:
    """Names of a comma-separated list that are categories; ``files`` alone if there is none, all of them for ``all``."""
    if not text or text == "files":
        return ["files"]
    every = ["files", *WEIGHTS]
    wanted = every if text == "all" else [w.strip() for w in text.lower().split(",")]
    return [c for c in every if c in wanted]


def _texts(column: str, kind: str) -> Column:
    """The texts of a field, one or many, as an array."""
    c = F.col(f"`{column}`")
    return F.coalesce(c if kind.startswith("array") else F.array(F.coalesce(c, F.lit(""))), F.array().cast("array<string>"))


def _score(texts: Column, tokens: list[str]) -> Column:
    return F.aggregate(F.transform(texts, lambda x: match_count(T.identifier_tokens(F.coalesce(x, F.lit("")), 1), tokens)), F.lit(0.0), lambda a, x: a + x)


def _hit(texts: Column, r: CategoryRequest) -> Column:
    if r.use_regex:
        if not valid_pattern(r.query):
            return F.lit(False)
        pattern = r.query if r.case_sensitive else "(?i)" + r.query
        return F.exists(texts, lambda x: x.isNotNull() & (x != "") & x.rlike(pattern))
    return F.exists(texts, lambda x: x.isNotNull() & (x != "") & (x.contains(r.query) if r.case_sensitive else F.lower(x).contains(r.query.lower())))


def search_category(rows: DataFrame, category: str, r: CategoryRequest, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """category, rank, id, score (to two places; null if unscored), matched_in and excerpt of the best rows.

    ``rows``: a unique ``id``, what ``order`` names and the fields of the
    category; a field may be an array of texts. Ties go by ``order``. Only the
    best rows are sorted.
    """
    kinds = dict(rows.dtypes)
    weights = {f: w for f, w in WEIGHTS[category].items() if f in kinds}
    if r.scored:
        tokens = T.query_tokens(r.query, 1)
        scores = {f: _score(_texts(f, kinds[f]), tokens) for f in weights}
        hits = {f: s > 0 for f, s in scores.items()}
        total = reduce(lambda a, b: a + b, [scores[f] * w for f, w in weights.items()])
    else:
        hits = {f: _hit(_texts(f, kinds[f]), r) for f in weights if f not in SCORED_ONLY.get(category, ())}
        total = F.lit(None).cast("double")
    matched = F.array_compact(F.array(*[F.when(h, F.lit(f)) for f, h in hits.items()]))
    field = EXCERPT.get(category)
    excerpt = T.excerpt(F.col(field), r.query) if field in kinds else F.lit(None).cast("string")
    found = rows.select(F.lit(category).alias("category"), F.col("id").cast("string").alias("id"), *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(order)], total.alias("score"), matched.alias("matched_in"), excerpt.alias("excerpt"))
    by = [*([F.desc("score")] if r.scored else []), *[f"__{i}" for i in range(len(order))]]
    best = found.where("score > 0" if r.scored else F.size("matched_in") > 0).orderBy(*by).limit(r.most)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*by)))  # of at most ``most`` rows
    return ranked.select("category", "rank", "id", T.to_fixed(F.col("score")).cast("double").alias("score"), "matched_in", "excerpt")


def search_categories(tables: dict[str, DataFrame], categories: list[str], r: CategoryRequest) -> DataFrame:
    """The rows of search_category for each of ``categories`` that has a table."""
    chosen = [search_category(tables[c], c, r) for c in WEIGHTS if c in categories and c in tables]
    if not chosen:
        raise ValueError("no category to search")
    return reduce(DataFrame.unionByName, chosen)


def insights(results: DataFrame) -> DataFrame:
    """category, n, best, strong and a line on each category that search_categories found something in."""
    return rank.insights(results.groupBy("category").agg(F.count("*").alias("n"), F.max("score").alias("best")))


def find_for_goal(files: DataFrame, goal: str, symbols: DataFrame, annotations: DataFrame | None = None, categorised: DataFrame | None = None, page: int = 1, size: int = 10, tables: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """One page of files by relevance (rank, path, score to two places, summary and
    total, the number of all files), and what the categories' tables hold on the goal."""
    scored = rank.relevance(files, goal, symbols, annotations, categorised)
    best = rank.page(scored.select("path", "score"), [F.desc("score"), "path"], page, size)
    total = files.agg(F.count("*").alias("total"))  # one row
    out = best.join(files.select("path", "summary"), "path", "left").crossJoin(total).select("rank", "path", T.to_fixed(F.col("score")).cast("double").alias("score"), F.coalesce("summary", F.lit("")).alias("summary"), "total")
    return out, search_categories(tables, list(WEIGHTS), CategoryRequest(goal)) if tables else None
