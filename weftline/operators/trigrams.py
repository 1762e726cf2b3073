"""An inverted index of trigrams, so that searches read the texts of candidates only.

The index is a table (gram, path), sorted by gram when it is saved. A substring, glob
or regular expression becomes an and/or of trigrams that each match must have;
one aggregation of the grams' rows finds the candidates, and the search itself runs on those.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Candidates whose paths are part of the filter on the scan; more are joined.
FEW_PATHS = 1000


@dataclass(frozen=True)
class Plan:
    """``kind`` is all, any or gram; ``all`` of nothing holds for every text, ``any`` of nothing for none."""

    kind: str
    parts: tuple = ()
    gram: str = ""

    def grams(self) -> set[str]:
        return {self.gram} if self.kind == "gram" else {g for p in self.parts for g in p.grams()}

    def holds(self, has) -> Column | bool:
        """The plan over ``has(gram)``."""
        if self.kind == "gram":
            return has(self.gram)
        parts = [p.holds(has) for p in self.parts]
        return reduce((lambda a, b: a & b) if self.kind == "all" else (lambda a, b: a | b), parts, self.kind == "all") if parts else self.kind == "all"

    @property
    def everything(self) -> bool:
        return self.kind == "all" and not self.parts


EVERY = Plan("all")


def every_of(parts) -> Plan:
    kept = tuple(dict.fromkeys(p for p in parts if not p.everything))
    return kept[0] if len(kept) == 1 else Plan("all", kept)


def any_of(parts) -> Plan:
    kept = tuple(dict.fromkeys(parts))
    return EVERY if any(p.everything for p in kept) else kept[0] if len(kept) == 1 else Plan("any", kept)


def of_literal(text: str) -> Plan:
    """The trigrams of a substring, in small letters. Others than ASCII characters part it, as their case is told in more than one way."""
    runs = re.findall(r"[\x01-\x7f]+", text.lower())
    return every_of(Plan("gram", gram=r[i : i + 3]) for r in runs for i in range(len(r) - 2))


def of_glob(glob: str) -> Plan:
    """What lies between a glob's wildcards and classes."""
    return every_of(of_literal(x) for x in re.split(r"[*?]+|\[[^\]]*\]|\{[^}]*\}", glob))


def of_regex(pattern: str) -> Plan:
    """The literals that each match has, alternatives apart; a pattern that can't be read makes every text a candidate."""
    try:
        tree = re._parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return EVERY
    return _of_tree(tree)


def _of_tree(tree) -> Plan:
    parts, run = [], ""

    def ended():
        nonlocal run
        parts.append(of_literal(run))
        run = ""

    for op, value in tree:
        name = str(op)
        if name == "LITERAL":
            run += chr(value)
            continue
        if name == "SUBPATTERN" and value[-1] is not None:
            inner = list(value[-1])
            if all(str(o) == "LITERAL" for o, _ in inner):
                run += "".join(chr(v) for _, v in inner)
                continue
        ended()
        if name == "BRANCH":
            parts.append(any_of(_of_tree(b) for b in value[1]))
        elif name == "SUBPATTERN":
            parts.append(_of_tree(value[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            parts.append(_of_tree(value[2]))
        elif name == "ATOMIC_GROUP":
            parts.append(_of_tree(value))
    ended()
    return every_of(parts)


def grams_of(text: Column) -> Column:
    """The distinct trigrams of a text in small letters, of ASCII characters only."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?=([\x01-\x7f]{3}))"), F.lit(1)))


def build(files: DataFrame, *columns: str) -> DataFrame:
    """(gram, path) of the given columns of files, together as one text with line feeds between them."""
    text = F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in columns or ("content",)])
    return files.select("path", F.explode(grams_of(text)).alias("gram")).select("gram", "path")


def updated(index: DataFrame, written: DataFrame, gone: DataFrame, *columns: str) -> DataFrame:
    """The index after ``written`` (path and the columns) came new or changed and ``gone`` (path) went."""
    touched = written.select("path").unionByName(gone.select("path")).distinct()
    return index.join(touched, "path", "left_anti").select("gram", "path").unionByName(build(written, *columns))


def save(index: DataFrame, path: str) -> None:
    """Sorted by gram, so that a filter on grams reads the parts of files that may have them."""
    index.repartitionByRange("gram", "path").sortWithinPartitions("gram", "path").write.mode("overwrite").parquet(path)


def candidates(index: DataFrame, plan: Plan) -> DataFrame:
    """The paths of texts that may match; the plan must need some gram."""
    grams = sorted(plan.grams())
    named = {g: f"g{k}" for k, g in enumerate(grams)}
    has = index.where(F.col("gram").isin(grams)).groupBy("path").agg(*[F.max(F.col("gram") == g).alias(n) for g, n in named.items()])
    holds = plan.holds(lambda g: F.col(named[g]))
    return has.where(holds).select("path")


def narrowed(files: DataFrame, index: DataFrame, plan: Plan) -> DataFrame:
    """``files`` that are candidates; all where the plan needs no gram.

    Up to FEW_PATHS of them go into the scan's filter by name, more are joined.
    """
    if plan.everything:
        return files
    found = candidates(index, plan)
    few = [r["path"] for r in found.limit(FEW_PATHS + 1).collect()]
    if len(few) > FEW_PATHS:
        return files.join(found, "path", "left_semi")
    return files.where(F.col("path").isin(few)) if few else files.where(F.lit(False))


def of_search(query: str, use_regex: bool = False) -> Plan:
    """What ``search.text_search`` needs of path or summary: the pattern, or any of the words."""
    return of_regex(query) if use_regex else any_of(of_literal(w) for w in T.query_keywords(query))
