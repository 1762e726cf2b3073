"""Column helpers: tokenisers, name matching, similarity, snippets, paths."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that keyword extraction leaves out, in its two dialects.
STOP_WORDS_LONG = ("a", "an", "the", "is", "are", "was", "were", "be", "to", "of", "in", "on", "at", "by", "for", "with", "from", "as", "this", "that")
STOP_WORDS_SHORT = ("a", "an", "the", "is", "are", "was", "were", "be", "to", "of", "in", "on", "at")


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def quote(literal: str) -> str:
    """A pattern that matches ``literal`` itself, in Java's and RE2's syntax."""
    return re.sub(r"([^\w\s/-])", r"\\\1", literal)


def words_of(text: Column) -> Column:
    """Lower-cased words of two characters and more, repeats kept: query_keywords on a column."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: F.length(w) >= 2)


def query_keywords(query: str) -> list[str]:
    """Lower-cased words of two characters and more, repeats kept."""
    return [w for w in query.lower().split() if len(w) >= 2]


# Fixed values, here and in identifier_tokens: where names are split (a lower-case letter before a capital, the last of some capitals before a small letter, blanks and _ - . / \\).
def query_tokens(query: str, longer_than: int = 2) -> list[str]:
    """The identifier tokens of a request, split as identifier_tokens does."""
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z])([A-Z])", r"\1 \2", query))
    return [t.lower() for t in re.split(r"[\s_\-./\\]+", spaced) if len(t) > longer_than]


def identifier_tokens(text: Column, longer_than: int = 2) -> Column:
    """Tokens of camel-case names, acronyms and paths, lower-cased, repeats kept."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(spaced, r"[\s_\-./\\]+"), lambda t: F.length(t) > longer_than), F.lower)


def keywords(text: Column, stop_words=STOP_WORDS_LONG) -> Column:
    """Distinct alphanumeric words of over two characters that are no stop words."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (F.length(w) > 2) & ~w.isin(*stop_words))
    return F.array_distinct(words)


def overlap(a: Column, b: Column) -> Column:
    """Common members over the larger size; 0 if one is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; equal empties 1, one empty 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(longest, F.lit(1)))


def subsequence_pattern(query: str) -> str:
    return "(?s)" + ".*".join(quote(c) for c in query)


def name_score(name: Column, query: str, fuzzy: float = 0.3) -> Column:
    """Equal 1, contains 0.7, subsequence ``fuzzy``, else null; case-insensitive."""
    q, n = query.lower(), F.lower(name)
    return F.when(n == q, 1.0).when(n.contains(q), 0.7).when(n.rlike(subsequence_pattern(q)), fuzzy)


def glob_name_pattern(glob: str) -> str:
    """Anchored and case-insensitive; only * is special and crosses slashes."""
    return "(?i)^" + ".*".join(quote(p) for p in glob.split("*")) + "$"


def audit_name_pattern(pattern: str) -> str:
    """Unanchored, * for anything, all else as in a regular expression."""
    return pattern.replace("*", ".*")


def audit_glob_pattern(glob: str) -> str:
    """Unanchored; ** crosses directories, * does not."""
    return "[^/]*".join(p for p in quote(glob).replace(r"\*\*", "\0").split(r"\*")).replace("\0", ".*")


def path_glob_pattern(glob: str) -> str:
    """Anchored shell glob of label targets: ** for any path, * within a segment, ? one character."""
    out = quote(glob).replace(r"\*\*/", "\0").replace(r"\*\*", "\1").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return "^" + out.replace("\0", "(?:.*/)?").replace("\1", ".*") + "$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def directory(path: Column) -> Column:
    """The part before the last slash; ``.`` without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def canonical(path: Column) -> Column:
    """Forward slashes, none repeated, no ./ in front and no slash at the end."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")
    return F.regexp_replace(F.regexp_replace(p, r"^\./", ""), "(.)/$", "$1")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def target_type(target: Column) -> Column:
    return F.when(target.contains("$"), "symbol").when(base_name(target).contains("."), "file").otherwise("directory")


def snippet(text: Column, words: list[str], window: int = 80) -> Column:
    """``window`` characters to either side of the middle of the earliest
    keyword, with dots where it is cut; twice the window from the start, if
    none occurs. Of keywords at the same place the first in ``words`` counts."""
    cut_short = F.when(F.length(text) <= 2 * window, text).otherwise(F.concat(F.substring(text, 1, 2 * window), F.lit("...")))
    if not words:
        return cut_short
    at = lambda w: F.instr(F.lower(text), w)
    found = F.filter(F.array(*[F.struct((at(w) - 1).alias("at"), F.lit(i).alias("i"), F.lit(len(w) // 2).alias("half")) for i, w in enumerate(words)]), lambda x: x["at"] >= 0)
    first = F.array_min(found)
    center = first["at"] + first["half"]
    start, stop = F.greatest(center - window, F.lit(0)), F.least(center + window, F.length(text))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, stop - start), F.when(stop < F.length(text), "...").otherwise(""))
    return F.when(F.size(found) == 0, cut_short).otherwise(cut)


def excerpt(text: Column, word: str, before: int = 30, after: int = 100) -> Column:
    at = F.instr(F.lower(text), word.lower())
    first = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.regexp_replace(F.substring(text, first, at + after - first), "\n", " "))


def gentle(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n", "\n")


def aggressive(text: Column) -> Column:
    """Trimmed lines without the blank ones."""
    return F.array_join(F.filter(F.transform(F.split(gentle(text), "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def same_text(a: Column, b: Column) -> Column:
    """Whether texts are equal but for their line ends."""
    return gentle(a) == gentle(b)


def to_fixed(number: Column, places: int = 2) -> Column:
    """The number as text with ``places`` decimals, by its exact binary value; of two that are as near, the one further from zero."""
    x = number.cast("double")
    halves = F.abs(x * float(1 << (places + 1)))
    tie = (halves == F.floor(halves)) & (halves % 2 == 1)
    return F.call_function("format_number", F.when(tie, x + F.signum(x) * 10.0 ** -(places + 2)).otherwise(x), F.lit("0." + "0" * places if places else "0"))


def stamp(ts: Column, seconds: bool = False) -> Column:
    """``YYYYMMDD`` or ``YYYYMMDD-HHMMSS``."""
    return F.date_format(ts, "yyyyMMdd-HHmmss" if seconds else "yyyyMMdd")


def label_id(name: Column, millis: Column) -> Column:
    """``lbl_``, the name in lower case with an underscore for all that is no letter or digit, and the last six digits of a time in milliseconds."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("lbl_"), plain, F.lit("_"), F.lpad((millis % 1_000_000).cast("string"), 6, "0"))


def member_type(path: Column) -> Column:
    """What a group's member is: a symbol by its ``$``, a directory by a slash at the end or a ``*``, else a file."""
    return F.when(path.contains("$"), "symbol").when(path.endswith("/") | path.contains("*"), "directory").otherwise("file")


def member_path(path: Column) -> Column:
    return F.when(path.contains("$"), path).otherwise(F.regexp_replace(path, "/$", ""))


def common_lines(a: Column, b: Column) -> Column:
    """Lines equal at the same place."""
    pairs = F.arrays_zip(F.split(gentle(a), "\n").alias("x"), F.split(gentle(b), "\n").alias("y"))
    return F.size(F.filter(pairs, lambda p: p["x"] == p["y"]))


def inline_diff(a: Column, b: Column) -> Column:
    """Common prefix, {-old-}, {+new+}, common suffix; empty parts are left out."""
    la, lb = F.length(a), F.length(b)
    short = F.least(la, lb)
    ks = F.sequence(F.lit(0), short)
    prefix = F.array_max(F.filter(ks, lambda k: F.substring(a, F.lit(1), k) == F.substring(b, F.lit(1), k)))
    suffix = F.array_max(F.filter(ks, lambda k: (k <= short - prefix) & (F.substring(a, la - k + 1, k) == F.substring(b, lb - k + 1, k))))
    old, new = F.substring(a, prefix + 1, la - prefix - suffix), F.substring(b, prefix + 1, lb - prefix - suffix)
    part = lambda x, s: F.when(x != "", F.concat(F.lit("{" + s), x, F.lit(s + "}"))).otherwise("")
    return F.concat(F.substring(a, F.lit(1), prefix), part(old, "-"), part(new, "+"), F.substring(a, la - suffix + 1, suffix))


def indent(text: Column, spaces: int) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(x == "", x).otherwise(F.concat(F.lit(" " * spaces), x))), "\n")


def duration(seconds: Column) -> Column:
    """``45s``, ``3m 20s`` or ``2h 5m``."""
    s = seconds.cast("bigint")
    whole = lambda d: F.floor(s / d).cast("bigint")
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(whole(60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(whole(3600).cast("string"), F.lit("h "), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))
