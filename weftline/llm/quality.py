"""Quality rules: a threshold table compiled into one projection.

Everything here is a DataFrame expression; no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, text_of, unpacked

# The separators between words, the counted symbols.
SEPARATORS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "which", "with", "you",
    "auf", "das", "den", "der", "des", "die", "ein", "eine", "für", "im", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "avec", "ce", "dans", "de", "du", "elle", "est", "et", "il", "la", "le", "les", "pas", "pour", "que", "qui", "sur", "un", "une",
    "con", "el", "en", "es", "las", "lo", "los", "no", "para", "por", "se", "su",
)


@dataclass(frozen=True)
class Rule:
    """Rejects a document if ``metric`` lies outside [low, high].

    ``from_words``: the rule holds only for documents of so many words at
    least, since ratios of short texts say little.
    """

    name: str
    metric: str
    low: float = float("-inf")
    high: float = float("inf")
    from_words: int = 0


#: metric: its value from the columns of ``features``. All are doubles.
METRICS = {
    "words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / cast(greatest(n_words, 1) as double)",
    "symbols_per_word": "n_symbols / cast(greatest(n_words, 1) as double)",
    "stop_word_share": "n_stop_words / cast(greatest(n_words, 1) as double)",
    "dup_line_share": "n_dup_lines / cast(greatest(n_lines, 1) as double)",
}

RULES = (
    Rule("mean word length", "mean_word_chars", 1.5, 20.0, 10),
    Rule("symbols", "symbols_per_word", high=0.5),
    Rule("no stop words", "stop_word_share", low=0.02, from_words=40),
    Rule("few stop words", "stop_word_share", low=0.06, from_words=100),
    Rule("repeated lines", "dup_line_share", high=0.5),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS), "")


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words inside 5-word windows that a text has twice.

    Windows are 64-bit hashes. Only if a text has fewer distinct ones than
    windows are they sorted with their places, so that equal ones meet; the
    covered words are then summed over the places in order.
    """
    n = F.size("__words")
    word = lambda i, k: F.element_at("__words", i + F.lit(k))
    df = df.withColumn(
        "__windows",
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(*[word(i, k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>")),
    )
    twice = F.size(F.array_distinct("__windows")) < F.size("__windows")
    places = F.sequence(F.lit(1), F.size("__windows"))
    df = df.withColumn("__sorted", F.when(twice, F.sort_array(F.arrays_zip(F.col("__windows").alias("h"), places.alias("i")))))
    none = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("int").alias("i"))
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    shifted = lambda d: F.concat(F.array(none), F.expr("slice(__sorted, 1, size(__sorted) - 1)")) if d < 0 else F.concat(F.expr("slice(__sorted, 2, size(__sorted) - 1)"), F.array(none))
    df = df.withColumn("__pairs", F.when(F.col("__sorted").isNotNull(), F.arrays_zip(F.col("__sorted").alias("x"), shifted(-1).alias("p"), shifted(1).alias("q"))))
    df = df.withColumn("__places", F.sort_array(F.transform(F.filter("__pairs", lambda z: same(z["x"], z["p"]) | same(z["x"], z["q"])), lambda z: z["x"]["i"])))
    covered = F.aggregate(
        "__places",
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))


FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")


def _features(df: DataFrame, text: Column) -> DataFrame:
    text = F.coalesce(text, F.lit(""))
    df = df.withColumn("__words", _words(text))
    df = df.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    df = _repeated(df)
    long = lambda x: x.cast("bigint")
    return df.withColumns({
        "n_words": long(F.size("__words")),
        "word_chars": long(F.length(F.array_join("__words", ""))),
        "n_symbols": long(F.regexp_count(text, F.lit(SYMBOLS))),
        "n_lines": long(F.size("__lines")),
        "n_dup_lines": long(F.size("__lines") - F.size(F.array_distinct("__lines"))),
        "n_stop_words": long(F.size(F.filter("__words", lambda w: w.isin(*STOP_WORDS)))),
    })


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """(kept, names of the failed rules) as expressions over FEATURES."""

    def fails(rule: Rule) -> Column:
        value = F.expr(METRICS[rule.metric])
        return (F.col("n_words") >= max(rule.from_words, 1)) & ((value < rule.low) | (value > rule.high))

    failed = F.array_compact(F.array(*[F.when(fails(r), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    return ~reduce(lambda a, b: a | b, map(fails, rules), F.lit(False)), failed


def score_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` packed in a struct ``row`` with FEATURES, base_failed, kept and
    failed_rules beside it.

    Words are maximal runs of other characters than SEPARATORS. A null text
    has none, as an empty one; both fail the base test (under 10 words, or
    over a fifth of the words in repeated 5-word windows). Texts of any length
    are judged whole, each within its row. Repeated rows are judged each for
    itself; an empty table gives an empty table; other columns
    stay inside ``row`` whatever their names.
    """
    df = _features(packed(docs, "row"), text_of("row", text))
    kept, failed = compile_rules(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = df.select("row", *FEATURES, base.alias("base_failed"), (~base & kept).alias("kept"), failed.alias("failed_rules"))
    # A generator keeps the optimiser from moving a filter on these columns below their projections, where it would compute the features anew for each use.
    return judged.select("row", F.inline(F.array(F.struct(*[c for c in judged.columns if c != "row"]))))


def filter_quality(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs``, with their columns, that score_quality keeps."""
    return unpacked(score_quality(docs, text, rules).where("kept").select("row"), "row")
