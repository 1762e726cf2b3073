"""Advice on a search, by its counts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Outcome:
    total: int
    query: str = ""
    use_regex: bool = False
    any_symbols: bool = False


@dataclass(frozen=True)
class Hint:
    id: str
    priority: int
    message: str
    applies: Callable[[Outcome], bool]


DEFAULT = (
    Hint("no-results-orientation", 100, "Nothing found. Has the right project been scanned?", lambda o: o.total == 0),
    Hint("regex-escaped-pipe", 95, "In a regular expression | stands for or; an escaped one matches itself.", lambda o: o.total == 0 and o.use_regex and r"\|" in o.query),
    Hint("no-results-alternatives", 90, "Try a search in the contents, or a regular expression.", lambda o: o.total == 0),
    Hint("symbol-direct-reading", 85, "A symbol can be read by itself as path$symbol.", lambda o: o.any_symbols),
    Hint("few-results-broaden", 50, "Few results. Try fewer words or the hybrid mode.", lambda o: 0 < o.total < 3),
    Hint("many-results-narrow", 40, "Many results. Try more words, kinds or a path prefix.", lambda o: o.total > 50),
)


def hints(outcome: Outcome, known=DEFAULT) -> list[Hint]:
    """Those that apply, highest priority first."""
    return sorted((h for h in known if h.applies(outcome)), key=lambda h: -h.priority)
