"""Cross-reference extraction: issue numbers named in free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reference phrases. Matched without case, result order is by
# phrase first and by position second.
DUPLICATE_PHRASES = ("duplicate of", "dup of", "duplicates", "same as")
RELATED_PHRASES = ("related to", "see also", "similar to")
CLOSING_KEYWORD = r"(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+"
ISSUE_URL = r"https?://github\.com/[^/]+/[^/]+/issues/"
BUG_FIX_WORDS = ("fix", "bug", "patch", "regression", "crash", "error")


def _numbers(text: Column, patterns: list[str], mark: str = "#") -> Column:
    """Numbers captured by each pattern in turn.

    Every match holds ``mark``, so texts without it skip the patterns.
    """
    safe = F.coalesce(text, F.lit(""))
    found = [F.regexp_extract_all(safe, F.lit(f"(?i){p}"), F.lit(1)) for p in patterns]
    # A number too long for 64 bits names no issue; it becomes null and is dropped.
    numbers = F.array_compact(reduce(lambda a, b: F.concat(a, b), found).try_cast("array<bigint>"))
    return F.when(F.contains(safe, F.lit(mark)), numbers).otherwise(F.array().cast("array<bigint>"))


def duplicate_refs(text: Column) -> Column:
    return _numbers(text, [rf"{p} #(\d+)" for p in DUPLICATE_PHRASES])


def related_refs(text: Column) -> Column:
    return _numbers(text, [rf"{p} #(\d+)" for p in RELATED_PHRASES])


def closing_refs(text: Column, strict: bool = False) -> Column:
    """Issues a pull request says it closes. ``strict`` asks for a word boundary."""
    start = r"\b" if strict else ""
    return _numbers(text, [rf"{start}{CLOSING_KEYWORD}#(\d+)"])


def commit_refs(message: Column, strict: bool = False) -> Column:
    """As :func:`closing_refs`, plus the full issue-URL form."""
    start = r"\b" if strict else ""
    by_url = _numbers(message, [rf"{start}{CLOSING_KEYWORD}{ISSUE_URL}(\d+)"], mark="://")
    return F.concat(closing_refs(message, strict), by_url)


def mentions(text: Column) -> Column:
    """Every ``#n`` in a text."""
    return _numbers(text, [r"#(\d+)"])


def is_bug_fix(message: Column, refs: Column) -> Column:
    lowered = F.lower(F.coalesce(message, F.lit("")))
    named = reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in BUG_FIX_WORDS])
    return (F.size(refs) > 0) | named
