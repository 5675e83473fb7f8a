"""Text columns: excerpts, paths, evidence matching, entity decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE_MIN_CHARS = 10   # Fixed value: quotations up to this length prove nothing
# A label holding any of these names a priority.
PRIORITY_WORDS = ("p0", "p1", "p2", "critical", "high", "medium", "low")


def empty_array(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def or_empty(values: Column, kind: str = "string") -> Column:
    return F.coalesce(values, empty_array(kind))


def excerpt(text: Column, chars: int | None) -> Column:
    """Leading code points of a text; the whole text when ``chars`` is None."""
    return text if chars is None else F.substring(text, 1, chars)


def present(value: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(value != "", F.lit(False))


def priority_label(labels: Column, strict: bool = False) -> Column:
    """First label naming a priority; ``strict`` needs it as a separate word."""
    words = "|".join(PRIORITY_WORDS)
    pattern = rf"(^|[^a-z0-9])({words})([^a-z0-9]|$)" if strict else words
    return F.get(F.filter(labels, lambda label: F.rlike(F.lower(label), F.lit(pattern))), 0)


def ancestors(path: Column) -> Column:
    """Every directory above a path, outermost first."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(parts) - 1),
            lambda depth: F.array_join(F.slice(parts, F.lit(1), depth), "/"),
        ),
    ).otherwise(empty_array("string"))


def is_shallow(path: Column) -> Column:
    """At most two levels deep."""
    return F.size(F.split(path, "/")) <= 2


def contains_ignoring_case(text: Column, needle: Column) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(needle))


def squash(text: Column) -> Column:
    """Whitespace runs to single blanks, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def is_evidence(body: Column, quotation: Column, chars: int | None = None) -> Column:
    """Whether a comment body holds a quotation, or its first ``chars`` characters."""
    needle = excerpt(squash(quotation), chars)
    found = (F.char_length(needle) > EVIDENCE_MIN_CHARS) & F.contains(squash(body), needle)
    return F.coalesce(found, F.lit(False))


# The five basic entities, ampersand last so that a decoded
# ampersand can complete another entity only in the next round.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decode_entities(text: Column) -> Column:
    """Undo escaping of the five basic entities, however often repeated, in one pass for each."""
    # an ampersand and any escapes of it are one ampersand, which may begin one of the others
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "&(?:amp;)+", "&")
    for entity, char in ENTITIES[:-1]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def pair_id(repo: Column, source: Column, number: Column, question_id: Column) -> Column:
    parts = [repo, source, number.cast("string"), question_id]
    return F.concat_ws("/", *[F.coalesce(p, F.lit("unknown")) for p in parts])


def stage_key(stage1_model: str, stage2_model: str) -> str:
    """Ledger key of a pair of models."""
    return f"classify_{stage1_model}_{stage2_model}".translate(str.maketrans(":/", "__"))


def stage_key_column(stage1_model: Column, stage2_model: Column) -> Column:
    return F.translate(F.concat(F.lit("classify_"), stage1_model, F.lit("_"), stage2_model), ":/", "__")


def repo_folder(repo: Column) -> Column:
    return F.replace(repo, F.lit("/"), F.lit("__"))
