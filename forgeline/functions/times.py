"""Timestamps, spans and rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3.6e9
MICROS_PER_DAY = 86_400_000_000


def parse_iso(text: Column) -> Column:
    """ISO-8601 text to a timestamp; null when it cannot be read."""
    return F.try_to_timestamp(text)


def format_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def date_prefix(text: Column) -> Column:
    """The day of an ISO-8601 text as it is written; null stays null."""
    return F.substring(text, 1, 10)


def hours_between(start: Column, end: Column) -> Column:
    """Fractional hours, negative when ``end`` precedes ``start``."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(MICROS_PER_HOUR)


def safe_rate(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def percent(part: Column, whole: Column) -> Column:
    """Whole-number percentage, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole * 100).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


# Lower bounds of the confidence bands.
CONFIDENCE_HIGH = 0.8
CONFIDENCE_MID = 0.6


def confidence_band(confidence: Column) -> Column:
    value = F.coalesce(confidence, F.lit(0.0))
    return F.when(value >= CONFIDENCE_HIGH, "high").when(value >= CONFIDENCE_MID, "mid").otherwise("low")


def activity_score(commits: Column, reviews: Column, comments: Column) -> Column:
    # Weights of the activity score.
    return commits * 3 + reviews * 2 + comments
