"""Lenient reading of JSON replies, and JSON encoding that keeps nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEEP_NULLS = {"ignoreNullFields": "false"}


def embedded_object(text: Column) -> Column:
    """Text from the first opening to the last closing brace, '' without one."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def parse_reply(text: Column) -> Column:
    """Reply as a VARIANT: read as is, else its embedded object, else null."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(embedded_object(text)))


def text_field(reply: Column, name: str) -> Column:
    return F.try_variant_get(reply, f"$.{name}", "string")


def number_field(reply: Column, name: str) -> Column:
    """Numeric field, also when quoted; 0 when absent or unreadable."""
    return F.coalesce(F.try_variant_get(reply, f"$.{name}", "string").try_cast("double"), F.lit(0.0))


# JSON texts that count as false.
FALSY = ("false", "0", "0.0", "-0.0", '""', "null", "[]", "{}")


def truthy_field(reply: Column, name: str) -> Column:
    value = F.to_json(F.try_variant_get(reply, f"$.{name}", "variant"))
    return F.coalesce(~value.isin(*FALSY), F.lit(False))


def to_json_text(record: Column) -> Column:
    return F.to_json(record, KEEP_NULLS)
