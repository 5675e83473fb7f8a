"""Scalar columns against hand-written expectations."""

import pytest
from pyspark.sql import functions as F

from forgeline.functions import json_text, refs, taxonomy, text, times
from forgeline.settings import Settings


def one(spark, column, **values):
    schema = ", ".join(f"{k} {kind}" for k, (kind, _) in values.items()) or "x INT"
    data = [tuple(v for _, v in values.values())] if values else [(1,)]
    return spark.createDataFrame(data, schema).select(column.alias("out")).first()[0]


SAMPLE = "See also #4. Same as #9, duplicate of #7"


@pytest.mark.parametrize(
    "build, value, want",
    [
        (refs.duplicate_refs, SAMPLE, [7, 9]),
        (refs.related_refs, SAMPLE, [4]),
        (refs.duplicate_refs, None, []),
        (refs.duplicate_refs, "DUP OF #3 dup of #3", [3, 3]),
        (refs.duplicate_refs, "duplicate of #99999999999999999999 same as #5", [5]),
        (refs.closing_refs, "Fixes #12, prefix #13 closed  #14 FIX#15", [12, 13, 14]),
        (lambda c: refs.closing_refs(c, strict=True), "Fixes #12, prefix #13", [12]),
        (refs.commit_refs, "resolve #3 fixes https://github.com/a/b/issues/8", [3, 8]),
        (refs.commit_refs, "CLOSES HTTPS://GITHUB.COM/a/b/issues/8", [8]),
        (refs.mentions, "a #1 and #22", [1, 22]),
        (text.ancestors, "a", []),
        (text.ancestors, "a/b/c", ["a", "a/b"]),
        (text.is_shallow, "a/b", True),
        (text.is_shallow, "a/b/c", False),
        (text.squash, "  A\n\t b ", "a b"),
        (text.decode_entities, "&amp;amp;lt;b&amp;gt; &quot;x&#39;", "<b> \"x'"),
        (text.decode_entities, None, ""),
        (text.repo_folder, "a/b", "a__b"),
    ],
)
def test_text_columns(spark, build, value, want):
    assert one(spark, build(F.col("t")), t=("STRING", value)) == want


@pytest.mark.parametrize(
    "message, want",
    [("Add prefix option", True), ("bump version", False), ("CRASH", True), (None, False)],
)
def test_bug_fix(spark, message, want):
    m = F.col("m")
    assert one(spark, refs.is_bug_fix(m, refs.commit_refs(m)), m=("STRING", message)) is want


@pytest.mark.parametrize(
    "labels, strict, want",
    [
        (["workflow", "P1"], False, "workflow"),
        (["workflow", "P1"], True, "P1"),
        (["docs"], False, None),
        ([], False, None),
    ],
)
def test_priority(spark, labels, strict, want):
    column = text.priority_label(F.col("l"), strict)
    assert one(spark, column, l=("ARRAY<STRING>", labels)) == want


def test_excerpt_counts_code_points(spark):
    assert one(spark, text.excerpt(F.col("t"), 2), t=("STRING", "\U0001f600ab")) == "\U0001f600a"
    assert one(spark, text.excerpt(F.col("t"), None), t=("STRING", "abc")) == "abc"


def test_evidence_needs_more_than_ten_characters(spark):
    column = text.is_evidence(F.col("b"), F.col("q"))
    body = ("STRING", "so 1234567890 1 it is")
    assert one(spark, column, b=body, q=("STRING", "1234567890")) is False
    assert one(spark, column, b=body, q=("STRING", "1234567890  1")) is True
    assert one(spark, column, b=body, q=("STRING", None)) is False


def test_evidence_may_compare_the_first_hundred_characters(spark):
    column = text.is_evidence(F.col("b"), F.col("q"), 100)
    start = "word " * 20
    assert one(spark, column, b=("STRING", start + "x"), q=("STRING", start + "other end")) is True


def test_pair_id_and_stage_key(spark):
    column = text.pair_id(F.col("r"), F.col("s"), F.col("n"), F.col("q"))
    got = one(spark, column, r=("STRING", "a/b"), s=("STRING", None), n=("BIGINT", 3), q=("STRING", "Q1"))
    assert got == "a/b/unknown/3/Q1"
    assert text.stage_key("m:7b", "org/m2") == "classify_m_7b_org_m2"
    assert one(spark, text.stage_key_column(F.col("a"), F.col("b")), a=("STRING", "m:7b"), b=("STRING", "org/m2")) == (
        "classify_m_7b_org_m2"
    )


def test_times(spark):
    hours = times.hours_between(times.parse_iso(F.col("a")), times.parse_iso(F.col("b")))
    a, b = ("STRING", "2024-01-01T03:00:00Z"), ("STRING", "2024-01-01T01:30:00Z")
    assert one(spark, hours, a=a, b=b) == -1.5
    assert one(spark, hours, a=a, b=("STRING", "not a time")) is None
    assert one(spark, times.format_iso(times.parse_iso(F.col("a"))), a=a) == "2024-01-01T03:00:00Z"
    assert one(spark, times.percent(F.lit(0), F.lit(0))) == 0
    assert one(spark, times.percent(F.lit(2), F.lit(3))) == 67
    assert one(spark, times.confidence_band(F.col("c")), c=("DOUBLE", 0.6)) == "mid"
    assert one(spark, times.confidence_band(F.col("c")), c=("DOUBLE", None)) == "low"
    assert one(spark, times.activity_score(F.lit(2), F.lit(1), F.lit(4))) == 12


@pytest.mark.parametrize(
    "reply, readable, confidence, truthy",
    [
        ('{"confidence": 0.5, "ok": true}', True, 0.5, True),
        ('Sure: {"confidence": "0.25", "ok": "false"} ok', True, 0.25, True),
        ('{"ok": false}', True, 0.0, False),
        ('{"ok": 0, "confidence": "high"}', True, 0.0, False),
        ('{"ok": ""}', True, 0.0, False),
        ("oops", False, 0.0, False),
        (None, False, 0.0, False),
    ],
)
def test_replies(spark, reply, readable, confidence, truthy):
    parsed = json_text.parse_reply(F.col("t"))
    out = F.struct(
        parsed.isNotNull(), json_text.number_field(parsed, "confidence"), json_text.truthy_field(parsed, "ok")
    )
    assert tuple(one(spark, out, t=("STRING", reply))) == (readable, confidence, truthy)


def test_taxonomy(spark):
    dim = taxonomy.question_dimension(spark)
    assert dim.filter("active").count() == 70
    assert dim.filter("NOT active").count() == 9
    assert dim.select("question_id").distinct().count() == 79
    assert taxonomy.category_dimension(spark).count() == 11
    assert taxonomy.category_questions("F") == ["Q47", "Q48", "Q49", "Q50", "Q51", "Q52"]
    assert set(q for k in taxonomy.CATEGORIES for q in taxonomy.category_questions(k)) <= set(taxonomy.questions())


def test_settings_defaults():
    assert Settings().inducing_window_days == 365
