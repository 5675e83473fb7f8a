"""Defaults keep all: rows beyond every limit of the hosting service, whole texts, all experts."""

import datetime

from forgeline import schemas
from forgeline.functions import text
from forgeline.operators import classify, ownership, review, threads
from forgeline.operators.issues import normalise_issues
from forgeline.plans import qa_pairs
from forgeline.settings import Settings
from forgeline.sources import tables
from pyspark.sql import functions as F

DAY = datetime.datetime(2024, 5, 1)


def test_long_issue_keeps_every_comment_event_and_character(landed):
    body = "b" * 60_000
    issue = {
        "repo": "o/r", "number": 1, "title": "t", "body": body, "state": "OPEN", "createdAt": "2024-05-01T00:00:00Z",
        "labels": {"nodes": [{"name": f"l{k}"} for k in range(30)]},
        "comments": {
            "totalCount": 70,
            "nodes": [{"databaseId": k, "author": {"login": "a"}, "body": f"ok {k}", "createdAt": "2024-05-01T01:00:00Z"} for k in range(70)],
        },
        "timelineItems": {
            "nodes": [{"__typename": "LabeledEvent", "createdAt": "2024-05-01T02:00:00Z", "label": {"name": f"x{k}"}} for k in range(60)]
        },
    }
    records = normalise_issues(landed(schemas.RAW_ISSUE, issue))
    row = records.first()
    assert len(row.comments) == 70 and len(row.labels) == 30 and len(row.label_history) == 60
    thread = threads.issue_threads(records).first()
    assert len(thread.comments) == 71 and thread.comments[0].body == body
    prompt = records.select(classify.stage1_prompt(F.col("body")).alias("p")).first().p
    assert body in prompt
    few = threads.issue_threads(records, Settings(thread_comments=20, thread_body_chars=5000)).first()
    assert len(few.comments) == 21 and len(few.comments[0].body) == 5000


def test_question_and_candidate_show_whole_bodies(rows):
    schema = "repo string, number bigint, title string, body string, duplicate_of array<bigint>, is_duplicate boolean"
    issues = rows(schema, ("o/r", 1, "a", "q" * 900, [2], True), ("o/r", 2, "b", "c" * 800, [], False))
    pair = qa_pairs.duplicate_positives(qa_pairs.Tables(issues=issues)).first()
    assert "q" * 900 in pair.question and "c" * 800 in str(pair.artifacts_needed)


def test_experts_include_authors_who_rank_the_path_low(rows):
    touched = [("o/r", f"s{k}", "busy", DAY, False, [], f"f{k}") for k in range(30) for _ in range(2)]
    touched.append(("o/r", "last", "busy", DAY, False, [], "rare"))
    table = rows(
        "repo string, sha string, author_login string, committed_at timestamp, is_bug_fix boolean, closes_issues array<bigint>, path string",
        *touched,
    )
    experts = ownership.file_experts(ownership.path_expertise(table))
    assert {r.file for r in experts.collect()} == {f"f{k}" for k in range(30)} | {"rare"}
    asked = qa_pairs.latest_owner(qa_pairs.Tables(touches=table))
    assert asked.count() == 31


def test_evidence_reads_the_whole_quotation(rows):
    quote = "word " * 40
    table = rows("body string, quote string", (quote + "end", quote + "end"), (quote + "other", quote + "end"))
    found = table.select(
        text.is_evidence(F.col("body"), F.col("quote")).alias("whole"),
        text.is_evidence(F.col("body"), F.col("quote"), 100).alias("start"),
    )
    assert [tuple(r) for r in found.collect()] == [(True, True), (False, True)]


def test_entities_are_decoded_to_the_last_level(rows):
    deep = "&" + "amp;" * 12 + "lt;"
    table = rows("t string", (deep,), ("&lt;&amp;gt;",), (None,), ("&ampamp;",))
    assert [r.x for r in table.select(text.decode_entities(F.col("t")).alias("x")).collect()] == ["<", "<>", "", "&ampamp;"]


def test_one_decision_per_pair_after_migration(rows):
    schema = "pair_id string, status string, note string, verified_at timestamp"
    later = DAY + datetime.timedelta(days=1)
    state = rows(schema, ("0", "accepted", "", DAY), ("r/i/1/Q1", "rejected", "x", later), ("7", "accepted", "", DAY))
    numbered = rows("ordinal bigint, pair_id string", (0, "r/i/1/Q1"), (1, "r/i/2/Q1"))
    got = review.migrate_ordinal_keys(state, numbered).collect()
    assert [(r.pair_id, r.status, r.note) for r in got] == [("r/i/1/Q1", "rejected", "x")]


def test_a_repo_without_rows_is_emptied(spark, rows, tmp_path):
    path, schema = str(tmp_path / "t"), "repo string, n bigint"
    tables.write_table(rows(schema, ("a/x", 1), ("a/y", 2), ("a/z", 3)), path)
    tables.replace_repos(rows(schema, ("a/x", 9)), path, ["a/x", "a/y", "a/none"])
    got = {tuple(r) for r in tables.read_table(spark, path, schema).collect()}
    assert got == {("a/x", 9), ("a/z", 3)}


def test_page_total(rows):
    queue = rows("pair_id string", *[(str(k),) for k in range(41)])
    assert tuple(review.page_total(queue, 20).first()) == (41, 3)
