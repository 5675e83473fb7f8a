"""Classification gates and review operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from forgeline.settings import Settings
from forgeline.operators import classify, review

KEY = ["repo", "source", "number"]
RESPONSES = "repo STRING, source STRING, number BIGINT, stage INT, model STRING, response_text STRING"


def outcomes(rows, first, second, threshold=0.55):
    keys = rows("repo STRING, source STRING, number BIGINT", ("r", "issue", 1))
    data = [("r", "issue", 1, s, "m", t) for s, t in ((1, first), (2, second)) if t is not None]
    responses = rows(RESPONSES, *data, ("r", "issue", 2, 1, "m", "x"))
    return classify.classify_with_responses(keys, responses, threshold).first()


YES = '{"contains_qa": true, "category": "g", "confidence": 0.9}'


@pytest.mark.parametrize(
    "first, second, threshold, outcome, confidence",
    [
        (None, None, 0.55, "parse_error_s1", 0.0),
        ("nope", None, 0.55, "parse_error_s1", 0.0),
        ('{"contains_qa": false, "confidence": 0.9}', None, 0.55, "no_qa", 0.0),
        ('{"contains_qa": true, "category": "z", "confidence": 0.9}', None, 0.55, "no_qa", 0.9),
        ('{"contains_qa": true, "confidence": 0.9}', None, 0.55, "no_qa", 0.9),
        (YES, None, 0.55, "failed", None),
        (YES, '{"question_id": "Q54", "confidence": 0.8}', 0.7, "kept", 0.9 * 0.8),
        (YES, '{"question_id": "Q54", "confidence": 0.8}', 0.73, "low_confidence", 0.9 * 0.8),
        (YES, '{"question_id": "NONE", "confidence": 1}', 0.7, "kept", 0.9),
        (YES, '{"confidence": "0.8"}', 0.7, "kept", 0.9 * 0.8),
    ],
)
def test_outcomes(rows, first, second, threshold, outcome, confidence):
    row = outcomes(rows, first, second, threshold)
    assert row.outcome == outcome
    if confidence is not None:
        assert row.confidence == pytest.approx(confidence)
    if outcome == "kept":
        assert row.stage1_category == "G"
        assert row.answer_text == "" and row.answer_is_accepted is False


def test_prompts(rows):
    df = rows("repo STRING, source STRING, number BIGINT, thread_text STRING, category STRING", ("r", "issue", 1, "t" * 60000, "E"))
    cut = Settings(prompt_thread_chars=50000)
    row = classify.with_stage2_prompt(df.withColumn("p1", classify.stage1_prompt(F.col("thread_text"), cut)), cut).first()
    assert row.p1.count("t" * 50000) == 1 and "t" * 50001 not in row.p1 and "A - People & Awareness" in row.p1
    assert "Q36: " in row.stage2_prompt and "Q37: " in row.stage2_prompt and "Q35: " not in row.stage2_prompt


def test_scorer_is_asked_again(rows, tmp_path):
    folder = str(tmp_path)
    df = rows("repo STRING, source STRING, number BIGINT, prompt STRING", *[("r", "issue", i, f"p{i}") for i in range(6)]).coalesce(1)

    def scorer(prompts):
        import os
        import uuid

        calls = len(os.listdir(folder))
        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if calls == 0:
            raise RuntimeError("busy")
        return [None if p == "p5" or (p == "p4" and calls == 1) else p.upper() for p in prompts]

    got = {r.number: r.response_text for r in classify.score(df, "prompt", scorer).collect()}
    assert got == {0: "P0", 1: "P1", 2: "P2", 3: "P3", 4: "P4", 5: None}
    assert len(list(tmp_path.iterdir())) == 3


def test_ledger(rows):
    threads = rows("repo STRING, source STRING, number BIGINT", ("r", "issue", 1), ("r", "issue", 2), ("r", "discussion", 1))
    done = threads.filter("source = 'issue' AND number = 1")
    ledger = classify.ledger_rows(done, "m:1", "x")
    assert {r.stage_key for r in ledger.collect()} == {"classify_m_1_x", "classify_seen"}
    left = classify.unprocessed(threads, ledger, "other", "model")
    assert {(r.source, r.number) for r in left.collect()} == {("issue", 2), ("discussion", 1)}


PAIRS = "source STRING, repo STRING, number BIGINT, question_id STRING, question_text STRING, answer_text STRING, title STRING, confidence DOUBLE, stage1_category STRING"
LOG = "pair_id STRING, status STRING, note STRING, verified_at TIMESTAMP"


@pytest.fixture
def pairs(rows):
    return rows(PAIRS, *[("issue", "a/b", n, f"Q{n % 2}", f"Who {n}", "Me", None, 0.5 + n / 10, "A") for n in range(1, 6)])


def log(rows, *entries):
    return rows(LOG, *[(f"a/b/issue/{n}/Q{n % 2}", s, note, datetime(2024, 1, d)) for n, s, note, d in entries])


def test_last_decision_wins(rows, pairs):
    valid, bad = review.verification_entries(
        log(rows, (1, "rejected", None, 2), (1, "accepted", "x", 3), (2, "accepted", None, 1), (3, "what", None, 1))
    )
    state = review.current_verification(valid)
    assert {(r.pair_id[-4:], r.status, r.note) for r in state.collect()} == {("1/Q1", "accepted", "x"), ("2/Q0", "accepted", "")}
    assert bad.count() == 1
    exported = review.accepted_pairs(pairs, state)
    assert sorted(r.number for r in exported.collect()) == [1, 2] and exported.columns == pairs.columns
    stats = {(r.kind, r.key): r.n for r in review.statistics(pairs, state).collect()}
    assert stats == {
        ("total", ""): 5, ("status", "accepted"): 2, ("status", "pending"): 3, ("repo", "a/b"): 5,
        ("question_id", "Q0"): 2, ("question_id", "Q1"): 3,
    }
    assert tuple(review.progress(pairs, state).first()) == (5, 2, 40)
    assert review.progress(pairs.limit(0), state).first().percent == 0


def test_queue_filters_and_pages(rows, pairs):
    state = review.current_verification(log(rows, (1, "accepted", "", 2)))
    queue = review.review_queue(pairs, state)
    assert {(r.number, r.status, r.note) for r in queue.collect()} == {(1, "accepted", "")} | {(n, "pending", "") for n in range(2, 6)}
    assert [r.number for r in review.page(queue, 2, 2).collect()] == [3, 4] and queue.count() == 5
    assert [r.number for r in review.page(queue, 3, 2).collect()] == [5]
    assert [r.number for r in review.page_after(queue, ("a/b", "issue", 3, "Q1"), 9).collect()] == [4, 5]
    assert review.review_queue(pairs, state, status="pending", question_id="Q1").count() == 2
    assert [r.number for r in review.review_queue(pairs, state, search="wHO 4").collect()] == [4]
    assert review.review_queue(pairs, state, search="me", repo="x").count() == 0
    assert review.pair_detail(pairs, state, "a/b/issue/2/Q0").first().status == "pending"


def test_ordinal_keys_move_to_ids(rows):
    numbered = rows("ordinal BIGINT, pair_id STRING", (0, "k0"), (1, "k1"))
    at = datetime(2024, 1, 1)
    state = rows(LOG, ("1", "accepted", "n", at), ("7", "accepted", "", at), ("x/y", "rejected", "", at))
    got = {(r.pair_id, r.status) for r in review.migrate_ordinal_keys(state, numbered).collect()}
    assert got == {("k1", "accepted"), ("x/y", "rejected")}


def test_evidence_by_id_or_text(rows):
    schema = (
        "source STRING, repo STRING, number BIGINT, question_id STRING, question_text STRING, answer_text STRING, "
        "question_comment_id STRING, answer_comment_id STRING, comments ARRAY<STRUCT<id:STRING, author:STRING, body:STRING, is_accepted:BOOLEAN>>"
    )
    comments = [("c0", None, "who wrote   this FILE?", False), ("c1", "u", "it was me, I think", True)]
    df = rows(schema, ("issue", "r", 1, "Q1", "Who wrote this file?", "short", "", "c1", comments))
    got = {r.comment_id: (r.author, r.is_question, r.is_answer, r.is_accepted) for r in review.tag_evidence(df).collect()}
    assert got == {"c0": ("?", True, False, False), "c1": ("u", False, True, True)}
