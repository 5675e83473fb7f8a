"""Threads beyond a scorer's window, scorer failures, and the keyword scorer."""

import json
import random

from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.operators import classify, long_threads
from forgeline.plans import natural
from forgeline.sources import generations
from tests.test_tables_runs import land, raw_issue

THREADS = "repo STRING, source STRING, number BIGINT, title STRING, thread_text STRING"


def test_parts_hold_every_character_once(rows):
    draw = random.Random(2)
    texts = ["", "short", "x" * 100, "y" * 101, "z" * 1234]
    texts += [long_threads.BLOCK_END.join("c%d " % k * draw.randint(0, 40) for k in range(draw.randint(1, 30))) for _ in range(30)]
    threads = rows(THREADS, *[("r", "issue", n, "t", t) for n, t in enumerate(texts)], ("r", "issue", 99, None, None))
    parts = long_threads.thread_parts(threads, 100).collect()
    for n, text in enumerate(texts):
        mine = sorted((r.part, r.thread_text) for r in parts if r.number == n)
        assert "".join(t for _, t in mine) == text and all(len(t) <= 100 for _, t in mine)
        assert len(mine) == 1 if len(text) <= 100 else len(mine) > 1
    assert [r.part for r in parts if r.number == 99] == [0]
    # comments that fit are not torn
    comments = ["a" * 30, "b" * 30, "c" * 30, "d" * 30]
    one = rows(THREADS, ("r", "issue", 1, "t", long_threads.BLOCK_END.join(comments)))
    whole = sorted((r.part, r.thread_text) for r in long_threads.thread_parts(one, 100).collect())
    assert [[c for c in comments if c in t] for _, t in whole] == [comments[:2], comments[2:3], comments[3:]]


def test_merged_outcomes(rows):
    schema = "repo STRING, source STRING, number BIGINT, part BIGINT, outcome STRING, confidence DOUBLE, question_id STRING"
    parts = rows(schema, *[("r", "issue", n, p, o, c, f"q{p}") for n, p, o, c in [
        (1, 0, "no_qa", 0.9), (1, 1, "kept", 0.6), (1, 2, "kept", 0.8), (1, 3, "kept", 0.8),
        (2, 0, "no_qa", 0.0), (2, 1, "parse_error_s1", 0.0), (3, 0, "retry", 0.0), (3, 1, "low_confidence", 0.3), (4, 0, "no_qa", 0.1),
    ]])
    got = {r.number: (r.outcome, r.question_id) for r in long_threads.merge_parts(parts).collect()}
    assert got == {1: ("kept", "q2"), 2: ("parse_error_s1", "q1"), 3: ("low_confidence", "q1"), 4: ("no_qa", "q0")}


def test_failures_are_told_from_answers(rows):
    df = rows("repo STRING, source STRING, number BIGINT, part BIGINT, prompt STRING",
              *[("r", "issue", n, 0, f"p{n}" * 10) for n in range(6)])

    def scorer(prompts):
        if any("p3" in p for p in prompts):
            raise OSError("down")
        assert sum(map(len, prompts[1:])) <= 40
        return [None if "p4" in p else "ok" for p in prompts]

    got = {r.number: (r.response_text, r.error) for r in classify.score(df.coalesce(1), "prompt", scorer, 2, 20).collect()}
    assert got == {n: ("ok", None) for n in (0, 1, 2, 5)} | {3: (None, "OSError: down"), 4: (None, None)}
    gate = classify.stage1_gate(rows("number BIGINT, response_text STRING, error STRING", (1, None, "x"), (2, None, None), (3, "{}", None)))
    assert {r.number: r.outcome for r in gate.collect()} == {1: "retry", 2: "parse_error_s1", 3: "no_qa"}


def test_threads_are_asked_again_after_a_failure(spark, tmp_path):
    base, root = tmp_path / "landed", str(tmp_path / "out")
    land(base / "issues", "1.json", *[raw_issue(n, comments=1 + 20 * (n == 2)) for n in range(4)])
    natural.mine_threads(spark, str(base), root)
    asked = []

    def responses(down):
        def answer(prompts, stage):
            n = F.col("number")
            asked.extend((stage, r.number, r.part) for r in prompts.select("number", "part").collect())
            text = F.lit('{"contains_qa": true, "category": "D", "confidence": 1}' if stage == 1 else '{"question_id": "Q33", "confidence": 0.9}')
            lost = n.isin(down) & (F.lit(stage == 1) | (n == 3))
            return prompts.withColumns({"response_text": F.when(~lost, text), "error": F.when(lost, "down")})

        return answer

    for down, kept in (([1, 3], [0, 2]), ([3], [0, 1, 2]), ([], [0, 1, 2, 3]), ([], [0, 1, 2, 3])):
        asked.clear()
        natural.classify_stored(spark, root, responses(down), "m", "n", window=1000)
        assert sorted(r.number for r in natural.read_pairs(spark, root).collect()) == kept
    assert asked == []
    folder = generations.current(spark, f"{root}/natural/pairs/{'classify_m_n'}")
    ledger = generations.read_batches(spark, folder, "ledger", schemas.LEDGER)
    assert ledger.filter("stage_key = 'classify_m_n'").count() == 4
    parts = generations.read_batches(spark, folder, "parts", "repo STRING, source STRING, number BIGINT, part BIGINT, thread_text STRING")
    assert {r.number: r.n > 1 for r in parts.groupBy("number").agg(F.count("*").alias("n")).filter("number = 2").collect()} == {2: True}


def test_keyword_replies(rows):
    prompt = classify.stage1_prompt(F.col("t"))
    df = rows("repo STRING, source STRING, number BIGINT, t STRING", ("r", "i", 1, "Who OWNS the owns file"), ("r", "i", 2, "build failed"), ("r", "i", 3, "hm"))
    words, questions = {"A": ["owns", "file"], "D": ["build"]}, {"A": "Q1", "D": "Q32"}
    first = long_threads.keyword_replies(df.withColumn("prompt", prompt), 1, words, questions)
    got = {r.number: json.loads(r.response_text) for r in first.collect()}
    assert got[1] == {"contains_qa": True, "category": "A", "confidence": 2 / 3} and got[2]["category"] == "D" and not got[3]["contains_qa"]
    second = long_threads.keyword_replies(df.withColumn("prompt", prompt), 2, words, questions)
    assert json.loads(second.filter("number = 2").first().response_text)["question_id"] == "Q32"
