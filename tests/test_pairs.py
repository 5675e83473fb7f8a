"""Question/answer pair builders on small tables."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.operators import ownership
from forgeline.plans import catalog, qa_pairs
from forgeline.session import shared_folder
from forgeline.settings import Settings
from forgeline.sources import star


def issue(number, dup=(), is_dup=False, body="b", repo="r", assignee=None):
    return {
        "repo": repo, "number": number, "title": f"T{number}", "body": body, "duplicate_of": list(dup),
        "is_duplicate": is_dup or bool(dup), "labels": ["x", "y"], "first_assignee_after_bug_label": assignee,
    }


@pytest.fixture
def issues(spark):
    def make(*records):
        return spark.read.schema(schemas.ISSUES).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))

    return make


def truth(df, path, kind="string"):
    return F.try_variant_get(F.col("ground_truth"), path, kind)


def test_positives_need_a_known_target(issues):
    t = qa_pairs.Tables(issues=issues(issue(1, [2, 2, 99, 1]), issue(2), issue(2, repo="other")))
    pairs = qa_pairs.duplicate_positives(t)
    got = [r.n for r in pairs.select(truth(pairs, "$.duplicate_of_issue", "bigint").alias("n")).collect()]
    assert sorted(got) == [1, 2, 2]
    row = pairs.filter(truth(pairs, "$.duplicate_of_issue", "bigint") == 2).first()
    assert row.question == "Has this bug been reported before?\n\nTitle: T1\nBody: b"
    assert (row.question_id, row.tier, row.issue_number) == ("Q53", 1, 1)
    assert qa_pairs.duplicate_positives(t, drop_self=True, distinct=True).count() == 1


def test_question_may_show_an_excerpt_and_artifacts_the_whole_body(issues):
    cut = Settings(question_excerpt_chars=500, candidate_excerpt_chars=300)
    tables = qa_pairs.Tables(issues=issues(issue(1, [2], body="x" * 900), issue(2, body="y" * 900)))
    pairs = qa_pairs.duplicate_positives(tables, cut)
    row = pairs.select(
        F.char_length("question").alias("q"),
        F.try_variant_get("artifacts_needed", "$.issue_body", "string").alias("whole"),
        F.try_variant_get("artifacts_needed", "$.candidate_issues[0].body", "string").alias("candidate"),
    ).first()
    assert row.q == len("Has this bug been reported before?\n\nTitle: T1\nBody: ") + 500
    assert len(row.whole) == 900 and len(row.candidate) == 300


def test_negatives(issues):
    records = [issue(n, [1]) for n in (100, 101, 102)] + [issue(n) for n in range(1, 40)] + [issue(50, is_dup=True)]
    df = issues(*records)
    edges = [(r.number, r.partner_number) for r in qa_pairs.negative_edges(df, 42).collect()]
    plain = set(range(1, 40))
    assert 1 <= len(edges) <= 3 and all(a in {1, 2, 3} and b in plain and a != b for a, b in edges)
    shuffled = qa_pairs.negative_edges(df.orderBy(F.rand(1)).repartition(5), 42)
    assert sorted(edges) == sorted((r.number, r.partner_number) for r in shuffled.collect())
    assert sorted(edges) != sorted((r.number, r.partner_number) for r in qa_pairs.negative_edges(df, 7).collect())
    pairs = qa_pairs.duplicate_negatives(qa_pairs.Tables(issues=df))
    assert pairs.count() == len(edges)
    assert pairs.filter(truth(pairs, "$.is_duplicate", "boolean")).count() == 0


def test_assignment(spark, rows, issues):
    totals = rows(
        "repo STRING, login STRING, total_commits BIGINT, activity_score BIGINT",
        *[("r", f"u{i:02d}", i, i // 2) for i in range(15)],
    )
    paths = rows(
        "repo STRING, login STRING, path STRING, commits BIGINT, rank INT",
        *[("r", "u14", f"p{i}", 9 - i, i + 1) for i in range(7)],
    )
    leaders = qa_pairs.top_profiles(totals, paths, Settings(files_per_profile=5))
    t = qa_pairs.Tables(issues=issues(issue(1, assignee="a"), issue(2), issue(3, repo="empty", assignee="b")), leaders=leaders)
    pairs = {r.issue_number: json.loads(r.j) for r in qa_pairs.assignment(t).select("issue_number", F.to_json("artifacts_needed").alias("j")).collect()}
    profiles = pairs[1]["contributor_profiles"]
    assert [p["login"] for p in profiles] == ["u14", "u12", "u13", "u10", "u11", "u08", "u09", "u06", "u07", "u04"]
    assert len(profiles[0]["top_files"]) == 5 and profiles[1]["top_files"] == []
    assert pairs[3]["contributor_profiles"] == [] and set(pairs) == {1, 3}
    question = qa_pairs.assignment(t).filter("issue_number = 1").first().question
    assert question == "Who should be assigned this bug?\n\nTitle: T1\nBody: b\nLabels: x, y"


def test_review_time_needs_five_samples(rows):
    def pulls(n):
        return rows("repo STRING, number BIGINT, hours_to_first_review DOUBLE", *[("r", i, float(i)) for i in range(n)], ("r", 99, None))

    assert qa_pairs.review_time(qa_pairs.Tables(pull_requests=pulls(4))).count() == 0
    pairs = qa_pairs.review_time(qa_pairs.Tables(pull_requests=pulls(6)))
    row = pairs.select(truth(pairs, "$.median_hours_to_first_review", "double").alias("m"), "question").first()
    assert row.m == 2.5 and row.question == "How long does PR review typically take in r?"
    history = qa_pairs.review_time(qa_pairs.Tables(pull_requests=pulls(80)), Settings(review_samples_shown=50))
    assert len(json.loads(history.select(F.to_json("artifacts_needed")).first()[0])["pr_review_history"]) == 50


def test_breakage(spark):
    records = [
        {"repo": "r", "run_id": 1, "workflow_name": "w", "head_sha": "s", "is_failure": True, "actor": "u",
         "failed_jobs": [{"job_name": "a", "failed_steps": ["x", "y"]}, {"job_name": "b", "failed_steps": ["z"]}]},
        {"repo": "r", "run_id": 2, "workflow_name": "w", "is_failure": True, "failed_jobs": [], "actor": "u"},
        {"repo": "r", "run_id": 3, "workflow_name": "w", "is_failure": True, "failed_jobs": [{"job_name": "a", "failed_steps": []}]},
    ]
    runs = spark.read.schema(schemas.CI_RUNS).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))
    t = qa_pairs.Tables(ci_runs=runs)
    cause = {r.question: json.loads(r.j) for r in qa_pairs.breakage_cause(t).select("question", F.to_json("ground_truth").alias("j")).collect()}
    assert cause["What caused this build to break? (Run ID: 1, Workflow: w)"]["failed_steps"] == ["x", "y", "z"]
    assert len(cause) == 2
    assert [r.question for r in qa_pairs.breakage_actor(t).collect()] == ["Who caused this build to break? (Run ID: 1)"]


def test_owners(rows):
    touches = rows(
        "repo STRING, sha STRING, author_login STRING, committed_at TIMESTAMP, path STRING",
        *[("r", f"s{i}", login, None, path) for i, (login, path) in enumerate([("u", "d/a"), ("u", "d/a"), ("v", "d/a"), ("v", "e")])],
    ).withColumn("committed_at", F.timestamp_seconds(F.substring("sha", 2, 9).cast("int")))
    late = touches.unionByName(touches.filter("sha = 's3'").withColumns({"sha": F.lit("s9"), "author_login": F.lit(None).cast("string"), "committed_at": F.timestamp_seconds(F.lit(99))}))
    from forgeline.operators.ownership import file_experts, path_expertise

    t = qa_pairs.Tables(experts=file_experts(path_expertise(late)), touches=late)
    latest = qa_pairs.latest_owner(t)
    assert [(r.f, r.l) for r in latest.select(F.try_variant_get("artifacts_needed", "$.file_path", "string").alias("f"), truth(latest, "$.login").alias("l")).collect()] == [("d/a", "v")]
    most = qa_pairs.primary_owner(t)
    got = {(r.f, r.l, r.n) for r in most.select(F.try_variant_get("artifacts_needed", "$.file_path", "string").alias("f"), truth(most, "$.login").alias("l"), truth(most, "$.commit_count", "bigint").alias("n")).collect()}
    assert got == {("d", "u", 2), ("d/a", "u", 2), ("e", "v", 1)}


def test_failing_builder_fails_the_job(issues):
    def broken(t, settings):
        raise ValueError("no input")

    with pytest.raises(ValueError):
        qa_pairs.build_all(qa_pairs.Tables(issues=issues(issue(1))), Settings(), {"broken": broken})


def test_builder_inputs_hold_what_builders_read(spark, rows, tmp_path):
    at = datetime(2024, 1, 1)
    orders = [(k, k % 7, "FOP"[k % 3], None, at + timedelta(days=k), "1-URGENT") for k in range(30)]
    lines = [(k, k % 4, k % 5 + 1, n, 1.0, 1.0, 0.0, 0.0, "R", "O", at + timedelta(days=k)) for k in range(30) for n in range(1, 5)]
    parts = [(p, "a", "Brand#1", "LARGE", 1, 1.0) for p in range(4)]
    events = [(k, at, 1, "error", 1.0, '{"k": 3}') for k in range(5)]
    for name, data in (("orders", orders), ("lineitem", lines), ("part", parts), ("events", events)):
        rows(star.TABLES[name], *data).write.parquet(f"{tmp_path}/{name}.parquet")

    def folders(name):
        return set(Path(shared_folder(spark)).glob(f"{name}-*"))

    before = {name: folders(name) for name in ("expertise", "top-paths")}
    t = catalog._pair_inputs(catalog.configure(spark), str(tmp_path))
    # the roll-up of all paths goes when its readers are written, and nobody else's paths are ranked and kept
    assert {name: folders(name) for name in before} == before
    assert set(t.issues.columns) == set(qa_pairs.ISSUE_COLUMNS)
    assert set(t.pull_requests.columns) == set(qa_pairs.PULL_COLUMNS)
    everyone = ownership.top_paths(star.touches(spark, str(tmp_path)))
    whole = qa_pairs.top_profiles(catalog._totals(spark, str(tmp_path)), everyone)
    profiles = [json.dumps([r.asDict(recursive=True) for r in df.orderBy("repo").collect()]) for df in (t.leaders, whole)]
    assert profiles[0] == profiles[1] and t.leaders.count() == 3
    assert {r.question_id for r in qa_pairs.build_all(t).select("question_id").distinct().collect()} >= {"Q18", "Q19", "Q32", "Q33"}
