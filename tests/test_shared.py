"""Artifacts stored once and named by pairs."""

import json

import pytest
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.plans import qa_pairs, shared
from forgeline.settings import Settings
from forgeline.sources import tables

PULLS = "repo STRING, number BIGINT, hours_to_first_review DOUBLE"


@pytest.fixture
def leaders(rows):
    def make(commits=9):
        totals = rows(
            "repo STRING, login STRING, total_commits BIGINT, activity_score BIGINT",
            *[(repo, f"u{i}", commits + i, i) for repo in ("r", "s") for i in range(3)],
        )
        paths = rows("repo STRING, login STRING, path STRING, commits BIGINT, rank INT", ("r", "u2", "p", 4, 1))
        return qa_pairs.top_profiles(totals, paths)

    return make


@pytest.fixture
def asked(spark):
    records = [
        {"repo": repo, "number": n, "title": f"T{n}", "body": "b", "labels": ["x"], "first_assignee_after_bug_label": who}
        for n, (repo, who) in enumerate([("r", "a"), ("r", "b"), ("s", "c"), ("empty", "d"), ("r", None)])
    ]
    return spark.read.schema(schemas.ISSUES).json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))


def loaded(df, *columns):
    return [
        tuple(json.loads(v) if v else v for v in r)
        for r in df.select(*[F.to_json(c) for c in columns]).collect()
    ]


def test_resolved_pairs_equal_whole_ones(asked, leaders, rows):
    pulls = rows(PULLS, *[("r", n, float(n % 7)) for n in range(12)], ("r", 99, None), ("s", 1, 1.0))
    t = qa_pairs.Tables(issues=asked, leaders=leaders(), pull_requests=pulls)
    artifacts = tables.settle(shared.shared_artifacts(t), "shared")

    got = shared.resolve(shared.assignment_refs(t, artifacts), artifacts).orderBy("issue_number")
    whole = qa_pairs.assignment(t).orderBy("issue_number")
    for (own, profiles), (want,) in zip(loaded(got, "artifacts_needed", "shared"), loaded(whole, "artifacts_needed"), strict=True):
        assert {**own, "contributor_profiles": profiles or []} == want
    keys = ["question", "repo", "issue_number", "tier"]
    assert got.select(keys).collect() == whole.select(keys).collect()

    got = shared.resolve(shared.review_time_refs(t, artifacts), artifacts)
    [(samples, truth)] = loaded(got, "shared", "ground_truth")
    [(want, want_truth)] = loaded(qa_pairs.review_time(t), "artifacts_needed", "ground_truth")
    assert [s["hours"] for s in samples] == want["pr_review_history"] and truth == want_truth


def test_a_question_moves_an_id_and_no_profiles(asked, leaders):
    t = qa_pairs.Tables(issues=asked)
    artifacts = tables.settle(shared.profile_artifacts(leaders()), "shared")
    refs = shared.assignment_refs(t, artifacts)
    plan = refs._jdf.queryExecution().executedPlan().toString()
    assert "artifact_id" in plan and "items" not in plan
    named = {r.issue_number: r.artifact_id for r in refs.collect()}
    assert named[0] == named[1] != named[2] and named[3] is None and set(named) == {0, 1, 2, 3}


def test_no_row_holds_a_whole_repo(rows, monkeypatch):
    monkeypatch.setattr(shared, "PART_ITEMS", 16)
    pulls = rows(PULLS, *[("hot", 3 * n, n / 8) for n in range(1000)], ("cold", 5, 2.0))
    parts = shared.review_artifacts(pulls).collect()
    assert max(len(r["items"]) for r in parts) == 16 and len(parts) == 63 + 1
    assert len({r.artifact_id for r in parts}) == 2
    hot = sorted((r for r in parts if r.repo == "hot"), key=lambda r: r.part)
    assert [json.loads(v.toJson())["hours"] for r in hot for v in r["items"]] == [n / 8 for n in range(1000)]
    bounded = shared.review_artifacts(pulls, Settings(review_samples_shown=20)).filter("repo = 'hot'")
    assert sorted(r.part for r in bounded.collect()) == [0, 1]


def test_ids_follow_content_and_order(rows):
    def ids(*hours):
        return shared.review_artifacts(rows(PULLS, *[("r", n, h) for n, h in enumerate(hours)])).first().artifact_id

    assert ids(1.0, 2.0) == ids(1.0, 2.0)
    assert len({ids(1.0, 2.0), ids(2.0, 1.0), ids(1.0, 2.0, 2.0), ids(1.0)}) == 4


def test_stored_once_and_completed_after_a_crash(spark, rows, leaders, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "PART_ITEMS", 4)
    path = str(tmp_path / "shared")
    pulls = rows(PULLS, *[("r", n, float(n)) for n in range(10)])
    artifacts = tables.settle(shared.shared_artifacts(qa_pairs.Tables(leaders=leaders(), pull_requests=pulls)), "shared")

    def stored():
        tables.refresh(spark, path)
        rows = tables.read_table(spark, path, schemas.SHARED_ARTIFACTS).select("artifact_id", "part").collect()
        return sorted(tuple(r) for r in rows)

    shared.add_artifacts(artifacts.filter("part <> 1"), path)  # ended before all was there
    assert len(stored()) == 4
    for _ in range(2):
        shared.add_artifacts(artifacts, path)
        assert len(stored()) == len(set(stored())) == 5
    shared.add_artifacts(shared.profile_artifacts(leaders(commits=20)), path)
    assert len(stored()) == 7
    pairs = artifacts.filter("repo = 'r'").select("artifact_id")
    left = shared.unreferenced(tables.read_table(spark, path, schemas.SHARED_ARTIFACTS), pairs)
    assert left.count() == 3


def test_empty_and_unknown(spark, rows, asked, leaders):
    none = rows(PULLS)
    assert shared.review_artifacts(none).count() == 0
    t = qa_pairs.Tables(issues=asked.limit(0), leaders=leaders(), pull_requests=none)
    artifacts = tables.settle(shared.shared_artifacts(t), "shared")
    assert shared.assignment_refs(t, artifacts).count() == shared.review_time_refs(t, artifacts).count() == 0
    refs = shared.assignment_refs(qa_pairs.Tables(issues=asked), artifacts)
    lost = shared.resolve(refs, artifacts.limit(0)).select("shared").collect()
    assert len(lost) == 4 and all(r.shared is None for r in lost)
    assert shared.shared_items(refs, artifacts).count() == 3
