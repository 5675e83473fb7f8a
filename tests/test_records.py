"""Landed records to analysis rows."""

from __spark_entry__ import SMALL
from forgeline import schemas
from forgeline.operators import ci, commits, issues, pulls
from forgeline.plans.catalog import QUERIES
from forgeline.settings import Settings
from forgeline.sources import landing

LONG = "x" * 100


def issue(**changes):
    record = {
        "repo": "a/b",
        "number": 1,
        "title": "T",
        "body": "body",
        "state": "OPEN",
        "createdAt": "2024-01-01T00:00:00Z",
        "labels": {"nodes": []},
        "comments": {"totalCount": 0, "nodes": []},
        "timelineItems": {"nodes": []},
    }
    return record | changes


def normalised(landed, record, settings=Settings(), **options):
    return issues.normalise_issues(landed(schemas.RAW_ISSUE, record), settings, **options).first()


def event(kind, **fields):
    return {"__typename": kind, "createdAt": "2024-01-02T00:00:00Z"} | fields


def assigned(login):
    return event("AssignedEvent", assignee={"login": login})


def labelled(name):
    return event("LabeledEvent", label={"name": name})


def test_issue_with_all_fields_missing(landed):
    row = normalised(landed, {"repo": "a/b", "number": 1, "title": "T", "state": "OPEN"})
    assert row.body == "" and row.labels == [] and row.assignees == [] and row.comments == []
    assert row.duplicate_of == [] and row.related_issues == [] and row.cross_refs == []
    assert row.is_duplicate is False and row.comment_count == 0
    assert row.time_to_close_hours is None and row.reporter is None


def test_duplicate_label_without_refs(landed):
    row = normalised(landed, issue(labels={"nodes": [{"name": "Duplicate"}]}, body=""))
    assert row.is_duplicate is True and row.duplicate_of == []


def test_comment_length_and_reference_roll_up(landed):
    comments = [
        {"databaseId": 1, "author": {"login": "u"}, "body": "duplicate of #12"},
        {"databaseId": 2, "author": None, "body": LONG[1:]},
        {"databaseId": 3, "author": {"login": "v"}, "body": LONG + " same as #5, see also #6"},
        {"databaseId": 4, "author": {"login": "v"}, "body": LONG},
        {"databaseId": 5, "body": None},
    ]
    record = issue(body="dup of #9", comments={"totalCount": 7, "nodes": comments})
    row = normalised(landed, record, settings=Settings(min_text_chars=100))
    assert [c.id for c in row.comments] == [3, 4]
    assert row.duplicate_of == [9, 5] and row.related_issues == [6] and row.comment_count == 7
    assert row.is_duplicate is True
    early = normalised(landed, record, settings=Settings(min_text_chars=100), refs_in_short_comments=True)
    assert early.duplicate_of == [9, 12, 5] and [c.id for c in early.comments] == [3, 4]


def test_comment_refs_do_not_make_a_duplicate(landed):
    comments = [{"databaseId": 3, "body": LONG + " same as #5"}]
    row = normalised(landed, issue(comments={"totalCount": 1, "nodes": comments}))
    assert row.duplicate_of == [5] and row.is_duplicate is False


def test_timeline_order_decides_first_assignee(landed):
    nodes = [assigned("a"), labelled("Bug"), assigned("b"), assigned("c"), assigned(None), labelled("bug")]
    row = normalised(landed, issue(timelineItems={"nodes": nodes}))
    assert row.first_assignee_after_bug_label == "b"
    assert [a.assignee for a in row.assignment_history] == ["a", "b", "c"]
    assert [x.label for x in row.label_history] == ["Bug", "bug"]
    assert row.first_bug_label_at is not None


def test_timeline_without_bug_labels(landed):
    nodes = [labelled("Bug"), assigned("b")]
    row = normalised(landed, issue(timelineItems={"nodes": nodes}), Settings(bug_labels=()))
    assert row.first_assignee_after_bug_label is None and row.first_bug_label_at is None


def test_cross_references_and_last_close(landed):
    nodes = [
        event("CrossReferencedEvent", source={"number": 7, "title": "x", "state": "MERGED"}),
        event("CrossReferencedEvent", source=None),
        event("ClosedEvent", createdAt="2024-02-01T00:00:00Z"),
        event("ClosedEvent", createdAt="2024-03-01T00:00:00Z"),
    ]
    row = normalised(landed, issue(timelineItems={"nodes": nodes}), with_last_closed_event=True)
    assert [(c.ref_number, c.ref_title, c.ref_state) for c in row.cross_refs] == [(7, "x", "merged"), (None, None, "")]
    assert row.last_closed_event_at.month == 3


def test_time_to_close(landed):
    row = normalised(landed, issue(closedAt="2024-01-01T12:30:00Z"))
    assert row.time_to_close_hours == 12.5


def test_source_labels(landed):
    raw = landed(
        schemas.RAW_ISSUE, issue(number=1, labels={"nodes": [{"name": "bug"}]}), issue(number=2), issue(number=3, labels=None)
    )
    assert [r.number for r in issues.with_source_labels(raw, ("bug", "x")).collect()] == [1]
    assert issues.with_source_labels(raw, ()).count() == 3


def test_bounded_nested_lists(landed):
    nodes = [{"databaseId": i, "body": LONG} for i in range(60)]
    raw = landed(schemas.RAW_ISSUE, issue(comments={"totalCount": 60, "nodes": nodes}))
    row = landing.bounded_issues(raw).first()
    assert len(row.comments.nodes) == 50 and row.comments.totalCount == 60


def pull(**changes):
    return {
        "repo": "a/b", "number": 1, "title": "P", "body": "", "state": "OPEN", "createdAt": "2024-01-01T00:00:00Z"
    } | changes


def test_pull_request(landed):
    reviews = [
        {"author": {"login": "z"}, "state": "APPROVED", "submittedAt": None, "body": None},
        {"author": {"login": "y"}, "state": "COMMENTED", "submittedAt": "2024-01-01T06:00:00Z", "body": "abc"},
        {"author": None, "state": "COMMENTED", "submittedAt": "2024-01-01T03:00:00Z", "body": ""},
        {"author": {"login": "y"}, "state": "APPROVED", "submittedAt": "2024-01-02T00:00:00Z", "body": ""},
    ]
    requests = [
        {"requestedReviewer": {"login": "u"}},
        {"requestedReviewer": {"slug": "team"}},
        {"requestedReviewer": {}},
        {"requestedReviewer": None},
    ]
    threads = [
        {"comments": {"nodes": [{"author": {"login": "r"}, "path": "p", "body": LONG}, {"body": "short"}]}},
        {"comments": None},
        {"comments": {"nodes": [{"author": None, "path": "q", "body": LONG}]}},
    ]
    row = pulls.normalise_pull_requests(
        landed(
            schemas.RAW_PULL_REQUEST,
            pull(
                state="MERGED", body=LONG + " closes #4", closedAt="2024-01-03T00:00:00Z",
                reviews={"nodes": reviews}, reviewRequests={"nodes": requests}, reviewThreads={"nodes": threads},
            ),
        )
    ).first()
    assert row.outcome == "merged" and row.closes_issues == [4] and row.has_rationale is True
    assert row.hours_to_first_review == 3.0 and row.hours_open == 48.0
    assert row.unique_reviewers == ["y", "z"] and row.requested_reviewers == ["u", "team"]
    assert [r.body_length for r in row.reviews] == [0, 3, 0, 0]
    assert [(c.reviewer, c.path, c.body) for c in row.review_comments] == [("r", "p", LONG), (None, None, "short"), (None, "q", LONG)]


def test_pull_request_without_lists(landed):
    rows = pulls.normalise_pull_requests(
        landed(schemas.RAW_PULL_REQUEST, *[pull(number=i, state=s) for i, s in enumerate(["CLOSED", "OPEN", ""])])
    ).orderBy("number").collect()
    assert [r.outcome for r in rows] == ["closed", "open", "open"]
    assert rows[0].reviews == [] and rows[0].review_comments == [] and rows[0].requested_reviewers == []
    assert rows[0].hours_to_first_review is None and rows[0].files_changed_count == 0


def test_commit(landed):
    record = {
        "repo": "a/b", "sha": "s1",
        "commit": {"message": "Fixes #3", "author": {"name": "N", "email": "e", "date": "2024-01-01T00:00:00Z"}},
        "author": {"login": "u"},
        "files": [{"filename": "a", "additions": 2, "deletions": 1}, {"filename": "b/c", "additions": None, "deletions": 4}],
        "parents": [{"sha": "s0"}],
    }
    bare = {"repo": "a/b", "sha": "s2", "commit": {"message": "docs", "author": {}}}
    raw = landed(schemas.RAW_COMMIT, record, bare)
    first, second = commits.normalise_commits(raw).orderBy("sha").collect()
    assert (first.additions, first.deletions, first.files_changed) == (2, 5, ["a", "b/c"])
    assert first.closes_issues == [3] and first.is_bug_fix and first.parents == ["s0"]
    assert second.files_changed == [] and second.additions == 0 and second.author_login is None
    assert not second.is_bug_fix
    listing = landed(schemas.RAW_COMMIT_LISTING, {"repo": "a/b", "sha": "s1"}, {"repo": "a/b", "sha": "gone"})
    assert [r.sha for r in commits.join_commit_details(listing, raw).collect()] == ["s1"]


def test_ci_runs(landed):
    runs = landed(
        schemas.RAW_CI_RUN,
        {"repo": "a/b", "id": 1, "conclusion": "failure", "name": "w", "pull_requests": [{"number": 4}]},
        {"repo": "a/b", "id": 2, "conclusion": "failure", "name": "w", "triggering_actor": {"login": "u"}},
        {"repo": "a/b", "id": 3, "conclusion": "success", "name": "w"},
        {"repo": "a/b", "id": 4, "conclusion": None, "name": "w"},
    )
    jobs = landed(
        schemas.RAW_CI_JOB,
        {"repo": "a/b", "run_id": 1, "name": "j2", "conclusion": "failure",
         "steps": [{"name": "s1", "conclusion": "success"}, {"name": "s2", "conclusion": "failure"}]},
        {"repo": "a/b", "run_id": 1, "name": "j1", "conclusion": "failure"},
        {"repo": "a/b", "run_id": 1, "name": "j3", "conclusion": "success"},
        {"repo": "a/b", "run_id": 3, "name": "j1", "conclusion": "failure"},
    )
    rows = {r.run_id: r for r in ci.normalise_ci_runs(runs, jobs).collect()}
    assert [(j.job_name, j.failed_steps) for j in rows[1].failed_jobs] == [("j1", []), ("j2", ["s2"])]
    assert rows[2].failed_jobs == [] and rows[3].failed_jobs == [] and len(rows) == 4
    assert rows[1].pr_numbers == [4] and rows[2].pr_numbers == []
    assert rows[1].is_failure and not rows[4].is_failure


def test_failure_rates_keep_the_null_actor(rows):
    runs = rows(
        "repo STRING, actor STRING, workflow_name STRING, conclusion STRING",
        ("r", None, "w1", "failure"), ("r", None, "w2", None), ("r", "u", "w1", "success"),
    )
    got = {r.actor: (r.failures, r.total_runs, r.failure_rate) for r in ci.actor_failure_rates(runs).collect()}
    assert got == {None: (1, 2, 0.5), "u": (0, 1, 0.0)}
    assert [tuple(r) for r in ci.workflow_failures(runs).collect()] == [("r", "w1", 1)]


def test_order_lines_are_sorted_once_and_collected_in_order(spark):
    plan = QUERIES["pull_request_records"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and "ObjectHashAggregate" not in plan
    slim = QUERIES["review_time_medians"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "row, thread" not in slim and "row, request" not in slim and "row, review" in slim


def test_references_alone_do_not_make_comments(landed):
    body = "dup of #4, see also #5"
    comment = {"databaseId": 9, "author": {"login": "a"}, "body": body, "createdAt": "2024-01-01T00:00:00Z"}
    record = issue(body="same as #2", comments={"totalCount": 2, "nodes": [comment, {"databaseId": 8}]})
    rows = issues.normalise_issues(landed(schemas.RAW_ISSUE, record))
    whole = rows.select("duplicate_of", "related_issues", "comments").first()
    assert (whole.duplicate_of, whole.related_issues) == ([2, 4], [5])
    assert [(c.id, c.duplicate_refs, c.related_refs) for c in whole.comments] == [(9, [4], [5]), (8, [], [])]
    some = rows.select("number", "duplicate_of")
    assert some.first().duplicate_of == [2, 4]
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert "dup of" in plan and "see also" not in plan
