"""Threads: structured comments, text, and reading text back."""

from forgeline import schemas
from forgeline.operators import issues, threads
from forgeline.settings import Settings

LONG = "answer " * 20


def issue(**changes):
    return {
        "repo": "a/b", "number": 7, "title": "T", "body": None, "state": "OPEN", "createdAt": "2024-01-01T00:00:00Z",
        "author": {"login": "rep"}, "labels": {"nodes": [{"name": "x"}, {"name": "y"}]},
        "comments": {"totalCount": 1, "nodes": [{"databaseId": 1, "author": {"login": "u"}, "body": LONG, "createdAt": None}]},
    } | changes


def built(landed, *records, settings=Settings()):
    return threads.issue_threads(issues.normalise_issues(landed(schemas.RAW_ISSUE, *records), settings), settings)


def test_issue_thread_text(landed):
    row = built(landed, issue()).first()
    assert row.thread_text == (
        "ISSUE #7: T\nAuthor: rep\nDate: 2024-01-01T00:00:00Z\nLabels: x, y\nState: open\n\n[c0]\n[no body]\n\n"
        f"--- COMMENTS ---\n[c1] @u:\n{LONG}\n---"
    )
    assert row.url == "https://github.com/a/b/issues/7"


def test_issue_thread_limits(landed):
    nodes = [{"databaseId": i, "author": None, "body": "z" * 6000, "createdAt": None} for i in range(25)]
    record = issue(body="y" * 6000, comments={"totalCount": 25, "nodes": nodes}, author=None)
    row = built(landed, record, settings=Settings(thread_body_chars=5000, thread_comments=20)).first()
    assert [c.id for c in row.comments] == [f"c{i}" for i in range(21)]
    assert {len(c.body) for c in row.comments} == {5000}
    assert row.comments[0].author == "unknown" and row.comments[1].author == "?"
    assert [c.role for c in row.comments[:2]] == ["body", "comment"]
    whole = built(landed, record).first()
    assert len(whole.comments) == 26 and {len(c.body) for c in whole.comments} == {6000}


def test_issue_without_any_comment_gives_no_thread(landed):
    empty = {"totalCount": 0, "nodes": []}
    only_short = {"totalCount": 2, "nodes": [{"databaseId": 1, "body": "ok"}]}
    rows = built(landed, issue(comments=empty), issue(number=8, comments=only_short)).collect()
    assert [(r.number, len(r.comments)) for r in rows] == [(8, 2)]


def discussion(**changes):
    nodes = [
        {"body": f"b{i}", "createdAt": "2024-01-02T00:00:00Z", "author": {"login": f"u{i}"}} for i in (1, 2, 3)
    ]
    return {
        "repo": "a/b", "number": 3, "title": "D", "body": "q", "createdAt": "2024-01-01T00:00:00Z",
        "author": {"login": "asker"}, "answer": None, "comments": {"totalCount": 3, "nodes": nodes},
    } | changes


def talk(landed, **changes):
    return threads.discussion_threads(landed(schemas.RAW_DISCUSSION, discussion(**changes))).first()


def test_answer_among_the_comments(landed):
    row = talk(landed, answer={"body": "b2", "createdAt": None, "author": {"login": "u2"}})
    assert [c.is_accepted for c in row.comments] == [False, False, True, False]
    assert "[c2] [ACCEPTED ANSWER] @u2 2024-01-02T00:00:00Z:\nb2\n---" in row.thread_text
    assert row.has_accepted_answer is True and row.comment_count == 3


def test_nested_answer_is_appended(landed):
    row = talk(landed, answer={"body": "b2", "createdAt": None, "author": {"login": "other"}})
    assert [(c.id, c.author, c.is_accepted) for c in row.comments][-1] == ("c4", "other", True)
    assert sum(c.is_accepted for c in row.comments) == 1


def test_deleted_authors_and_missing_comments(landed):
    row = talk(landed, author=None, comments=None, body=None)
    assert row.author == "unknown" and len(row.comments) == 1 and row.comment_count == 0
    assert row.has_accepted_answer is False and row.thread_text.endswith("--- COMMENTS ---")


def reread(df):
    rows = threads.comments_from_text(df).orderBy("position").collect()
    return [(r.position, r.author, r.timestamp, r.body, r.is_accepted) for r in rows]


def test_text_reads_back(landed):
    df = threads.discussion_threads(
        landed(schemas.RAW_DISCUSSION, discussion(answer={"body": "b2", "createdAt": None, "author": {"login": "u2"}}))
    )
    at = "2024-01-02T00:00:00Z"
    assert reread(df) == [
        (0, "asker", "2024-01-01T00:00:00Z", "q", False),
        (1, "u1", at, "b1", False), (2, "u2", at, "b2", True), (3, "u3", at, "b3", False),
    ]


def test_older_layout_reads_back(rows):
    text = "ISSUE #1: T\nAuthor: a\nLabels: x\n\nbody\nmore\n\n--- COMMENTS ---\n@u 2024:\nfirst\n---\ninside\n---\n[ACCEPTED ANSWER] @v:\nyes\n---"
    df = rows("source STRING, repo STRING, number BIGINT, thread_text STRING", ("issue", "r", 1, text))
    assert reread(df) == [
        (0, "a", "", "body\nmore", False), (1, "u", "2024", "first\n---\ninside", False), (2, "v", "", "yes", True),
    ]
