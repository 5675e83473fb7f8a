"""SQL counterparts of the registered queries, for an independent engine.

Each oracle is a WITH chain over the warehouse tables. ``VIEWS`` holds the shared
steps; ``_with`` puts the needed ones, in order, in front of a query.
"""

from __future__ import annotations

import re

from forgeline.functions import taxonomy
from forgeline.operators.classify import STAGE1_TASK, STAGE2_TASK


def _refs(text: str, *patterns: str) -> str:
    """Numbers captured by each pattern in turn, as a BIGINT list."""
    found = [f"regexp_extract_all(coalesce({text}, ''), '(?i){p}', 1)" for p in patterns]
    joined = found[0]
    for more in found[1:]:
        joined = f"list_concat({joined}, {more})"
    return f"CAST({joined} AS BIGINT[])"


DUP = tuple(rf"{p} #(\d+)" for p in ("duplicate of", "dup of", "duplicates", "same as"))
REL = tuple(rf"{p} #(\d+)" for p in ("related to", "see also", "similar to"))
CLOSE = r"(?:close[sd]?|fix(?:e[sd])?|resolve[sd]?)\s+"
CLOSE_NUMBER = CLOSE + r"#(\d+)"
CLOSE_URL = CLOSE + r"https?://github\.com/[^/]+/[^/]+/issues/(\d+)"
ISO = "'%Y-%m-%dT%H:%M:%SZ'"


def _repo(key: str) -> str:
    return f"'acme/r' || ({key} % 3)"


def _text(values: str, separator: str = ",") -> str:
    return f"coalesce(array_to_string({values}, '{separator}'), '')"


VIEWS: dict[str, str] = {}

# ---- commits and files

VIEWS["v_commits"] = f"""
SELECT *, (len(refs) > 0 OR regexp_matches(lower(message), 'fix|bug|patch|regression|crash|error')) AS is_fix_text
FROM (
  SELECT *, {_refs("message", CLOSE_NUMBER, CLOSE_URL)} AS refs FROM (
    SELECT o_orderkey AS k, {_repo("o_orderkey")} AS repo, md5(CAST(o_orderkey AS VARCHAR)) AS sha, o_custkey,
      CASE WHEN o_custkey % 97 <> 0 THEN 'u' || o_custkey END AS login,
      epoch_us(o_orderdate) AS us,
      CASE o_orderstatus
        WHEN 'F' THEN 'Fixes #' || (o_orderkey % 1000) || CASE WHEN o_orderkey % 5 = 0
          THEN ', resolves https://github.com/acme/core/issues/' || (o_orderkey % 777) ELSE '' END
        WHEN 'P' THEN 'bump version' ELSE 'crash on load' END AS message
    FROM orders))"""

VIEWS["v_parts"] = """
SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 'p' || p_partkey
  ELSE 'src/' || p_type || '/' || replace(p_brand, '#', '') || '/p' || p_partkey END AS path
FROM part"""

VIEWS["v_touches"] = """
SELECT DISTINCT c.repo, c.sha, c.login, c.us, c.refs, c.is_fix_text, p.path
FROM lineitem JOIN v_commits c ON c.k = l_orderkey JOIN v_parts p ON p.p_partkey = l_partkey"""

VIEWS["v_inducing"] = """
SELECT f.repo, unnest(f.refs) AS issue_number, f.sha AS fix_sha, f.login AS fix_author, f.us AS fix_us,
  b.best.sha AS inducing_sha, b.best.login AS inducing_author, b.best.us AS inducing_us, f.path AS file
FROM v_touches f JOIN (
  SELECT x.repo, x.path, x.sha, max({'us': e.us, 'sha': e.sha, 'login': e.login}) AS best
  FROM v_touches x JOIN v_touches e
    ON e.repo = x.repo AND e.path = x.path AND e.us < x.us AND x.us - e.us <= 31536000000000
  WHERE len(x.refs) > 0
  GROUP BY ALL) b ON b.repo = f.repo AND b.path = f.path AND b.sha = f.sha"""

VIEWS["v_files"] = """
SELECT l_orderkey AS k, path, sum(CAST(l_quantity AS BIGINT))::BIGINT AS additions,
  sum(l_linenumber)::BIGINT AS deletions,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY path) AS pos
FROM lineitem JOIN v_parts ON p_partkey = l_partkey GROUP BY l_orderkey, path"""

# every directory above a file: prefixes ending before each slash
VIEWS["v_dirs"] = """
SELECT path, array_to_string(list_slice(string_split(path, '/'), 1, d), '/') AS dir, d
FROM v_parts, range(1, 10) r(d) WHERE d < len(string_split(path, '/'))"""

VIEWS["v_expertise"] = """
SELECT repo, login, path, count(*) AS commits FROM (
  SELECT repo, login, path FROM v_touches WHERE login IS NOT NULL
  UNION ALL
  SELECT t.repo, t.login, d.dir FROM v_touches t JOIN v_dirs d USING (path) WHERE t.login IS NOT NULL)
GROUP BY ALL"""

VIEWS["v_top"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, login ORDER BY commits DESC, path) AS rank
  FROM v_expertise) WHERE rank <= 20"""

VIEWS["v_experts"] = """
SELECT * FROM (SELECT repo, login, path, commits,
  row_number() OVER (PARTITION BY repo, path ORDER BY commits DESC, login) AS rank FROM v_expertise) WHERE rank <= 5"""

VIEWS["v_latest"] = """
SELECT repo, path AS file, last.login AS login FROM (
  SELECT repo, path, max({'us': us, 'sha': sha, 'login': login}) AS last FROM v_touches GROUP BY ALL)"""

# ---- order lines as nested entries

VIEWS["v_lines"] = f"""
SELECT *, 's' || l_suppkey AS any_supplier, CASE WHEN l_suppkey % 41 <> 0 THEN 's' || l_suppkey END AS supplier,
  epoch_us(l_shipdate) AS ship_us,
  row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS pos
FROM lineitem"""

# ---- issues

VIEWS["v_raw_issues"] = f"""
SELECT o_orderkey AS k, {_repo("o_orderkey")} AS repo, o_orderkey // 3 AS number,
  'Issue ' || (o_orderkey // 3) || ' ' || o_orderpriority AS title,
  CASE o_orderkey % 7
    WHEN 0 THEN 'Crash seen. Duplicate of #' || (o_orderkey % 5003)
    WHEN 1 THEN 'Same as #1 and dup of #' || (o_orderkey % 701) || '. See also #' || (o_orderkey % 211)
    WHEN 2 THEN 'Related to #' || (o_orderkey % 499)
    WHEN 3 THEN NULL ELSE 'Steps: open, save, close.' END AS body,
  CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'open' END AS state,
  epoch_us(o_orderdate) AS created_us,
  CASE WHEN o_orderstatus = 'F' THEN (SELECT max(epoch_us(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey) END AS closed_us,
  CASE WHEN o_custkey % 97 <> 0 THEN 'u' || o_custkey END AS reporter,
  list_filter([o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN 'Bug' END,
    CASE WHEN o_orderkey % 11 = 0 THEN 'Duplicate' END], lambda x: x IS NOT NULL) AS labels,
  list_filter(['u' || (o_custkey % 50), CASE WHEN o_orderkey % 2 = 0 THEN 'u' || (o_custkey % 31) END],
    lambda x: x IS NOT NULL) AS assignees,
  o_orderpriority
FROM orders"""

VIEWS["v_comments"] = f"""
SELECT *, {_refs("body", *DUP)} AS dup, {_refs("body", *REL)} AS rel FROM (
  SELECT l_orderkey AS k, pos, l_orderkey * 100 + pos AS comment_id, supplier AS author, ship_us AS created_us,
    repeat('text ', CAST(l_quantity AS INTEGER)) || CASE l_linenumber
      WHEN 3 THEN 'duplicate of #' || (l_partkey % 1000)
      WHEN 5 THEN 'similar to #' || (l_partkey % 1000) ELSE '' END AS body
  FROM v_lines)"""

VIEWS["v_comment_refs"] = """
SELECT k, flatten(list(dup ORDER BY pos)) AS dup, flatten(list(rel ORDER BY pos)) AS rel, count(*) AS n
FROM v_comments GROUP BY k"""

VIEWS["v_events"] = """
SELECT l_orderkey AS k, pos, ship_us AS us, supplier,
  CASE WHEN l_linenumber % 5 = 0 THEN 'X' WHEN l_linenumber = 7 THEN 'C' WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'L' END AS kind,
  CASE WHEN l_returnflag = 'R' THEN 'Bug' ELSE l_returnflag END AS label,
  CASE WHEN l_suppkey % 10 <> 0 THEN l_partkey END AS ref_number,
  CASE WHEN l_suppkey % 10 <> 0 THEN 'ref ' || l_partkey END AS ref_title,
  CASE WHEN l_suppkey % 10 = 0 THEN '' WHEN l_linestatus = 'O' THEN 'open' ELSE 'merged' END AS ref_state
FROM v_lines"""

VIEWS["v_fold"] = """
SELECT b.k, b.bug_pos, b.bug_us, a.first_assignee FROM (
  SELECT k, min(pos) AS bug_pos, arg_min(us, pos) AS bug_us FROM v_events
  WHERE kind = 'L' AND lower(label) = 'bug' GROUP BY k) b
LEFT JOIN (
  SELECT e.k, arg_min(e.supplier, e.pos) AS first_assignee
  FROM v_events e JOIN (SELECT k, min(pos) AS bug_pos FROM v_events
    WHERE kind = 'L' AND lower(label) = 'bug' GROUP BY k) f ON f.k = e.k AND e.pos > f.bug_pos
  WHERE e.kind = 'A' AND e.supplier IS NOT NULL GROUP BY e.k) a ON a.k = b.k"""

VIEWS["v_issues"] = f"""
SELECT r.k, r.repo, r.number, r.title, coalesce(r.body, '') AS body, r.state, r.created_us, r.closed_us, r.reporter,
  r.labels, r.assignees, f.first_assignee AS first_assignee_after_bug_label, f.bug_us AS first_bug_label_us,
  (list_contains(r.labels, 'Duplicate') OR len({_refs("r.body", *DUP)}) > 0) AS is_duplicate,
  list_concat({_refs("r.body", *DUP)}, coalesce(c.dup, CAST([] AS BIGINT[]))) AS duplicate_of,
  list_concat({_refs("r.body", *REL)}, coalesce(c.rel, CAST([] AS BIGINT[]))) AS related_issues,
  CASE WHEN regexp_matches(lower(r.o_orderpriority), 'p0|p1|p2|critical|high|medium|low') THEN r.o_orderpriority END AS priority_label,
  (r.closed_us - r.created_us) / 3.6e9::DOUBLE AS time_to_close_hours,
  coalesce(c.n, 0) AS kept_comments,
  (SELECT count(*) FROM lineitem WHERE l_orderkey = r.k) AS comment_count
FROM v_raw_issues r LEFT JOIN v_comment_refs c ON c.k = r.k LEFT JOIN v_fold f ON f.k = r.k"""

# ---- pull requests

VIEWS["v_pull_base"] = f"""
SELECT o_orderkey AS k, {_repo("o_orderkey")} AS repo, o_orderkey // 3 AS number, 'PR ' || (o_orderkey // 3) AS title,
  CASE WHEN o_custkey % 97 <> 0 THEN 'u' || o_custkey END AS author,
  coalesce(CASE o_orderkey % 5 WHEN 0 THEN 'This fixes #' || (o_orderkey % 400) || ' and closes #' || (o_orderkey % 300)
    WHEN 1 THEN repeat('why ', 30) WHEN 2 THEN NULL ELSE 'prefix #9' END, '') AS body,
  epoch_us(o_orderdate) AS created_us,
  CASE WHEN o_orderstatus = 'F' THEN epoch_us(o_orderdate) + 72 * 3600000000 END AS merged_us,
  CASE WHEN o_orderstatus <> 'O' THEN epoch_us(o_orderdate) + (o_orderkey % 100) * 3600000000 END AS closed_us,
  CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'P' THEN 'closed' ELSE 'open' END AS outcome,
  o_orderpriority AS labels, o_orderkey % 9 AS files_changed_count, o_orderkey % 500 AS additions, o_orderkey % 77 AS deletions
FROM orders"""

VIEWS["v_reviews"] = """
SELECT l_orderkey AS k, pos, supplier, l_returnflag AS state,
  CASE WHEN l_linenumber <> 6 THEN ship_us END AS us,
  CASE WHEN l_linenumber <> 1 THEN CAST(l_quantity AS INTEGER) ELSE 0 END AS chars
FROM v_lines"""

VIEWS["v_review_lists"] = """
SELECT k, min(us) AS first_us,
  string_agg(coalesce(supplier, '-') || '|' || state || '|' || coalesce(CAST(us AS VARCHAR), '-') || '|' || chars, ';' ORDER BY pos) AS reviews,
  array_to_string(list_sort(list(DISTINCT supplier) FILTER (supplier IS NOT NULL)), ',') AS unique_reviewers
FROM v_reviews GROUP BY k"""

VIEWS["v_requests"] = """
SELECT k, string_agg(who, ',' ORDER BY pos) AS requested FROM (
  SELECT l_orderkey AS k, pos, CASE WHEN l_linenumber % 2 = 1 THEN any_supplier
    WHEN l_linenumber % 4 = 0 THEN 'team' || (l_suppkey % 5) END AS who
  FROM v_lines) WHERE who IS NOT NULL GROUP BY k"""

VIEWS["v_inline"] = """
SELECT l_orderkey AS k, string_agg(coalesce(supplier, '-') || '|p' || l_partkey || '|' || 5 * CAST(l_quantity AS INTEGER), ';' ORDER BY pos) AS inline
FROM v_lines GROUP BY l_orderkey"""

VIEWS["v_pulls"] = f"""
SELECT b.*, {_refs("b.body", CLOSE_NUMBER)} AS closes, coalesce(q.requested, '') AS requested,
  coalesce(r.reviews, '') AS reviews, coalesce(r.unique_reviewers, '') AS unique_reviewers,
  (r.first_us - b.created_us) / 3.6e9::DOUBLE AS first_hours, coalesce(i.inline, '') AS inline
FROM v_pull_base b LEFT JOIN v_review_lists r ON r.k = b.k LEFT JOIN v_requests q ON q.k = b.k LEFT JOIN v_inline i ON i.k = b.k"""

# ---- contributor activity

VIEWS["v_activity"] = """
SELECT repo, login, 'total_commits' AS metric, 1 AS n FROM v_commits
UNION ALL SELECT i.repo, c.author, 'total_issue_comments', 1 FROM v_comments c JOIN v_raw_issues i ON i.k = c.k
UNION ALL SELECT b.repo, r.supplier, 'total_reviews_given', 1 FROM v_reviews r JOIN v_pull_base b ON b.k = r.k
UNION ALL SELECT b.repo, b.author, 'total_reviews_received', 1 FROM v_reviews r JOIN v_pull_base b ON b.k = r.k
UNION ALL SELECT repo, reporter, 'issues_reported', 1 FROM v_raw_issues
UNION ALL SELECT repo, unnest(assignees), 'issues_assigned', 1 FROM v_raw_issues"""

METRICS = (
    "total_commits total_issue_comments total_reviews_given total_reviews_received issues_reported issues_assigned"
).split()

VIEWS["v_totals"] = (
    "SELECT *, total_commits * 3 + total_reviews_given * 2 + total_issue_comments AS activity_score FROM (SELECT repo, login, "
    + ", ".join(f"count(*) FILTER (metric = '{m}') AS {m}" for m in METRICS)
    + " FROM v_activity WHERE login IS NOT NULL GROUP BY repo, login)"
    " WHERE total_commits > 0 OR total_issue_comments > 0 OR total_reviews_given > 0"
)

VIEWS["v_leaders"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY activity_score DESC, login) AS rank FROM v_totals)
WHERE rank <= 10"""

# ---- CI

VIEWS["v_runs"] = f"""
SELECT event_id AS run_id, {_repo("event_id")} AS repo,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'success' WHEN 'click' THEN 'success' WHEN 'view' THEN 'cancelled' END AS conclusion,
  CASE WHEN event_type = 'signup' THEN 'in_progress' ELSE 'completed' END AS status,
  CASE WHEN user_id % 29 <> 0 THEN 'u' || user_id END AS actor,
  'wf' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 10) AS workflow_name,
  md5(CAST(event_id AS VARCHAR)) AS head_sha, 'b' || (event_id % 7) AS head_branch,
  epoch_us(date_trunc('second', ts)) AS created_us,
  CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 50 AS VARCHAR) ELSE '' END AS pr_numbers
FROM events"""

VIEWS["v_failed_jobs"] = """
SELECT l_orderkey AS run_id, 'job' || l_linenumber || '-' || l_partkey AS job_name,
  array_to_string(list_filter([CASE WHEN l_linestatus = 'O' THEN 'build' END, CASE WHEN l_linenumber % 2 = 0 THEN 'test' END],
    lambda x: x IS NOT NULL), ',') AS steps, ship_us, l_linenumber AS line
FROM v_lines WHERE l_returnflag = 'R'"""

VIEWS["v_run_jobs"] = """
SELECT r.*, coalesce(j.jobs, '') AS failed_jobs, j.first_job, j.first_steps FROM v_runs r LEFT JOIN (
  SELECT run_id, string_agg(job_name || '|' || steps || '|' || ship_us, ';' ORDER BY line DESC, job_name, steps, ship_us) AS jobs,
    first(job_name ORDER BY line DESC, job_name, steps, ship_us) AS first_job,
    string_agg(nullif(steps, ''), ',' ORDER BY line DESC, job_name, steps, ship_us) AS first_steps
  FROM v_failed_jobs GROUP BY run_id) j ON j.run_id = r.run_id AND r.conclusion = 'failure'"""

# ---- threads

VIEWS["v_turns"] = f"""
SELECT conv_id, turn, role, text, {_repo("conv_id")} AS repo,
  CASE WHEN turn = 0 OR turn % 4 <> 3 THEN strftime(TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER) + to_minutes(turn::INTEGER), {ISO}) ELSE '' END AS stamp
FROM conversations"""

VIEWS["v_issue_posts"] = """
SELECT conv_id, repo, 0 AS n, CASE WHEN conv_id % 13 <> 0 THEN role ELSE 'unknown' END AS author, stamp,
  text AS body, false AS is_accepted, 'body' AS role
FROM v_turns WHERE turn = 0
UNION ALL
SELECT conv_id, repo, row_number() OVER (PARTITION BY conv_id ORDER BY turn), role, stamp, text, false, 'comment'
FROM v_turns WHERE turn >= 1"""

VIEWS["v_replies"] = "SELECT conv_id, count(*) FILTER (turn >= 1) AS n FROM conversations GROUP BY conv_id"

VIEWS["v_discussion_posts"] = f"""
WITH placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM v_turns WHERE turn >= 1),
shown AS (SELECT * FROM placed),
answer AS (SELECT conv_id, text AS abody, role AS aauthor FROM placed WHERE p = 1 AND conv_id % 3 = 0)
SELECT conv_id, repo, 0 AS n, CASE WHEN conv_id % 13 <> 0 THEN role ELSE 'unknown' END AS author, stamp, text AS body,
  false AS is_accepted, 'body' AS role
FROM v_turns WHERE turn = 0
UNION ALL
SELECT s.conv_id, s.repo, s.p, s.role, s.stamp, s.text, coalesce(s.text = a.abody AND s.role = a.aauthor, false), 'comment'
FROM shown s LEFT JOIN answer a USING (conv_id)
UNION ALL
SELECT t.conv_id, t.repo, least(r.n, 15) + 1, 'helper',
  strftime(TIMESTAMP '2024-01-01' + to_hours(t.conv_id::INTEGER) + to_minutes(90), {ISO}), 'Nested answer ' || t.conv_id, true, 'comment'
FROM v_turns t JOIN v_replies r USING (conv_id) WHERE t.turn = 0 AND t.conv_id % 3 = 1"""


def _thread_text(kind: str, posts: str, headers: str) -> str:
    return f"""
SELECT repo, conv_id AS number, '{kind} #' || conv_id || ': Conversation ' || conv_id || chr(10)
  || 'Author: ' || max(author) FILTER (n = 0) || chr(10) || 'Date: ' || max(stamp) FILTER (n = 0) || chr(10){headers}
  || chr(10) || '[c0]' || chr(10) || CASE WHEN max(body) FILTER (n = 0) = '' THEN '[no body]' ELSE max(body) FILTER (n = 0) END
  || chr(10) || chr(10) || '--- COMMENTS ---'
  || coalesce(string_agg(chr(10) || '[c' || n || ']' || CASE WHEN is_accepted THEN ' [ACCEPTED ANSWER]' ELSE '' END
    || ' @' || author || CASE WHEN stamp <> '' THEN ' ' || stamp ELSE '' END || ':' || chr(10) || body || chr(10) || '---', '' ORDER BY n)
    FILTER (n > 0), '') AS thread_text
FROM {posts} GROUP BY repo, conv_id"""


VIEWS["v_issue_text"] = _thread_text(
    "ISSUE",
    "(SELECT p.* FROM v_issue_posts p JOIN v_replies r USING (conv_id) WHERE r.n >= 1)",
    " || 'Labels: l' || (conv_id % 3) || ', chat' || chr(10) || 'State: open' || chr(10)",
)
VIEWS["v_discussion_text"] = _thread_text("DISCUSSION", "v_discussion_posts", "")

# ---- classification

VIEWS["v_docs"] = f"""
SELECT doc_id AS d, CASE WHEN doc_id % 2 = 0 THEN 'issue' ELSE 'discussion' END AS source, {_repo("doc_id")} AS repo,
  doc_id AS number, text, coalesce(quality, 0) AS quality, substr('ABCDEFGHIJK', (doc_id % 11 + 1)::INTEGER, 1) AS letter
FROM documents LEFT JOIN (SELECT doc_id, quality FROM labels) USING (doc_id)"""

# outcome of each stage stated from the rules that made the replies
VIEWS["v_stage1"] = """
SELECT *, CASE WHEN d % 10 <= 1 THEN 'parse_error_s1' WHEN d % 10 IN (3, 4) THEN 'no_qa' END AS gate,
  CASE WHEN d % 10 = 2 THEN 'B' WHEN d % 10 = 4 THEN 'Z' WHEN d % 10 >= 5 THEN letter END AS category,
  CASE WHEN d % 10 IN (2, 4) THEN 0.9::DOUBLE WHEN d % 10 >= 5 THEN CAST('0.' || lpad(CAST(50 + quality * 30 + d % 20 AS VARCHAR), 2, '0') AS DOUBLE)
    ELSE 0::DOUBLE END AS c1
FROM v_docs"""

VIEWS["v_results"] = """
SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN d % 7 IN (0, 2) THEN 'failed'
    WHEN confidence < 0.55::DOUBLE THEN 'low_confidence' ELSE 'kept' END AS outcome
FROM (SELECT *, (gate IS NULL AND d % 7 >= 3) AS is_full,
  CASE WHEN gate IS NOT NULL THEN c1 WHEN d % 7 IN (0, 2) THEN c1 * 0::DOUBLE WHEN d % 7 = 1 THEN c1 * 0.95::DOUBLE
    ELSE c1 * CAST('0.' || lpad(CAST(60 + d % 40 AS VARCHAR), 2, '0') AS DOUBLE) END AS confidence
FROM v_stage1)"""

# ---- review

VIEWS["v_pairs"] = f"""
SELECT q.conv_id AS c, q.turn AS t, {_repo("q.conv_id")} AS repo, CASE WHEN q.conv_id % 2 = 0 THEN 'issue' ELSE 'discussion' END AS source,
  q.conv_id * 1000 + q.turn AS number, CASE WHEN q.conv_id % 9 <> 0 THEN 'Conversation ' || q.conv_id END AS title,
  'Q' || ((q.conv_id + q.turn) % 37 + 1) AS question_id, q.text AS question_text, a.text AS answer_text,
  CAST((q.conv_id * 7 + q.turn) % 45 + 55 AS DOUBLE) / 100 AS confidence,
  substr('ABCDEFGHIJK', (q.conv_id % 11 + 1)::INTEGER, 1) AS stage1_category,
  {_repo("q.conv_id")} || '/' || CASE WHEN q.conv_id % 2 = 0 THEN 'issue' ELSE 'discussion' END || '/' || (q.conv_id * 1000 + q.turn)
    || '/Q' || ((q.conv_id + q.turn) % 37 + 1) AS pair_id
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'"""

# the last valid decision per pair, stated from the rules that made the requests
VIEWS["v_state"] = """
SELECT pair_id, number, CASE WHEN number % 5 = 0 THEN 'accepted' WHEN number % 6 = 0 THEN 'rejected' ELSE 'accepted' END AS status,
  CASE WHEN number % 5 = 0 THEN 'ok' WHEN number % 6 = 0 THEN 'wrong' ELSE '' END AS note,
  (1706745600 + CASE WHEN number % 5 = 0 THEN 2 WHEN number % 6 = 0 THEN 1 ELSE 0 END * 86400 + number * 60) * 1000000 AS verified_us
FROM v_pairs WHERE number % 5 = 0 OR number % 3 = 0"""

VIEWS["v_queue"] = """
SELECT p.*, coalesce(s.status, 'pending') AS status, coalesce(s.note, '') AS note
FROM v_pairs p LEFT JOIN v_state s USING (pair_id)"""


def _with(sql: str) -> str:
    """Put the views a query uses in front of it, each after those it uses itself."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                wanted.append(name)

    need(sql)
    steps = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in wanted)
    return f"WITH {steps}\n{sql}" if steps else sql


RAW: dict[str, str] = {}

# ---- normalised records

RAW["issue_records"] = f"""
SELECT repo, number, title, body, state, created_us, closed_us, reporter, {_text("labels")} AS labels, {_text("assignees")} AS assignees,
  first_assignee_after_bug_label, first_bug_label_us, is_duplicate, {_text("duplicate_of")} AS duplicate_of,
  {_text("related_issues")} AS related_issues, priority_label, time_to_close_hours, kept_comments, comment_count
FROM v_issues"""

RAW["timeline_fold"] = """
SELECT r.repo, r.number, f.first_assignee AS first_assignee_after_bug_label, f.bug_us AS first_bug_label_us,
  coalesce(e.assignments, '') AS assignments, coalesce(e.labels_applied, '') AS labels_applied,
  coalesce(e.cross_refs, '') AS cross_refs, e.last_closed_us
FROM v_raw_issues r LEFT JOIN v_fold f ON f.k = r.k LEFT JOIN (
  SELECT k, string_agg(supplier || '|' || us, ';' ORDER BY pos) FILTER (kind = 'A' AND supplier IS NOT NULL) AS assignments,
    string_agg(label || '|' || us, ';' ORDER BY pos) FILTER (kind = 'L') AS labels_applied,
    string_agg(coalesce(CAST(ref_number AS VARCHAR), '-') || '|' || coalesce(ref_title, '-') || '|' || ref_state || '|' || us, ';' ORDER BY pos)
      FILTER (kind = 'X') AS cross_refs,
    arg_max(us, pos) FILTER (kind = 'C') AS last_closed_us
  FROM v_events GROUP BY k) e ON e.k = r.k"""

RAW["issue_comment_refs"] = f"""
SELECT i.repo, i.number, c.comment_id, c.author, length(c.body) AS chars, c.created_us,
  {_text("c.dup")} AS duplicate_refs, {_text("c.rel")} AS related_refs
FROM v_comments c JOIN v_raw_issues i ON i.k = c.k"""

RAW["pull_request_records"] = f"""
SELECT repo, number, title, author, created_us, merged_us, closed_us, outcome, labels, files_changed_count, additions, deletions,
  {_text("closes")} AS closes_issues, requested AS requested_reviewers, reviews, unique_reviewers,
  first_hours AS hours_to_first_review, (closed_us - created_us) / 3.6e9::DOUBLE AS hours_open,
  length(body) >= 100 AS has_rationale, inline AS review_comments
FROM v_pulls"""

RAW["commit_records"] = f"""
SELECT c.repo, c.sha, c.message, 'Name ' || c.o_custkey AS author_name, c.o_custkey || '@example.org' AS author_email,
  c.login AS author_login, c.us AS committed_us, coalesce(f.paths, '') AS files_changed, coalesce(f.additions, 0) AS additions,
  coalesce(f.deletions, 0) AS deletions, CASE WHEN c.k >= 3 THEN md5(CAST(c.k - 3 AS VARCHAR)) ELSE '' END AS parents,
  {_text("c.refs")} AS closes_issues, c.is_fix_text AS is_bug_fix
FROM v_commits c LEFT JOIN (
  SELECT k, string_agg(path, ',' ORDER BY path) AS paths, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions
  FROM v_files GROUP BY k) f ON f.k = c.k"""

RAW["commit_parent_edges"] = "SELECT repo, sha, md5(CAST(k - 3 AS VARCHAR)) AS parent_sha FROM v_commits WHERE k >= 3"

RAW["ci_run_records"] = """
SELECT repo, run_id, workflow_name, head_sha, head_branch, actor, status, conclusion, created_us, created_us AS updated_us,
  pr_numbers, failed_jobs, coalesce(conclusion = 'failure', false) AS is_failure FROM v_run_jobs"""

RAW["labelled_issues"] = """
SELECT repo, number, title FROM v_raw_issues WHERE list_contains(labels, 'Bug') OR list_contains(labels, '1-URGENT')"""

RAW["selected_repos"] = "SELECT repo, sha, message FROM v_commits WHERE repo <> 'acme/r1'"

RAW["bounded_records"] = """
SELECT repo, number, len(labels) AS n_labels, least(n, 50) AS n_comments, least(n, 50) AS n_events, n AS total_comments
FROM (SELECT *, (SELECT count(*) FROM lineitem WHERE l_orderkey = k) AS n FROM v_raw_issues)"""

# ---- text

RAW["duplicate_refs"] = f"SELECT repo, number, {_text(_refs('body', *DUP))} AS refs FROM v_raw_issues"
RAW["related_refs"] = f"SELECT repo, number, {_text(_refs('body', *REL))} AS refs FROM v_raw_issues"
RAW["closing_refs"] = (
    f"SELECT repo, number, {_text('closes')} AS refs, "
    + _text(_refs("body", r"\b" + CLOSE_NUMBER))
    + " AS strict_refs FROM v_pulls"
)
RAW["commit_refs"] = f"SELECT repo, sha, {_text('refs')} AS refs, is_fix_text AS is_bug_fix FROM v_commits"
RAW["issue_mentions"] = f"""
SELECT 'issue' AS source, repo, number, unnest({_refs("body", r"#(\d+)")}) AS mentioned FROM v_raw_issues"""

RAW["path_ancestors"] = """
SELECT p.path, coalesce(string_agg(d.dir, ',' ORDER BY d.d), '') AS directories,
  len(p.path) - len(replace(p.path, '/', '')) < 2 AS shallow
FROM (SELECT DISTINCT path FROM v_touches) p LEFT JOIN v_dirs d USING (path) GROUP BY p.path"""


def _decoded(text: str, rounds: int) -> str:
    for _ in range(rounds):
        for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
            text = f"replace({text}, '{entity}', '{plain}')"
    return text


RAW["decoded_pages"] = f"""
SELECT page_id, length(plain) AS chars, md5(plain) AS digest FROM (SELECT page_id, {_decoded("html", 6)} AS plain FROM pages)"""

# ---- commits, files, people

RAW["inducing_commits"] = "SELECT * FROM v_inducing"
RAW["file_ownership"] = """
SELECT repo, path AS filepath, count(*) AS total_commits,
  coalesce(array_to_string(list_sort(list(DISTINCT login) FILTER (login IS NOT NULL)), ','), '') AS unique_authors
FROM v_touches GROUP BY ALL"""
RAW["file_authors"] = "SELECT repo, path AS filepath, login, count(*) AS commits FROM v_touches GROUP BY ALL"
RAW["commits_per_author"] = """
SELECT repo, login, count(*) AS total_commits FROM v_commits WHERE login IS NOT NULL GROUP BY ALL"""
RAW["path_expertise"] = "SELECT repo, login, path, commits FROM v_expertise"
RAW["top_paths"] = "SELECT repo, login, path, commits, rank FROM v_top"
RAW["top_directories"] = """
SELECT repo, login, path, commits FROM v_top WHERE len(path) - len(replace(path, '/', '')) < 2"""
RAW["path_experts"] = "SELECT repo, login, path, commits, rank FROM v_experts"
RAW["file_experts"] = """
SELECT repo, path AS file, string_agg(login || '|' || commits, ';' ORDER BY rank) AS experts FROM v_experts GROUP BY ALL"""
RAW["latest_modifier"] = "SELECT repo, file, login FROM v_latest"
RAW["contributor_activity"] = "SELECT * FROM v_totals"
RAW["contributor_profiles"] = """
SELECT t.*, coalesce(p.top_files, '') AS top_files, coalesce(p.top_directories, '') AS top_directories
FROM v_totals t LEFT JOIN (
  SELECT repo, login, string_agg(path || '|' || commits, ';' ORDER BY rank) AS top_files,
    string_agg(path || '|' || commits, ';' ORDER BY rank) FILTER (len(path) - len(replace(path, '/', '')) < 2) AS top_directories
  FROM v_top GROUP BY ALL) p USING (repo, login)"""
RAW["most_active"] = "SELECT repo, login, activity_score, rank FROM v_leaders"

# ---- CI and reviews

RAW["ci_actor_failure_rates"] = """
SELECT repo, actor, count(*) FILTER (conclusion = 'failure') AS failures, count(*) AS total_runs,
  count(*) FILTER (conclusion = 'failure') / count(*)::DOUBLE AS failure_rate
FROM v_runs GROUP BY repo, actor"""
RAW["ci_workflow_failures"] = """
SELECT repo, workflow_name AS workflow, count(*) AS failure_count FROM v_runs WHERE conclusion = 'failure' GROUP BY ALL"""
RAW["running_ci_counters"] = RAW["ci_actor_failure_rates"]
RAW["review_time_medians"] = """
SELECT repo, round(median(first_hours), 6) AS median_hours, count(first_hours) AS sample_size
FROM v_pulls GROUP BY repo HAVING count(first_hours) >= 5"""

# ---- question/answer pairs


def _question(opening: str, alias: str) -> str:
    return (
        f"'{opening}' || chr(10) || chr(10) || 'Title: ' || {alias}.title || chr(10) || 'Body: ' || {alias}.body"
    )


VIEWS["v_positive"] = """
SELECT i.repo, i.number, i.title, i.body, o.number AS target, o.title AS target_title, o.body AS target_body
FROM (SELECT repo, number, title, body, unnest(duplicate_of) AS target FROM v_issues) i
JOIN v_issues o ON o.repo = i.repo AND o.number = i.target"""

VIEWS["v_plain"] = """
SELECT *, row_number() OVER (PARTITION BY repo ORDER BY number) AS rank, count(*) OVER (PARTITION BY repo) AS n
FROM v_issues WHERE len(duplicate_of) = 0 AND NOT is_duplicate"""

VIEWS["v_negative"] = """
SELECT a.repo, a.number, a.title, a.body, b.number AS partner, b.title AS partner_title
FROM v_plain a
JOIN (SELECT repo, count(*) FILTER (len(duplicate_of) > 0) AS positives FROM v_issues GROUP BY repo) s
  ON s.repo = a.repo AND a.rank <= s.positives
JOIN v_plain b ON b.repo = a.repo
  AND b.rank = CAST('0x' || substr(md5('42:' || a.repo || ':' || a.number), 1, 12) AS BIGINT) % a.n + 1
WHERE a.number <> b.number"""

RAW["duplicate_positive_pairs"] = f"""
SELECT 'Q53' AS question_id, repo, number AS issue_number, 1 AS tier, {_question("Has this bug been reported before?", "p")} AS question,
  true AS is_duplicate, target, target_title, target_body AS candidate_body
FROM v_positive p"""

RAW["duplicate_negative_pairs"] = f"""
SELECT 'Q53' AS question_id, repo, number AS issue_number, 1 AS tier, {_question("Has this bug been reported before?", "p")} AS question,
  false AS is_duplicate, CAST(NULL AS BIGINT) AS target, partner, partner_title
FROM v_negative p"""

VIEWS["v_assigned"] = f"""
SELECT repo, number, labels, first_assignee_after_bug_label AS assignee,
  {_question("Who should be assigned this bug?", "i")} || chr(10) || 'Labels: ' || {_text("labels", ", ")} AS question
FROM v_issues i WHERE first_assignee_after_bug_label <> ''"""

RAW["assignment_pairs"] = """
SELECT 'Q54' AS question_id, a.repo, a.number AS issue_number, 2 AS tier, a.question, a.assignee, a.labels[1] AS first_label,
  l.login AS leader, l.total_commits AS leader_commits, f.path AS leader_file, t.login AS tenth
FROM v_assigned a LEFT JOIN v_leaders l ON l.repo = a.repo AND l.rank = 1
LEFT JOIN v_top f ON f.repo = a.repo AND f.login = l.login AND f.rank = 5
LEFT JOIN v_leaders t ON t.repo = a.repo AND t.rank = 10"""

RAW["resolved_assignment_pairs"] = RAW["assignment_pairs"]
RAW["shared_profiles"] = """
SELECT l.repo, 0 AS part, l.rank - 1 AS place, l.login, l.total_commits, f.path AS fifth_file
FROM v_leaders l LEFT JOIN v_top f ON f.repo = l.repo AND f.login = l.login AND f.rank = 5"""

RAW["regression_pairs"] = """
SELECT 'Q56' AS question_id, repo, issue_number, 1 AS tier,
  'Which commit introduced the regression in issue #' || issue_number || '?' AS question,
  inducing_sha, inducing_author, file, fix_sha
FROM v_inducing"""

VIEWS["v_broken"] = "SELECT * FROM v_run_jobs WHERE conclusion = 'failure' AND failed_jobs <> ''"
CAUSE = "'What caused this build to break? (Run ID: ' || run_id || ', Workflow: ' || workflow_name || ')'"
BREAKER = "'Who caused this build to break? (Run ID: ' || run_id || ')'"

RAW["breakage_cause_pairs"] = f"""
SELECT 'Q32' AS question_id, repo, CAST(NULL AS BIGINT) AS issue_number, 1 AS tier, {CAUSE} AS question,
  head_sha AS triggering_sha, first_job, nullif(string_split(coalesce(first_steps, ''), ',')[1], '') AS first_step, head_branch AS branch
FROM v_broken"""

RAW["breakage_actor_pairs"] = f"""
SELECT 'Q33' AS question_id, repo, CAST(NULL AS BIGINT) AS issue_number, 1 AS tier, {BREAKER} AS question,
  actor, workflow_name AS workflow
FROM v_broken WHERE actor IS NOT NULL"""

LATEST = "'Who most recently modified this file?' || chr(10) || chr(10) || 'File: ' || file"
MOST = "'Who has modified this file most frequently?' || chr(10) || chr(10) || 'File: ' || file"
VIEWS["v_latest_owner"] = """
SELECT l.* FROM v_latest l WHERE l.login IS NOT NULL"""

RAW["latest_owner_pairs"] = f"""
SELECT 'Q18' AS question_id, repo, CAST(NULL AS BIGINT) AS issue_number, 1 AS tier, {LATEST} AS question, login, file AS file_path
FROM v_latest_owner"""

VIEWS["v_primary_owner"] = """
SELECT repo, path AS file, max(login) FILTER (WHERE rank = 1) AS login, max(commits) FILTER (WHERE rank = 1) AS commits,
  max(login) FILTER (WHERE rank = 2) AS second
FROM v_experts GROUP BY repo, path"""

RAW["primary_owner_pairs"] = f"""
SELECT 'Q19' AS question_id, repo, CAST(NULL AS BIGINT) AS issue_number, 1 AS tier, {MOST} AS question, login,
  commits AS commit_count, second
FROM v_primary_owner"""

REVIEW_TIME = "'How long does PR review typically take in ' || repo || '?'"
RAW["review_time_pairs"] = f"""
SELECT 'Q50' AS question_id, repo, CAST(NULL AS BIGINT) AS issue_number, 1 AS tier, {REVIEW_TIME} AS question,
  round(median(first_hours), 1) AS median_hours, count(first_hours) AS sample_size,
  arg_min(first_hours, number) AS first_sample
FROM v_pulls GROUP BY repo HAVING count(first_hours) >= 5"""

RAW["shared_review_history"] = """
SELECT repo, (place - 1) // 4096 AS part, count(*) AS samples,
  round(arg_min(first_hours, place), 6) AS first_hours, round(arg_max(first_hours, place), 6) AS last_hours
FROM (SELECT repo, first_hours, row_number() OVER (PARTITION BY repo ORDER BY number) AS place
  FROM v_pulls WHERE first_hours IS NOT NULL) GROUP BY ALL"""

VIEWS["v_all_pairs"] = f"""
SELECT 'Q53' AS question_id, repo, number AS issue_number, 1 AS tier, {_question("Has this bug been reported before?", "p")} AS question FROM v_positive p
UNION ALL SELECT 'Q53', repo, number, 1, {_question("Has this bug been reported before?", "p")} FROM v_negative p
UNION ALL SELECT 'Q54', repo, number, 2, question FROM v_assigned
UNION ALL SELECT 'Q56', repo, issue_number, 1, 'Which commit introduced the regression in issue #' || issue_number || '?' FROM v_inducing
UNION ALL SELECT 'Q32', repo, NULL, 1, {CAUSE} FROM v_broken
UNION ALL SELECT 'Q33', repo, NULL, 1, {BREAKER} FROM v_broken WHERE actor IS NOT NULL
UNION ALL SELECT 'Q18', repo, NULL, 1, {LATEST} FROM v_latest_owner
UNION ALL SELECT 'Q19', repo, NULL, 1, {MOST} FROM v_primary_owner
UNION ALL SELECT 'Q50', repo, NULL, 1, {REVIEW_TIME} FROM v_pulls GROUP BY repo HAVING count(first_hours) >= 5"""

RAW["all_qa_pairs"] = "SELECT question_id, repo, issue_number, tier, question FROM v_all_pairs"
# no list of the sample is longer than one request returns
RAW["bounded_pull_records"] = RAW["pull_request_records"]
RAW["qa_builder_counts"] = """
SELECT 'duplicate_positives' AS builder, count(*) AS n FROM v_positive
UNION ALL SELECT 'duplicate_negatives', count(*) FROM v_negative
UNION ALL SELECT 'assignment', count(*) FROM v_assigned
UNION ALL SELECT 'regression', count(*) FROM v_inducing
UNION ALL SELECT 'breakage_cause', count(*) FROM v_broken
UNION ALL SELECT 'breakage_actor', count(*) FROM v_broken WHERE actor IS NOT NULL
UNION ALL SELECT 'latest_owner', count(*) FROM v_latest_owner
UNION ALL SELECT 'primary_owner', count(*) FROM v_primary_owner
UNION ALL SELECT 'review_time', count(*) FROM (SELECT repo FROM v_pulls GROUP BY repo HAVING count(first_hours) >= 5)"""
RAW["qa_pair_counts"] = "SELECT repo, question_id, count(*) AS n FROM v_all_pairs GROUP BY ALL"

# ---- threads

RAW["issue_thread_comments"] = """
SELECT repo, conv_id AS number, 'c' || n AS comment_id, author, stamp AS posted_at, body, is_accepted, role
FROM v_issue_posts JOIN v_replies r USING (conv_id) WHERE r.n >= 1""".replace("'c' || n", "'c' || v_issue_posts.n")
RAW["discussion_thread_comments"] = """
SELECT repo, conv_id AS number, 'c' || n AS comment_id, author, stamp AS posted_at, body, is_accepted, role FROM v_discussion_posts"""
RAW["comment_days"] = "SELECT repo, substr(stamp, 1, 10) AS day, count(*) AS n FROM v_discussion_posts GROUP BY ALL"
RAW["issue_thread_text"] = "SELECT repo, number, thread_text FROM v_issue_text"
RAW["incremental_threads"] = RAW["issue_thread_text"]
RAW["bounded_discussions"] = "SELECT repo, conv_id AS number, n AS total_comments, least(n, 15) AS n_comments FROM v_openings"
RAW["discussion_thread_text"] = "SELECT repo, number, thread_text FROM v_discussion_text"
VIEWS["v_openings"] = """
SELECT t.*, r.n, epoch_us(TIMESTAMP '2024-01-01' + to_hours(conv_id::INTEGER)) AS us
FROM v_turns t JOIN v_replies r USING (conv_id) WHERE t.turn = 0"""
RAW["thread_records"] = """
SELECT 'issue' AS source, repo, conv_id AS number, 'Conversation ' || conv_id AS title, n AS comment_count,
  'l' || (conv_id % 3) || ',chat' AS labels, 'open' AS state, us AS created_us, CASE WHEN conv_id % 13 <> 0 THEN role END AS reporter,
  CAST(NULL AS BOOLEAN) AS has_accepted_answer, CAST(NULL AS VARCHAR) AS author,
  'https://github.com/' || repo || '/issues/' || conv_id AS url
FROM v_openings WHERE n >= 1
UNION ALL
SELECT 'discussion', repo, conv_id, 'Conversation ' || conv_id, n, NULL, NULL, us, NULL, (conv_id % 3 = 1 OR conv_id % 3 = 0 AND n >= 1),
  CASE WHEN conv_id % 13 <> 0 THEN role ELSE 'unknown' END, 'https://github.com/' || repo || '/discussions/' || conv_id
FROM v_openings"""

_SQUASHED = r"lower(trim(regexp_replace(CASE WHEN p.n = 0 AND p.body = '' THEN '[no body]' ELSE p.body END, '\s+', ' ', 'g')))"
RAW["reread_thread_comments"] = f"""
SELECT 'issue' AS source, p.repo, p.conv_id AS number, p.n AS position, p.author, p.stamp AS posted_at, p.is_accepted, {_SQUASHED} AS body
FROM v_issue_posts p JOIN v_replies r USING (conv_id) WHERE r.n >= 1
UNION ALL
SELECT 'discussion', p.repo, p.conv_id, p.n, p.author, p.stamp AS posted_at, p.is_accepted, {_SQUASHED} FROM v_discussion_posts p"""

# ---- classification


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BLOCK = "'<thread>' || chr(10) || text || chr(10) || '</thread>' || chr(10) || chr(10) || "
RAW["stage1_prompts"] = (
    f"SELECT repo, source, number, md5({_BLOCK}"
    + _literal(STAGE1_TASK.format(categories=taxonomy.category_list()))
    + ") AS digest FROM v_docs"
)

_TEXTS = taxonomy.questions()
_CATEGORY_ROWS = ", ".join(
    f"({_literal(k)}, {_literal(name)}, "
    + _literal("\n".join(f"{q}: {_TEXTS[q]}" for q in taxonomy.category_questions(k)))
    + ")"
    for k, name in taxonomy.CATEGORIES.items()
)
RAW["stage2_prompts"] = f"""
SELECT repo, source, number, s.category, md5({_BLOCK}'Category: ' || c.name || chr(10) || chr(10) || 'Questions:' || chr(10) || c.list
  || {_literal(chr(10) + "NONE: none of the above" + chr(10) * 2 + STAGE2_TASK)}) AS digest
FROM v_stage1 s JOIN (VALUES {_CATEGORY_ROWS}) c(category, name, list) ON c.category = s.category
WHERE s.gate IS NULL"""

RAW["parsed_replies"] = """
SELECT repo, source, number, 1::BIGINT AS stage, d % 10 > 1 AS readable,
  CASE WHEN d % 10 = 1 THEN 0 WHEN d % 10 = 3 THEN 0.4 ELSE c1 END::DOUBLE AS confidence,
  CASE d % 10 WHEN 1 THEN NULL WHEN 2 THEN 'b' WHEN 3 THEN 'A' ELSE category END AS category, CAST(NULL AS VARCHAR) AS question_id
FROM v_stage1 WHERE d % 10 > 0
UNION ALL
SELECT repo, source, number, 2, d % 7 <> 2,
  CASE WHEN d % 7 = 1 THEN 0.95 WHEN d % 7 = 2 THEN 0 ELSE CAST('0.' || lpad(CAST(60 + d % 40 AS VARCHAR), 2, '0') AS DOUBLE) END::DOUBLE,
  NULL, CASE WHEN d % 7 = 1 THEN 'NONE' WHEN d % 7 > 2 THEN 'Q' || (d % 37 + 1) END
FROM v_stage1 WHERE d % 7 > 0"""

RAW["stage1_gates"] = "SELECT repo, source, number, gate AS outcome, category, c1 AS s1_confidence FROM v_stage1"

RAW["classified_threads"] = """
SELECT repo, source, number, outcome, category AS stage1_category,
  CASE WHEN is_full THEN 'Q' || (d % 37 + 1) ELSE 'NONE' END AS question_id,
  CASE WHEN is_full THEN 'Who owns file ' || d ELSE '' END AS question_text,
  CASE WHEN is_full THEN 'u' || (d % 17) ELSE '' END AS question_author,
  CASE WHEN is_full THEN 'c0' ELSE '' END AS question_comment_id,
  CASE WHEN is_full THEN 'owner ' || (d % 5) ELSE '' END AS answer_text,
  CASE WHEN is_full THEN 'u' || (d % 11) ELSE '' END AS answer_author,
  is_full AND d % 2 = 0 AS answer_is_accepted, round(confidence, 9) AS confidence,
  CASE WHEN is_full THEN 'named' ELSE '' END AS reasoning
FROM v_results"""

RAW["natural_qa_pairs"] = """
SELECT repo, source, number, 'Doc ' || d AS title, 'https://example.org/' || d AS url, (1704067200 + d * 60) * 1000000 AS created_us,
  CASE WHEN is_full THEN 'Q' || (d % 37 + 1) ELSE 'NONE' END AS question_id,
  CASE WHEN is_full THEN 'owner ' || (d % 5) ELSE '' END AS answer_text, round(confidence, 9) AS confidence, text AS thread_text,
  'm:1' AS stage1_model, 'm/2' AS stage2_model, 1::BIGINT AS n_comments
FROM v_results WHERE outcome = 'kept'"""

RAW["classification_summary"] = "SELECT repo, outcome, count(*) AS n FROM v_results GROUP BY ALL"
_QUESTION_ROWS = ", ".join(f"({_literal(q)}, {_literal(t)})" for q, t in _TEXTS.items())
RAW["question_counts"] = f"""
SELECT k.question_id, coalesce(q.description, '') AS description, k.n FROM (
  SELECT CASE WHEN is_full THEN 'Q' || (d % 37 + 1) ELSE 'NONE' END AS question_id, count(*) AS n
  FROM v_results WHERE outcome = 'kept' GROUP BY ALL) k
LEFT JOIN (VALUES {_QUESTION_ROWS}) q(question_id, description) USING (question_id)"""
RAW["taxonomy_usage"] = f"""
SELECT q.question_id, q.description, q.active, coalesce(k.n, 0) AS n FROM (
  SELECT question_id, description, true AS active FROM (VALUES {_QUESTION_ROWS}) v(question_id, description)
  UNION ALL SELECT 'Q' || r.range, '', false FROM range(38, 47) r) q
LEFT JOIN ({RAW["question_counts"]}) k USING (question_id)"""
RAW["unprocessed_threads"] = "SELECT repo, source, number FROM v_stage1 WHERE gate IS NULL"
RAW["incremental_classification"] = "SELECT repo, source, number, outcome FROM v_results"

# ---- review

RAW["verification_current"] = "SELECT pair_id, status, note, verified_us FROM v_state"
RAW["verification_rejects"] = "SELECT pair_id, 'maybe' AS status FROM v_pairs WHERE number % 7 = 0"
RAW["review_queue"] = """
SELECT pair_id, repo, question_id, number, question_text, title, confidence, stage1_category, source, status, note FROM v_queue"""
RAW["review_search"] = """
SELECT pair_id, question_text, title, status, note FROM v_queue WHERE repo = 'acme/r1' AND status = 'accepted'
  AND (lower(question_text) LIKE '%the%' OR lower(answer_text) LIKE '%the%' OR lower(coalesce(title, '')) LIKE '%the%')"""
RAW["review_page"] = """
SELECT pair_id, number, confidence FROM v_queue WHERE status = 'pending'
ORDER BY repo, source, number, question_id LIMIT 20 OFFSET 20"""
RAW["review_page_total"] = """
SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM v_queue WHERE status = 'pending'"""
RAW["review_next_page"] = """
SELECT pair_id, number, confidence FROM v_queue WHERE status = 'pending'
  AND (repo > 'acme/r0' OR repo = 'acme/r0' AND source = 'issue' AND (number > 30000 OR number = 30000 AND question_id > 'Q1'))
ORDER BY repo, source, number, question_id LIMIT 20"""
RAW["review_pair_detail"] = """
SELECT pair_id, question_text, answer_text, status, note FROM v_queue WHERE pair_id = 'acme/r0/issue/0/Q1'"""
RAW["review_statistics"] = """
SELECT 'total' AS kind, '' AS key, count(*) AS n FROM v_queue
UNION ALL SELECT 'status', status, count(*) FROM v_queue GROUP BY status
UNION ALL SELECT 'repo', repo, count(*) FROM v_queue GROUP BY repo
UNION ALL SELECT 'question_id', question_id, count(*) FROM v_queue GROUP BY question_id"""
RAW["review_progress"] = """
SELECT count(*) AS total, count(*) FILTER (status <> 'pending') AS done,
  CAST(round(count(*) FILTER (status <> 'pending') / count(*)::DOUBLE * 100) AS BIGINT) AS percent FROM v_queue"""
RAW["review_confidence_bands"] = """
SELECT repo, CASE WHEN confidence >= 0.8::DOUBLE THEN 'high' WHEN confidence >= 0.6::DOUBLE THEN 'mid' ELSE 'low' END AS band, count(*) AS n
FROM v_pairs GROUP BY ALL"""
RAW["review_facets"] = """
SELECT DISTINCT 'repo' AS facet, repo AS value FROM v_pairs UNION ALL SELECT DISTINCT 'question_id', question_id FROM v_pairs"""
RAW["review_export"] = """
SELECT source, repo, number, question_id, question_text, answer_text FROM v_queue WHERE status = 'accepted'"""
RAW["long_thread_outcomes"] = """
SELECT * FROM (WITH parts AS (
  SELECT repo, source, number, 0 AS part, text FROM v_docs WHERE len(text) <= 1500
  UNION ALL
  SELECT repo, source, number, k, substr(text, (k * 750 + 1)::BIGINT, 750)
  FROM (SELECT *, unnest(range((len(text) + 749) // 750)) AS k FROM v_docs WHERE len(text) > 1500)
), words AS (
  SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM parts
), hits AS (
  SELECT *, len(list_intersect(w, ['the', 'and'])) AS a, len(list_intersect(w, ['der', 'und'])) AS d,
    len(list_intersect(w, ['les', 'que'])) AS f FROM words
), judged AS (
  SELECT repo, source, number, part, greatest(a, d, f) AS n,
    CASE WHEN a >= d AND a >= f THEN 'A' WHEN d >= f THEN 'D' ELSE 'F' END AS c FROM hits
), results AS (
  SELECT *, CASE n WHEN 0 THEN 0::DOUBLE ELSE (n::DOUBLE / (n + 1)) * 0.9::DOUBLE END AS confidence FROM judged
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY repo, source, number ORDER BY confidence DESC, part) AS rank FROM results
)
SELECT repo, source, number, CASE WHEN n = 0 THEN 'no_qa' WHEN confidence < 0.55 THEN 'low_confidence' ELSE 'kept' END AS outcome,
  CASE WHEN n > 0 THEN c END AS stage1_category, CASE WHEN n = 0 THEN 'NONE' WHEN c = 'A' THEN 'Q1' WHEN c = 'D' THEN 'Q32' ELSE 'Q50' END AS question_id,
  round(confidence, 9) AS confidence
FROM ranked WHERE rank = 1)"""
RAW["migrated_verification"] = "SELECT pair_id, status, note FROM v_state"
RAW["verification_state"] = "SELECT pair_id, status, note, verified_us FROM v_state"
RAW["line_ordinals"] = """
SELECT pair_id, row_number() OVER (ORDER BY replace(repo, '/', '__'), source, number, question_id) - 1 AS ordinal FROM v_pairs"""
RAW["landing_rejects"] = """
SELECT number, CASE number % 17 WHEN 3 THEN 'not JSON' WHEN 5 THEN 'wrong type' WHEN 7 THEN 'no key' ELSE 'good' END AS reason
FROM (SELECT DISTINCT conv_id AS number FROM v_openings)
UNION ALL SELECT conv_id, 'no detail' FROM v_openings WHERE conv_id % 17 IN (3, 5, 7)"""
RAW["one_scan_history"] = """
SELECT 'commits' AS dataset, repo, sha, CAST(NULL AS VARCHAR) AS path FROM v_commits
UNION ALL
SELECT 'touches', c.repo, c.sha, p.path FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l
JOIN v_commits c ON c.k = l.l_orderkey JOIN v_parts p ON p.p_partkey = l.l_partkey"""
RAW["stored_natural_pairs"] = f"""
SELECT source, repo, number, title, comment_count, 'Q' || (number % 37 + 1) AS question_id, 'owner ' || number AS answer_text,
  0.72::DOUBLE AS confidence, substr('ABCDEFGHIJK', (number % 11 + 1)::INTEGER, 1) AS stage1_category
FROM ({RAW["thread_records"]}) WHERE number % 5 >= 2 AND number % 7 >= 2"""


def _evidence(body: str, quote: str) -> str:
    squash = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
    needle = squash.format(quote)
    return f"(length({needle}) > 10 AND contains({squash.format(body)}, {needle}))"


RAW["evidence_tags"] = f"""
SELECT pair_id, 'c0' AS comment_id, 'user' AS author,
  CASE WHEN c % 2 = 0 THEN true ELSE {_evidence("question_text", "question_text")} END AS is_question,
  CASE WHEN c % 4 = 0 THEN false ELSE {_evidence("question_text", "answer_text")} END AS is_answer, false AS is_accepted
FROM v_pairs
UNION ALL
SELECT pair_id, 'c1', 'assistant', CASE WHEN c % 2 = 0 THEN false ELSE {_evidence("answer_text", "question_text")} END,
  CASE WHEN c % 4 = 0 THEN true ELSE {_evidence("answer_text", "answer_text")} END, true
FROM v_pairs"""

# ---- direct questions

RAW["review_load"] = """
SELECT repo, reviewer, count(*) AS open_reviews FROM (
  SELECT repo, unnest(string_split(requested, ',')) AS reviewer FROM v_pulls WHERE outcome = 'open' AND requested <> '') GROUP BY ALL"""
RAW["file_creators"] = """
SELECT repo, path, f.login AS login, f.sha AS sha FROM (
  SELECT repo, path, min({'us': us, 'sha': sha, 'login': login}) AS f FROM v_touches GROUP BY ALL)"""
RAW["most_changed_files"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commits DESC, path) AS rank FROM (
  SELECT repo, path, count(*) AS commits FROM v_touches GROUP BY ALL)) WHERE rank <= 20"""
RAW["recently_changed_files"] = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY changed_us DESC, path) AS rank FROM (
  SELECT repo, path, max(us) AS changed_us FROM v_touches GROUP BY ALL)) WHERE rank <= 20"""
RAW["closing_links"] = """
SELECT p.repo, p.number AS pr_number, p.outcome, i.number AS issue_number, i.state AS issue_state
FROM (SELECT repo, number, outcome, unnest(closes) AS n FROM v_pulls) p JOIN v_raw_issues i ON i.repo = p.repo AND i.number = p.n"""
RAW["longest_waiting"] = """
SELECT * FROM (SELECT repo, number, created_us, row_number() OVER (PARTITION BY repo ORDER BY created_us, number) AS rank
  FROM v_pulls WHERE outcome = 'open' AND first_hours IS NULL) WHERE rank <= 20"""
RAW["issue_priorities"] = "SELECT repo, priority_label, state, count(*) AS n FROM v_issues GROUP BY ALL"
RAW["related_not_duplicate"] = """
SELECT DISTINCT repo, number, related_number FROM (
  SELECT repo, number, duplicate_of, unnest(related_issues) AS related_number FROM v_issues)
WHERE NOT list_contains(duplicate_of, related_number)"""
RAW["time_to_fix_by_label"] = """
SELECT repo, label, round(median(h), 6) AS median_hours, count(*) AS sample_size FROM (
  SELECT repo, unnest(labels) AS label, time_to_close_hours AS h FROM v_issues WHERE time_to_close_hours IS NOT NULL) GROUP BY ALL"""
RAW["issue_lifecycle"] = """
SELECT repo, number, created_us AS at_us, 'opened' AS kind, reporter AS detail FROM v_raw_issues
UNION ALL SELECT repo, number, closed_us, 'closed', NULL FROM v_raw_issues WHERE closed_us IS NOT NULL
UNION ALL SELECT i.repo, i.number, e.us, CASE e.kind WHEN 'L' THEN 'labeled' WHEN 'A' THEN 'assigned' ELSE 'referenced' END,
  CASE e.kind WHEN 'L' THEN e.label WHEN 'A' THEN e.supplier ELSE CAST(e.ref_number AS VARCHAR) END
FROM v_events e JOIN v_raw_issues i ON i.k = e.k WHERE e.kind = 'L' OR e.kind = 'A' AND e.supplier IS NOT NULL OR e.kind = 'X'"""

ORACLES: dict[str, str] = {name: _with(sql) for name, sql in RAW.items()}
