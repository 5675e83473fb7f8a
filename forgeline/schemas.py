"""Explicit schemas of the landed (raw) and derived tables, as Spark DDL."""

RAW_ISSUE = """
repo STRING, number BIGINT, title STRING, body STRING, state STRING,
createdAt STRING, closedAt STRING, author STRUCT<login:STRING>,
labels STRUCT<nodes:ARRAY<STRUCT<name:STRING>>>,
assignees STRUCT<nodes:ARRAY<STRUCT<login:STRING>>>,
comments STRUCT<totalCount:BIGINT, nodes:ARRAY<STRUCT<databaseId:BIGINT,
  author:STRUCT<login:STRING>, body:STRING, createdAt:STRING>>>,
timelineItems STRUCT<nodes:ARRAY<STRUCT<__typename:STRING, createdAt:STRING,
  assignee:STRUCT<login:STRING>, label:STRUCT<name:STRING>,
  source:STRUCT<number:BIGINT, title:STRING, state:STRING>>>>
"""

RAW_PULL_REQUEST = """
repo STRING, number BIGINT, title STRING, body STRING, state STRING,
createdAt STRING, mergedAt STRING, closedAt STRING, author STRUCT<login:STRING>,
labels STRUCT<nodes:ARRAY<STRUCT<name:STRING>>>,
additions BIGINT, deletions BIGINT, changedFiles BIGINT,
reviewRequests STRUCT<nodes:ARRAY<STRUCT<requestedReviewer:STRUCT<login:STRING, slug:STRING>>>>,
reviews STRUCT<nodes:ARRAY<STRUCT<author:STRUCT<login:STRING>, state:STRING,
  submittedAt:STRING, body:STRING>>>,
reviewThreads STRUCT<nodes:ARRAY<STRUCT<comments:STRUCT<nodes:ARRAY<STRUCT<
  author:STRUCT<login:STRING>, path:STRING, body:STRING, createdAt:STRING>>>>>>
"""

RAW_DISCUSSION = """
repo STRING, number BIGINT, title STRING, body STRING, createdAt STRING,
author STRUCT<login:STRING>,
answer STRUCT<body:STRING, createdAt:STRING, author:STRUCT<login:STRING>>,
comments STRUCT<totalCount:BIGINT, nodes:ARRAY<STRUCT<body:STRING, createdAt:STRING,
  author:STRUCT<login:STRING>>>>
"""

RAW_COMMIT_LISTING = "repo STRING, sha STRING"

RAW_COMMIT = """
repo STRING, sha STRING,
commit STRUCT<message:STRING, author:STRUCT<name:STRING, email:STRING, date:STRING>>,
author STRUCT<login:STRING>,
files ARRAY<STRUCT<filename:STRING, additions:BIGINT, deletions:BIGINT>>,
parents ARRAY<STRUCT<sha:STRING>>
"""

RAW_CI_RUN = """
repo STRING, id BIGINT, conclusion STRING, status STRING,
triggering_actor STRUCT<login:STRING>, name STRING, head_sha STRING, head_branch STRING,
created_at STRING, updated_at STRING, pull_requests ARRAY<STRUCT<number:BIGINT>>
"""

RAW_CI_JOB = """
repo STRING, run_id BIGINT, ordinal BIGINT, name STRING, conclusion STRING, started_at STRING,
completed_at STRING, steps ARRAY<STRUCT<name:STRING, conclusion:STRING>>
"""

SCORER_RESPONSE = """
repo STRING, source STRING, number BIGINT, stage INT, model STRING, response_text STRING
"""

ISSUES = """
repo STRING, number BIGINT, title STRING, body STRING, state STRING,
created_at TIMESTAMP, closed_at TIMESTAMP, reporter STRING,
labels ARRAY<STRING>, assignees ARRAY<STRING>,
first_assignee_after_bug_label STRING, first_bug_label_at TIMESTAMP,
is_duplicate BOOLEAN, duplicate_of ARRAY<BIGINT>, related_issues ARRAY<BIGINT>,
cross_refs ARRAY<STRUCT<ref_number:BIGINT, ref_title:STRING, ref_state:STRING, at:TIMESTAMP>>,
priority_label STRING, time_to_close_hours DOUBLE,
assignment_history ARRAY<STRUCT<assignee:STRING, at:TIMESTAMP>>,
label_history ARRAY<STRUCT<label:STRING, at:TIMESTAMP>>,
comments ARRAY<STRUCT<id:BIGINT, author:STRING, body:STRING, created_at:TIMESTAMP,
  duplicate_refs:ARRAY<BIGINT>, related_refs:ARRAY<BIGINT>>>,
comment_count BIGINT
"""

PULL_REQUESTS = """
repo STRING, number BIGINT, title STRING, body STRING, author STRING,
created_at TIMESTAMP, merged_at TIMESTAMP, closed_at TIMESTAMP, outcome STRING,
labels ARRAY<STRING>, files_changed_count BIGINT, additions BIGINT, deletions BIGINT,
closes_issues ARRAY<BIGINT>, requested_reviewers ARRAY<STRING>,
reviews ARRAY<STRUCT<reviewer:STRING, state:STRING, submitted_at:TIMESTAMP, body_length:INT>>,
unique_reviewers ARRAY<STRING>, hours_to_first_review DOUBLE, hours_open DOUBLE,
has_rationale BOOLEAN,
review_comments ARRAY<STRUCT<reviewer:STRING, path:STRING, body:STRING, created_at:TIMESTAMP>>
"""

COMMITS = """
repo STRING, sha STRING, message STRING, author_name STRING, author_email STRING,
author_login STRING, committed_at TIMESTAMP, files_changed ARRAY<STRING>,
additions BIGINT, deletions BIGINT, parents ARRAY<STRING>, closes_issues ARRAY<BIGINT>,
is_bug_fix BOOLEAN
"""

TOUCHES = """
repo STRING, sha STRING, author_login STRING, committed_at TIMESTAMP, is_bug_fix BOOLEAN,
closes_issues ARRAY<BIGINT>, path STRING
"""

FILE_OWNERSHIP = "repo STRING, filepath STRING, total_commits BIGINT, unique_authors ARRAY<STRING>"

INDUCING_PAIRS = """
repo STRING, issue_number BIGINT, fix_sha STRING, fix_author STRING, fix_at TIMESTAMP,
inducing_sha STRING, inducing_author STRING, inducing_at TIMESTAMP, file STRING,
ground_truth_q56 STRUCT<question:STRING, answer_sha:STRING, answer_author:STRING, file:STRING>
"""

CI_RUNS = """
repo STRING, run_id BIGINT, workflow_name STRING, head_sha STRING, head_branch STRING,
actor STRING, status STRING, conclusion STRING, created_at TIMESTAMP, updated_at TIMESTAMP,
pr_numbers ARRAY<BIGINT>,
failed_jobs ARRAY<STRUCT<job_name:STRING, failed_steps:ARRAY<STRING>,
  started_at:TIMESTAMP, completed_at:TIMESTAMP>>,
is_failure BOOLEAN
"""

CI_ACTOR_FAILURE_RATES = (
    "repo STRING, actor STRING, failures BIGINT, total_runs BIGINT, failure_rate DOUBLE"
)
CI_WORKFLOW_FAILURES = "repo STRING, workflow STRING, failure_count BIGINT"

CONTRIBUTORS = """
repo STRING, login STRING, total_commits BIGINT, total_issue_comments BIGINT,
total_reviews_given BIGINT, total_reviews_received BIGINT, issues_reported BIGINT,
issues_assigned BIGINT, top_files ARRAY<STRUCT<file:STRING, commits:BIGINT>>,
top_directories ARRAY<STRUCT<dir:STRING, commits:BIGINT>>, activity_score BIGINT
"""

FILE_EXPERTS = "repo STRING, file STRING, experts ARRAY<STRUCT<login:STRING, commits:BIGINT>>"

THREAD_COMMENT = (
    "STRUCT<id:STRING, author:STRING, timestamp:STRING, body:STRING, is_accepted:BOOLEAN, role:STRING>"
)

RAW_THREADS = f"""
source STRING, repo STRING, number BIGINT, title STRING, thread_text STRING,
comments ARRAY<{THREAD_COMMENT}>, comment_count BIGINT, labels ARRAY<STRING>, state STRING,
created_at TIMESTAMP, closed_at TIMESTAMP, reporter STRING, has_accepted_answer BOOLEAN,
author STRING, url STRING
"""

NATURAL_QA_PAIRS = f"""
source STRING, repo STRING, number BIGINT, title STRING, url STRING, created_at TIMESTAMP,
question_id STRING, question_text STRING, question_author STRING, question_source STRING,
question_comment_id STRING, answer_text STRING, answer_author STRING, answer_comment_id STRING,
answer_is_accepted BOOLEAN, confidence DOUBLE, reasoning STRING, stage1_category STRING,
thread_text STRING, comments ARRAY<{THREAD_COMMENT}>, stage1_model STRING, stage2_model STRING
"""

QA_PAIRS = """
question_id STRING, question STRING, ground_truth VARIANT, artifacts_needed VARIANT,
tier INT, repo STRING, issue_number BIGINT
"""

PAIR_REFS = f"{QA_PAIRS}, shared_field STRING, artifact_id STRING"
SHARED_ARTIFACTS = "artifact_id STRING, kind STRING, repo STRING, part BIGINT, items ARRAY<VARIANT>"

VERIFICATION = "pair_id STRING, status STRING, note STRING, verified_at TIMESTAMP"
LEDGER = "repo STRING, source STRING, number BIGINT, stage_key STRING"

DATASETS = {
    "issues": ISSUES,
    "pull_requests": PULL_REQUESTS,
    "commits": COMMITS,
    "touches": TOUCHES,
    "file_ownership": FILE_OWNERSHIP,
    "szz_pairs": INDUCING_PAIRS,
    "ci_runs": CI_RUNS,
    "ci_actor_failure_rates": CI_ACTOR_FAILURE_RATES,
    "ci_workflow_failures": CI_WORKFLOW_FAILURES,
    "contributors": CONTRIBUTORS,
    "file_experts": FILE_EXPERTS,
    "raw_threads": RAW_THREADS,
    "natural_qa_pairs": NATURAL_QA_PAIRS,
    "qa_pairs": QA_PAIRS,
    "qa_pair_refs": PAIR_REFS,
    "shared_artifacts": SHARED_ARTIFACTS,
}
