"""Named queries over the warehouse tables, one per operator or builder.

Results hold scalar columns only: lists are joined to text, times are given as
microseconds, so that they can be compared with the result of another engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.functions import json_text, refs, taxonomy, text, times
from forgeline.operators import (
    ci,
    classify,
    commits,
    contributors,
    inducing,
    issues,
    long_threads,
    ownership,
    pulls,
    questions,
    review,
    threads,
)
from forgeline.plans import natural, qa_pairs, shared
from forgeline.session import configure, new_run_folder
from forgeline.sources import decisions, landing, ordinals, rejects, star
from forgeline.sources.tables import discard, only_repos, read_jsonl, read_table, settle, settle_at, write_jsonl
from forgeline.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(configure(spark), sf_dir)

    QUERIES[build.__name__] = run
    return run


def _us(column: str | Column) -> Column:
    return F.unix_micros(F.col(column) if isinstance(column, str) else column)


def _list(column: str | Column, separator: str = ",") -> Column:
    values = F.col(column) if isinstance(column, str) else column
    return F.array_join(values.cast("array<string>"), separator)


def _records(column: str, line: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(column, line), ";")


def _join(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])


def _at(field: Column) -> Column:
    return F.unix_micros(field)


# ---- inputs -----------------------------------------------------------------


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return issues.normalise_issues(star.raw_issues(spark, sf))


def _pulls(spark: SparkSession, sf: str) -> DataFrame:
    return pulls.normalise_pull_requests(star.raw_pull_requests(spark, sf))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    runs = star.raw_ci_runs(star.read(spark, sf, "events"))
    return ci.normalise_ci_runs(runs, star.raw_ci_jobs(spark, sf))


def _touched(spark: SparkSession, sf: str) -> DataFrame:
    """Written, for readers that read them more than once."""
    return settle(star.touches(spark, sf), "touches")


def _experts(touched: DataFrame) -> DataFrame:
    return ownership.file_experts(ownership.path_expertise(touched))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    return ownership.top_paths(star.touches(spark, sf))


def _totals(spark: SparkSession, sf: str) -> DataFrame:
    return contributors.activity_totals(
        contributors.activity_rows(
            star.commit_rows(spark, sf),
            star.issue_people(spark, sf),
            star.comment_people(spark, sf),
            star.review_people(spark, sf),
        )
    )


def _issue_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The issue columns duplicate pairs read, written because they read them twice."""
    columns = ["repo", "number", "title", "body", "duplicate_of", "is_duplicate"]
    return settle(_issues(spark, sf).select(*columns), "issue-texts")


def _leaders(spark: SparkSession, sf: str, paths: DataFrame) -> DataFrame:
    """Written before use, so that the optimizer knows the size of the join side."""
    return settle(qa_pairs.top_profiles(_totals(spark, sf), paths), "leaders")


def _issue_threads(spark: SparkSession, sf: str) -> DataFrame:
    return threads.issue_threads(issues.normalise_issues(star.conversation_issues(spark, sf)))


def _discussion_threads(spark: SparkSession, sf: str) -> DataFrame:
    return threads.discussion_threads(star.conversation_discussions(spark, sf))


def _pairs_and_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pairs = star.conversation_pairs(spark, sf)
    valid, _ = review.verification_entries(star.verification_requests(review.with_pair_id(pairs)))
    return pairs, review.current_verification(valid)


# ---- normalised records ------------------------------------------------------


@query
def issue_records(spark, sf):
    return _issues(spark, sf).select(
        "repo",
        "number",
        "title",
        "body",
        "state",
        _us("created_at").alias("created_us"),
        _us("closed_at").alias("closed_us"),
        "reporter",
        _list("labels").alias("labels"),
        _list("assignees").alias("assignees"),
        "first_assignee_after_bug_label",
        _us("first_bug_label_at").alias("first_bug_label_us"),
        "is_duplicate",
        _list("duplicate_of").alias("duplicate_of"),
        _list("related_issues").alias("related_issues"),
        "priority_label",
        "time_to_close_hours",
        F.size("comments").cast("bigint").alias("kept_comments"),
        "comment_count",
    )


@query
def timeline_fold(spark, sf):
    rows = issues.normalise_issues(star.raw_issues(spark, sf), with_last_closed_event=True)
    return rows.select(
        "repo",
        "number",
        "first_assignee_after_bug_label",
        _us("first_bug_label_at").alias("first_bug_label_us"),
        _records("assignment_history", lambda e: _join(e["assignee"], _at(e["at"]))).alias("assignments"),
        _records("label_history", lambda e: _join(e["label"], _at(e["at"]))).alias("labels_applied"),
        _records(
            "cross_refs", lambda e: _join(e["ref_number"], e["ref_title"], e["ref_state"], _at(e["at"]))
        ).alias("cross_refs"),
        _us("last_closed_event_at").alias("last_closed_us"),
    )


@query
def issue_comment_refs(spark, sf):
    rows = _issues(spark, sf).select("repo", "number", F.explode("comments").alias("c"))
    return rows.select(
        "repo",
        "number",
        F.col("c.id").alias("comment_id"),
        F.col("c.author").alias("author"),
        F.char_length("c.body").cast("bigint").alias("chars"),
        _us("c.created_at").alias("created_us"),
        _list("c.duplicate_refs").alias("duplicate_refs"),
        _list("c.related_refs").alias("related_refs"),
    )


def _pull_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "repo",
        "number",
        "title",
        "author",
        _us("created_at").alias("created_us"),
        _us("merged_at").alias("merged_us"),
        _us("closed_at").alias("closed_us"),
        "outcome",
        _list("labels").alias("labels"),
        "files_changed_count",
        "additions",
        "deletions",
        _list("closes_issues").alias("closes_issues"),
        _list("requested_reviewers").alias("requested_reviewers"),
        _records(
            "reviews", lambda r: _join(r["reviewer"], r["state"], _at(r["submitted_at"]), r["body_length"])
        ).alias("reviews"),
        _list("unique_reviewers").alias("unique_reviewers"),
        "hours_to_first_review",
        "hours_open",
        "has_rationale",
        _records("review_comments", lambda c: _join(c["reviewer"], c["path"], F.char_length(c["body"]))).alias(
            "review_comments"
        ),
    )


@query
def pull_request_records(spark, sf):
    return _pull_columns(_pulls(spark, sf))


@query
def bounded_pull_records(spark, sf):
    """Pull requests with nested lists cut to what one request of the service returns."""
    return _pull_columns(pulls.normalise_pull_requests(landing.bounded_pull_requests(star.raw_pull_requests(spark, sf))))


@query
def bounded_discussions(spark, sf):
    raw = landing.bounded_discussions(star.conversation_discussions(spark, sf))
    return raw.select(
        "repo",
        "number",
        F.col("comments.totalCount").alias("total_comments"),
        F.coalesce(F.size("comments.nodes"), F.lit(0)).cast("bigint").alias("n_comments"),
    )


@query
def commit_records(spark, sf):
    return commits.normalise_commits(star.raw_commits(spark, sf)).select(
        "repo",
        "sha",
        "message",
        "author_name",
        "author_email",
        "author_login",
        _us("committed_at").alias("committed_us"),
        _list("files_changed").alias("files_changed"),
        "additions",
        "deletions",
        _list("parents").alias("parents"),
        _list("closes_issues").alias("closes_issues"),
        "is_bug_fix",
    )


@query
def commit_parent_edges(spark, sf):
    return commits.commit_graph(commits.normalise_commits(star.raw_commits(spark, sf)))


@query
def one_scan_history(spark, sf):
    """Commits and their touches, written as two tables by one scan of the landed commits."""
    landed, root = new_run_folder(spark, "landed-commits"), new_run_folder(spark, "history")
    write_jsonl(star.raw_commits(spark, sf), landed)
    commits.write_history(read_jsonl(spark, landed, schemas.RAW_COMMIT), root)
    made = read_table(spark, f"{root}/commits", schemas.COMMITS)
    touched = read_table(spark, f"{root}/touches", schemas.TOUCHES)
    return made.select(F.lit("commits").alias("dataset"), "repo", "sha", F.lit(None).cast("string").alias("path")).unionByName(
        touched.select(F.lit("touches").alias("dataset"), "repo", "sha", "path")
    )


@query
def ci_run_records(spark, sf):
    return _runs(spark, sf).select(
        "repo",
        "run_id",
        "workflow_name",
        "head_sha",
        "head_branch",
        "actor",
        "status",
        "conclusion",
        _us("created_at").alias("created_us"),
        _us("updated_at").alias("updated_us"),
        _list("pr_numbers").alias("pr_numbers"),
        _records(
            "failed_jobs", lambda j: _join(j["job_name"], F.array_join(j["failed_steps"], ","), _at(j["started_at"]))
        ).alias("failed_jobs"),
        "is_failure",
    )


@query
def labelled_issues(spark, sf):
    wanted = issues.with_source_labels(star.raw_issues(spark, sf), ("Bug", "1-URGENT"))
    return wanted.select("repo", "number", "title")


@query
def selected_repos(spark, sf):
    return only_repos(star.commit_rows(spark, sf), ["acme/r0", "acme/r2"]).select("repo", "sha", "message")


@query
def bounded_records(spark, sf):
    raw = landing.bounded_issues(star.raw_issues(spark, sf))
    return raw.select(
        "repo",
        "number",
        F.size("labels.nodes").cast("bigint").alias("n_labels"),
        F.coalesce(F.size("comments.nodes"), F.lit(0)).cast("bigint").alias("n_comments"),
        F.coalesce(F.size("timelineItems.nodes"), F.lit(0)).cast("bigint").alias("n_events"),
        F.col("comments.totalCount").alias("total_comments"),
    )


# ---- text --------------------------------------------------------------------


@query
def duplicate_refs(spark, sf):
    return star.raw_issues(spark, sf).select(
        "repo", "number", _list(refs.duplicate_refs(F.col("body"))).alias("refs")
    )


@query
def related_refs(spark, sf):
    return star.raw_issues(spark, sf).select(
        "repo", "number", _list(refs.related_refs(F.col("body"))).alias("refs")
    )


@query
def closing_refs(spark, sf):
    body = F.col("body")
    return star.raw_pull_requests(spark, sf).select(
        "repo",
        "number",
        _list(refs.closing_refs(body)).alias("refs"),
        _list(refs.closing_refs(body, strict=True)).alias("strict_refs"),
    )


@query
def commit_refs(spark, sf):
    return star.commit_rows(spark, sf).select(
        "repo", "sha", _list("closes_issues").alias("refs"), "is_bug_fix"
    )


@query
def issue_mentions(spark, sf):
    return threads.issue_mentions(_issue_rows_as_threads(spark, sf), "body")


def _issue_rows_as_threads(spark, sf):
    return star.raw_issues(spark, sf).withColumn("source", F.lit("issue"))


@query
def path_ancestors(spark, sf):
    paths = star.touches(spark, sf).select("path").distinct()
    return paths.select(
        "path", _list(text.ancestors(F.col("path"))).alias("directories"), text.is_shallow(F.col("path")).alias("shallow")
    )


@query
def decoded_pages(spark, sf):
    pages = star.read(spark, sf, "pages").select("page_id", text.decode_entities(F.col("html")).alias("plain"))
    return pages.select(
        "page_id", F.char_length("plain").cast("bigint").alias("chars"), F.md5("plain").alias("digest")
    )


# ---- commits, files, people --------------------------------------------------


@query
def inducing_commits(spark, sf):
    return inducing.inducing_pairs(_touched(spark, sf)).select(
        "repo",
        "issue_number",
        "fix_sha",
        "fix_author",
        _us("fix_at").alias("fix_us"),
        "inducing_sha",
        "inducing_author",
        _us("inducing_at").alias("inducing_us"),
        "file",
    )


@query
def file_ownership(spark, sf):
    return ownership.file_ownership(star.touches(spark, sf)).select(
        "repo", "filepath", "total_commits", _list("unique_authors").alias("unique_authors")
    )


@query
def file_authors(spark, sf):
    return ownership.file_authors(star.touches(spark, sf))


@query
def commits_per_author(spark, sf):
    return ownership.commits_per_author(star.commit_rows(spark, sf))


@query
def path_expertise(spark, sf):
    return ownership.path_expertise(star.touches(spark, sf))


@query
def top_paths(spark, sf):
    return _paths(spark, sf).withColumn("rank", F.col("rank").cast("bigint"))


@query
def top_directories(spark, sf):
    return ownership.top_directories(_paths(spark, sf)).select("repo", "login", "path", "commits")


@query
def path_experts(spark, sf):
    return ownership.path_experts(ownership.path_expertise(star.touches(spark, sf))).withColumn("rank", F.col("rank").cast("bigint"))


@query
def file_experts(spark, sf):
    return _experts(star.touches(spark, sf)).select(
        "repo", "file", _records("experts", lambda e: _join(e["login"], e["commits"])).alias("experts")
    )


@query
def latest_modifier(spark, sf):
    return ownership.latest_modifier(star.touches(spark, sf))


@query
def contributor_activity(spark, sf):
    return _totals(spark, sf)


@query
def contributor_profiles(spark, sf):
    rows = contributors.profiles(_totals(spark, sf), _paths(spark, sf))
    return rows.select(
        "repo",
        "login",
        *contributors.METRICS,
        "activity_score",
        _records("top_files", lambda f: _join(f["file"], f["commits"])).alias("top_files"),
        _records("top_directories", lambda f: _join(f["dir"], f["commits"])).alias("top_directories"),
    )


@query
def most_active(spark, sf):
    return contributors.most_active(_totals(spark, sf)).select(
        "repo", "login", "activity_score", F.col("rank").cast("bigint").alias("rank")
    )


# ---- CI and reviews ------------------------------------------------------------


def _run_facts(events: DataFrame) -> DataFrame:
    """The run columns that statistics need; no jobs are looked up for them."""
    return star.raw_ci_runs(events).select(
        "repo", F.col("triggering_actor.login").alias("actor"), F.col("name").alias("workflow_name"), "conclusion"
    )


@query
def ci_actor_failure_rates(spark, sf):
    return ci.actor_failure_rates(_run_facts(star.read(spark, sf, "events")))


@query
def ci_workflow_failures(spark, sf):
    rows = ci.workflow_failures(_run_facts(star.read(spark, sf, "events")))
    return rows.orderBy(F.desc("failure_count"), "repo", "workflow")


@query
def review_time_medians(spark, sf):
    return qa_pairs.review_time_medians(_pulls(spark, sf)).select(
        "repo", F.round("median", 6).alias("median_hours"), "sample_size"
    )


# ---- question/answer pairs -----------------------------------------------------


def _flat(pairs: DataFrame, **fields: str) -> DataFrame:
    """Pair columns plus named payload fields: name='column:$.path:type'."""
    extracted = []
    for name, where in fields.items():
        column, path, kind = where.split(":")
        extracted.append(F.try_variant_get(F.col(column), path, kind).alias(name))
    return pairs.select("question_id", "repo", "issue_number", "tier", "question", *extracted)


@query
def duplicate_positive_pairs(spark, sf):
    return _flat(
        qa_pairs.duplicate_positives(qa_pairs.Tables(issues=_issue_texts(spark, sf))),
        is_duplicate="ground_truth:$.is_duplicate:boolean",
        target="ground_truth:$.duplicate_of_issue:bigint",
        target_title="ground_truth:$.original_title:string",
        candidate_body="artifacts_needed:$.candidate_issues[0].body:string",
    )


@query
def duplicate_negative_pairs(spark, sf):
    return _flat(
        qa_pairs.duplicate_negatives(qa_pairs.Tables(issues=_issue_texts(spark, sf))),
        is_duplicate="ground_truth:$.is_duplicate:boolean",
        target="ground_truth:$.duplicate_of_issue:bigint",
        partner="artifacts_needed:$.candidate_issues[0].number:bigint",
        partner_title="artifacts_needed:$.candidate_issues[0].title:string",
    )


@query
def assignment_pairs(spark, sf):
    leaders = _leaders(spark, sf, settle(_paths(spark, sf), "top-paths"))
    return _flat(
        qa_pairs.assignment(qa_pairs.Tables(issues=_issues(spark, sf), leaders=leaders)),
        assignee="ground_truth:$.assignee:string",
        first_label="artifacts_needed:$.issue.labels[0]:string",
        leader="artifacts_needed:$.contributor_profiles[0].login:string",
        leader_commits="artifacts_needed:$.contributor_profiles[0].total_commits:bigint",
        leader_file="artifacts_needed:$.contributor_profiles[0].top_files[4].file:string",
        tenth="artifacts_needed:$.contributor_profiles[9].login:string",
    )


@query
def regression_pairs(spark, sf):
    return _flat(
        qa_pairs.regression(qa_pairs.Tables(inducing=inducing.inducing_pairs(_touched(spark, sf)))),
        inducing_sha="ground_truth:$.inducing_sha:string",
        inducing_author="ground_truth:$.inducing_author:string",
        file="ground_truth:$.file:string",
        fix_sha="artifacts_needed:$.fix_commit_sha:string",
    )


@query
def breakage_cause_pairs(spark, sf):
    return _flat(
        qa_pairs.breakage_cause(qa_pairs.Tables(ci_runs=_runs(spark, sf))),
        triggering_sha="ground_truth:$.triggering_sha:string",
        first_job="ground_truth:$.failed_jobs[0].job_name:string",
        first_step="ground_truth:$.failed_steps[0]:string",
        branch="artifacts_needed:$.ci_run.head_branch:string",
    )


@query
def breakage_actor_pairs(spark, sf):
    return _flat(
        qa_pairs.breakage_actor(qa_pairs.Tables(ci_runs=_runs(spark, sf))),
        actor="ground_truth:$.actor:string",
        workflow="artifacts_needed:$.ci_run.workflow_name:string",
    )


@query
def latest_owner_pairs(spark, sf):
    return _flat(
        qa_pairs.latest_owner(qa_pairs.Tables(touches=star.touches(spark, sf))),
        login="ground_truth:$.login:string",
        file_path="artifacts_needed:$.file_path:string",
    )


@query
def primary_owner_pairs(spark, sf):
    return _flat(
        qa_pairs.primary_owner(qa_pairs.Tables(experts=_experts(star.touches(spark, sf)))),
        login="ground_truth:$.login:string",
        commit_count="ground_truth:$.commit_count:bigint",
        second="artifacts_needed:$.contributor_profiles[1].login:string",
    )


@query
def review_time_pairs(spark, sf):
    waits = settle(_pulls(spark, sf).select("repo", "number", "hours_to_first_review"), "waits")
    return _flat(
        qa_pairs.review_time(qa_pairs.Tables(pull_requests=waits)),
        median_hours="ground_truth:$.median_hours_to_first_review:double",
        sample_size="ground_truth:$.sample_size:bigint",
        first_sample="artifacts_needed:$.pr_review_history[0]:double",
    )


def _pair_inputs(spark, sf):
    """Builder inputs, written so that shared ones are computed once, with the columns that builders read."""
    touched = _touched(spark, sf)
    rolled = new_run_folder(spark, "expertise")
    expertise = settle_at(ownership.path_expertise(touched), rolled, drop_shuffles=True)
    experts = settle(ownership.file_experts(expertise), "experts")
    # Only the leading people's paths are shown, so only those are ranked.
    people = settle(contributors.most_active(_totals(spark, sf)).drop("rank"), "people")
    led = expertise.join(people.select("repo", "login"), ["repo", "login"], "left_semi")
    leaders = settle(qa_pairs.top_profiles(people, ownership.top_paths_of(led)), "leaders")
    discard(spark, rolled)
    return qa_pairs.Tables(
        issues=settle(_issues(spark, sf).select(*qa_pairs.ISSUE_COLUMNS), "issues"),
        leaders=leaders,
        experts=experts,
        inducing=settle(inducing.inducing_pairs(touched).select(*qa_pairs.INDUCING_COLUMNS), "inducing"),
        ci_runs=settle(_runs(spark, sf).select(*qa_pairs.RUN_COLUMNS), "ci-runs"),
        touches=touched,
        pull_requests=settle(_pulls(spark, sf).select(*qa_pairs.PULL_COLUMNS), "pulls"),
    )


def _all_pairs(spark, sf):
    return qa_pairs.build_all(_pair_inputs(spark, sf))


@query
def all_qa_pairs(spark, sf):
    return _all_pairs(spark, sf).select("question_id", "repo", "issue_number", "tier", "question")


@query
def qa_pair_counts(spark, sf):
    return qa_pairs.pair_counts(_all_pairs(spark, sf))


@query
def qa_builder_counts(spark, sf):
    """Rows of each builder, counted while all pairs are written."""
    path = new_run_folder(spark, "qa-pairs")
    counts = qa_pairs.write_all(_pair_inputs(spark, sf), lambda pairs: pairs.write.parquet(path))
    return spark.createDataFrame(list(counts.items()), "builder STRING, n BIGINT")


def _profiles(spark, sf):
    paths = settle(_paths(spark, sf), "top-paths")
    return settle(shared.profile_artifacts(_leaders(spark, sf, paths)), "profile-artifacts")


@query
def shared_profiles(spark, sf):
    """One row per profile of the shared artifacts, in its place."""
    rows = _profiles(spark, sf).select("repo", "part", F.posexplode("items").alias("place", "item"))
    return rows.select(
        "repo",
        "part",
        "place",
        F.try_variant_get("item", "$.login", "string").alias("login"),
        F.try_variant_get("item", "$.total_commits", "bigint").alias("total_commits"),
        F.try_variant_get("item", "$.top_files[4].file", "string").alias("fifth_file"),
    )


@query
def shared_review_history(spark, sf):
    """Parts of the review times of each repo, by how many they hold and what they begin and end with."""
    waits = settle(_pulls(spark, sf).select("repo", "number", "hours_to_first_review"), "waits")
    hours = F.transform("items", lambda v: F.try_variant_get(v, "$.hours", "double"))
    return shared.review_artifacts(waits).select(
        "repo",
        "part",
        F.size("items").cast("bigint").alias("samples"),
        F.round(F.element_at(hours, 1), 6).alias("first_hours"),
        F.round(F.element_at(hours, -1), 6).alias("last_hours"),
    )


@query
def resolved_assignment_pairs(spark, sf):
    """Assignment pairs by reference, put together again with the profiles that they name."""
    artifacts = _profiles(spark, sf)
    refs = shared.assignment_refs(qa_pairs.Tables(issues=_issues(spark, sf)), artifacts)
    pairs = shared.resolve(settle(refs, "assignment-refs"), artifacts)
    return pairs.select(
        "question_id",
        "repo",
        "issue_number",
        "tier",
        "question",
        F.try_variant_get("ground_truth", "$.assignee", "string").alias("assignee"),
        F.try_variant_get("artifacts_needed", "$.issue.labels[0]", "string").alias("first_label"),
        F.try_variant_get(F.get("shared", 0), "$.login", "string").alias("leader"),
        F.try_variant_get(F.get("shared", 0), "$.total_commits", "bigint").alias("leader_commits"),
        F.try_variant_get(F.get("shared", 0), "$.top_files[4].file", "string").alias("leader_file"),
        F.try_variant_get(F.get("shared", 9), "$.login", "string").alias("tenth"),
    )


# ---- threads -------------------------------------------------------------------


def _comment_rows(rows: DataFrame) -> DataFrame:
    return rows.select("repo", "number", F.explode("comments").alias("c")).select(
        "repo",
        "number",
        F.col("c.id").alias("comment_id"),
        F.col("c.author").alias("author"),
        F.col("c.timestamp").alias("posted_at"),
        F.col("c.body").alias("body"),
        F.col("c.is_accepted").alias("is_accepted"),
        F.col("c.role").alias("role"),
    )


@query
def issue_thread_comments(spark, sf):
    return _comment_rows(_issue_threads(spark, sf))


@query
def comment_days(spark, sf):
    """Comments of discussions per repo and day."""
    rows = _comment_rows(_discussion_threads(spark, sf))
    return rows.groupBy("repo", times.date_prefix(F.col("posted_at")).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query
def discussion_thread_comments(spark, sf):
    return _comment_rows(_discussion_threads(spark, sf))


@query
def issue_thread_text(spark, sf):
    return _issue_threads(spark, sf).select("repo", "number", "thread_text")


@query
def discussion_thread_text(spark, sf):
    return _discussion_threads(spark, sf).select("repo", "number", "thread_text")


@query
def thread_records(spark, sf):
    rows = threads.all_threads(_issue_threads(spark, sf), _discussion_threads(spark, sf))
    return rows.select(
        "source",
        "repo",
        "number",
        "title",
        "comment_count",
        _list("labels").alias("labels"),
        "state",
        _us("created_at").alias("created_us"),
        "reporter",
        "has_accepted_answer",
        "author",
        "url",
    )


@query
def reread_thread_comments(spark, sf):
    rows = threads.all_threads(_issue_threads(spark, sf), _discussion_threads(spark, sf))
    return threads.comments_from_text(rows).select(
        "source", "repo", "number", F.col("position").cast("bigint").alias("position"), "author",
        F.col("timestamp").alias("posted_at"), "is_accepted", text.squash(F.col("body")).alias("body"),
    )


def _landed(spark, sf) -> str:
    """Conversations as landed JSON lines of issues and discussions."""
    folder = new_run_folder(spark, "landed")
    write_jsonl(star.conversation_issues(spark, sf), f"{folder}/issues")
    write_jsonl(star.conversation_discussions(spark, sf), f"{folder}/discussions")
    return folder


@query
def stored_natural_pairs(spark, sf):
    """Landed files to threads to classified pairs, through the stored tables of every step."""
    root, n = new_run_folder(spark, "natural"), F.col("number")
    letter = F.substring(F.lit("ABCDEFGHIJK"), (n % 11 + 1).cast("int"), F.lit(1))
    stage1 = F.when(n % 5 == 0, "no answer").when(n % 5 == 1, '{"contains_qa": false}').otherwise(
        F.concat(F.lit('{"contains_qa": true, "confidence": 0.9, "category": "'), letter, F.lit('"}'))
    )
    sure = F.when(n % 7 == 1, "0.5").otherwise("0.8")
    stage2 = F.when(n % 7 > 0, F.concat(
        F.lit('{"question_id": "Q'), n % 37 + 1, F.lit('", "answer_text": "owner '), n, F.lit('", "confidence": '), sure, F.lit("}")
    ))

    def responses(prompts: DataFrame, stage: int) -> DataFrame:
        return prompts.withColumn("response_text", stage1 if stage == 1 else stage2)

    natural.mine_threads(spark, _landed(spark, sf), root)
    natural.classify_stored(spark, root, responses, "m:1", "m/2")
    threads_read = natural.read_threads(spark, root).select(*classify.THREAD_KEY, "comment_count")
    return natural.read_pairs(spark, root).join(threads_read, classify.THREAD_KEY).select(
        *classify.THREAD_KEY, "title", "comment_count", "question_id", "answer_text",
        F.round("confidence", 9).alias("confidence"), "stage1_category",
    )


@query
def landing_rejects(spark, sf):
    """Landed issues with damaged lines: which ones are read, and why the others are not."""
    issues_read = star.conversation_issues(spark, sf)
    n = F.col("number")
    whole = F.struct("number", *[c for c in issues_read.columns if c != "number"])
    line = F.to_json(whole)
    damaged = (
        F.when(n % 17 == 3, F.left(line, F.lit(20)))
        .when(n % 17 == 5, F.regexp_replace(line, r'^\{"number":(\d+)', r'{"number":"x$1"'))
        .when(n % 17 == 7, F.regexp_replace(line, r'"repo":"[^"]*"', '"repo":null'))
        .otherwise(line)
    )
    folder = new_run_folder(spark, "landed-issues")
    issues_read.select(damaged.alias("value")).write.text(folder)
    budget = rejects.Budget(share=0.5)
    good, bad = rejects.read_with_rejects(spark, folder, schemas.RAW_ISSUE, "issues", ["repo", "number"], budget)
    absent = rejects.missing_details(issues_read, good, ["number"], "issues")
    found = bad.unionByName(absent)
    number = F.regexp_extract("record", r'^\{"(?:repo":null,"|)number":"?x?(\d+)', 1)
    number = F.coalesce(F.try_to_number(F.nullif(number, F.lit("")), F.lit("999999999999")).cast("bigint"), F.get_json_object("record", "$.number").cast("bigint"))
    return good.select("number", F.lit("good").alias("reason")).unionByName(found.select(number.alias("number"), "reason"))


# ---- classification ------------------------------------------------------------


def _doc_results(spark, sf):
    docs = star.document_threads(spark, sf)
    return classify.classify_with_responses(
        docs.select(*classify.THREAD_KEY), star.document_responses(spark, sf)
    )


def _doc_gate(spark, sf):
    keys = star.document_threads(spark, sf).select(*classify.THREAD_KEY)
    first = classify.replies_of_stage(star.document_responses(spark, sf), 1)
    return classify.stage1_gate(keys.join(first, classify.THREAD_KEY, "left"))


@query
def stage1_prompts(spark, sf):
    prompt = classify.stage1_prompt(F.col("thread_text"))
    return star.document_threads(spark, sf).select(*classify.THREAD_KEY, F.md5(prompt).alias("digest"))


@query
def stage2_prompts(spark, sf):
    open_keys = _doc_gate(spark, sf).filter("outcome IS NULL").select(*classify.THREAD_KEY, "category")
    texts = star.document_threads(spark, sf).select(*classify.THREAD_KEY, "thread_text")
    rows = classify.with_stage2_prompt(open_keys.join(texts, classify.THREAD_KEY))
    return rows.select(*classify.THREAD_KEY, "category", F.md5("stage2_prompt").alias("digest"))


@query
def parsed_replies(spark, sf):
    reply = json_text.parse_reply(F.col("response_text"))
    rows = star.document_responses(spark, sf).withColumn("reply", reply)
    return rows.select(
        *classify.THREAD_KEY,
        F.col("stage").cast("bigint").alias("stage"),
        F.col("reply").isNotNull().alias("readable"),
        json_text.number_field(F.col("reply"), "confidence").alias("confidence"),
        json_text.text_field(F.col("reply"), "category").alias("category"),
        json_text.text_field(F.col("reply"), "question_id").alias("question_id"),
    )


@query
def stage1_gates(spark, sf):
    return _doc_gate(spark, sf).select(*classify.THREAD_KEY, "outcome", "category", "s1_confidence")


@query
def classified_threads(spark, sf):
    return _doc_results(spark, sf).select(
        *classify.THREAD_KEY,
        "outcome",
        "stage1_category",
        "question_id",
        "question_text",
        "question_author",
        "question_comment_id",
        "answer_text",
        "answer_author",
        "answer_is_accepted",
        F.round("confidence", 9).alias("confidence"),
        "reasoning",
    )


@query
def long_thread_outcomes(spark, sf):
    """Whole documents asked about in parts of 1500 characters, by keywords."""
    words = {"A": ["the", "and"], "D": ["der", "und"], "F": ["les", "que"]}
    asked = {"A": "Q1", "D": "Q32", "F": "Q50"}

    def replies(prompts: DataFrame, stage: int) -> DataFrame:
        return long_threads.keyword_replies(prompts, stage, words, asked)

    docs = star.document_threads(spark, sf).select(*classify.THREAD_KEY, "thread_text")
    parts = settle(long_threads.thread_parts(docs, 1500), "parts")
    keys = parts.select(*classify.PART_KEY)
    first = replies(parts.withColumn("prompt", classify.stage1_prompt(F.col("thread_text"))), 1)
    gated = settle(classify.stage1_gate(keys.join(first, classify.PART_KEY, "left")), "gated")
    open_ones = gated.filter("outcome IS NULL").select(*classify.PART_KEY, "category").join(parts, classify.PART_KEY)
    second = replies(classify.with_stage2_prompt(open_ones).withColumnRenamed("stage2_prompt", "prompt"), 2)
    merged = long_threads.merge_parts(classify.stage2_merge(gated.join(second, classify.PART_KEY, "left"), 0.55))
    return merged.select(
        *classify.THREAD_KEY, "outcome", "stage1_category", "question_id", F.round("confidence", 9).alias("confidence")
    )


@query
def natural_qa_pairs(spark, sf):
    docs = star.document_threads(spark, sf)
    rows = classify.natural_pairs(_doc_results(spark, sf), docs, "m:1", "m/2")
    return rows.select(
        *classify.THREAD_KEY, "title", "url", _us("created_at").alias("created_us"), "question_id",
        "answer_text", F.round("confidence", 9).alias("confidence"), "thread_text", "stage1_model", "stage2_model",
        F.size("comments").cast("bigint").alias("n_comments"),
    )


@query
def classification_summary(spark, sf):
    return classify.outcome_summary(_doc_results(spark, sf))


@query
def question_counts(spark, sf):
    return classify.question_summary(_doc_results(spark, sf).filter("outcome = 'kept'"))


@query
def taxonomy_usage(spark, sf):
    """Every question of the taxonomy with its natural pairs, unused and retired ones too."""
    rows = taxonomy.usage(classify.question_summary(_doc_results(spark, sf).filter("outcome = 'kept'")))
    return rows.select("question_id", F.coalesce("description", F.lit("")).alias("description"), "active", "n")


@query
def unprocessed_threads(spark, sf):
    docs = star.document_threads(spark, sf).select(*classify.THREAD_KEY)
    done = _doc_gate(spark, sf).filter("outcome IS NOT NULL")
    ledger = classify.ledger_rows(done, "m:1", "m/2")
    return classify.unprocessed(docs, ledger, "m:1", "other")


# ---- review --------------------------------------------------------------------


@query
def verification_current(spark, sf):
    _, state = _pairs_and_state(spark, sf)
    return state.select("pair_id", "status", "note", _us("verified_at").alias("verified_us"))


@query
def verification_state(spark, sf):
    """Decisions that came in three changes, two of them in the snapshot."""
    pairs = review.with_pair_id(star.conversation_pairs(spark, sf))
    requests = settle(star.verification_requests(pairs), "requests")
    root = new_run_folder(spark, "decisions")
    part = F.pmod(F.xxhash64("pair_id", "verified_at"), F.lit(3))
    for k in range(3):
        decisions.submit(requests.filter(part == k), root)
        if k == 1:
            decisions.compact(spark, root)
    state = decisions.read_state(spark, root)
    return state.select("pair_id", "status", "note", _us("verified_at").alias("verified_us"))


@query
def verification_rejects(spark, sf):
    pairs = review.with_pair_id(star.conversation_pairs(spark, sf))
    _, bad = review.verification_entries(star.verification_requests(pairs))
    return bad.select("pair_id", "status")


@query
def review_queue(spark, sf):
    return review.review_queue(*_pairs_and_state(spark, sf))


@query
def review_search(spark, sf):
    return review.review_queue(*_pairs_and_state(spark, sf), repo="acme/r1", status="accepted", search="THE").select(
        "pair_id", "question_text", "title", "status", "note"
    )


@query
def review_page(spark, sf):
    queue = review.review_queue(*_pairs_and_state(spark, sf), status="pending")
    return review.page(queue, 2, 20).select("pair_id", "number", "confidence")


@query
def review_page_total(spark, sf):
    return review.page_total(review.review_queue(*_pairs_and_state(spark, sf), status="pending"), 20)


@query
def review_next_page(spark, sf):
    queue = review.review_queue(*_pairs_and_state(spark, sf), status="pending")
    return review.page_after(queue, ("acme/r0", "issue", 30000, "Q1"), 20).select("pair_id", "number", "confidence")


@query
def review_pair_detail(spark, sf):
    pairs, state = _pairs_and_state(spark, sf)
    return review.pair_detail(pairs, state, "acme/r0/issue/0/Q1").select(
        "pair_id", "question_text", "answer_text", "status", "note"
    )


@query
def review_statistics(spark, sf):
    return review.statistics(*_pairs_and_state(spark, sf))


@query
def review_progress(spark, sf):
    return review.progress(*_pairs_and_state(spark, sf))


@query
def review_confidence_bands(spark, sf):
    return review.confidence_bands(star.conversation_pairs(spark, sf))


@query
def review_facets(spark, sf):
    return review.facets(star.conversation_pairs(spark, sf))


@query
def review_export(spark, sf):
    return review.accepted_pairs(*_pairs_and_state(spark, sf)).select(
        "source", "repo", "number", "question_id", "question_text", "answer_text"
    )


@query
def evidence_tags(spark, sf):
    return review.tag_evidence(star.conversation_pairs(spark, sf))


def _line_ordinals(spark, sf):
    """Ordinals of pairs by file and line, read from JSON lines with a folder for each repo."""
    pairs = star.conversation_pairs(spark, sf).select("repo", "source", "number", "question_id")
    folder = new_run_folder(spark, "pairs-by-repo")
    (
        pairs.withColumn("repo_dir", text.repo_folder(F.col("repo")))
        .repartition("repo_dir")
        .sortWithinPartitions("repo_dir", "source", "number", "question_id")
        .write.partitionBy("repo_dir")
        .json(folder)
    )
    schema = "repo STRING, source STRING, number BIGINT, question_id STRING"
    return review.with_pair_id(ordinals.numbered_json(spark, f"{folder}/*", schema)).select("ordinal", "pair_id")


@query
def line_ordinals(spark, sf):
    return _line_ordinals(spark, sf)


@query
def migrated_verification(spark, sf):
    """Decisions stored under the pair's place in the files instead of its id, moved to the id."""
    pairs = review.with_pair_id(star.conversation_pairs(spark, sf))
    numbered = settle(_line_ordinals(spark, sf), "ordinals")
    valid, _ = review.verification_entries(star.verification_requests(pairs))
    old = review.current_verification(valid).join(numbered, "pair_id").withColumn(
        "pair_id", F.when(F.col("ordinal") % 2 == 0, F.col("ordinal").cast("string")).otherwise(F.col("pair_id"))
    )
    moved = review.migrate_ordinal_keys(old.drop("ordinal"), numbered)
    return moved.select("pair_id", "status", "note")


# ---- incremental ---------------------------------------------------------------


@query
def running_ci_counters(spark, sf):
    """Counters kept by a stream over the event files, after all of them."""
    schema = star.read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    root = new_run_folder(spark, "ci-counters")
    incremental.count_runs(_run_facts(events), root).awaitTermination()
    return incremental.latest_counters(spark, root)


def _as_stream(df: DataFrame, name: str) -> DataFrame:
    """A derived table, written and then read as arriving files."""
    spark = df.sparkSession
    path = new_run_folder(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query
def incremental_threads(spark, sf):
    """Threads built by a stream over landed issues; equal to the batch result."""
    root = new_run_folder(spark, "threads")
    landed = _as_stream(star.conversation_issues(spark, sf), "landed")
    incremental.build_threads(landed, "issue", root).awaitTermination()
    built = threads.issue_threads(issues.normalise_issues(star.conversation_issues(spark, sf))).schema
    return spark.read.schema(built).parquet(f"{root}/threads").select("repo", "number", "thread_text")


@query
def incremental_classification(spark, sf):
    """Outcomes of a stream over threads with replies from a table; equal to the batch result."""
    root = new_run_folder(spark, "classified")
    replies = settle(star.document_responses(spark, sf), "replies")

    def responses(prompts: DataFrame, stage: int) -> DataFrame:
        return prompts.select(*classify.THREAD_KEY).join(
            classify.replies_of_stage(replies, stage), classify.THREAD_KEY
        )

    stream = _as_stream(star.document_threads(spark, sf), "threads")
    incremental.classify_threads(stream, responses, root, "m:1", "m/2").awaitTermination()
    schema = "repo STRING, source STRING, number BIGINT, outcome STRING"
    return spark.read.schema(schema).parquet(f"{root}/outcomes").select(*classify.THREAD_KEY, "outcome")


# ---- direct questions ------------------------------------------------------------


@query
def review_load(spark, sf):
    return questions.review_load(_pulls(spark, sf))


@query
def file_creators(spark, sf):
    return questions.file_creators(star.touches(spark, sf))


@query
def most_changed_files(spark, sf):
    return questions.most_changed_files(star.touches(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query
def recently_changed_files(spark, sf):
    rows = questions.recently_changed_files(star.touches(spark, sf))
    return rows.select("repo", "path", _us("changed_at").alias("changed_us"), F.col("rank").cast("bigint").alias("rank"))


@query
def closing_links(spark, sf):
    return questions.closing_links(_pulls(spark, sf), _issues(spark, sf))


@query
def longest_waiting(spark, sf):
    rows = questions.longest_waiting(_pulls(spark, sf))
    return rows.select("repo", "number", _us("created_at").alias("created_us"), F.col("rank").cast("bigint").alias("rank"))


@query
def issue_priorities(spark, sf):
    return questions.priorities(_issues(spark, sf))


@query
def related_not_duplicate(spark, sf):
    return questions.related_not_duplicate(_issues(spark, sf))


@query
def time_to_fix_by_label(spark, sf):
    rows = questions.time_to_fix_by_label(_issues(spark, sf))
    return rows.select("repo", "label", F.round("median", 6).alias("median_hours"), "sample_size")


@query
def issue_lifecycle(spark, sf):
    return questions.lifecycle(_issues(spark, sf)).select("repo", "number", _us("at").alias("at_us"), "kind", "detail")
