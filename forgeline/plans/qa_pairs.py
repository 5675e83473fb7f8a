"""Question/answer pairs with exact answers, one builder per question family."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from forgeline.functions.text import excerpt, present
from forgeline.operators import ci, contributors, ownership, ranking
from forgeline.settings import Settings
from forgeline.sources.tables import settle

# Question wording by question id.
ASK_DUPLICATE = "Has this bug been reported before?\n\nTitle: "
ASK_ASSIGNEE = "Who should be assigned this bug?\n\nTitle: "
ASK_CAUSE = "What caused this build to break? (Run ID: "
ASK_BREAKER = "Who caused this build to break? (Run ID: "
ASK_LATEST = "Who most recently modified this file?\n\nFile: "
ASK_MOST = "Who has modified this file most frequently?\n\nFile: "
ASK_REVIEW_TIME = "How long does PR review typically take in "


# What the builders read of the large tables.
ISSUE_COLUMNS = ("repo", "number", "title", "body", "labels", "first_assignee_after_bug_label", "is_duplicate", "duplicate_of")
INDUCING_COLUMNS = ("repo", "issue_number", "fix_sha", "inducing_sha", "inducing_author", "file", "ground_truth_q56")
RUN_COLUMNS = (
    "repo", "run_id", "workflow_name", "head_sha", "head_branch", "actor", "created_at", "failed_jobs", "is_failure"
)
PULL_COLUMNS = ("repo", "number", "hours_to_first_review")


@dataclass(frozen=True)
class Tables:
    """Inputs of the builders; a single builder needs only those it reads."""

    issues: DataFrame | None = None
    leaders: DataFrame | None = None        # top_profiles: one row per repo
    experts: DataFrame | None = None        # ownership.file_experts
    inducing: DataFrame | None = None       # inducing.inducing_pairs
    ci_runs: DataFrame | None = None
    touches: DataFrame | None = None        # commits.touches
    pull_requests: DataFrame | None = None


def _pair(
    df: DataFrame,
    question_id: str,
    question: Column,
    ground_truth: Column,
    artifacts: Column,
    tier: int,
    issue_number: Column | None = None,
) -> DataFrame:
    number = F.lit(None) if issue_number is None else issue_number
    return df.select(
        F.lit(question_id).alias("question_id"),
        question.alias("question"),
        F.to_variant_object(ground_truth).alias("ground_truth"),
        F.to_variant_object(artifacts).alias("artifacts_needed"),
        F.lit(tier).alias("tier"),
        "repo",
        number.cast("bigint").alias("issue_number"),
    )


def _ask(opening: str, settings: Settings, *more: Column) -> Column:
    """Opening, title, body excerpt and further parts of an issue question."""
    title = F.coalesce(F.col("title"), F.lit(""))
    body = excerpt(F.col("body"), settings.question_excerpt_chars)
    return F.concat(F.lit(opening), title, F.lit("\nBody: "), body, *more)


def _candidate(prefix: str, settings: Settings) -> Column:
    return F.array(
        F.struct(
            F.col(f"{prefix}_number").alias("number"),
            F.col(f"{prefix}_title").alias("title"),
            excerpt(F.col(f"{prefix}_body"), settings.candidate_excerpt_chars).alias("body"),
        )
    )


def _issue_artifacts(prefix: str, settings: Settings) -> Column:
    return F.struct(
        F.col("body").alias("issue_body"),
        F.col("title").alias("issue_title"),
        _candidate(prefix, settings).alias("candidate_issues"),
    )


def _partners(issues: DataFrame, prefix: str, settings: Settings) -> DataFrame:
    """Slim lookup side: only the part of the body that the artifact shows is shuffled."""
    return issues.select(
        "repo",
        F.col("number").alias(f"{prefix}_number"),
        F.col("title").alias(f"{prefix}_title"),
        excerpt(F.col("body"), settings.candidate_excerpt_chars).alias(f"{prefix}_body"),
    )


def duplicate_positives(
    t: Tables, settings: Settings = Settings(), drop_self: bool = False, distinct: bool = False
) -> DataFrame:
    """Q53, true: one pair per duplicate reference that names an issue of the repo.

    Repeated and self references give a pair each, unless dropped by option. A
    target named by very many issues makes one hot key on the left side, which
    adaptive skew handling splits; the right side has one row per key.
    """
    refs = F.array_distinct("duplicate_of") if distinct else F.col("duplicate_of")
    edges = t.issues.filter(F.size("duplicate_of") > 0).select(
        "repo", "number", "title", "body", F.explode(refs).alias("target_number")
    )
    if drop_self:
        edges = edges.filter(F.col("number") != F.col("target_number"))
    found = edges.join(_partners(t.issues, "target", settings), ["repo", "target_number"])
    truth = F.struct(
        F.lit(True).alias("is_duplicate"),
        F.col("target_number").alias("duplicate_of_issue"),
        F.col("target_title").alias("original_title"),
    )
    return _pair(
        found,
        "Q53",
        _ask(ASK_DUPLICATE, settings),
        truth,
        _issue_artifacts("target", settings),
        1,
        F.col("number"),
    )


def negative_edges(issues: DataFrame, seed: int) -> DataFrame:
    """(repo, number, partner_number): non-duplicates paired with a random other one.

    Per repo, the first N non-duplicates by number, N being the number of issues
    with duplicate references, each get the partner whose rank is a seeded hash of
    (seed, repo, number) modulo the count of non-duplicates. Pairs with itself are
    dropped. The result depends on neither row order nor partitioning.
    """
    has_refs = F.size("duplicate_of") > 0
    is_plain = ~has_refs & ~F.col("is_duplicate")
    plain = ranking.with_rank(
        issues.select("repo", "number", "duplicate_of", "is_duplicate"),
        ["repo"],
        "number",
        is_plain,
        totals={"positives": has_refs, "plain": is_plain},
    )
    plain = settle(plain.select("repo", "number", "rank", "positives", "plain"), "plain-issues")  # ranked once for both sides
    text = F.concat_ws(":", F.lit(str(seed)), F.col("repo"), F.col("number").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    left = plain.filter(F.col("rank") <= F.col("positives")).select(
        "repo", "number", (F.pmod(draw, F.col("plain")) + 1).alias("partner_rank")
    )
    right = plain.select("repo", F.col("number").alias("partner_number"), F.col("rank").alias("partner_rank"))
    return (
        left.join(right, ["repo", "partner_rank"])
        .filter("number <> partner_number")
        .select("repo", "number", "partner_number")
    )


def duplicate_negatives(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q53, false. Pairs are formed on numbers alone; texts are joined last."""
    edges = negative_edges(t.issues, settings.negative_seed)
    found = edges.join(t.issues.select("repo", "number", "title", "body"), ["repo", "number"]).join(
        _partners(t.issues, "partner", settings), ["repo", "partner_number"]
    )
    truth = F.struct(
        F.lit(False).alias("is_duplicate"), F.lit(None).cast("bigint").alias("duplicate_of_issue")
    )
    return _pair(
        found,
        "Q53",
        _ask(ASK_DUPLICATE, settings),
        truth,
        _issue_artifacts("partner", settings),
        1,
        F.col("number"),
    )


def top_profiles(totals: DataFrame, paths: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(repo, contributor_profiles): the most active people of each repo, one row per repo."""
    leaders = contributors.most_active(totals, settings.profiles_per_assignment).select(
        "repo", "login", "total_commits", F.col("rank").alias("place")
    )
    shown = paths
    if settings.files_per_profile is not None:
        shown = paths.filter(F.col("rank") <= settings.files_per_profile)
    files = ranking.nest(
        shown, ["repo", "login"], F.struct(F.col("path").alias("file"), "commits"), "rank", "top_files"
    )
    no_files = F.from_json(F.lit("[]"), "ARRAY<STRUCT<file:STRING, commits:BIGINT>>")
    rows = leaders.join(files, ["repo", "login"], "left").withColumn(
        "top_files", F.coalesce("top_files", no_files)
    )
    return ranking.nest(
        rows, ["repo"], F.struct("login", "top_files", "total_commits"), "place", "contributor_profiles"
    )


def assignment_pair(asked: DataFrame, artifacts: Column, settings: Settings) -> DataFrame:
    """Q54 of the asked issues, with the given artifacts."""
    return _pair(
        asked,
        "Q54",
        _ask(ASK_ASSIGNEE, settings, F.lit("\nLabels: "), F.array_join("labels", ", ")),
        F.struct(F.col("first_assignee_after_bug_label").alias("assignee")),
        artifacts,
        2,
        F.col("number"),
    )


def assignment(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q54: first assignee after the bug label, with the repo's leading contributors."""
    asked = t.issues.filter(present(F.col("first_assignee_after_bug_label"))).select(
        "repo", "number", "title", "body", "labels", "first_assignee_after_bug_label"
    )
    # The leaders come from a written table, so the optimizer knows their size and
    # broadcasts them only below its threshold; beyond it the join is a shuffle whose
    # hot repos adaptive execution splits. Repos without leaders keep their questions.
    found = asked.join(t.leaders, "repo", "left")
    issue = F.struct(
        "title", excerpt(F.col("body"), settings.question_excerpt_chars).alias("body"), "labels"
    )
    no_profiles = F.from_json(
        F.lit("[]"),
        "ARRAY<STRUCT<login:STRING, top_files:ARRAY<STRUCT<file:STRING, commits:BIGINT>>, total_commits:BIGINT>>",
    )
    artifacts = F.struct(
        issue.alias("issue"), F.coalesce("contributor_profiles", no_profiles).alias("contributor_profiles")
    )
    return assignment_pair(found, artifacts, settings)


def _nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def regression(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q56: the inducing commit of each (fix, issue, file)."""
    artifacts = F.struct(
        F.col("fix_sha").alias("fix_commit_sha"), "file", _nothing("string").alias("recent_commits_on_file")
    )
    return _pair(
        t.inducing,
        "Q56",
        F.col("ground_truth_q56.question"),
        F.struct("inducing_sha", "inducing_author", "file"),
        artifacts,
        1,
        F.col("issue_number"),
    )


def _broken_runs(t: Tables) -> DataFrame:
    return t.ci_runs.filter(F.col("is_failure") & (F.size("failed_jobs") > 0))


def breakage_cause(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q32: the failed jobs and steps of a broken run."""
    truth = F.struct(
        "failed_jobs",
        ci.failed_steps(F.col("failed_jobs")).alias("failed_steps"),
        F.col("head_sha").alias("triggering_sha"),
    )
    run = F.struct("run_id", "workflow_name", "head_sha", "head_branch", "created_at")
    question = F.concat(
        F.lit(ASK_CAUSE),
        F.col("run_id").cast("string"),
        F.lit(", Workflow: "),
        F.coalesce("workflow_name", F.lit("")),
        F.lit(")"),
    )
    return _pair(
        _broken_runs(t), "Q32", question, truth, F.struct(run.alias("ci_run"), "failed_jobs"), 1
    )


def breakage_actor(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q33: who triggered a broken run."""
    run = F.struct("run_id", "workflow_name", "head_sha", "actor")
    question = F.concat(F.lit(ASK_BREAKER), F.col("run_id").cast("string"), F.lit(")"))
    return _pair(
        _broken_runs(t).filter(present(F.col("actor"))),
        "Q33",
        question,
        F.struct("actor"),
        F.struct(run.alias("ci_run")),
        1,
    )


def latest_owner(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q18: last modifier of each file."""
    found = ownership.latest_modifier(t.touches).filter(present(F.col("login")))
    artifacts = F.struct(F.col("file").alias("file_path"), _nothing("string").alias("recent_commits"))
    return _pair(
        found, "Q18", F.concat(F.lit(ASK_LATEST), "file"), F.struct("login"), artifacts, 1
    )


def primary_owner(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q19: most frequent modifier of each path, directories included."""
    first = F.get("experts", 0)
    truth = F.struct(first["login"].alias("login"), first["commits"].alias("commit_count"))
    artifacts = F.struct(F.col("file").alias("file_path"), F.col("experts").alias("contributor_profiles"))
    return _pair(t.experts, "Q19", F.concat(F.lit(ASK_MOST), "file"), truth, artifacts, 1)


def review_time_medians(pull_requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(repo, median, sample_size) of hours to first review, with enough samples."""
    hours = pull_requests.select("repo", F.col("hours_to_first_review").alias("hours"))
    # Whole-hour buckets hold at most 3,600 distinct values at one-second resolution.
    medians = ranking.exact_median(hours, ["repo"], "hours", F.floor("hours"))
    return medians.filter(F.col("sample_size") >= settings.review_samples_min)


def review_time_pair(medians: DataFrame, artifacts: Column) -> DataFrame:
    """Q50 of the repos' medians, with the given artifacts."""
    truth = F.struct(F.round("median", 1).alias("median_hours_to_first_review"), "sample_size")
    question = F.concat(F.lit(ASK_REVIEW_TIME), "repo", F.lit("?"))
    return _pair(medians, "Q50", question, truth, artifacts, 1)


def review_time(t: Tables, settings: Settings = Settings()) -> DataFrame:
    """Q50: median hours to first review per repo."""
    waits = t.pull_requests.filter("hours_to_first_review IS NOT NULL").select(
        "repo", "number", "hours_to_first_review"
    )
    if settings.review_samples_shown is not None:
        waits = ranking.top_k(waits, ["repo"], [F.asc("number")], settings.review_samples_shown)
    history = ranking.nest(waits, ["repo"], F.col("hours_to_first_review"), "number", "pr_review_history")
    found = review_time_medians(t.pull_requests, settings).join(history, "repo")
    return review_time_pair(found, F.struct("pr_review_history"))


Builder = Callable[[Tables, Settings], DataFrame]

BUILDERS: dict[str, Builder] = {
    "duplicate_positives": duplicate_positives,
    "duplicate_negatives": duplicate_negatives,
    "assignment": assignment,
    "regression": regression,
    "breakage_cause": breakage_cause,
    "breakage_actor": breakage_actor,
    "latest_owner": latest_owner,
    "primary_owner": primary_owner,
    "review_time": review_time,
}


def build_all(
    t: Tables,
    settings: Settings = Settings(),
    builders: dict[str, Builder] | None = None,
    counts: dict[str, Observation] | None = None,
) -> DataFrame:
    """The ``qa_pairs`` table: every builder's rows. A failing builder fails the job.

    ``counts`` takes an observation per builder, which counts its rows while they are written.
    """
    chosen = BUILDERS if builders is None else builders

    def observed(name: str, rows: DataFrame) -> DataFrame:
        if counts is None:
            return rows
        counts[name] = Observation(name)
        return rows.observe(counts[name], F.count(F.lit(1)).alias("n"))

    return reduce(DataFrame.unionByName, [observed(name, build(t, settings)) for name, build in chosen.items()])


def write_all(
    t: Tables, write: Callable[[DataFrame], None], settings: Settings = Settings(), builders: dict[str, Builder] | None = None
) -> dict[str, int]:
    """Write the pairs of all builders with ``write``, once; returns the rows of each, counted on the way."""
    counts: dict[str, Observation] = {}
    write(build_all(t, settings, builders, counts))
    return {name: seen.get["n"] for name, seen in counts.items()}


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Pairs per repo and question id."""
    return pairs.groupBy("repo", "question_id").agg(F.count(F.lit(1)).alias("n"))
