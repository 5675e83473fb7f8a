"""The whole job: landed records to analysis tables to question/answer pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forgeline import schemas
from forgeline.operators import ci, commits, contributors, inducing, issues, ownership, pulls
from forgeline.plans import natural, qa_pairs, shared
from forgeline.session import new_run_folder
from forgeline.settings import Settings
from forgeline.sources import landing, rejects, tables
from forgeline.streaming.incremental import Responses


def _stored(spark: SparkSession, root: str, name: str, repos: list[str]) -> DataFrame:
    return tables.read_table(spark, f"{root}/{name}", schemas.DATASETS[name], repos)


def mine(
    spark: SparkSession,
    landed: str,
    root: str,
    repos: list[str],
    settings: Settings = Settings(),
    skip_ci: bool = False,
    budget: rejects.Budget | None = None,
) -> None:
    """Normalise and derive every table; repos that already have one are skipped.

    With a ``budget`` unusable landed lines go to ``<root>/rejects`` instead of ending the job,
    unless there are more of them than it allows.
    """

    def save(name: str, df: DataFrame) -> None:
        tables.write_new_repos(df, f"{root}/{name}", repos)

    def landed_rows(kind: str) -> DataFrame:
        if budget is None:
            return landing.read_landed(spark, landed, kind)
        rows, bad = rejects.read_with_rejects(
            spark, f"{landed}/{kind}", landing.SCHEMAS[kind], kind, landing.REQUIRED[kind], budget
        )
        rejects.write_rejects(bad, root, "lines")
        return rows

    def raw(kind: str) -> DataFrame:
        return tables.only_repos(landed_rows(kind), repos)

    wanted = issues.with_source_labels(raw("issues"), settings.source_labels)
    save("issues", issues.normalise_issues(wanted, settings))
    if todo := tables.missing_repos(spark, f"{root}/commits", repos):
        listing, details = landed_rows("commit_listing"), landed_rows("commits")
        if budget is not None:
            rejects.write_rejects(rejects.missing_details(listing, details, ["repo", "sha"], "commits"), root, "details")
        commits.write_history(tables.only_repos(commits.join_commit_details(listing, details), todo), root)
    save("pull_requests", pulls.normalise_pull_requests(raw("pull_requests"), settings))
    if not skip_ci:
        save("ci_runs", ci.normalise_ci_runs(raw("ci_runs"), raw("ci_jobs")))
        runs = _stored(spark, root, "ci_runs", repos)
        save("ci_actor_failure_rates", ci.actor_failure_rates(runs))
        save("ci_workflow_failures", ci.workflow_failures(runs))

    # From here on the jobs read the written tables, so each is computed once.
    touched = _stored(spark, root, "touches", repos)
    save("file_ownership", ownership.file_ownership(touched))
    save("szz_pairs", inducing.inducing_pairs(touched, settings.inducing_window_days))
    expertise = tables.settle(ownership.path_expertise(touched), "expertise")
    paths = tables.settle(ownership.top_paths_of(expertise, settings.top_files_per_author), "top-paths")
    reported = _stored(spark, root, "issues", repos)
    totals = contributors.activity_totals(
        contributors.activity_rows(
            _stored(spark, root, "commits", repos),
            reported,
            contributors.comment_rows(reported),
            contributors.review_rows(_stored(spark, root, "pull_requests", repos)),
        )
    )
    save("contributors", contributors.profiles(totals, paths))
    save("file_experts", ownership.file_experts(expertise, settings.experts_per_path))


def stored_inputs(
    spark: SparkSession, root: str, repos: list[str], settings: Settings = Settings()
) -> qa_pairs.Tables:
    """Builder inputs read from the written tables."""

    def table(name: str) -> DataFrame:
        return _stored(spark, root, name, repos)

    people = table("contributors")
    paths = ownership.paths_of_profiles(people)
    leaders = tables.settle(qa_pairs.top_profiles(people, paths, settings), "leaders")
    return qa_pairs.Tables(
        issues=table("issues"),
        leaders=leaders,
        experts=table("file_experts"),
        inducing=table("szz_pairs"),
        ci_runs=table("ci_runs"),
        touches=table("touches"),
        pull_requests=table("pull_requests"),
    )


def run(
    spark: SparkSession,
    landed: str,
    root: str,
    repos: list[str],
    settings: Settings = Settings(),
    skip_ci: bool = False,
    only_qa: bool = False,
    force: bool = False,
    budget: rejects.Budget | None = None,
) -> dict[str, int]:
    """All steps for the given repos; ``only_qa`` rebuilds the pairs from stored tables.

    ``force`` drops what the tables hold of these repos first, so that they are derived anew.
    Returns the number of pairs of each builder, counted while they were written.
    """
    if force and not only_qa:
        for name in schemas.DATASETS:
            tables.drop_repos(spark, f"{root}/{name}", repos)
    if not only_qa:
        mine(spark, landed, root, repos, settings, skip_ci, budget)
    folder = new_run_folder(spark, "pairs")
    inputs = stored_inputs(spark, root, repos, settings)
    counts = qa_pairs.write_all(inputs, lambda pairs: pairs.write.parquet(folder), settings)
    tables.replace_repos(spark.read.schema(schemas.QA_PAIRS).parquet(folder), f"{root}/qa_pairs", repos)
    return counts


def run_by_reference(spark: SparkSession, root: str, repos: list[str], settings: Settings = Settings()) -> None:
    """``qa_pair_refs`` of the repos from the stored tables, after the ``shared_artifacts`` that they name.

    Artifacts come first, so a crash between the two leaves pairs that name stored ones.
    """
    inputs = stored_inputs(spark, root, repos, settings)
    artifacts = tables.settle(shared.shared_artifacts(inputs, settings), "shared-artifacts")
    shared.add_artifacts(artifacts, f"{root}/shared_artifacts")
    pairs = tables.settle(shared.build_refs(inputs, artifacts, settings), "pair-refs")
    tables.replace_repos(pairs, f"{root}/qa_pair_refs", repos)


def run_natural(
    spark: SparkSession,
    landed: str,
    root: str,
    responses: Responses,
    stage1_model: str,
    stage2_model: str,
    repos: list[str] | None = None,
    settings: Settings = Settings(),
    force: bool = False,
) -> None:
    """Threads and natural pairs of what has landed since the last run; ``force`` derives all anew."""
    natural.mine_threads(spark, landed, root, repos, settings, force)
    natural.classify_stored(spark, root, responses, stage1_model, stage2_model, settings.confidence_threshold, force)
