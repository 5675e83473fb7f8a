"""Artifacts that belong to many pairs, stored once and named by their content.

A pair by reference holds its own artifacts, and for the shared one the field it goes to and
its id. The shared table has a row per (artifact_id, part) with at most ``PART_ITEMS`` items,
so a repo with a third of all reviews is many rows, and a question carries an id instead of the
profiles of its repo. An id is a hash of kind, repo and content: equal content is stored once,
and pairs written earlier keep what they were asked with when the content changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.functions.text import excerpt, present
from forgeline.operators import ranking
from forgeline.plans import qa_pairs
from forgeline.settings import Settings
from forgeline.sources import tables

PROFILES = "contributor_profiles"
REVIEWS = "pr_review_history"
PART_ITEMS = 4096


def _content_id(kind: str, *content: Column) -> Column:
    return F.sha2(F.to_json(F.struct(F.lit(kind).alias("kind"), "repo", *content)), 256)


def profile_artifacts(leaders: DataFrame) -> DataFrame:
    """The leading contributors of each repo (``qa_pairs.top_profiles``): one part of a few items."""
    return leaders.select(
        _content_id(PROFILES, F.col(PROFILES)).alias("artifact_id"),
        F.lit(PROFILES).alias("kind"),
        "repo",
        F.lit(0).cast("bigint").alias("part"),
        F.transform(PROFILES, F.to_variant_object).alias("items"),
    )


def review_artifacts(pull_requests: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Hours to first review of each repo in order of the pull requests, in parts.

    Numbers are unique within a repo. The id folds a hash of every (place, hours) into sums, which
    combine before the shuffle; no task holds a whole repo.
    """
    waits = pull_requests.filter("hours_to_first_review IS NOT NULL").select(
        "repo", "number", F.col("hours_to_first_review").alias("hours")
    )
    if settings.review_samples_shown is None:
        ranked = ranking.with_rank(waits, ["repo"], "number", F.lit(True))
    else:
        ranked = ranking.top_k(waits, ["repo"], [F.asc("number")], settings.review_samples_shown)
    parted = ranked.withColumn("part", F.floor((F.col("rank") - 1) / PART_ITEMS))
    mark = F.xxhash64("rank", "hours")
    parts = parted.groupBy("repo", "part").agg(
        F.array_sort(F.collect_list(F.struct("rank", "hours"))).alias("samples"),
        F.count(F.lit(1)).alias("n"),
        F.sum(mark.cast("decimal(38,0)")).alias("total"),
        F.bit_xor(mark).alias("folded"),
    )
    parts = tables.settle(parts, "review-parts")
    ids = parts.groupBy("repo").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("folded").alias("folded"))
    named = ids.select("repo", _content_id(REVIEWS, F.col("n"), F.col("total"), F.col("folded")).alias("artifact_id"))
    return parts.select("repo", "part", "samples").join(named, "repo").select(
        "artifact_id",
        F.lit(REVIEWS).alias("kind"),
        "repo",
        "part",
        F.transform("samples", lambda s: F.to_variant_object(F.struct(s["hours"].alias("hours")))).alias("items"),
    )


def shared_artifacts(t: qa_pairs.Tables, settings: Settings = Settings()) -> DataFrame:
    """All shared artifacts of the builders' inputs."""
    return profile_artifacts(t.leaders).unionByName(review_artifacts(t.pull_requests, settings))


def _ids(artifacts: DataFrame, kind: str) -> DataFrame:
    """(repo, artifact_id) of a kind; every artifact has a part 0."""
    return artifacts.filter((F.col("kind") == kind) & (F.col("part") == 0)).select("repo", "artifact_id")


def _refer(pairs: DataFrame, field: str, ids: DataFrame, how: str) -> DataFrame:
    return pairs.join(ids, "repo", how).select(
        *[c for c in pairs.columns], F.lit(field).alias("shared_field"), "artifact_id"
    )


def assignment_refs(t: qa_pairs.Tables, artifacts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Q54 by reference: the question and its issue, with the id of the repo's profiles.

    Repos without leading contributors keep their questions, with a null id.
    """
    alone = t.issues.filter(present(F.col("first_assignee_after_bug_label")))
    issue = F.struct("title", excerpt(F.col("body"), settings.question_excerpt_chars).alias("body"), "labels")
    pairs = qa_pairs.assignment_pair(alone, F.struct(issue.alias("issue")), settings)
    return _refer(pairs, PROFILES, _ids(artifacts, PROFILES), "left")


def review_time_refs(t: qa_pairs.Tables, artifacts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Q50 by reference: the median of each repo, with the id of its samples."""
    medians = qa_pairs.review_time_medians(t.pull_requests, settings)
    own = F.struct("sample_size")
    return _refer(qa_pairs.review_time_pair(medians, own), REVIEWS, _ids(artifacts, REVIEWS), "inner")


def build_refs(t: qa_pairs.Tables, artifacts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Pairs of all builders; those without a shared artifact hold all their own."""
    plain = {name: b for name, b in qa_pairs.BUILDERS.items() if name not in ("assignment", "review_time")}
    rest = qa_pairs.build_all(t, settings, plain).withColumns(
        {"shared_field": F.lit(None).cast("string"), "artifact_id": F.lit(None).cast("string")}
    )
    return rest.unionByName(assignment_refs(t, artifacts, settings)).unionByName(review_time_refs(t, artifacts, settings))


def add_artifacts(artifacts: DataFrame, path: str) -> None:
    """Append the parts that the table at ``path`` does not hold yet.

    The keys are parts, so a run that was ended between files is completed by the next one. One
    writer at a time.
    """
    stored = tables.read_table(artifacts.sparkSession, path, schemas.SHARED_ARTIFACTS).select("artifact_id", "part")
    new = artifacts.join(stored, ["artifact_id", "part"], "left_anti")
    tables.refresh(artifacts.sparkSession, path)
    tables.write_table(tables.settle(new, "new-artifacts"), path, "append")


def unreferenced(artifacts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Parts that no pair names any more."""
    return artifacts.join(pairs.select("artifact_id").distinct(), "artifact_id", "left_anti")


def shared_items(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row per pair and part of its shared artifact, for an export that streams parts.

    Grows by the parts of each pair; nothing is gathered.
    """
    return pairs.join(artifacts.select("artifact_id", "part", "items"), "artifact_id")


def resolve(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Pairs with whole shared artifacts in them as one array, null where none is named or stored.

    Made for a page of pairs or for settings that bound the samples; a whole table is better
    exported next to its artifacts, or by :func:`shared_items`.
    """
    wanted = pairs.select("artifact_id").filter("artifact_id IS NOT NULL").distinct()
    found = artifacts.join(wanted, "artifact_id", "left_semi")
    whole = found.groupBy("artifact_id").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "items"))).alias("parts")
    )
    order = F.array_sort(F.map_keys("parts"))
    items = F.flatten(F.transform(order, lambda p: F.element_at("parts", p)))
    return pairs.join(whole.select("artifact_id", items.alias("shared")), "artifact_id", "left")
