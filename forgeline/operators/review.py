"""Review of natural pairs: queue, verification state, statistics, export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.functions.text import contains_ignoring_case, is_evidence, pair_id, present
from forgeline.functions.times import confidence_band, percent

STATUSES = ("accepted", "rejected", "pending")
PAGE_ORDER = ["repo", "source", "number", "question_id"]


def with_pair_id(pairs: DataFrame) -> DataFrame:
    key = pair_id(F.col("repo"), F.col("source"), F.col("number"), F.col("question_id"))
    return pairs.withColumn("pair_id", key)


def verification_entries(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) review decisions; valid ones get note '' for none and a stamp."""
    known = F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    at = F.coalesce("verified_at", F.current_timestamp()) if "verified_at" in requests.columns else F.current_timestamp()
    valid = requests.filter(known).select(
        "pair_id", "status", F.coalesce("note", F.lit("")).alias("note"), at.alias("verified_at")
    )
    return valid, requests.filter(~known)


def current_verification(log: DataFrame) -> DataFrame:
    """Last decision per pair: by time, then status and note for equal times."""
    last = F.max(F.struct("verified_at", "status", "note"))
    return log.groupBy("pair_id").agg(last.alias("v")).select("pair_id", "v.status", "v.note", "v.verified_at")


def migrate_ordinal_keys(state: DataFrame, numbered_pairs: DataFrame) -> DataFrame:
    """Re-key decisions stored under a row ordinal; ordinals out of range are dropped.

    ``numbered_pairs`` has (ordinal, pair_id). Where a pair has decisions under both keys, the
    last one counts.
    """
    by_ordinal = F.rlike("pair_id", F.lit(r"^\d+$"))
    moved = (
        state.filter(by_ordinal)
        .withColumn("ordinal", F.col("pair_id").try_cast("bigint"))
        .drop("pair_id")
        .join(numbered_pairs.select("ordinal", "pair_id"), "ordinal")
        .select("pair_id", "status", "note", "verified_at")
    )
    kept = state.filter(~by_ordinal).select("pair_id", "status", "note", "verified_at")
    return current_verification(kept.unionByName(moved))


def with_status(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs with their decision; undecided ones are pending with an empty note."""
    return (
        with_pair_id(pairs)
        .join(state, "pair_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("pending")))
        .withColumn("note", F.coalesce("note", F.lit("")))
    )


def matches_search(search: str) -> Column:
    needle = F.lit(search)
    fields = ("question_text", "answer_text", "title")
    return reduce(lambda a, b: a | b, [contains_ignoring_case(F.col(f), needle) for f in fields])


def review_queue(
    pairs: DataFrame,
    state: DataFrame,
    repo: str = "",
    question_id: str = "",
    status: str = "",
    search: str = "",
) -> DataFrame:
    """Filtered queue; an empty argument filters nothing.

    Filters on pair columns are applied before the state is joined.
    """
    selected = pairs
    if repo:
        selected = selected.filter(F.col("repo") == repo)
    if question_id:
        selected = selected.filter(F.col("question_id") == question_id)
    if search:
        selected = selected.filter(matches_search(search))
    queue = with_status(
        selected.select(
            "repo", "source", "number", "question_id", "question_text", "title", "confidence", "stage1_category"
        ),
        state,
    )
    if status:
        queue = queue.filter(F.col("status") == status)
    return queue.select(
        "pair_id",
        "repo",
        "question_id",
        "number",
        F.coalesce("question_text", F.lit("")).alias("question_text"),
        "title",
        "confidence",
        "stage1_category",
        "source",
        "status",
        "note",
    )


def page(queue: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    """One page of the queue in key order; only page x size rows are kept per task."""
    return queue.orderBy(*PAGE_ORDER).offset((number - 1) * size).limit(size)


def page_total(queue: DataFrame, size: int = 50) -> DataFrame:
    """(total, pages) of the whole queue."""
    return queue.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("bigint")
    )


def page_after(queue: DataFrame, last_pair: tuple, size: int = 50) -> DataFrame:
    """The page after a pair's (repo, source, number, question_id), for deep paging."""
    key = F.struct(*PAGE_ORDER)
    return queue.filter(key > F.struct(*[F.lit(v).alias(n) for n, v in zip(PAGE_ORDER, last_pair)])).orderBy(*PAGE_ORDER).limit(size)


def pair_detail(pairs: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """One pair with its decision, all columns."""
    # the key is in both tables, so neither is joined beyond its rows of this pair
    return with_status(
        with_pair_id(pairs).filter(F.col("pair_id") == key), state.filter(F.col("pair_id") == key)
    )


def statistics(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Counts in total, by status, repo and question id: (kind, key, n), one pass."""
    rows = with_status(pairs.select("repo", "source", "number", "question_id"), state).select(
        F.coalesce("repo", F.lit("unknown")).alias("repo"),
        F.coalesce("question_id", F.lit("?")).alias("question_id"),
        "status",
    )
    sets = rows.groupingSets(
        [[], [F.col("status")], [F.col("repo")], [F.col("question_id")]], "status", "repo", "question_id"
    )
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g")).select(
        F.when(F.col("_g") == 7, "total").when(F.col("_g") == 3, "status").when(F.col("_g") == 5, "repo").otherwise("question_id").alias("kind"),
        F.coalesce("status", "repo", "question_id", F.lit("")).alias("key"),
        "n",
    )


def progress(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """One row: total, done, percent done."""
    rows = with_status(pairs.select("repo", "source", "number", "question_id"), state)
    return rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status").isin("accepted", "rejected")).alias("done"),
    ).withColumn("percent", percent(F.col("done"), F.col("total")))


def confidence_bands(pairs: DataFrame) -> DataFrame:
    return (
        pairs.groupBy("repo", confidence_band(F.col("confidence")).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def facets(pairs: DataFrame) -> DataFrame:
    """Distinct repos and question ids: (facet, value)."""
    repos = pairs.select(F.lit("repo").alias("facet"), F.coalesce("repo", F.lit("")).alias("value"))
    ids = pairs.select(F.lit("question_id").alias("facet"), F.coalesce("question_id", F.lit("")).alias("value"))
    return repos.union(ids).distinct()


def accepted_pairs(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs whose current decision is acceptance, in their own columns."""
    accepted = state.filter(F.col("status") == "accepted").select("pair_id")
    return with_pair_id(pairs).join(accepted, "pair_id", "left_semi").drop("pair_id")


def tag_evidence(pairs: DataFrame) -> DataFrame:
    """One row per comment of a pair, marked as question, answer or accepted.

    A comment is found by its id if the pair names one, else by its text.
    """
    c = F.col("comment")
    rows = with_pair_id(pairs).select(
        "pair_id",
        "question_text",
        "answer_text",
        "question_comment_id",
        "answer_comment_id",
        F.explode("comments").alias("comment"),
    )

    def tagged(named: str, text: str) -> Column:
        by_id = F.coalesce(c["id"] == F.col(named), F.lit(False))
        return F.when(present(F.col(named)), by_id).otherwise(is_evidence(c["body"], F.col(text)))

    return rows.select(
        "pair_id",
        c["id"].alias("comment_id"),
        F.coalesce(c["author"], F.lit("?")).alias("author"),
        tagged("question_comment_id", "question_text").alias("is_question"),
        tagged("answer_comment_id", "answer_text").alias("is_answer"),
        F.coalesce(c["is_accepted"], F.lit(False)).alias("is_accepted"),
    )
