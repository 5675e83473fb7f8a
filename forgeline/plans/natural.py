"""Natural pairs from landed records to the review export, all steps as stored tables.

Threads and pairs are kept below ``<root>/natural`` in generations; a forced run derives a new one
beside the one that readers see. Threads come from a stream over landed files. Classification takes
the committed thread batches that it has not had yet, so neither step reads its own history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline import schemas
from forgeline.functions.text import stage_key
from forgeline.operators import classify, review
from forgeline.settings import Settings
from forgeline.sources import decisions, generations, landing, tables
from forgeline.streaming import incremental

KINDS = {"issue": "issues", "discussion": "discussions"}


def _threads_root(root: str, source: str) -> str:
    return f"{root}/natural/threads_{source}"


def mine_threads(
    spark: SparkSession,
    landed: str,
    root: str,
    repos: list[str] | None = None,
    settings: Settings = Settings(),
    force: bool = False,
    files_per_batch: int = 1000,
) -> None:
    """Threads of newly landed issues and discussions; with ``force`` of all, as a new generation."""
    for source, kind in KINDS.items():
        if not generations.names(spark, f"{landed}/{kind}"):
            continue
        base = _threads_root(root, source)
        generation = generations.begin(spark, base, force)
        raw = tables.only_repos(landing.stream_landed(spark, landed, kind, files_per_batch), repos)
        incremental.build_threads(raw, source, generation, settings).awaitTermination()
        generations.fold(spark, generation, "threads", schemas.RAW_THREADS)
        generations.commit(spark, base, generation)


def read_threads(spark: SparkSession, root: str, repos: list[str] | None = None) -> DataFrame:
    """All committed threads (``schemas.RAW_THREADS``)."""
    parts = [
        generations.read(spark, generations.current(spark, _threads_root(root, s)), "threads", schemas.RAW_THREADS, repos)
        for s in KINDS
    ]
    return reduce(DataFrame.unionByName, parts)


def _new_threads(spark: SparkSession, root: str, generation: str, taken: dict) -> tuple[DataFrame, dict]:
    """Committed threads that are not classified in this generation, and how far that goes.

    Batches are taken whole. Only where threads were derived anew are keys compared with the ledger.
    """
    parts, reached = [], {}
    for source in KINDS:
        folder = generations.current(spark, _threads_root(root, source))
        if folder is None:
            continue
        number = int(folder.rpartition("=")[2])
        upto = max(generations.committed_batches(spark, folder), default=-1)
        before, after = taken.get(source, [number, -1])
        rows = generations.read_batches(spark, folder, "threads", schemas.RAW_THREADS, after if before == number else -1, upto)
        if before != number:
            ledger = generations.read_batches(spark, generation, "ledger", schemas.LEDGER).select(*classify.THREAD_KEY).distinct()
            rows = rows.join(ledger, classify.THREAD_KEY, "left_anti")
        parts.append(rows)
        reached[source] = [number, upto]
    empty = spark.createDataFrame([], schemas.RAW_THREADS)
    return reduce(DataFrame.unionByName, parts, empty), reached


def _to_retry(spark: SparkSession, root: str, generation: str, last: int) -> DataFrame | None:
    """Threads that the last batch left to be asked again, None if there are none."""
    schema = "repo STRING, source STRING, number BIGINT, outcome STRING"
    left = generations.read_batches(spark, generation, "outcomes", schema, last - 1).filter("outcome = 'retry'")
    if left.isEmpty():
        return None
    return read_threads(spark, root).join(left.select(*classify.THREAD_KEY), classify.THREAD_KEY, "left_semi")


def classify_stored(
    spark: SparkSession,
    root: str,
    responses: incremental.Responses,
    stage1_model: str,
    stage2_model: str,
    threshold: float = Settings.confidence_threshold,
    force: bool = False,
    window: int | None = None,
) -> None:
    """Classify the threads that this pair of models has not had, as one batch; with ``force`` all of them.

    Threads on which the scorer failed last time are asked about again. With a ``window`` longer
    threads are asked about in parts.
    """
    base = f"{root}/natural/pairs/{stage_key(stage1_model, stage2_model)}"
    generation = generations.begin(spark, base, force)
    done = generations.committed_batches(spark, generation)
    taken = generations.batch_note(spark, generation, done[-1])["threads"] if done else {}
    fresh, reached = _new_threads(spark, root, generation, taken)
    again = _to_retry(spark, root, generation, done[-1]) if done else None
    if again is not None:
        again = again.join(fresh.select(*classify.THREAD_KEY), classify.THREAD_KEY, "left_anti")
        fresh = fresh.unionByName(again)
    if reached != taken or again is not None:
        batch = done[-1] + 1 if done else 0
        incremental.classify_batch(
            fresh, batch, responses, generation, stage1_model, stage2_model, threshold, {"threads": reached}, window
        )
    generations.fold(spark, generation, "pairs", schemas.NATURAL_QA_PAIRS)
    generations.commit(spark, base, generation)


def read_pairs(spark: SparkSession, root: str, repos: list[str] | None = None) -> DataFrame:
    """All committed pairs of all model pairs (``schemas.NATURAL_QA_PAIRS``)."""
    base = f"{root}/natural/pairs"
    parts = [
        generations.read(spark, generations.current(spark, f"{base}/{name}"), "pairs", schemas.NATURAL_QA_PAIRS, repos)
        for name in generations.names(spark, base)
    ]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schemas.NATURAL_QA_PAIRS))


def read_outcomes(spark: SparkSession, root: str, stage1_model: str, stage2_model: str) -> DataFrame:
    """Outcome of every thread that a pair of models has had."""
    base = f"{root}/natural/pairs/{stage_key(stage1_model, stage2_model)}"
    schema = "repo STRING, source STRING, number BIGINT, outcome STRING"
    generation = generations.current(spark, base)
    return generations.read(spark, generation, "outcomes", schema)


def decide(spark: SparkSession, root: str, requests: DataFrame) -> DataFrame:
    """Store review decisions; returns the requests with an unknown status."""
    return decisions.submit(requests, f"{root}/natural/decisions")


def review_inputs(spark: SparkSession, root: str, repos: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, decisions) as the functions of ``operators.review`` take them."""
    return read_pairs(spark, root, repos), decisions.read_state(spark, f"{root}/natural/decisions")


def pair_detail(spark: SparkSession, root: str, pair_id: str) -> DataFrame:
    """One pair with its decision, from the repo's partition and the pair's bucket."""
    repo = "/".join(pair_id.split("/")[:-3])
    state = decisions.read_state(spark, f"{root}/natural/decisions", pair_id)
    return review.pair_detail(read_pairs(spark, root, [repo]), state, pair_id)


def export_accepted(spark: SparkSession, root: str, path: str, repos: list[str] | None = None) -> None:
    """Accepted pairs as JSON lines."""
    tables.export_jsonl(review.accepted_pairs(*review_inputs(spark, root, repos)), path)
