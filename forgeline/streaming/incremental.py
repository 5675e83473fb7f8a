"""Incremental jobs: new landed files only, each thread once.

Which threads have been seen is keyed state of the stream (the state store behind
``dropDuplicates``), so a batch reads its own files and nothing of the history. Every batch
writes to its own ``batch_id=`` folder and is committed by a marker at its end; one that is run
again after a failure starts from the same state, replaces its output and adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forgeline import schemas
from forgeline.operators import ci, classify, issues, long_threads, threads
from forgeline.settings import Settings
from forgeline.sources import generations
from forgeline.sources.tables import _unless_missing

KEY = classify.THREAD_KEY
COUNTER_KEY = ["repo", "actor"]
COUNTER_BUCKETS = 64


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _written(df: DataFrame, path: str, batch_id: int) -> DataFrame:
    """Write a batch and read it back, so that all later uses see the same rows."""
    _write_batch(df, path, batch_id)
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/batch_id={batch_id}")


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a stored dataset, in order; those the rows lack are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def build_threads(raw: DataFrame, source: str, root: str, settings: Settings = Settings()) -> StreamingQuery:
    """Landed issues or discussions to ``<root>/threads``, their keys to ``<root>/thread_ledger``.

    The first row of a thread that arrives counts. Issues without comments enter the ledger but
    give no thread.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        # Inside a batch the batch's own session must be used.
        fresh = _written(batch, f"{root}/fresh", batch_id)
        keys = fresh.select(*KEY, F.lit(f"raw_threads_{source}s").alias("stage_key"))
        if source == "issue":
            built = threads.issue_threads(issues.normalise_issues(fresh.drop("source"), settings), settings)
        else:
            built = threads.discussion_threads(fresh.drop("source"))
        _write_batch(conform(built, schemas.RAW_THREADS), f"{root}/threads", batch_id)
        _write_batch(keys, f"{root}/thread_ledger", batch_id)
        generations.commit_batch(batch.sparkSession, root, batch_id)

    keyed = raw.withColumn("source", F.lit(source)).dropDuplicates(KEY)
    return _run(keyed, each, f"{root}/_checkpoint")


Responses = Callable[[DataFrame, int], DataFrame]


def classify_batch(
    batch: DataFrame,
    batch_id: int,
    responses: Responses,
    root: str,
    stage1_model: str,
    stage2_model: str,
    threshold: float = Settings.confidence_threshold,
    note: dict | None = None,
    window: int | None = None,
) -> None:
    """Both stages for the threads of one batch, committed at its end.

    Each stage's answers are written before they are used, so that a lost task does not ask again.
    With a ``window`` longer threads are asked about in parts (column ``part`` of prompts and
    answers), and the parts' outcomes merged. Threads on which the scorer failed get the outcome
    ``retry`` and stay out of the ledger.
    """
    key = KEY if window is None else classify.PART_KEY

    def written(df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{root}/{name}", batch_id)

    def answers(prompts: DataFrame, stage: int) -> DataFrame:
        found = responses(prompts, stage)
        return written(found.select(*key, "response_text", *(["error"] if "error" in found.columns else [])), f"stage{stage}")

    fresh = written(batch, "fresh")
    asked = fresh.select(*KEY, "thread_text")
    if window is not None:
        asked = written(long_threads.thread_parts(asked, window), "parts")
    first = answers(asked.select(*key, classify.stage1_prompt(F.col("thread_text")).alias("prompt")), 1)
    gated = written(classify.stage1_gate(asked.select(*key).join(first, key, "left")), "gated")
    going_on = gated.filter("outcome IS NULL").select(*key, "category").join(asked, key)
    prompts = classify.with_stage2_prompt(going_on).select(*key, F.col("stage2_prompt").alias("prompt"))
    second = answers(prompts, 2)
    merged = classify.stage2_merge(gated.join(second, key, "left"), threshold)
    results = written(merged if window is None else long_threads.merge_parts(merged), "results")
    pairs = classify.natural_pairs(results, fresh, stage1_model, stage2_model)
    _write_batch(pairs, f"{root}/pairs", batch_id)
    _write_batch(results.select(*KEY, "outcome"), f"{root}/outcomes", batch_id)
    _write_batch(classify.ledger_rows(results, stage1_model, stage2_model), f"{root}/ledger", batch_id)
    generations.commit_batch(batch.sparkSession, root, batch_id, note)


def classify_threads(
    stream: DataFrame,
    responses: Responses,
    root: str,
    stage1_model: str,
    stage2_model: str,
    threshold: float = Settings.confidence_threshold,
    window: int | None = None,
) -> StreamingQuery:
    """Threads to ``<root>/pairs`` and ``<root>/outcomes``, their keys to ``<root>/ledger``.

    ``responses(prompts, stage)`` answers a stage: it gets the thread key and prompt and returns the
    thread key, ``response_text`` and, if it can fail, ``error``.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        classify_batch(batch, batch_id, responses, root, stage1_model, stage2_model, threshold, window=window)

    return _run(stream.dropDuplicates(KEY), each, f"{root}/_checkpoint")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Everything written so far, with the ``batch_id`` of each row."""
    full = f"{schema}, batch_id BIGINT"
    return _unless_missing(lambda: spark.read.schema(full).parquet(path), spark, full)


def count_runs(stream: DataFrame, root: str, buckets: int = COUNTER_BUCKETS) -> StreamingQuery:
    """Running CI counters per actor in ``<root>/counters``, one row for each.

    A batch hands on the actors whose counts it changed, with their whole counts. They replace the
    rows they had; only the buckets they fall into are rewritten, and nothing of former batches is
    kept. The counts are absolute, so a batch that is run again writes what it wrote.
    """
    bucket = F.pmod(F.xxhash64(*COUNTER_KEY), F.lit(buckets)).alias("bucket")

    def each(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        changed.select("*", bucket).write.mode("overwrite").parquet(f"{root}/changed")
        schema = f"{schemas.CI_ACTOR_FAILURE_RATES}, bucket BIGINT"
        new = spark.read.schema(schema).parquet(f"{root}/changed")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # ``buckets`` at most
        known = _unless_missing(lambda: spark.read.schema(schema).parquet(f"{root}/counters"), spark, schema)
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"k.{c}")) for c in COUNTER_KEY]
        kept = known.filter(F.col("bucket").isin(touched)).alias("k").join(new.alias("n"), same, "left_anti")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{root}/merged")
        (
            spark.read.schema(schema)
            .parquet(f"{root}/merged")
            .repartition("bucket")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(f"{root}/counters")
        )
        spark.catalog.refreshByPath(root)

    return _run(ci.actor_failure_rates(stream), each, f"{root}/_checkpoint", "update")


def latest_counters(spark: SparkSession, root: str) -> DataFrame:
    """The counters that :func:`count_runs` keeps."""
    schema = f"{schemas.CI_ACTOR_FAILURE_RATES}, bucket BIGINT"
    return _unless_missing(lambda: spark.read.schema(schema).parquet(f"{root}/counters"), spark, schema).drop("bucket")
