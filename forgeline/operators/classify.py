"""Two-stage thread classification around a pluggable scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeline.functions import taxonomy
from forgeline.functions.json_text import number_field, parse_reply, text_field, truthy_field
from forgeline.functions.text import excerpt, stage_key
from forgeline.settings import Settings

THREAD_KEY = ["repo", "source", "number"]
PART_KEY = [*THREAD_KEY, "part"]  # of a thread that is asked about in parts

# Wording of this library; the reply fields are what the parser below expects.
STAGE1_TASK = """Decide whether the thread asks for information about the development process
(people, ownership, history, reviews, builds, planning) and also answers it.
Usage help, feature wishes, bug reports and answers that are only a code change do not count.

Categories:
{categories}
N - none of these

Reply with one JSON object:
{{"contains_qa": <true|false>, "category": "<A..K or N>", "confidence": <0..1>}}"""

STAGE2_TASK = """Pick the one question of this category that the thread asks and answers.
Use NONE unless question and answer both fit without stretching the definition.
Quote the question and the answer word for word, and name the posts by their [cN] ids.

Reply with one JSON object with the fields question_id, question_source, question_author,
question_text, question_comment_id, answer_text, answer_author, answer_comment_id,
answer_is_accepted, confidence, reasoning."""


def _thread_block(text: Column, settings: Settings) -> Column:
    return F.concat(F.lit("<thread>\n"), excerpt(text, settings.prompt_thread_chars), F.lit("\n</thread>\n\n"))


def stage1_prompt(text: Column, settings: Settings = Settings()) -> Column:
    task = STAGE1_TASK.format(categories=taxonomy.category_list())
    return F.concat(_thread_block(text, settings), F.lit(task))


def with_stage2_prompt(df: DataFrame, settings: Settings = Settings(), category: str = "category") -> DataFrame:
    """Add ``stage2_prompt`` with the candidate questions of the row's category.

    The category dimension is fixed at 11 rows, so it is broadcast.
    """
    dim = taxonomy.category_dimension(df.sparkSession).withColumnRenamed("category", category)
    prompt = F.concat(
        _thread_block(F.col("thread_text"), settings),
        F.lit("Category: "),
        F.col("category_name"),
        F.lit("\n\nQuestions:\n"),
        F.col("question_list"),
        F.lit(f"\n{taxonomy.NO_QUESTION}: none of the above\n\n{STAGE2_TASK}"),
    )
    return (
        df.join(F.broadcast(dim), category)
        .withColumn("stage2_prompt", prompt)
        .drop("category_name", "question_list")
    )


def stage1_gate(replies: DataFrame) -> DataFrame:
    """Read stage-1 replies: adds ``outcome`` (null = goes on), ``category``, ``s1_confidence``.

    An unreadable or missing reply counts as no-QA with confidence 0 and is marked
    ``parse_error_s1``; a category outside the taxonomy is no-QA with its confidence. Where an
    ``error`` column says that the scorer failed, the outcome is ``retry``.
    """
    reply = parse_reply(F.col("response_text"))
    parsed = replies.withColumn("_reply", reply)
    category = F.upper(F.coalesce(text_field(F.col("_reply"), "category"), F.lit("N")))
    positive = truthy_field(F.col("_reply"), "contains_qa")
    return (
        parsed.withColumn("category", F.when(positive, category))
        .withColumn("s1_confidence", F.when(positive, number_field(F.col("_reply"), "confidence")).otherwise(0.0))
        .withColumn(
            "outcome",
            F.when(_lost(replies), "retry")
            .when(F.col("_reply").isNull(), "parse_error_s1")
            .when(~positive | ~taxonomy.is_category(category), "no_qa")
            .otherwise(F.lit(None).cast("string")),
        )
        .drop("_reply", "response_text", "error")
    )


def _lost(replies: DataFrame) -> Column:
    """Whether a scorer failed on the row instead of answering."""
    if "error" not in replies.columns:
        return F.lit(False)
    return F.col("response_text").isNull() & F.col("error").isNotNull()


def _text_or(reply: Column, name: str, default: str) -> Column:
    return F.coalesce(text_field(reply, name), F.lit(default))


def stage2_merge(gated: DataFrame, threshold: float) -> DataFrame:
    """Read stage-2 replies of gated rows and route every row to its outcome.

    ``gated`` has the columns of :func:`stage1_gate` and ``response_text`` of stage 2
    (null where there is none). Outcomes: parse_error_s1, no_qa, retry, failed,
    low_confidence, kept. A reply of NONE is kept when it is confident enough.
    """
    r = F.col("_reply")
    merged = gated.withColumn("_reply", F.when(F.col("outcome").isNull(), parse_reply(F.col("response_text"))))
    on = F.col("outcome").isNull()
    confidence = F.when(on, F.col("s1_confidence") * number_field(r, "confidence")).otherwise(F.col("s1_confidence"))
    return (
        merged.withColumn("question_id", F.when(on, _text_or(r, "question_id", taxonomy.NO_QUESTION)).otherwise(taxonomy.NO_QUESTION))
        .withColumn("question_text", _text_or(r, "question_text", ""))
        .withColumn("question_author", _text_or(r, "question_author", ""))
        .withColumn("question_source", _text_or(r, "question_source", ""))
        .withColumn("question_comment_id", _text_or(r, "question_comment_id", ""))
        .withColumn("answer_text", _text_or(r, "answer_text", ""))
        .withColumn("answer_author", _text_or(r, "answer_author", ""))
        .withColumn("answer_comment_id", _text_or(r, "answer_comment_id", ""))
        .withColumn("answer_is_accepted", truthy_field(r, "answer_is_accepted"))
        .withColumn("reasoning", _text_or(r, "reasoning", ""))
        .withColumn("confidence", confidence)
        .withColumn(
            "outcome",
            F.when(F.col("outcome").isNotNull(), F.col("outcome"))
            .when(_lost(gated), "retry")
            .when(r.isNull(), "failed")
            .when(F.col("confidence") < threshold, "low_confidence")
            .otherwise("kept"),
        )
        .withColumnRenamed("category", "stage1_category")
        .drop("_reply", "response_text", "error", "s1_confidence")
    )


def replies_of_stage(responses: DataFrame, stage: int) -> DataFrame:
    return responses.filter(F.col("stage") == stage).select(*THREAD_KEY, "response_text")


def classify_with_responses(
    keys: DataFrame, responses: DataFrame, threshold: float = Settings.confidence_threshold
) -> DataFrame:
    """Both stages with replies looked up in a table; ``keys`` carries no text."""
    gated = stage1_gate(keys.join(replies_of_stage(responses, 1), THREAD_KEY, "left"))
    return stage2_merge(gated.join(replies_of_stage(responses, 2), THREAD_KEY, "left"), threshold)


Scorer = Callable[[list[str]], list[str | None]]


def score(df: DataFrame, prompt: str, scorer: Scorer, attempts: int = 3, group_bytes: int = 4 << 20) -> DataFrame:
    """Ask ``scorer`` about each prompt: (thread key, and part if there is one, response_text, error).

    The scorer gets a list of prompts, of ``group_bytes`` characters or one prompt, and returns one
    text or None for each. Prompts without an answer, and groups that raise, are asked again,
    ``attempts`` times in all. What is still missing is null, with the last error where the scorer
    raised. Write the result to a table before it is used, so that a lost task does not ask again.
    """
    keys = [c for c in PART_KEY if c in df.columns]

    def groups(prompts: pd.Series) -> Iterator[pd.Index]:
        group = (prompts.str.len().fillna(0).cumsum() // group_bytes).astype("int64")
        for _, rows in prompts.groupby(group):
            yield rows.index

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            errors = answers.copy()
            for _ in range(attempts):
                for rows in groups(batch.loc[answers.index[answers.isna()], prompt]):
                    try:
                        answers.loc[rows] = scorer(batch.loc[rows, prompt].tolist())
                        errors.loc[rows] = None
                    except Exception as e:  # asked again, then recorded
                        errors.loc[rows] = f"{type(e).__name__}: {e}"[:500]
            yield batch[keys].assign(response_text=answers, error=errors)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, prompt).mapInPandas(run, f"{kinds}, response_text STRING, error STRING")


def natural_pairs(results: DataFrame, threads: DataFrame, stage1_model: str, stage2_model: str) -> DataFrame:
    """Kept results with their thread. Text is joined last, to kept keys only."""
    kept = results.filter(F.col("outcome") == "kept").drop("outcome")
    return kept.join(
        threads.select(*THREAD_KEY, "title", "url", "created_at", "thread_text", "comments"), THREAD_KEY
    ).select(
        "source",
        "repo",
        "number",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        "created_at",
        "question_id",
        "question_text",
        "question_author",
        "question_source",
        "question_comment_id",
        "answer_text",
        "answer_author",
        "answer_comment_id",
        "answer_is_accepted",
        "confidence",
        "reasoning",
        "stage1_category",
        "thread_text",
        "comments",
        F.lit(stage1_model).alias("stage1_model"),
        F.lit(stage2_model).alias("stage2_model"),
    )


def outcome_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("repo", "outcome").agg(F.count(F.lit(1)).alias("n"))


def question_summary(pairs: DataFrame) -> DataFrame:
    """Pairs per question id over all repos, with its description."""
    counts = pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"))
    return taxonomy.with_description(counts).select("question_id", F.coalesce("description", F.lit("")).alias("description"), "n")


def unprocessed(threads: DataFrame, ledger: DataFrame, stage1_model: str, stage2_model: str) -> DataFrame:
    """Threads in neither the ledger of this model pair nor the general one."""
    done = ledger.filter(F.col("stage_key").isin(stage_key(stage1_model, stage2_model), SEEN_KEY))
    return threads.join(done.select(*THREAD_KEY), THREAD_KEY, "left_anti")


SEEN_KEY = "classify_seen"


def ledger_rows(done: DataFrame, stage1_model: str, stage2_model: str) -> DataFrame:
    """Ledger entries of processed threads, under both keys; failed ones count as done, those to retry don't."""
    if "outcome" in done.columns:
        done = done.filter(~F.coalesce(F.col("outcome") == "retry", F.lit(False)))
    keys = F.array(F.lit(stage_key(stage1_model, stage2_model)), F.lit(SEEN_KEY))
    return done.select(*THREAD_KEY, F.explode(keys).alias("stage_key"))
