"""Threads longer than a scorer's window: asked part by part, one outcome for each thread."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.operators.classify import PART_KEY, THREAD_KEY

BLOCK_END = "\n---\n"
# Of the outcomes of a thread's parts the first in this order is the thread's. A part that could not
# be asked or read comes before those that hold nothing, so that it is seen and can be asked again.
OUTCOMES = ("kept", "low_confidence", "retry", "failed", "parse_error_s1", "no_qa")


def thread_parts(threads: DataFrame, window: int, text: str = "thread_text") -> DataFrame:
    """Threads with their ``part`` (from 0), none longer than ``window`` characters.

    A thread that fits is its part 0 and stays where it is read. Of a longer one every comment
    begins a new block, and blocks of more than half a window are cut. Blocks that begin in the
    same half window make a part, so parts are whole comments where these are short enough. No
    character is lost or repeated.
    """
    half = max(1, window // 2)
    others = [c for c in threads.columns if c != text]
    short = threads.filter(F.coalesce(F.length(text), F.lit(0)) <= window).select(
        *others, F.lit(0).cast("bigint").alias("part"), text
    )
    ends = F.split(F.col(text), BLOCK_END)
    last = F.size(ends) - 1
    blocks = F.transform(ends, lambda b, k: F.when(k < last, F.concat(b, F.lit(BLOCK_END))).otherwise(b))
    pieces = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.sequence(F.lit(0), F.floor((F.greatest(F.length(b), F.lit(1)) - 1) / half).cast("int")),
                lambda k: F.substring(b, k * half + 1, F.lit(half)),
            ),
        )
    )
    long = threads.filter(F.length(text) > window)
    cut = long.select(*THREAD_KEY, F.posexplode(pieces).alias("at", "piece"))
    before = Window.partitionBy(*THREAD_KEY).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("part", F.floor(F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) / half))
    joined = placed.groupBy(*THREAD_KEY, "part").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))
    whole = joined.select(
        *THREAD_KEY, "part", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias(text)
    )
    again = whole.join(long.select(*others), THREAD_KEY).select(*others, "part", text)
    return short.unionByName(again)


def merge_parts(results: DataFrame) -> DataFrame:
    """One row per thread: of its parts the one with the first outcome of ``OUTCOMES``, the surest, the first."""
    rank = F.array_position(F.array(*[F.lit(o) for o in OUTCOMES]), F.col("outcome"))
    columns = [c for c in results.columns if c not in PART_KEY]
    order = F.struct(rank.alias("rank"), (-F.col("confidence")).alias("less"), "part", F.struct(*columns).alias("row"))
    return results.groupBy(*THREAD_KEY).agg(F.min(order).alias("best")).select(*THREAD_KEY, "best.row.*")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z]{3,})"), F.lit(1)))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), use), 0)


def keyword_replies(prompts: DataFrame, stage: int, keywords: dict[str, list[str]], questions: dict[str, str]) -> DataFrame:
    """Replies by keywords, without a model: keys and ``response_text``.

    Stage 1 names the category (first of equals) whose words the thread has most of, as sure as hits / (hits + 1).
    Stage 2 takes the question that ``questions`` has for that category. A thread without a hit
    has no question. All of it are expressions.
    """
    text = F.substring_index(F.substring_index("prompt", "\n</thread>", 1), "<thread>\n", -1)

    def best(words: Column) -> Column:
        return F.array_max(
            F.array(
                *[
                    F.struct(
                        F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in wanted]))).alias("hits"),
                        F.lit(-place).alias("place"),
                        F.lit(category).alias("category"),
                        F.lit(questions[category]).alias("question"),
                        F.get(words, 0).alias("first"),
                    )
                    for place, (category, wanted) in enumerate(sorted(keywords.items()))
                ]
            )
        )

    def reply(found: Column) -> Column:
        n = found["hits"]
        if stage == 1:
            sure = (n / (n + 1)).alias("confidence")
            return F.to_json(F.struct((n > 0).alias("contains_qa"), found["category"].alias("category"), sure))
        return F.to_json(
            F.struct(
                found["question"].alias("question_id"),
                F.lit(0.9).alias("confidence"),
                found["first"].alias("answer_text"),
                F.lit("keywords").alias("reasoning"),
            )
        )

    keys = [c for c in PART_KEY if c in prompts.columns]
    answer = _once(_words(text), lambda words: _once(best(words), reply))
    return prompts.select(*keys, answer.alias("response_text"))
