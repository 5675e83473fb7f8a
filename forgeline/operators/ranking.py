"""Ranking, as-of and median building blocks that survive hot groups.

None of them sorts or collects one group of unbounded size in a single task:
top-k keeps k rows per group on the map side, ranks and medians work on
buckets whose size is bounded by the key's resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANK_BUCKET = 65_536


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group in a total order.

    The ``<= k`` filter on row_number lets Spark keep k rows per group before the
    shuffle as well as after it.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def collected(record: Column, rank: str) -> Column:
    """Aggregate of the records of a group as an array, ordered by ``rank``."""
    gathered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("at"), record.alias("row"))))
    return F.transform(gathered, lambda x: x["row"])


def nest(df: DataFrame, keys: list[str], record: Column, rank: str, name: str) -> DataFrame:
    """Collect the ranked rows left by :func:`top_k` into one ordered array."""
    return df.groupBy(*keys).agg(collected(record, rank).alias(name))


def with_rank(
    df: DataFrame,
    keys: list[str],
    number: str,
    where: Column,
    totals: dict[str, Column] | None = None,
    rank: str = "rank",
) -> DataFrame:
    """Rows with ``where``, numbered from 1 within their group by a unique whole number.

    Rows are numbered inside buckets of the number line, then shifted by the count
    of rows in earlier buckets. A bucket holds at most ``RANK_BUCKET`` rows because
    the number is unique in the group, so even a group with a third of all rows is
    ranked by many tasks. ``totals`` are counts of predicates over the whole group,
    attached to every row from the same small bucket table.
    """
    totals = totals or {}
    bucketed = df.withColumn("_bucket", F.floor(F.col(number) / RANK_BUCKET))
    sizes = bucketed.groupBy(*keys, "_bucket").agg(
        F.count_if(where).alias("_size"), *[F.count_if(c).alias(name) for name, c in totals.items()]
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"),
        *[F.sum(name).over(group).alias(name) for name in totals],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(number)
    return (
        bucketed.filter(where)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(rank, F.row_number().over(inside) + F.col("_offset"))
        .drop("_bucket", "_offset")
    )


def exact_median(df: DataFrame, keys: list[str], value: str, bucket: Column) -> DataFrame:
    """Exact median and sample size per group: (keys, median, sample_size).

    Values are first reduced to (value, count). ``bucket`` must grow with the value
    and split its range so that a bucket holds a bounded number of distinct values.
    Running counts over the buckets find the one or two that hold the middle; only
    those are looked into. An even sample averages its two middle values.
    """
    counts = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, bucket.alias("_bucket"), F.col(value).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = counts.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("_in_bucket"))
    group = Window.partitionBy(*keys)
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = (
        totals.withColumn("sample_size", F.sum("_in_bucket").over(group))
        .withColumn("_through", F.sum("_in_bucket").over(running))
        .withColumn("_before", F.col("_through") - F.col("_in_bucket"))
        .withColumn("_low", F.expr("(sample_size + 1) div 2"))
        .withColumn("_high", F.expr("(sample_size + 2) div 2"))
        .filter((F.col("_before") < F.col("_high")) & (F.col("_through") >= F.col("_low")))
        .select(*keys, "_bucket", "_before", "_low", "_high", "sample_size")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_value")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        counts.join(middle, [*keys, "_bucket"])
        .withColumn("_to", F.sum("_n").over(upto) + F.col("_before"))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )

    def holds(rank: str) -> Column:
        return (F.col("_from") < F.col(rank)) & (F.col("_to") >= F.col(rank))

    return ranked.groupBy(*keys).agg(
        (
            (F.max(F.when(holds("_low"), F.col("_value"))) + F.max(F.when(holds("_high"), F.col("_value")))) / 2
        ).alias("median"),
        F.max("sample_size").alias("sample_size"),
    )
