"""Exact top-k inner products by norm-bucketed retrieval (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forgeline.sources.tables import settle

SEEDS = 2048  # longest vectors, from which every query gets a first bound
BUCKETS = 16  # groups of vectors of like length, at most
CANDIDATES = 8192  # vectors of a bucket compared in one task
QUERIES = 2048  # queries compared in one task
ROWS_AT_ONCE = 128
COORDINATES = 3  # largest components of a query that coordinate pruning looks at
MOST_BLOCKS = 1 << 40  # numbers set aside for the blocks of a bucket
HIGH_COSINE = 0.6  # from this local threshold on, coordinates prune better than lengths


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(uid, id, norm, parts): components as floor(scale * x), x as double; unusable rows left out."""
    parts = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint"))
    whole = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    )
    usable = vectors.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & whole)
    norm = F.sqrt(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return usable.select(
        F.monotonically_increasing_id().alias("uid"), F.col(key).cast("bigint").alias("id"), parts.alias("parts")
    ).withColumn("norm", norm)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``, as whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def widest(column: pa.Array | pa.ChunkedArray) -> int:
    return max((len(x) for x in column.to_pylist()), default=0) if len(column) else 0


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: by floating point where all sums are whole numbers below 2**53."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if bound < 2**53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((uids[at], ids[at], -scores[at]))][:k]


def local_search(left: pa.Table, right: pa.Table, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query row, candidate rows, scores) for a block of queries and a block of one bucket.

    A query's local cosine threshold is its bound over the product of its length and the
    longest vector here. Above 1 nothing here can reach it. Below ``HIGH_COSINE`` candidates
    are pruned by length: only those long enough to reach the bound at full cosine. From there
    on by coordinates: on its largest components a candidate of that cosine must lie near the
    query. What is left is verified by its exact product.
    """
    width = max(widest(left["parts"]), widest(right["parts"]))
    order = np.argsort(-right["norm"].to_numpy(), kind="stable")
    c = matrix(right["parts"], width)[order]
    norms = right["norm"].to_numpy()[order]
    ids, uids = right["id"].to_numpy()[order], right["uid"].to_numpy()[order]
    unit = c / np.maximum(norms, 1e-300)[:, None]
    q = matrix(left["parts"], width)
    q_norm, bound, q_uid = left["norm"].to_numpy(), left["bound"].to_numpy().astype(np.float64), left["uid"].to_numpy()
    top = norms[0] if len(norms) else 0.0
    reach = q_norm * top
    # rounding of lengths must not prune a tie
    slack = 1e-9 * np.maximum(1.0, np.abs(bound))
    floor = bound - slack
    cosine = np.where(reach > 0, floor / np.maximum(reach, 1e-300), np.where(floor > 0, 2.0, -1.0))
    by_length = np.flatnonzero(cosine < HIGH_COSINE)
    for at in range(0, len(by_length), ROWS_AT_ONCE):
        rows = by_length[at : at + ROWS_AT_ONCE]
        need = np.where(q_norm[rows] > 0, floor[rows] / np.maximum(q_norm[rows], 1e-300), -np.inf)
        count = np.searchsorted(-norms, -need, "right")
        count[floor[rows] <= 0] = len(norms)
        table = products(q[rows], c[: int(count.max(initial=0))])
        for row, n, scores in zip(rows, count, table):
            use = np.flatnonzero((scores[:n] >= bound[row]) & (uids[:n] != q_uid[row]))
            pick = best(scores[use], ids[use], uids[use], k)
            yield row, order[use[pick]], scores[use[pick]]
    for row in np.flatnonzero((cosine >= HIGH_COSINE) & (cosine <= 1)):
        t = cosine[row]
        u = q[row] / q_norm[row]
        near = np.arange(len(norms))
        for f in np.argsort(-np.abs(u))[:COORDINATES]:
            wide = np.sqrt(max(0.0, (1 - u[f] ** 2) * (1 - t**2))) + 1e-9
            near = near[np.abs(unit[near, f] - u[f] * t) <= wide + (1 - t) * abs(u[f])]
        scores = products(q[row : row + 1], c[near])[0]
        use = np.flatnonzero((scores >= bound[row]) & (uids[near] != q_uid[row]))
        near, scores = near[use], scores[use]
        pick = best(scores, ids[near], uids[near], k)
        yield row, order[near[pick]], scores[pick]


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k highest integer inner products of every query with all rows but itself.

    Components become floor(scale * x). Vectors fall into buckets of like length. Every query
    first meets the ``SEEDS`` longest vectors, which gives it a lower bound of its k-th score;
    a bucket whose longest vector can't reach the bound is left out for it. The rest is compared in
    blocks of queries against blocks of a bucket, each task pruning by length or coordinates as
    its local cosine threshold suggests, and each query's block results are merged by rank.

    Ties go to the smaller key. Rows with a null key, and vectors that are null or hold null,
    NaN or infinite components take no part. Missing components of shorter vectors count as 0.
    Rows that repeat are different candidates of each other. Queries with fewer than k others
    get all. An empty table gives no rows. Scores must fit 64 bits. Other columns may be used by
    ``is_query`` only.
    """
    usable = settle(integer_vectors(vectors, key, vector, scale).withColumnRenamed("id", key), "vectors")
    marked = usable.withColumn("asks", is_query).withColumnRenamed(key, "id")
    seeds = usable.orderBy(F.col("norm").desc(), "uid").limit(SEEDS).select("uid", "parts").toArrow()
    cuts = usable.agg(
        F.percentile_approx("norm", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("cuts")
    ).first()["cuts"]
    cuts = sorted(set(cuts or []))
    bucket = sum((F.when(F.col("norm") >= c, 0).otherwise(1) for c in cuts), F.lit(0))
    sized = marked.withColumn("bucket", bucket)
    stats = {
        r["bucket"]: (r["count"], r["longest"])
        for r in sized.groupBy("bucket").agg(F.count("*").alias("count"), F.max("norm").alias("longest")).collect()
    }

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with the k-th score among the seeds, the buckets that can reach it."""
        width = widest(seeds["parts"])
        uid, wide = seeds["uid"].to_numpy(), None
        for batch in batches:
            full = max(width, widest(batch.column("parts")))
            if wide is None or wide.shape[1] < full:
                wide = matrix(seeds["parts"], full)
            q = matrix(batch.column("parts"), full)
            bound = np.full(len(q), np.iinfo(np.int64).min + 1, np.int64)
            for at in range(0, len(q), ROWS_AT_ONCE):
                scores = products(q[at : at + ROWS_AT_ONCE], wide)
                own = uid[None, :] == batch.column("uid").to_numpy()[at : at + ROWS_AT_ONCE, None]
                scores[own] = np.iinfo(np.int64).min + 1
                if scores.shape[1] >= k:
                    bound[at : at + ROWS_AT_ONCE] = np.partition(scores, scores.shape[1] - k, 1)[:, -k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("uid", "id", "norm", "parts")] + [pa.array(bound)],
                names=["uid", "id", "norm", "parts", "bound"],
            )

    asked = marked.filter("asks").select("uid", "id", "norm", "parts")
    n_queries = asked.count()
    q_blocks = max(1, -(-n_queries // QUERIES))
    blocks = {b: max(1, -(-n // CANDIDATES)) for b, (n, _) in stats.items()}
    schema = "uid bigint, id bigint, norm double, parts array<bigint>, bound bigint"
    queries = settle(asked.mapInArrow(bounded, schema), "queries")
    # every bucket in reach, and every block in it
    reach = F.array(
        *[
            F.when(
                F.col("bound") <= F.col("norm") * longest * (1 + 1e-9) + 1,
                F.sequence(F.lit(b * MOST_BLOCKS), F.lit(b * MOST_BLOCKS + blocks[b] - 1)),
            )
            for b, (_, longest) in sorted(stats.items())
        ]
    ).cast("array<array<bigint>>")
    # both sides' keys have one type: as int and bigint, equal numbers hash to different partitions
    left = queries.withColumn("block", F.explode(F.flatten(F.filter(reach, lambda x: x.isNotNull())))).withColumn(
        "part", F.pmod(F.xxhash64("uid"), F.lit(q_blocks)).cast("bigint")
    )
    count = F.coalesce(*[F.when(F.col("bucket") == b, F.lit(n)) for b, n in blocks.items()], F.lit(1))
    right = (
        sized.select("uid", "id", "norm", "parts", "bucket")
        .withColumn("block", F.col("bucket").cast("bigint") * MOST_BLOCKS + F.pmod(F.xxhash64("uid"), count))
        .drop("bucket")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)).cast("array<bigint>")))
    )

    def compare(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        owner, ids, uids, scores = [], [], [], []
        if len(queries) and len(candidates):
            c_id, c_uid = candidates["id"].to_numpy(), candidates["uid"].to_numpy()
            for row, found, score in local_search(queries, candidates, k):
                owner.append(np.full(len(found), row))
                ids.append(c_id[found])
                uids.append(c_uid[found])
                scores.append(score)
        none = [np.empty(0, np.int64)]
        rows = np.concatenate(owner + none).astype(np.int64)
        return pa.table(
            {
                "query_uid": queries["uid"].to_numpy()[rows] if len(queries) else none[0],
                "query_id": queries["id"].to_numpy()[rows] if len(queries) else none[0],
                key: np.concatenate(ids + none),
                "uid": np.concatenate(uids + none),
                "score": np.concatenate(scores + none),
            }
        )

    schema = f"query_uid bigint, query_id bigint, `{key}` bigint, uid bigint, score bigint"
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(compare, schema)
    order = Window.partitionBy("query_uid").orderBy(F.col("score").desc(), key, "uid")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", key, "score")
    )
