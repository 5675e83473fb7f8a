"""Generations and committed batches of incremental jobs.

A job keeps what it makes in ``<root>/generation=N``. Each batch writes its own folders and is
committed by one marker file, so readers never see half a batch. Starting over means writing a new
generation next to the old one; readers change over when it is committed, and nothing is deleted
before. Committed batches are folded into a table partitioned by repo, again behind a marker.

    <root>/_generations/<N>.started, <N>.committed
    <root>/generation=<N>/<dataset>/batch_id=<B>/...
    <root>/generation=<N>/_batches/<B>                       counts and notes of the batch, as JSON
    <root>/generation=<N>/tables/<dataset>/repo_dir=<R>/upto=<B>/...
    <root>/generation=<N>/_folded/<dataset>/<B>
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forgeline.functions.text import repo_folder
from forgeline.sources.tables import refresh


def _path(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def mark(spark: SparkSession, path: str, note: dict | None = None) -> None:
    """Create a marker file; it is there as a whole or not at all."""
    target, fs = _path(spark, path)
    draft, _ = _path(spark, f"{target.getParent()}/.{target.getName()}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(note or {}).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"could not create {path}")


def note_of(spark: SparkSession, path: str) -> dict:
    """What :func:`mark` left in a marker file."""
    target, fs = _path(spark, path)
    stream = fs.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist; drafts are left out."""
    folder, fs = _path(spark, path)
    if not fs.exists(folder):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(folder) if not s.getPath().getName().startswith("."))


def numbers(spark: SparkSession, path: str, suffix: str = "") -> list[int]:
    found = [n.removesuffix(suffix) for n in names(spark, path) if n.endswith(suffix)]
    return sorted(int(n) for n in found if n.isdigit())


def remove(spark: SparkSession, path: str) -> None:
    folder, fs = _path(spark, path)
    fs.delete(folder, True)


# -- generations -----------------------------------------------------------------


def newest(spark: SparkSession, root: str) -> int | None:
    """The generation that readers take: the last one committed."""
    return max(numbers(spark, f"{root}/_generations", ".committed"), default=None)


def current(spark: SparkSession, root: str) -> str | None:
    """Folder of the generation that readers take."""
    number = newest(spark, root)
    return None if number is None else f"{root}/generation={number}"


def begin(spark: SparkSession, root: str, force: bool = False) -> str:
    """Folder of the generation to write: the current one, or with ``force`` one that starts from nothing.

    A forced run that did not get to its commit is gone on with by the next forced one.
    """
    done = newest(spark, root)
    started = numbers(spark, f"{root}/_generations", ".started")
    if done is None:
        number = max(started, default=0)
    elif force:
        number = max([n for n in started if n > done], default=done + 1)
    else:
        number = done
    mark(spark, f"{root}/_generations/{number}.started")
    return f"{root}/generation={number}"


def commit(spark: SparkSession, root: str, generation: str) -> None:
    """Make a generation the one that readers take."""
    mark(spark, f"{root}/_generations/{generation.rpartition('=')[2]}.committed")


def drop_old(spark: SparkSession, root: str) -> list[int]:
    """Delete generations before the current one; returns them."""
    done = newest(spark, root)
    old = [n for n in numbers(spark, f"{root}/_generations", ".started") if done is not None and n < done]
    for number in old:
        remove(spark, f"{root}/generation={number}")
        for event in ("committed", "started"):
            remove(spark, f"{root}/_generations/{number}.{event}")
    return old


# -- batches ---------------------------------------------------------------------


def commit_batch(spark: SparkSession, generation: str, batch_id: int, note: dict | None = None) -> None:
    """From now on readers see the batch."""
    mark(spark, f"{generation}/_batches/{batch_id}", note)


def committed_batches(spark: SparkSession, generation: str) -> list[int]:
    return numbers(spark, f"{generation}/_batches")


def batch_note(spark: SparkSession, generation: str, batch_id: int) -> dict:
    return note_of(spark, f"{generation}/_batches/{batch_id}")


def _folded(spark: SparkSession, generation: str, dataset: str) -> list[int]:
    return numbers(spark, f"{generation}/_folded/{dataset}")


def _open_batches(spark: SparkSession, generation: str, dataset: str, schema: str, batches: list[int]) -> DataFrame:
    present = set(names(spark, f"{generation}/{dataset}"))
    paths = [f"{generation}/{dataset}/batch_id={b}" for b in batches if f"batch_id={b}" in present]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def read_batches(
    spark: SparkSession, generation: str, dataset: str, schema: str, after: int = -1, upto: int | None = None
) -> DataFrame:
    """Rows of the committed batches with ``after < batch <= upto`` that are still in their folders."""
    chosen = [b for b in committed_batches(spark, generation) if b > after and (upto is None or b <= upto)]
    return _open_batches(spark, generation, dataset, schema, chosen)


def read(
    spark: SparkSession, generation: str | None, dataset: str, schema: str, repos: list[str] | None = None
) -> DataFrame:
    """All committed rows of a dataset: the folded table and the batches after it; ``repos`` prunes to theirs."""
    if generation is None:
        return spark.createDataFrame([], schema)
    done = _folded(spark, generation, dataset)
    rows = read_batches(spark, generation, dataset, schema, max(done, default=-1))
    if repos is not None:
        rows = rows.filter(F.col("repo").isin(repos))
    if done:
        full = f"{schema}, repo_dir STRING, upto BIGINT"
        # A fold that did not get to its marker is passed over.
        stored = spark.read.schema(full).parquet(f"{generation}/tables/{dataset}").filter(F.col("upto").isin(done))
        if repos is not None:
            stored = stored.filter(F.col("repo_dir").isin([r.replace("/", "__") for r in repos]))
        rows = stored.drop("repo_dir", "upto").unionByName(rows)
    return rows


def fold(spark: SparkSession, generation: str, dataset: str, schema: str) -> int:
    """Move committed batches into the table partitioned by repo; returns the last batch in it.

    Running it again after a crash writes the same partitions again; readers see them once the
    marker is there.
    """
    done = max(_folded(spark, generation, dataset), default=-1)
    todo = [b for b in committed_batches(spark, generation) if b > done]
    if not todo:
        return done
    rows = _open_batches(spark, generation, dataset, schema, todo)
    path = f"{generation}/tables/{dataset}"
    (
        rows.withColumns({"repo_dir": repo_folder(F.col("repo")), "upto": F.lit(todo[-1]).cast("bigint")})
        .hint("rebalance", "repo_dir")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("repo_dir", "upto")
        .parquet(path)
    )
    mark(spark, f"{generation}/_folded/{dataset}/{todo[-1]}")
    refresh(spark, path)
    return todo[-1]


def drop_folded(spark: SparkSession, generation: str, dataset: str) -> None:
    """Delete the batch folders of a dataset that are in its table."""
    done = max(_folded(spark, generation, dataset), default=-1)
    for batch in committed_batches(spark, generation):
        if batch <= done:
            remove(spark, f"{generation}/{dataset}/batch_id={batch}")
