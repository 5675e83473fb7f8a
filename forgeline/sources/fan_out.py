"""Several datasets from one scan.

Each input row is turned into the rows that it gives of every dataset, tagged with the dataset's
name, and written partitioned by it and by repo in a single narrow job. The partitions are then
renamed into the datasets' own folders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from forgeline.functions.text import repo_folder
from forgeline.sources import generations
from forgeline.sources.tables import refresh


def tagged(df: DataFrame, datasets: dict[str, Column]) -> DataFrame:
    """Rows of all datasets with the columns of all; ``datasets`` gives an array of structs for each.

    A column that two datasets share must have one type.
    """
    kinds: dict[str, StructType] = {name: df.select(rows.alias("r")).schema["r"].dataType.elementType for name, rows in datasets.items()}
    fields: dict[str, str] = {}
    for name, kind in kinds.items():
        for f in kind.fields:
            if fields.setdefault(f.name, f.dataType.simpleString()) != f.dataType.simpleString():
                raise ValueError(f"{f.name} of {name} has another type elsewhere")

    def widen(name: str) -> Callable[[Column], Column]:
        own = set(kinds[name].names)

        def widened(row: Column) -> Column:
            values = [(row[f] if f in own else F.lit(None).cast(t)).alias(f) for f, t in fields.items()]
            return F.struct(F.lit(name).alias("dataset"), *values)

        return widened

    parts = [F.transform(rows, widen(name)) for name, rows in datasets.items()]
    return df.select(F.inline(F.concat(*parts)))


def write(df: DataFrame, root: str, datasets: dict[str, Column]) -> None:
    """Write all datasets (with a ``repo`` column each) to ``<root>/<dataset>/repo_dir=...``.

    Of the repos in ``df`` a dataset's partitions are replaced, one rename each; datasets follow in
    the order given, so the presence of the last one says that all are there.
    """
    spark = df.sparkSession
    staged = f"{root}/_staged/{uuid.uuid4().hex}"
    rows = tagged(df, datasets).withColumn("repo_dir", repo_folder(F.col("repo")))
    rows.write.partitionBy("dataset", "repo_dir").parquet(staged)
    for name in datasets:
        source = f"{staged}/dataset={name}"
        for partition in generations.names(spark, source):
            target, fs = generations._path(spark, f"{root}/{name}/{partition}")
            fs.mkdirs(target.getParent())
            fs.delete(target, True)
            moved, _ = generations._path(spark, f"{source}/{partition}")
            if not fs.rename(moved, target):
                raise OSError(f"could not publish {target}")
        refresh(spark, f"{root}/{name}")
    generations.remove(spark, staged)
