"""Masses of cells kept up to date as documents come.

A micro-batch is scored by itself, and what it adds to each cell is written to a folder that has the batch's number:
one that is run again after a failure replaces itself, and the masses stay what they were.  The masses are
the sum of these deltas.  `compact` folds the deltas so far into a snapshot; batches that it
holds are passed over if they come again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def held(spark: SparkSession, path: str) -> int:
    """The last batch that a snapshot holds; -1 where there is none."""
    try:
        row = spark.read.parquet(f"{path}/snapshots").agg(F.max("upto")).first()
    except AnalysisException:  # no snapshot yet
        return -1
    return -1 if row[0] is None else int(row[0])


def adder(path: str, score: Callable[[DataFrame], DataFrame], keys: list[str], sums: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: sums (SQL, over what score makes of a batch) by keys, in the batch's own folder."""

    def add(batch: DataFrame, number: int) -> None:
        if number > held(batch.sparkSession, path):
            score(batch).groupBy(*keys).agg(*[F.expr(c).alias(n) for n, c in sums.items()]).write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")

    return add


def follow(documents: DataFrame, add: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs until all documents that there are have been added, and ends."""
    return documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parts(spark: SparkSession, path: str, schema: str, upto: int | None = None) -> DataFrame:
    """The latest snapshot and the deltas after it, up to a batch if one is given."""
    last = held(spark, path)
    later = spark.read.schema(f"{schema}, batch bigint").parquet(f"{path}/deltas").where(F.col("batch") > last)
    if upto is not None:
        later = later.where(F.col("batch") <= upto)
    later = later.drop("batch")
    if last < 0:
        return later
    return spark.read.schema(f"{schema}, upto bigint").parquet(f"{path}/snapshots").where(F.col("upto") == last).drop("upto").unionByName(later)


def masses(spark: SparkSession, path: str, schema: str, keys: list[str], upto: int | None = None) -> DataFrame:
    """What all batches add up to, a row a cell; null keys are cells of their own."""
    rows = parts(spark, path, schema, upto)
    return rows.groupBy(*keys).agg(*[F.sum(n).cast(t).alias(n) for n, t in rows.dtypes if n not in keys])


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], upto: int) -> None:
    """A snapshot of batches 0 to upto, which the stream must have finished; there already, it stays."""
    if upto > held(spark, path):
        masses(spark, path, schema, keys, upto).coalesce(1).write.mode("overwrite").parquet(f"{path}/snapshots/upto={upto}")
