"""Small tables put in the order that NumPy's generator gives: for results that must repeat its permutations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 4096  # rows, of which the driver sees the number


def permutation(n: int, seed: int) -> list[int]:
    """For each place the place that its value comes from, as `numpy.random.default_rng(seed).permutation`."""
    return np.random.default_rng(seed).permutation(n).tolist()


def permuted(table: DataFrame, order: list[Column], column: str, seed: int) -> DataFrame:
    """table, a few rows such as cells, with the values of column dealt anew over its rows in this order, which should have no ties."""
    n = table.count()
    if n > MOST:
        raise ValueError(f"{n} rows are too many for a permutation in the driver")
    numbered = table.withColumn("_i", F.row_number().over(Window.partitionBy().orderBy(*order)) - 1)
    places = table.sparkSession.createDataFrame(list(enumerate(permutation(n, seed))) or [(0, 0)], "_i int, _j int")
    theirs = numbered.select(F.col("_i").alias("_j"), F.col(column).alias("_v"))
    return numbered.join(F.broadcast(places), "_i").join(theirs, "_j").withColumn(column, F.col("_v")).drop("_i", "_j", "_v")
