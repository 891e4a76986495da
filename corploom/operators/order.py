"""Places and running sums over a whole table, without a task that holds it.

Rows are range-partitioned by their sort key and stored with the number that Spark gives each: its
partition in the high bits, its place there in the low ones.  Partitions' sizes, as many rows as there
are partitions, make the offsets that turn these into places in the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that takes null for a key like others; keys come once."""
    theirs = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    same = [left[k].eqNullSafe(theirs[f"_key_{k}"]) for k in keys]
    return left.join(theirs, same, how).drop(*[f"_key_{k}" for k in keys])


def placed(df: DataFrame, order: list[Column], name: str = "place", value: Column | None = None, total: str = "before") -> DataFrame:
    """df (stored) with the place of each row in this order, from 0; with a value, also the sum of it over all rows before.

    The order should have no ties, which would fall by chance.
    """
    wide = df if value is None else df.withColumn("_value", value.cast("double"))
    rows = stored(wide.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_n"), 33)
    sums = [F.count(F.lit(1)).alias("_size")] + ([] if value is None else [F.sum("_value").alias("_sum")])
    offsets = rows.groupBy(part.alias("_p")).agg(*sums)  # a row a partition
    before = Window.partitionBy().orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    columns = {"_begin": F.coalesce(F.sum("_size").over(before), F.lit(0))} | ({} if value is None else {"_base": F.coalesce(F.sum("_sum").over(before), F.lit(0.0))})
    offsets = offsets.withColumns(columns).drop("_size", "_sum")
    out = rows.withColumn("_p", part).join(F.broadcast(offsets), "_p")
    new = {name: F.col("_begin") + F.col("_n").bitwiseAND((1 << 33) - 1)}
    if value is not None:
        within = Window.partitionBy("_p").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
        new[total] = F.col("_base") + F.coalesce(F.sum("_value").over(within), F.lit(0.0))
    return out.withColumns(new).drop("_p", "_n", "_begin", "_base", "_value")


def placed_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """df with the place of each row in its group, from 0, however large groups are."""
    rows = placed(df, [*[F.col(c) for c in groups], *order], "_all")
    return within(rows, groups, "_all", name)


def within(rows: DataFrame, groups: list[str], every: str, name: str) -> DataFrame:
    if not groups:
        return rows.withColumnRenamed(every, name)
    first = rows.groupBy(*groups).agg(F.min(every).alias("_first"))
    same = None
    for c in groups:  # a null group is one, too
        first = first.withColumnRenamed(c, f"_g_{c}")
        equal = rows[c].eqNullSafe(first[f"_g_{c}"])
        same = equal if same is None else same & equal
    return rows.join(first, same).withColumn(name, F.col(every) - F.col("_first")).drop(every, "_first", *[f"_g_{c}" for c in groups])


def ranked(df: DataFrame, groups: list[str], value: str, name: str = "rank") -> DataFrame:
    """df with the average rank, from 1, of its value in its group; equal values share one.

    Ranks come from counts of distinct values, so a value that many rows share is one row.  Rows
    without a value have no rank, and go.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_m"))
    run = placed(counts, [F.col(c) for c in (*groups, value)], "_i", F.col("_m"), "_before")
    if groups:
        first = run.groupBy(*groups).agg(F.min("_before").alias("_first"))
        run = joined(run, first, groups)
    else:
        run = run.withColumn("_first", F.lit(0.0))
    ranks = run.select(*groups, value, "_m", (F.col("_before") - F.col("_first") + (F.col("_m") + 1) / 2).alias(name), (F.col("_before") - F.col("_first") + F.col("_m")).alias("_upto"))
    return joined(df, ranks, [*groups, value])


def quantiles(df: DataFrame, value: str, levels: list[float], groups: list[str] = (), name: str = "q") -> DataFrame:
    """(groups, name): exact quantiles of value, interpolated between neighbours, as an array; a row a group, or one.

    They are read off the running counts of distinct values, so no task holds a group's values.
    """
    groups = list(groups)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_m"))
    run = placed(counts, [F.col(c) for c in (*groups, value)], "_i", F.col("_m"), "_before")
    sizes = run.groupBy(*groups).agg(F.min("_before").alias("_first"), F.sum("_m").alias("_n"))
    both = run.crossJoin(F.broadcast(sizes)) if not groups else joined(run, sizes, groups)
    at = F.col("_before") - F.col("_first")
    wanted = [(k, q, f) for k, q in enumerate(levels) for f in (F.floor, F.ceil)]
    spots = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(f is F.ceil).alias("up"), f(F.lit(q) * (F.col("_n") - 1)).alias("i")) for k, q, f in wanted])
    hit = both.select(*groups, "_n", F.col(value).cast("double").alias("_x"), F.explode(F.filter(spots, lambda s: (s["i"] >= at) & (s["i"] < at + F.col("_m")))).alias("_s"))
    side = lambda k, up: F.max(F.when((F.col("_s.k") == k) & (F.col("_s.up") == up), F.col("_x")))
    made = []
    for k, q in enumerate(levels):
        part = F.lit(q) * (F.first("_n") - 1)
        made.append(side(k, False) + (part - F.floor(part)) * (side(k, True) - side(k, False)))
    return hit.groupBy(*groups).agg(F.array(*made).alias(name))
