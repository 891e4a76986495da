"""Decisions on grids of study cells: which rate to take, and whether to go on.

A grid is a rate and a seed a cell, few enough for one row of a table.  No decision is made on a grid that is not
complete: whatever the cells that are there say, nothing is selected and the gate stays shut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLOSE = 1e-12


def missing_cells(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared (rate, seed) that no complete cell has."""
    done = cells.where("status = 'complete'").select("rate", "seed").distinct()
    return declared.select("rate", "seed").distinct().join(done, ["rate", "seed"], "left_anti")


def rates(cells: DataFrame, base: DataFrame, declared: DataFrame, tolerance: float) -> DataFrame:
    """A row a declared rate: means over its seeds, and what the base (one row: base_target, base_retention) makes of them."""
    done = cells.where("status = 'complete'").join(declared, ["rate", "seed"], "left_semi").crossJoin(F.broadcast(base))
    every = F.first("base_target"), F.first("base_retention")
    out = done.groupBy("rate").agg(F.avg("target").alias("target_mean"), F.avg("retention").alias("retention_mean"), F.avg("nll").alias("nll_mean"), F.avg("change").alias("change_mean"), F.count_if(F.col("target") >= F.col("base_target")).alias("seeds_at_or_above_base"), every[0].alias("base_target"), every[1].alias("base_retention"))
    return out.withColumn("eligible", F.col("retention_mean") >= F.col("base_retention") - tolerance)


def chosen(table: DataFrame, order: list[Column], where: Column) -> DataFrame:
    """The row that comes first among those of a small table that are eligible; none if none is."""
    place = F.row_number().over(Window.partitionBy().orderBy(*order))
    return table.where(where).withColumn("_place", place).where("_place = 1").drop("_place")


def stage_one(cells: DataFrame, base: DataFrame, declared: DataFrame, tolerance: float, tie: float, least_seeds: int, least_change: float) -> DataFrame:
    """One row: complete, n_missing, selected, four checks, passed.

    Of the rates that retain (mean retention no lower than the base's less tolerance), those whose target mean is within `tie` of the best are
    tied, and the larger rate is taken: it moves more.  The gate opens if there is such a rate, its target
    mean is at or above the base's, so many of its seeds are, and it changes so many predictions.
    """
    missing = missing_cells(cells, declared).agg(F.count(F.lit(1)).alias("n_missing"))
    table = rates(cells, base, declared, tolerance)
    best = F.max(F.when(F.col("eligible"), F.col("target_mean"))).over(Window.partitionBy())
    tied = table.withColumn("_best", best)
    pick = chosen(tied, [F.desc("rate")], F.col("eligible") & (F.col("target_mean") >= F.col("_best") - tie))
    one = missing.join(pick, F.lit(True), "left").withColumn("complete", F.col("n_missing") == 0)
    known = one.withColumn("selected", F.when(F.col("complete"), F.col("rate")))
    check = lambda c: F.when(F.col("complete"), F.coalesce(c, F.lit(False)))
    out = known.select(
        "complete", "n_missing", "selected", check(F.col("rate").isNotNull()).alias("retains"), check(F.col("target_mean") >= F.col("base_target")).alias("at_or_above_base"),
        check(F.col("seeds_at_or_above_base") >= least_seeds).alias("enough_seeds"), check(F.col("change_mean") >= least_change).alias("moves"),
    )
    return out.withColumn("passed", F.coalesce(F.col("retains") & F.col("at_or_above_base") & F.col("enough_seeds") & F.col("moves"), F.lit(False)))


def calibrated_rate(cells: DataFrame, base: DataFrame, declared: DataFrame, tolerance: float) -> DataFrame:
    """One row (complete, selected, reason, holds_base): among the rates over the retention floor the best target, then the lower loss, then the smaller rate.

    If none is over the floor, the best sum of target and retention, then the smaller rate.  Means that differ
    after the twelfth decimal are tied; no loss counts as nought.
    """
    table = rates(cells, base, declared, tolerance + CLOSE)
    missing = missing_cells(cells, declared).agg(F.count(F.lit(1)).alias("n_missing"))
    reached = F.bool_or("eligible").over(Window.partitionBy())
    table = table.withColumn("_reached", reached)
    r12 = lambda c: F.round(c, 12)
    first = F.when(F.col("_reached"), r12(F.col("target_mean"))).otherwise(r12(F.col("target_mean") + F.col("retention_mean")))
    loss = F.when(F.col("_reached"), r12(F.coalesce("nll_mean", F.lit(0.0)))).otherwise(F.lit(0.0))
    pick = chosen(table, [first.desc(), loss.asc(), F.asc("rate")], F.col("eligible") | ~F.col("_reached"))
    one = missing.join(pick, F.lit(True), "left").withColumn("complete", F.col("n_missing") == 0)
    when = lambda c: F.when(F.col("complete"), c)
    return one.select("complete", when(F.col("rate")).alias("selected"), when(F.when(F.col("_reached"), "floor").when(F.col("rate").isNotNull(), "fallback")).alias("reason"), when(F.col("target_mean") >= F.col("base_target") - CLOSE).alias("holds_base"))
