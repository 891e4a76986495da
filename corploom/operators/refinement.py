"""Weights of groups refined over steps in which a proxy learns from what they draw.

Each step draws a batch through the weights (a group by its weight, a row of it evenly), lets the proxy
learn from it, takes every group's loss anew under what it has learned, and moves the weights by
w <- w exp(eta * loss) / sum.  Groups are few: weights are a row a group, stored at each step, so that lineage does not grow.
The pool is read for the draws alone; losses come from sums that a group has once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import small, stored
from .order import placed_within


def drawn(places: DataFrame, sizes: DataFrame, weights: DataFrame, slots: DataFrame, group: str) -> DataFrame:
    """Rows of places (group, r, ...) that slots (u, v) in [0, 1) fall on: a group by its weight, then a row of it evenly."""
    run = Window.partitionBy().orderBy(group)  # a row a group
    total = F.sum("w").over(Window.partitionBy())
    bounds = weights.join(sizes, group).select(group, "m", (F.sum("w").over(run) / total).alias("hi"), ((F.sum("w").over(run) - F.col("w")) / total).alias("lo"))
    hit = slots.join(F.broadcast(bounds), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(group, F.floor(F.col("v") * F.col("m")).alias("r"))
    return hit.join(places, [group, "r"])


def refine(pool: DataFrame, weights: DataFrame, group: str, key: str, draws: Callable[[int], DataFrame], start, learn: Callable, losses: Callable, eta: float, steps: int, settled: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Weights (group, w) after at most `steps` steps, and their path (step, group, w, loss, distance).

    draws(t) gives the slots of step t; learn(state, batch) the proxy's next state from rows of the pool that
    were drawn; losses(state) rows (group, loss) for all groups.  With `settled` it ends before if the total variation between
    weights of two steps is that or less; without, all steps are made, for weights that rest at a step, as where no group has a loss,
    move again as soon as later draws teach the proxy otherwise.  Groups of no weight or no rows are never drawn; weights need not sum to one at first.
    """
    rows = placed_within(pool, [group], [F.col(key)], "r")
    sizes = small(rows.groupBy(group).agg(F.count(F.lit(1)).alias("m")))
    whole = Window.partitionBy()  # a row a group
    now = stored(weights.join(sizes, group, "left_semi").select(group, (F.col("w") / F.sum("w").over(whole)).alias("w")))
    state, path = start, now.select(F.lit(0).alias("step"), group, "w", F.lit(None).cast("double").alias("loss"), F.lit(None).cast("double").alias("distance"))
    for t in range(1, steps + 1):
        state = learn(state, drawn(rows, sizes, now, draws(t), group))
        moved = now.join(losses(state), group).withColumn("e", F.col("w") * F.exp(eta * (F.col("loss") - F.max("loss").over(whole))))
        moved = moved.withColumn("new", F.col("e") / F.sum("e").over(whole))
        after = stored(moved.select(group, F.col("new").alias("w"), "loss", (F.sum(F.abs(F.col("new") - F.col("w"))).over(whole) / 2).alias("distance")))
        path = path.unionByName(after.select(F.lit(t).alias("step"), group, "w", "loss", "distance"))
        now = after.select(group, "w")
        if settled is not None:
            far = after.agg(F.max("distance")).first()[0]
            if far is None or far <= settled:
                break
    return now, path


class MeanProxy:
    """A proxy that predicts one number for all rows, learns by gradient steps on squared error, and is held against a reference's number.

    A group's excess loss is the mean squared error above that of the reference, not below nought; it follows from the
    group's mean and mean square.
    """

    def __init__(self, pool: DataFrame, group: str, value: Column, rate: float, reference: float):
        self.value, self.rate, self.reference, self.group = value, rate, reference, group
        self.sums = small(pool.groupBy(group).agg(F.avg(value).alias("a"), F.avg(value * value).alias("q")))

    def learn(self, state: float, batch: DataFrame) -> float:
        mean = batch.agg(F.avg(self.value)).first()[0]
        return state if mean is None else state + self.rate * (mean - state)

    def losses(self, state: float) -> DataFrame:
        error = lambda x: F.col("q") - 2 * x * F.col("a") + x * x
        return self.sums.select(self.group, F.greatest(F.lit(0.0), error(state) - error(self.reference)).alias("loss"))
