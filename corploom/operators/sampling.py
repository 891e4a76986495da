"""Draws with replacement, and weights that are stepped again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import placed


def draw(rows: DataFrame, slots: DataFrame, cells: int, key: str = "doc_id", p: str = "p", u: str = "u") -> DataFrame:
    """For each slot (a number u in [0, 1)) the row in whose stretch of the summed p it falls.

    Stretches and slots meet by the cell of [0, 1) that they lie in, of `cells` equal ones (about as many as
    slots): an equi-join, in which a row stands once for each cell that it reaches into.
    """
    run = placed(rows, [F.col(key)], "_place", F.col(p), "_lo").withColumn("_hi", F.col("_lo") + F.col(p))
    cell = lambda x: F.least(F.lit(cells - 1), F.floor(x * cells)).cast("long")
    wide = run.where(F.col(p) > 0).withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    hit = slots.withColumn("_cell", cell(F.col(u))).join(wide, "_cell").where((F.col(u) >= F.col("_lo")) & (F.col(u) < F.col("_hi")))
    return hit.drop("_cell", "_lo", "_hi", "_place")


def weight_path(losses: DataFrame, key: str, step: str, loss: str, eta: float, smooth: float) -> DataFrame:
    """(key, last_weight, mean_weight) after w <- (1 - smooth) softmax(ln w + eta loss) + smooth / k at each step, from uniform.

    Groups and steps are few: their losses are one row of arrays, over which the steps fold.
    """
    by_key = losses.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.col(loss).alias("x")))).alias("xs"))
    one = by_key.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("xs")))).alias("g"))
    one = one.withColumn("n", F.size("g")).withColumn("steps", F.size(F.col("g")[0]["xs"]))

    def fold(state, t):
        e = F.zip_with(state["w"], "g", lambda w, g: w * F.exp(eta * g["xs"][t]["x"]))
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        new = F.transform(e, lambda x: (1 - smooth) * x / total + smooth / F.col("n"))
        return F.struct(new.alias("w"), F.zip_with(state["sum"], new, lambda a, b: a + b).alias("sum"))

    start = F.struct(F.transform("g", lambda x: 1.0 / F.col("n")).alias("w"), F.transform("g", lambda x: F.lit(0.0)).alias("sum"))
    done = one.withColumn("r", F.aggregate(F.sequence(F.lit(0), F.col("steps") - 1), start, fold))
    return done.select("steps", F.explode(F.arrays_zip(F.transform("g", lambda x: x["k"]).alias("k"), F.col("r.w").alias("w"), F.col("r.sum").alias("sum"))).alias("x")).select(F.col("x.k").alias(key), F.col("x.w").alias("last_weight"), (F.col("x.sum") / F.col("steps")).alias("mean_weight"))
