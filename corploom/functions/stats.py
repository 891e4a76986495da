"""Exact and classical statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import placed, ranked
from ..sources.io import stored

# Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom.
T_975 = [12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922, 2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831, 2.048407, 2.045230, 2.042272]


def t_point(df: Column) -> Column:
    return F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in T_975]), F.when((df >= 1) & (df <= len(T_975)), df.cast("int"))), F.lit(1.959964))


def interval_half(n: Column, sd: Column) -> Column:
    """Half a 95 % interval; null under three values."""
    return F.when(n >= 3, t_point(n - 1) * sd / F.sqrt(n))


def sign_test(wins: Column, losses: Column) -> Column:
    """Exact two-sided p; ties are out before; 1 where nothing is left."""
    n, k = wins + losses, F.least(wins, losses)
    total = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("s")),
        lambda a, i: F.struct((a["c"] * (n - i) / (i + 1)).alias("c"), (a["s"] + a["c"]).alias("s")),
        lambda a: a["s"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * total / F.pow(F.lit(2.0), n)))


def holm(tests: DataFrame, p: str = "p", key: str = "name", family: int | None = None) -> DataFrame:
    """tests (a declared family, a few rows) with p_holm; null p stays null and counts in the family."""
    size = F.lit(family) if family else F.count(F.lit(1)).over(Window.partitionBy())
    order = Window.partitionBy().orderBy(F.col(p).asc_nulls_last(), key)
    stepped = tests.withColumn("_m", size).withColumn("_q", (F.col("_m") - F.row_number().over(order) + 1) * F.col(p))
    return stepped.withColumn("p_holm", F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.max("_q").over(order.rowsBetween(Window.unboundedPreceding, 0))))).drop("_m", "_q")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (n, rho); null under three rows or two values.  Ranks come from counts of distinct values."""
    out = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    for c in (a, b):
        out = ranked(out, [], c, f"r_{c}").drop("_m", "_upto")
    rho = F.when((F.count(F.lit(1)) >= 3) & (F.min(f"r_{a}") < F.max(f"r_{a}")) & (F.min(f"r_{b}") < F.max(f"r_{b}")), F.corr(f"r_{a}", f"r_{b}"))
    return out.agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def ks_pairs(df: DataFrame, group: str, x: str) -> DataFrame:
    """For each two groups a < b: the two-sample Kolmogorov-Smirnov D, its asymptotic p and Cohen's d.

    Counts of distinct values go to each pair of their group by an equi-join; the gap of the two
    distributions is one running sum over all pairs, since each pair's own ends at nought.
    """
    counts = df.groupBy(F.col(group).alias("g"), x).agg(F.count(F.lit(1)).alias("m"))
    sizes = stored(df.groupBy(F.col(group).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var")))
    side = lambda s: sizes.select(*[F.col(c).alias(n) for c, n in (("g", s), ("n", f"n{s}"), ("mean", f"m{s}"), ("var", f"v{s}"))])
    pairs = side("a").join(side("b"), F.col("a") < F.col("b"))  # a row a group, joined once
    part = lambda s, sign: pairs.select(F.col(s).alias("g"), "a", "b", (sign / F.col(f"n{s}")).alias("step"))
    steps = counts.join(part("a", F.lit(1.0)).unionAll(part("b", F.lit(-1.0))), "g").groupBy("a", "b", x).agg(F.sum(F.col("m") * F.col("step")).alias("step"))
    run = placed(steps, [F.col(c) for c in ("a", "b", x)], "_i", F.col("step"), "_before")
    gap = run.groupBy("a", "b").agg(F.max(F.abs(F.col("_before") + F.col("step"))).alias("ks_d"))
    d = gap.join(pairs, ["a", "b"])
    lam = F.col("ks_d") * F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    p = sum((F.lit(2.0 * (-1) ** (j - 1)) * F.exp(-2.0 * j * j * lam * lam) for j in range(1, 101)), F.lit(0.0))
    return d.select("a", "b", "ks_d", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)).alias("p"), ((F.col("ma") - F.col("mb")) / F.sqrt((F.col("va") + F.col("vb")) / 2)).alias("cohens_d"))


def cosine_rate(step: Column, steps: int, warm: int, peak: float, floor: float = 0.1) -> Column:
    """Linear warm-up, then a cosine to floor * peak."""
    part = (step - warm) / F.lit(float(max(1, steps - warm)))
    return F.when(step < warm, peak * (step + 1) / F.lit(float(warm))).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * part))))
