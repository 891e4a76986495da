"""Whether two studies may be compared: the same settings but for declared ones, and the same inputs, byte by byte of content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differing(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, old, new) of two maps wherever they differ, also where one has no such key or a null."""
    one, two = (df.select(*[F.col(k).alias(f"{s}_{k}") for k in keys], F.col(value).cast("string").alias(s), F.lit(True).alias(f"has_{s}")) for df, s in ((old, "old"), (new, "new")))
    same = [F.col(f"old_{k}").eqNullSafe(F.col(f"new_{k}")) for k in keys]
    both = one.join(two, same, "full")
    differ = F.col("has_old").isNull() | F.col("has_new").isNull() | ~F.col("old").eqNullSafe(F.col("new"))
    return both.where(differ).select(*[F.coalesce(f"old_{k}", f"new_{k}").alias(k) for k in keys], "old", "new")


def bars(settings: DataFrame, declared: DataFrame, inputs: DataFrame) -> DataFrame:
    """Rows (kind, name, old, new) of all that stands against a comparison.

    settings and declared are rows (name, old, new): what differs, and what was to; a declared
    difference that is not there, or is another, counts too.  inputs are rows (name, old, new) of digests that differ.
    """
    got, want = (df.select("name", F.concat_ws(" -> ", F.coalesce("old", F.lit("none")), F.coalesce("new", F.lit("none"))).alias("change")) for df in (settings, declared))
    odd = differing(want, got, ["name"], "change")
    kind = F.when(F.col("old").isNull(), "setting").when(F.col("new").isNull(), "declared_only").otherwise("other_change")
    return odd.select(kind.alias("kind"), "name", "old", "new").unionByName(inputs.select(F.lit("input").alias("kind"), "name", "old", "new"))


def gated(contrasts: DataFrame, bars: DataFrame, shown: int = 10) -> DataFrame:
    """contrasts, if nothing stands against them; an error that names what does else."""
    found = bars.orderBy("kind", "name").limit(shown).collect()
    if found:
        raise ValueError("the studies cannot be compared: " + "; ".join(f"{r['kind']} {r['name']}: {r['old']} | {r['new']}" for r in found))
    return contrasts
