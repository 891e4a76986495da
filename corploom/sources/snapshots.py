"""Pinned tables: a tree of SHA-256 digests over ranges of a key, which says whether a table changed, and where.

A row's digest is that of its columns, by name, as JSON; how rows lie in files says nothing, so equal content has
equal digests.  Ranges of a whole-number key are so many numbers wide; other keys go by the first digits
of their own digest.  Inside a range rows are grouped by digits of their digests, as many as its number of rows
asks for, so that a key that holds a third of a table is summed up by many tasks; rows that repeat
count as one and a number.  Digests of groups make their range's, sixteen ranges the next level's, and so on up to
one root.  Null keys are a range of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .io import stored

GROUP = 256  # distinct rows that a group has, about
FAN_BITS = 4
HASHED_BITS = 16


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row as JSON, its columns by name; null ones are written as null."""
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)


def range_of(df: DataFrame, key: str, width: int) -> Column:
    if isinstance(df.schema[key].dataType, IntegralType):
        return F.floor(F.col(f"`{key}`") / F.lit(width)).cast("long")
    return F.conv(F.substring(F.sha2(F.col(f"`{key}`").cast("string").cast("binary"), 256), 1, HASHED_BITS // 4), 16, 10).cast("long")


def joined(digests: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(digests), "\n").cast("binary"), 256)


def ranges(df: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Rows (range, n, digest): the leaves of the tree."""
    rows = df.select(range_of(df, key, width).alias("range"), row_digest(df).alias("d")).groupBy("range", "d").agg(F.count(F.lit(1)).alias("c"))
    rows = stored(rows)
    sizes = rows.groupBy("range").agg(F.count(F.lit(1)).alias("k")).withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log(F.col("k") / GROUP) / F.log(F.lit(16.0)))).cast("int"))
    sized = rows.join(sizes.withColumnRenamed("range", "_r"), F.col("range").eqNullSafe(F.col("_r"))).drop("_r")
    each = sized.groupBy("range", F.expr("left(d, digits)").alias("part")).agg(F.sum("c").alias("n"), joined(F.collect_list(F.concat_ws(":", "d", "c"))).alias("d"))
    # parts of one range: as many as its rows by GROUP
    return each.groupBy("range").agg(F.sum("n").alias("n"), joined(F.collect_list(F.concat_ws(":", "part", "d"))).alias("digest"))


def tree(df: DataFrame, key: str, width: int = 1024) -> DataFrame:
    """Rows (level, range, n, digest): leaves at level 0, the root, of range 0, at the last."""
    child = F.concat_ws(":", F.coalesce(F.col("range").cast("string"), F.lit("null")), "digest")
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined(F.collect_list(child)).alias("digest")]
    levels = [stored(ranges(df, key, width))]
    low, high = levels[0].agg(F.min("range"), F.max("range")).first()
    while (low or 0) < -1 or (high or 0) > 0:
        levels.append(stored(levels[-1].groupBy(F.shiftright("range", FAN_BITS).alias("range")).agg(*sums)))
        low, high = (low or 0) >> FAN_BITS, (high or 0) >> FAN_BITS
    # what is left are the ranges below nought, from nought on, and of null keys
    levels.append(levels[-1].agg(*sums).select(F.lit(0).cast("long").alias("range"), "n", "digest"))
    out = None
    for k, level in enumerate(levels):
        told = level.select(F.lit(k).alias("level"), "range", "n", "digest")
        out = told if out is None else out.unionByName(told)
    return stored(out)


def root(nodes: DataFrame) -> DataFrame:
    """One row (n, digest) of a tree."""
    return nodes.agg(F.max_by(F.struct("n", "digest"), "level").alias("r")).select("r.n", "r.digest")


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (range, change, old_n, new_n) of two trees' leaves that differ: changed, gone or added."""
    a, b = (t.where("level = 0").select(F.col("range").alias(f"{s}_range"), F.col("n").alias(f"{s}_n"), F.col("digest").alias(f"{s}_digest")) for t, s in ((old, "old"), (new, "new")))
    both = a.join(b, F.col("old_range").eqNullSafe(F.col("new_range")), "full")
    change = F.when(F.col("old_n").isNull(), "added").when(F.col("new_n").isNull(), "gone").when(F.col("old_digest") != F.col("new_digest"), "changed")
    return both.withColumn("change", change).where("change is not null").select(F.coalesce("old_range", "new_range").alias("range"), "change", "old_n", "new_n")


def pinned(df: DataFrame, key: str, old: DataFrame, width: int = 1024) -> DataFrame:
    """df, if its tree's root is that of old; else an error that names ranges that changed."""
    now = tree(df, key, width)
    if root(now).first() != root(old).first():
        where = ", ".join(f"{r['range']} {r['change']}" for r in changed(old, now).orderBy("range").limit(10).collect())
        raise ValueError(f"the table is not the one that was pinned: ranges {where}")
    return df
