"""Permutation tests and bootstraps with many replicates, in one pass over the rows.

A replicate is never a copy of the rows.  Tasks keep running sums, an array with a place for each
replicate, and these arrays are added up in two steps, some sixteen at a time at the end.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import stored

STEP = 1 << 21  # draws made at a time

# Chances that a Poisson variable of mean 1 is at most 0, 1, 2, ...
POISSON_1 = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(13)])


def digest_draws(keys: list[str], replicates: int, seed: str) -> np.ndarray:
    """A row a key, a column a replicate: 64 bits each, four replicates a SHA-256 of `seed:replicate // 4:key`."""
    blocks = -(-replicates // 4)
    raw = b"".join(hashlib.sha256(f"{seed}:{b}:{k}".encode()).digest() for k in keys for b in range(blocks))
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(len(keys), 4 * blocks)[:, :replicates]


def mixed_draws(keys: list[str], replicates: int, seed: str) -> np.ndarray:
    """As digest_draws, some hundred times faster: one SHA-256 a key, spread over the replicates by mixing counters."""
    start = np.frombuffer(b"".join(hashlib.sha256(f"{seed}:{k}".encode()).digest()[:8] for k in keys), "<u8").reshape(-1, 1)
    with np.errstate(over="ignore"):
        x = start + np.arange(1, replicates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


DRAWS = {"digest": digest_draws, "mixed": mixed_draws}


def added(parts: DataFrame, group: str = "grp") -> DataFrame:
    """Rows (grp, sums): arrays of doubles (as bytes) of one group added up, in two steps, so that no task gets them all."""
    kind = f"{group} {parts.schema[group].dataType.simpleString()}"

    def add(rows: pa.Table) -> pa.Table:
        total = sum((np.frombuffer(s.as_py()) for s in rows["sums"].combine_chunks()[1:]), np.frombuffer(rows["sums"][0].as_py()))
        return pa.table({group: rows[group].slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    spread = parts.withColumn("_bin", F.pmod(F.spark_partition_id(), F.lit(16)))
    return spread.groupBy(group, "_bin").applyInArrow(add, f"{kind}, sums binary").groupBy(group).applyInArrow(add, f"{kind}, sums binary")


def opened(sums: DataFrame, width: int, names: list[str], group: str = "grp") -> DataFrame:
    """Rows (grp, b, names...) of arrays that have `width` places for each name."""

    def rows(batches):
        for batch in batches:
            for g, raw in zip(batch.column(group), batch.column("sums"), strict=True):
                each = np.frombuffer(raw.as_py()).reshape(len(names), width)
                columns = {group: pa.array([g.as_py()] * width, batch.schema.field(group).type), "b": pa.array(np.arange(width), pa.int32())}
                yield pa.RecordBatch.from_pydict(columns | {n: pa.array(x) for n, x in zip(names, each, strict=True)})

    return sums.mapInArrow(rows, f"{group} {sums.schema[group].dataType.simpleString()}, b int, " + ", ".join(f"{n} double" for n in names))


def relabelled(rows: DataFrame, key: str, value: str, inside: Column, replicates: int, seed: str, draws: str = "mixed") -> DataFrame:
    """Rows (b, stat, observed): the difference of mean value, inside less outside, if as many rows as are inside were chosen by chance.

    Each replicate chooses exactly that many rows, without replacement: those of the least draws.  Where the
    last of them lies is known beforehand but for some multiple of the root of the number of rows:
    draws below that stretch are added up where they stand, and only the rows inside it, some
    twelve roots a replicate, are put in order.  A replicate whose bound falls outside the stretch (one in a thousand million)
    makes the stretch wider for all, and the pass is made again.

    Rows without a value or key go.  Keys should not repeat: rows of one key are chosen together, and of
    those at the bound by their value.  Null where nothing or all is inside.
    """
    known = rows.select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), F.coalesce(inside, F.lit(False)).alias("i")).where("k is not null and v is not null")
    total = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("i").alias("m"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.coalesce(F.sum(F.when(F.col("i"), F.col("v"))), F.lit(0.0)).alias("si")).first()
    n, m, every = total["n"], total["m"], total["s"]
    spark = rows.sparkSession
    if not 0 < m < n:
        return spark.range(replicates).select(F.col("id").cast("int").alias("b"), F.lit(None).cast("double").alias("stat"), F.lit(None).cast("double").alias("observed"))
    observed = total["si"] / m - (every - total["si"]) / (n - m)
    drawn, wide = DRAWS[draws], 6.0
    while True:
        off = wide * math.sqrt(m / n * (1 - m / n) / n) + 2 / n
        low, high = (min((1 << 64) - 1, max(0, int(x * 2.0**64))) for x in (m / n - off, m / n + off))

        def told(batches, low=low, high=high):
            sums = np.zeros((2, replicates))
            step = max(1, STEP // replicates)
            for batch in batches:
                keys, values = batch.column("k").to_pylist(), batch.column("v").to_numpy()
                for a in range(0, len(keys), step):
                    u = drawn(keys[a : a + step], replicates, seed)
                    below = u < np.uint64(low)
                    sums[0] += below.sum(0)
                    sums[1] += values[a : a + step] @ below
                    r, b = np.nonzero((u < np.uint64(high)) & ~below)
                    columns = [pa.array(b, pa.int32()), pa.array((u[r, b] ^ np.uint64(1 << 63)).view(np.int64)), pa.array(values[a : a + step][r]), pa.nulls(len(r), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["b", "u", "v", "sums"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([sums.tobytes()], pa.binary())], ["b", "u", "v", "sums"])

        both = stored(known.select("k", "v").mapInArrow(told, "b int, u long, v double, sums binary"))
        sums = stored(opened(added(both.where("sums is not null").select(F.lit(0).alias("grp"), "sums")), replicates, ["below", "sum"]).drop("grp"))
        edge = both.where("b is not null")
        sizes = sums.join(edge.groupBy("b").agg(F.count(F.lit(1)).alias("size")), "b", "left")
        missed = sizes.where((F.col("below") > m) | (F.col("below") + F.coalesce("size", F.lit(0)) < m)).count()
        if not missed:
            break
        wide *= 2
    place = F.row_number().over(Window.partitionBy("b").orderBy("u", "v"))  # some twelve roots of n rows
    rest = edge.join(F.broadcast(sums.select("b", "below")), "b").withColumn("r", place).where(F.col("r") <= m - F.col("below")).groupBy("b").agg(F.sum("v").alias("more"))
    chosen = F.col("sum") + F.coalesce("more", F.lit(0.0))
    return sums.join(rest, "b", "left").select("b", (chosen / m - (every - chosen) / (n - m)).alias("stat"), F.lit(observed).alias("observed"))


def p_value(stats: DataFrame) -> DataFrame:
    """One row (observed, replicates, p): two-sided, the observed arrangement counting as one of them."""
    extreme = F.abs("stat") >= F.abs("observed") - 1e-12
    return stats.agg(F.first("observed").alias("observed"), F.count("stat").alias("replicates"), ((1 + F.count_if(extreme)) / (1 + F.count("stat"))).alias("p"))


def flipped(pairs: DataFrame, groups: list[str], diff: str, replicates: int = 10_000, seed: str = "flip", exact: int = 20) -> DataFrame:
    """Rows (groups, n, mean, p): does the mean difference of pairs leave nought, if each pair's sign were a coin's?

    With at most `exact` pairs all patterns of signs are tried, by one expression; with more, a pattern a replicate
    is drawn for each of the pairs, which are never listed.  Pairs without a difference go.
    """
    known = pairs.select(*groups, F.col(diff).cast("double").alias("d")).where("d is not null")
    sizes = stored(known.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.sum("d").alias("t")))
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in groups]
    few = known.join(F.broadcast(sizes.where(F.col("n") <= exact)), same(known, sizes), "left_semi").groupBy(*groups).agg(F.sort_array(F.collect_list("d")).alias("ds"))
    total = lambda mask: F.aggregate(F.transform("ds", lambda x, i: F.when(F.call_function("shiftright", mask, i).bitwiseAND(1) == 1, x).otherwise(-x)), F.lit(0.0), lambda a, x: a + x)
    patterns = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("ds")) - 1)
    own = F.abs(F.aggregate("ds", F.lit(0.0), lambda a, x: a + x))
    hits = F.aggregate(patterns, F.lit(0), lambda a, mask: a + (F.abs(total(mask)) >= own - 1e-9 * (1 + own)).cast("int"))
    small = few.select(*groups, F.size("ds").cast("long").alias("n"), (F.aggregate("ds", F.lit(0.0), lambda a, x: a + x) / F.size("ds")).alias("mean"), (hits / F.call_function("shiftleft", F.lit(1), F.size("ds"))).alias("p"))
    large = sizes.where(F.col("n") > exact)
    if not large.limit(1).count():
        return small
    many = known.join(F.broadcast(large), same(known, large), "left_semi").select(F.struct(*groups).alias("g"), "d").select(F.to_json("g", {"ignoreNullFields": "false"}).alias("grp"), "d")

    def told(batches):
        sums: dict = {}
        step = max(1, STEP // replicates)
        count = 0
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                at = TaskPlace.number()
                u = mixed_draws([f"{at}:{count + i}" for i in range(part.num_rows)], replicates, seed)
                count += part.num_rows
                signed = np.where(u >> np.uint64(63), 1.0, -1.0) * part.column("d").to_numpy()[:, None]
                names = np.array(part.column("grp").to_pylist())
                for g in np.unique(names).tolist():
                    sums[g] = sums.get(g, 0) + signed[names == g].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["grp", "sums"])

    drawn = opened(added(many.mapInArrow(told, "grp string, sums binary")), replicates, ["sum"])
    named = large.withColumn("grp", F.to_json(F.struct(*groups), {"ignoreNullFields": "false"}))
    hit = F.abs("sum") >= F.abs("t") - 1e-9 * (1 + F.abs("t"))
    big = drawn.join(F.broadcast(named), "grp").groupBy("grp").agg(*[F.first(c).alias(c) for c in groups], F.first("n").alias("n"), F.first("mean").alias("mean"), ((1 + F.count_if(hit)) / (1 + F.count(F.lit(1)))).alias("p"))
    return small.unionByName(big.drop("grp"))


class TaskPlace:
    """The number of the task's partition, which names rows that have no key."""

    @staticmethod
    def number() -> int:
        from pyspark import TaskContext

        context = TaskContext.get()
        return context.partitionId() if context else 0


def clustered(rows: DataFrame, group: str, cluster: list[str], total: str, count: str, replicates: int = 1000, seed: str = "cluster", draws: str = "mixed") -> DataFrame:
    """Rows (group, b, mean) of a bootstrap over clusters: each cluster counts as often as a Poisson variable of mean 1 says.

    rows has what each cluster adds to a mean's numerator (total) and denominator (count), in one row or many: rows of a cluster get the
    same weights, wherever they are, since these hang on the cluster's name and the replicate alone.  A replicate of
    weight nought has a null mean.  Null clusters and groups are ones of their own.
    """
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in cluster])
    known = rows.select(F.col(group).alias("grp"), name.alias("k"), F.col(total).cast("double").alias("t"), F.col(count).cast("double").alias("c")).where("t is not null and c is not null")
    known = known.groupBy("grp", "k").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kind = known.schema["grp"].dataType.simpleString()
    drawn = DRAWS[draws]

    def told(batches):
        sums: dict = {}
        step = max(1, STEP // replicates)
        arrow = None
        for batch in batches:
            arrow = batch.schema.field("grp").type
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                u = drawn(part.column("k").to_pylist(), replicates, seed)
                weight = np.searchsorted(POISSON_1, (u >> np.uint64(11)) * 2.0**-53, "right").astype(np.float64)
                both = np.stack([part.column("t").to_numpy(), part.column("c").to_numpy()], 1)
                places: dict = {}
                for i, g in enumerate(part.column("grp").to_pylist()):
                    places.setdefault(g, []).append(i)
                for g, at in places.items():
                    sums[g] = sums.get(g, 0) + both[at].T @ weight[at]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), arrow), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["grp", "sums"])

    each = opened(added(known.mapInArrow(told, f"grp {kind}, sums binary")), replicates, ["t", "c"])
    return each.select(F.col("grp").alias(group), "b", F.when(F.col("c") > 0, F.col("t") / F.col("c")).alias("mean"))
