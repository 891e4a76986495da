"""Shards of near-equal bytes by sampled splitters over a range-partitioned key.

The key is a hash of the text, so equal texts lie side by side.  A size-weighted sample of
keys gives quantile boundaries of many small ranges; exact range sizes come from one
aggregation; a range that is overfull is subdivided, by keys where it has several and by id
where one key alone fills it.  Ranges, the largest first, go to the shard that has least.
A group of equal texts stays in one shard unless it is larger than a shard's fair share.

Null texts have size 1 and the key of the empty text.  Repeated rows and null ids are each placed: a
number that each row is stored with breaks ties of key and id, so that rows equal in all can still be
parted.  Slots follow range, key and that tie, so which of the rows that are equal in all gets which slot hangs on how the input's files were read.
Texts, however long, are read for their size and hash alone.  An empty table gives an empty one; columns other than id and
text are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import placed_within
from .common import stored


def ranged(rows: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """rows with `range`: how many cuts (key, tie) are at most the row's own."""
    schema = rows.schema.simpleString()[len("struct<") : -1]
    pairs = sorted(set(cuts))
    keys, ties = np.array([k for k, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64)

    def place(batches):
        for batch in batches:
            k, t = batch.column("key").to_numpy(), batch.column("tie").to_numpy()
            low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            out = high.copy()
            for i in np.flatnonzero(high > low):  # rows whose key is itself a cut
                out[i] = low[i] + np.searchsorted(ties[low[i] : high[i]], t[i], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.astype(np.int32))], [*batch.schema.names, "range"])

    return rows.mapInArrow(place, f"{schema}, range int")


def quantiles(sample: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    ordered = sorted(sample)
    return [ordered[len(ordered) * i // parts] for i in range(1, parts)] if len(ordered) >= parts else ordered


def drawn(rows: DataFrame, total: int, wanted: int, seed: int) -> DataFrame:
    """Rows drawn by size, about `wanted` of them; the draw hangs on key and tie alone."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("key"), F.col("tie")), F.lit(1 << 40)) / float(1 << 40)
    return rows.where(u < F.col("size") * (wanted / max(total, 1)))


def shard(docs: DataFrame, shards: int = 8, ranges_per_shard: int = 64, samples_per_range: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, shard, slot)."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stored(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("key"), F.xxhash64(F.col(id_col), F.monotonically_increasing_id()).alias("tie")))
    parts = shards * ranges_per_shard
    total = rows.agg(F.sum("size")).first()[0] or 0
    pick = lambda df: [(r["key"], -(1 << 63)) for r in df.select("key").collect()]  # noqa: E731  at most a few times the wanted number
    cuts = quantiles(pick(drawn(rows, total, parts * samples_per_range, 1)), parts)
    placed = stored(ranged(rows, cuts))
    limit = 2 * total / max(parts, 1)
    for seed in itertools.count(2):  # each pass parts what is overfull many times over, until nothing parts it further
        sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.min("key").alias("a"), F.max("key").alias("b")).where(F.col("bytes") > limit).collect()
        many, single = [r for r in sizes if r["a"] < r["b"]], [r for r in sizes if r["a"] == r["b"]]
        if not sizes:
            break
        full = placed.where(F.col("range").isin([r["range"] for r in sizes]))
        over = sum(r["bytes"] for r in sizes)
        sample = drawn(full, over, int(over / max(limit, 1) * 2 * samples_per_range) + 1, seed).select("range", "key", "tie").collect()
        new = []
        for r in many:
            mine = [(x["key"], -(1 << 63)) for x in sample if x["range"] == r["range"]]
            new += [c for c in quantiles(mine, int(4 * r["bytes"] / limit) + 1) if c[0] > r["a"]] + [(r["b"], -(1 << 63))]
        for r in single:
            mine = [(x["key"], x["tie"]) for x in sample if x["range"] == r["range"]]
            new += quantiles(mine, int(2 * r["bytes"] / limit) + 1)
        more = [c for c in new if c not in set(cuts)]
        if not more:
            break
        cuts += more
        placed = stored(ranged(rows, cuts))
    sizes = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).orderBy("range").collect()
    groups: list[list] = []
    for r in sizes:  # ranges that one key fills stay together up to a fair share
        glued = groups and r["a"] == r["b"] == groups[-1][-1]["b"] == groups[-1][-1]["a"] and sum(x["bytes"] for x in groups[-1]) + r["bytes"] <= total / shards
        groups[-1].append(r) if glued else groups.append([r])
    load = [(0, s) for s in range(shards)]
    home: dict[int, int] = {}
    for g in sorted(groups, key=lambda g: (-sum(x["bytes"] for x in g), g[0]["range"])):
        have, s = heapq.heappop(load)
        home |= {x["range"]: s for x in g}
        heapq.heappush(load, (have + sum(x["bytes"] for x in g), s))
    spark = docs.sparkSession
    where = spark.createDataFrame([(r["range"], home[r["range"]]) for r in sizes], "range int, shard int")  # as many rows as ranges, which a parameter bounds
    put = placed.join(F.broadcast(where), "range").select(F.col("id"), "size", "text_crc32", "shard", "range", "key", "tie")
    return placed_within(put, ["shard"], [F.col("range"), F.col("key"), F.col("tie")], "slot").select(F.col("id").alias(id_col), "size", "text_crc32", "shard", "slot")
