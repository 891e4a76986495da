"""Event logs as streams: windowed counts, the furthest record of each key, de-duplication.

Counts and progress come as updates: a batch tells what changed in it and no more, and state goes as the
watermark passes it.  `updates` keeps each batch in a folder of its own, so that one that is
run again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def source(spark: SparkSession, folder: str, schema: str = SCHEMA) -> DataFrame:
    """Files of a folder (part-*.parquet or one events file) as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def furthest(events: DataFrame, key: str, step: Column, time: str = "ts", late: str = "1 hour", keep: str = "1 day") -> DataFrame:
    """Updates (columns of events, step, n_seen, ended): each key's record of the largest step, whenever it changes.

    Of one step the later record is further, of one time too the one whose other columns sort last as text.  A stale
    record is counted and changes nothing.  A key whose furthest record is older than the
    watermark by `keep` gets a last row, marked as ended, and its state goes; if it speaks again, it begins anew.
    A batch brings a row at most for each of its keys.  Records without a key, a step or a time are
    left out.  State is a record a key.  Where the events have a column of a new one's name, underscores are added to it.
    """
    fields = events.schema.fields
    names = [f.name for f in fields]
    step_name, seen_name, ended_name = (n + "_" * next(i for i in range(len(names) + 1) if n + "_" * i not in names) for n in ("step", "n_seen", "ended"))
    at = names.index(time)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = events.withColumn(step_name, step.cast("long")).where(F.col(key).isNotNull() & F.col(step_name).isNotNull() & F.col(time).isNotNull())
    rows = rows.withWatermark(time, late)
    kind = StructType([*fields, StructField(step_name, LongType()), StructField(seen_name, LongType())])
    out = StructType([*kind.fields, StructField(ended_name, BooleanType())])
    every = [*names, step_name, seen_name, ended_name]

    def plain(value):
        return None if value is None or value is pd.NaT else value.to_pydatetime() if isinstance(value, pd.Timestamp) else value.item() if hasattr(value, "item") else value

    def order(record: tuple) -> tuple:
        return record[len(names)], record[at], [str(x) for x in record]

    def advance(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            told = [*state.get, True]
            state.remove()
            yield pd.DataFrame([told], columns=every)
            return
        held = state.get if state.exists else None
        best, seen = (tuple(held[:-1]), held[-1]) if held else (None, 0)
        before = best
        for batch in batches:
            seen += len(batch)
            for record in batch[[*names, step_name]].itertuples(index=False):
                record = tuple(plain(x) for x in record)
                if best is None or order(record) > order(best):
                    best = record
        state.update((*best, seen))
        wanted = int(pd.Timestamp(best[at]).timestamp() * 1000) + keep_ms
        state.setTimeoutTimestamp(max(wanted, state.getCurrentWatermarkMs() + 1))
        if best != before:
            yield pd.DataFrame([[*best, seen, False]], columns=every)

    return rows.groupBy(key).applyInPandasWithState(advance, out, kind, "update", GroupStateTimeout.EventTimeTimeout)


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append(events: DataFrame, path: str, checkpoint: str):
    """An append-only sink, exactly once, that takes what there is and ends."""
    return events.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def ended(run) -> None:
    """Waits for a run that takes what there is."""
    run.awaitTermination()
    if run.exception():
        raise run.exception()


def updates(changes: DataFrame, path: str, checkpoint: str):
    """What each batch changed, in `path/batch=<number>`: takes what there is and ends."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The last update of each key, as `updates` has written them."""
    rows = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    names = [f.name for f in schema.fields]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch").alias("_last"))
    return last.select(*[F.col(f"_last.{n}").alias(n) for n in names])
