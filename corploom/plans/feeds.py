"""Queries over what sources and sinks do: files of several kinds, guarded writes, fingerprints, streams."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ..functions import text
from ..operators import audit
from ..sources import io, snapshots
from ..streaming import events as stream
from ..streaming import masses
from .catalog import POOL, known_words, query, r6, scored_pool


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, d):
    path = io.scratch(spark)
    io.write(io.table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, "csv")
    return io.read_csv(spark, path, "n_nationkey long, n_name string, n_regionkey long")


@query("SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, d):
    path = io.scratch(spark)
    io.write(io.table(spark, d, "conversations"), path, "json")
    return io.read_jsonl(spark, path, "conv_id long, turn long, role string, text string")


@query("SELECT r_name AS arm, r_regionkey AS seed, round(r_regionkey * 1.5::DOUBLE, 6) AS metric FROM region")
def json_tree_scan(spark, d):
    """One result file a cell, found by a glob; what the file is called says the arm."""
    path = io.scratch(spark)
    cells = io.table(spark, d, "region").select("r_name", F.struct(F.col("r_regionkey").alias("seed"), (F.col("r_regionkey") * 1.5).alias("metric")).alias("x"))
    cells.select("r_name", "x.*").repartition("r_name").write.partitionBy("r_name").json(path)
    found = io.read_json_tree(spark, f"{path}/*/*.json", "seed long, metric double")
    arm = F.url_decode(F.regexp_extract("file", r"r_name=([^/]+)/", 1))
    return found.select(arm.alias("arm"), "seed", r6("metric").alias("metric"))


@query("SELECT 'orders' AS name, count(*)::BIGINT AS n, true AS verified, true AS refused FROM orders")
def guarded_report(spark, d):
    """A written table has the fingerprint of its source, a changed one is refused, and so is a second write."""
    orders, path = io.table(spark, d, "orders"), io.scratch(spark)
    row = io.fingerprint(orders).first()
    io.write(orders, path)
    again = io.verified(spark.read.parquet(path), f"{row['n']}:{row['mark']}")
    refused = 0
    try:
        io.write(orders, path)
    except AnalysisException:
        refused += 1
    try:
        io.verified(orders.limit(1), f"{row['n']}:{row['mark']}")
    except ValueError:
        refused += 1
    return again.agg(F.lit("orders").alias("name"), F.count(F.lit(1)).alias("n"), F.lit(True).alias("verified"), F.lit(refused == 2).alias("refused"))


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def appended_events(spark, d):
    """The log appended to a table as a stream, exactly once: a second run finds nothing new."""
    path, checkpoint = io.scratch(spark), io.scratch(spark)
    for _ in range(2):
        stream.ended(stream.append(stream.source(spark, d), path, checkpoint))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, event_id % 997 AS step, event_id, event_type, ts, count AS n_seen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 997 DESC, ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id) AS count FROM events) WHERE r = 1")
def monotone_progress(spark, d):
    """The furthest record of each user, kept by the stream; a stale record never takes it back."""
    path, checkpoint = io.scratch(spark), io.scratch(spark)
    found = stream.furthest(stream.source(spark, d), "user_id", F.col("event_id") % 997, late="1 day", keep="3650 days")
    stream.ended(stream.updates(found, path, checkpoint))
    return stream.current(spark, path, found.schema, ["user_id"]).select("user_id", "step", "event_id", "event_type", "ts", "n_seen")


CELL_SUMS = {"n": "count(1)", "score": "sum(greatest(score, 0))", "wrong": "sum(greatest(wrong, 0))", "words": "sum(n_words)"}
CELL_SCHEMA = "domain string, bucket int, n bigint, score double, wrong double, words bigint"


def followed(spark, d, files=4):
    """Documents as a stream of several files, each a batch, added up by domain and bucket; where the deltas are."""
    arrived, path, checkpoint = io.scratch(spark), io.scratch(spark), io.scratch(spark)
    docs = io.table(spark, d, "documents")
    docs.repartitionByRange(files, "doc_id").write.parquet(arrived)
    words = [io.small(known_words(spark, d, *x)) for x in (("benchmark", "b"), ("conversations", "w"))]
    add = masses.adder(path, lambda batch: scored_pool(batch, *words), ["domain", "bucket"], CELL_SUMS)
    come = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(arrived)
    stream.ended(masses.follow(come, add, checkpoint))
    return path, add


@query(f"WITH {POOL} SELECT domain, bucket, count(*)::BIGINT AS n, round(sum(greatest(score, 0)), 6) AS score, round(sum(greatest(wrong, 0)), 6) AS wrong, sum(n_words)::BIGINT AS words FROM pool GROUP BY 1, 2")
def followed_masses(spark, d):
    """Masses of cells after four micro-batches: those of the whole pool."""
    path, _ = followed(spark, d)
    return masses.masses(spark, path, CELL_SCHEMA, ["domain", "bucket"]).select("domain", "bucket", "n", r6("score").alias("score"), r6("wrong").alias("wrong"), "words")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_id) AS r FROM events) WHERE r = 1")
def deduplicated_events(spark, d):
    """Events that came twice (here: all of them) pass the stream once."""
    path, checkpoint = io.scratch(spark), io.scratch(spark)
    twice = stream.source(spark, d).unionByName(stream.source(spark, d))
    stream.ended(stream.append(stream.deduplicated(twice, "3650 days"), path, checkpoint))
    return spark.read.schema(stream.SCHEMA).parquet(path).select("event_id", "event_type")


@query("SELECT count(*)::BIGINT AS n, true AS fresh, false AS stale FROM region")
def fresh_files(spark, d):
    """Files no older than the run that should have written them; and none is newer than the end of it."""
    path = io.scratch(spark)
    began = spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
    io.write(io.table(spark, d, "region"), path)
    at = F.col("_metadata.file_modification_time")
    rows = spark.read.parquet(path).select((at >= F.lit(began) - F.expr("INTERVAL 1 SECOND")).alias("fresh"), (at < F.lit(began) - F.expr("INTERVAL 1 DAY")).alias("stale"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and("fresh").alias("fresh"), F.bool_or("stale").alias("stale"))


@query("SELECT failure, count(*)::BIGINT AS n FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'interrupted' WHEN event_id % 5 IN (1, 2) THEN 'numerical' ELSE 'runtime' END AS failure FROM events) GROUP BY 1")
def failure_classes(spark, d):
    kinds = F.array(*[F.lit(m) for m in ("SIGTERM: received signal", "loss is NaN", "Overflow in step", "index out of range", "disk full")])
    message = F.get(kinds, (F.col("event_id") % 5).cast("int"))
    return io.table(spark, d, "events").select(text.failure_kind(message).alias("failure")).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (CASE WHEN props IS NULL OR NOT json_valid(props) OR left(trim(props), 1) <> '{' OR event_id % 4 > 1 THEN 'refused' ELSE 'read' END) AS receipt, count(*)::BIGINT AS n FROM events GROUP BY 1")
def progress_receipts(spark, d):
    """Progress receipts as JSON objects of bounded size; broken ones, other values and too large ones are refused (half are spoilt here)."""
    e = io.table(spark, d, "events")
    spoilt = F.when(F.col("event_id") % 4 == 2, F.concat(F.lit("["), F.col("props"), F.lit("]"))).when(F.col("event_id") % 4 == 3, F.concat(F.col("props"), F.repeat(F.lit(" "), 1 << 19))).otherwise(F.col("props"))
    got = text.receipt(spoilt, "k string, page string")
    return e.select(F.when(got.isNull(), "refused").otherwise("read").alias("receipt")).groupBy("receipt").agg(F.count(F.lit(1)).alias("n"))


# --- pinned tables -----------------------------------------------------------------------------

ROWS = "d AS (SELECT o_orderkey // 1024 AS range, sha256('{{\"o_custkey\":' || o_custkey || ',\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}}') AS d FROM orders), c AS (SELECT range, d, count(*) AS c FROM d GROUP BY 1, 2), s AS (SELECT range, greatest(0, ceil(ln(count(*) / 256.0) / ln(16.0)))::INT AS digits FROM c GROUP BY 1), p AS (SELECT range, d[1:digits] AS part, sum(c) AS n, sha256(string_agg(d || ':' || c, chr(10) ORDER BY d || ':' || c)) AS d FROM c JOIN s USING (range) GROUP BY 1, 2)".replace("{{", "{").replace("}}", "}")


def pinned_orders(spark, d):
    return io.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


@query(f"WITH {ROWS} SELECT range::BIGINT AS range, sum(n)::BIGINT AS n, sha256(string_agg(part || ':' || d, chr(10) ORDER BY part || ':' || d)) AS digest FROM p GROUP BY 1")
def snapshot_ranges(spark, d):
    """The leaves of a table's digest tree."""
    return snapshots.ranges(pinned_orders(spark, d), "o_orderkey")


@query(f"WITH b AS (SELECT o_orderkey // 1024 AS range, count(*) AS n, count_if(o_orderkey % 5000 = 77) AS bent, count_if(o_orderkey % 7000 = 8) AS lost FROM orders GROUP BY 1), m AS (SELECT max(o_orderkey) AS top FROM orders), x AS (SELECT (top + 5000) // 1024 AS range FROM m), j AS (SELECT coalesce(b.range, x.range) AS range, coalesce(n, 0) AS old_n, coalesce(n - lost, 0) + (x.range IS NOT NULL)::INT AS new_n, coalesce(bent + lost, 0) + (x.range IS NOT NULL)::INT AS touched FROM b FULL JOIN x USING (range)) SELECT range::BIGINT AS range, CASE WHEN old_n = 0 THEN 'added' WHEN new_n = 0 THEN 'gone' ELSE 'changed' END AS change, nullif(old_n, 0)::BIGINT AS old_n, nullif(new_n, 0)::BIGINT AS new_n FROM j WHERE touched > 0")
def snapshot_changes(spark, d):
    """Which ranges of keys a bent copy (cells changed, rows lost, one far row more) differs in; a copy in other files differs in none."""
    orders = pinned_orders(spark, d)
    old, path = snapshots.tree(orders, "o_orderkey"), io.scratch(spark)
    orders.repartition(7, "o_custkey").write.parquet(path)
    copy = snapshots.pinned(spark.read.parquet(path), "o_orderkey", old)  # refuses, were it not the same
    bent = copy.where("o_orderkey % 7000 <> 8").withColumn("o_custkey", F.when(F.expr("o_orderkey % 5000 = 77"), F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    bent = bent.unionByName(copy.agg((F.max("o_orderkey") + 5000).alias("o_orderkey"), F.max("o_custkey").alias("o_custkey"), F.max("o_orderstatus").alias("o_orderstatus")))
    return snapshots.changed(old, snapshots.tree(bent, "o_orderkey"))


# --- receipts in files ---------------------------------------------------------------------------


def receipt_tree(spark, d, path):
    """Result files of a study, a cell each; by seed some are missing, stale, broken, false or not declared.  Gives the time the run began."""
    lines = io.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("arm"), (F.col("l_linenumber") - 1).cast("int").alias("seed"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    cells = io.stored(lines.groupBy("arm", "seed").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("metric")))
    told = F.when(F.col("seed") == 4, F.col("metric") * 1.001).otherwise(F.col("metric"))
    whole = F.to_json(F.struct("n", told.alias("metric")))
    body = F.when((F.col("seed") == 3) & (F.col("arm") == "A"), F.expr("left(body, 9)")).when((F.col("seed") == 3) & (F.col("arm") == "N"), F.lit('{"n": 3}')).otherwise(F.col("body"))
    files = cells.withColumn("body", whole).withColumn("value", body).where("not (arm = 'R' and seed = 1)")
    files = files.unionByName(files.where("arm = 'N' and seed = 2").withColumn("arm", F.lit("X")))
    write = lambda df: df.select("arm", "seed", "value").repartition("arm", "seed").write.partitionBy("arm", "seed").mode("append").text(path)
    write(files.where("arm = 'A' and seed in (0, 3)"))
    time.sleep(1.5)  # files have times in whole seconds, perhaps
    began = spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
    time.sleep(1.1)
    write(files.where("not (arm = 'A' and seed in (0, 3))"))
    write(files.where("arm = 'R' and seed = 2"))
    return began, cells


@query("""WITH c AS (SELECT l_returnflag AS arm, (l_linenumber - 1)::INT AS seed, count(*) AS n, avg(l_extendedprice / l_quantity) AS metric FROM lineitem GROUP BY 1, 2),
p AS (SELECT arm, seed, 'missing' AS problem, NULL AS field, NULL::DOUBLE AS told, NULL::DOUBLE AS again FROM c WHERE arm = 'R' AND seed = 1
UNION ALL SELECT 'X', 2, 'unexpected', NULL, NULL, NULL UNION ALL SELECT 'R', 2, 'twice', NULL, NULL, NULL
UNION ALL SELECT arm, seed, 'broken', NULL, NULL, NULL FROM c WHERE arm IN ('A', 'N') AND seed = 3
UNION ALL SELECT arm, seed, 'stale', NULL, NULL, NULL FROM c WHERE arm = 'A' AND seed IN (0, 3)
UNION ALL SELECT arm, seed, 'false', 'metric', metric * 1.001, metric FROM c WHERE seed = 4)
SELECT arm, seed::INT AS seed, problem, field, round(told, 6) AS told, round(again, 6) AS again FROM p""")
def receipt_violations(spark, d):
    """What a tree of result files says that it should not, or does not say."""
    path = io.scratch(spark)
    began, cells = receipt_tree(spark, d, path)
    found = audit.receipts(spark, path, "arm string, seed int", "n long, metric double")
    out = audit.violations(found, cells, cells, ["arm", "seed"], ["n", "metric"], F.lit(began))
    return out.select("arm", "seed", "problem", "field", r6("told").alias("told"), r6("again").alias("again"))


PROGRESS = "bound_to string, completed_cells long, failed_cells long, baseline_status string, recovery_count long, full_clean_matrix boolean"
PROBLEMS = "CASE n_nationkey % 10 WHEN 1 THEN 'exit' WHEN 2 THEN 'missing' WHEN 3 THEN 'broken' WHEN 4 THEN 'stale' WHEN 5 THEN 'other_run' WHEN 6 THEN 'incomplete' WHEN 7 THEN 'failed' WHEN 8 THEN 'baseline' END"


@query(f"SELECT 'run' || n_nationkey::VARCHAR AS run_id, {PROBLEMS} AS problem, ({PROBLEMS}) IS NULL AS verified, ({PROBLEMS}) IS NULL AND n_nationkey % 10 <> 9 AS clean FROM nation")
def run_completion(spark, d):
    """Runs (a nation each) held against their progress files; by number a run has one of the problems that bar it, or was recovered."""
    path, k = io.scratch(spark), F.col("n_nationkey") % 10
    runs = io.stored(io.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("run"), F.col("n_nationkey")).alias("run_id"), (F.col("n_regionkey") + 3).alias("expected"), (k == 1).cast("int").alias("exit_code")))
    told = F.to_json(F.struct(
        F.when(k == 5, "another").when(F.col("n_nationkey") < 10, F.col("run_id")).alias("bound_to"), (F.col("expected") - (k == 6).cast("int")).alias("completed_cells"),
        (k == 7).cast("int").alias("failed_cells"), F.when(k == 8, "running").alias("baseline_status"), F.when(k == 9, F.lit(2)).alias("recovery_count"),
    ))
    files = runs.where(k != 2).withColumn("value", F.when(k == 3, F.lit('{"completed_cells": 3,')).otherwise(told))
    write = lambda df: df.select("run_id", "value").repartition("run_id").write.partitionBy("run_id").mode("append").text(path)
    write(files.where(k == 4))
    time.sleep(1.5)  # files have times in whole seconds, perhaps
    began = spark.range(1).select(F.current_timestamp().alias("t")).first()["t"]
    time.sleep(1.1)
    write(files.where(k != 4))
    found = audit.receipts(spark, path, "run_id string", PROGRESS)
    return audit.completion(runs.withColumn("began", F.lit(began)), found)
