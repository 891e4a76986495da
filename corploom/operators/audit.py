"""A tree of result files held against what was declared, when the run began, and the rows that results stand on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROKEN = "_corrupt_record"


def receipts(spark: SparkSession, path: str, keys: str, schema: str) -> DataFrame:
    """One JSON document a file below path, whose folders name its cell (keys: DDL): its fields, when the file was written, and whether it can be read."""
    read = spark.read.schema(f"{schema}, {BROKEN} string, {keys}").option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN).json(path)
    names = [c for c in read.columns if c != BROKEN]
    return read.select(*names, F.col("_metadata.file_modification_time").alias("written"), F.col("_metadata.file_name").alias("file"), F.col(BROKEN).isNotNull().alias("broken"))


def violations(found: DataFrame, declared: DataFrame, again: DataFrame, keys: list[str], numbers: list[str], began: Column, tolerance: float = 1e-8) -> DataFrame:
    """Rows (keys, problem, field, told, again), none where all is well.

    A declared cell without a file is missing, a file of no declared cell unexpected, a second file of a cell
    twice there.  A file that is no JSON of the schema, or lacks a number or has one that is not finite, is
    broken; one written before the run began is stale, whatever it says.  A number that does not follow from the rows (again) is
    false.  A file may have several problems, and each is a row.
    """
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    own = lambda a: [F.col(f"{a}.{k}") for k in keys]
    none = [F.lit(None).cast("string").alias("field"), F.lit(None).cast("double").alias("told"), F.lit(None).cast("double").alias("again")]
    row = lambda df, a, problem: df.select(*own(a), F.lit(problem).alias("problem"), *none)
    f, d = found.alias("f"), declared.select(*keys).distinct().alias("d")
    out = row(d.join(f, same("d", "f"), "left_anti"), "d", "missing")
    out = out.unionByName(row(f.join(d, same("f", "d"), "left_anti").groupBy(*keys).agg(F.count(F.lit(1))).alias("f"), "f", "unexpected"))
    out = out.unionByName(row(found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").alias("f"), "f", "twice"))
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    fine = ~F.col("broken")
    for c in numbers:
        fine = fine & finite(c)
    out = out.unionByName(row(found.where(~fine).alias("f"), "f", "broken"))
    out = out.unionByName(row(found.where(F.col("written") < began).alias("f"), "f", "stale"))
    read = found.where(fine).alias("f").join(again.alias("a"), same("f", "a"))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"f.{c}").cast("double").alias("told"), F.col(f"a.{c}").cast("double").alias("again")) for c in numbers]))
    told = read.select(*own("f"), each.alias("x")).where(~(F.abs(F.col("x.told") - F.col("x.again")) <= tolerance * F.abs("x.again")))
    return out.unionByName(told.select(*keys, F.lit("false").alias("problem"), "x.field", "x.told", "x.again"))


def completion(runs: DataFrame, progress: DataFrame) -> DataFrame:
    """Rows (run_id, problem, verified, clean): whether each run is complete, from what it was to do and its progress file.

    runs has (run_id, expected, exit_code, began); progress a row a file: (run_id of its folder, bound_to, completed_cells, failed_cells,
    baseline_status, recovery_count, full_clean_matrix, written, broken), all but the first may be null.  A run is verified if it exited with 0, its file is there, whole,
    no older than the run and (if it says so) the run's own, and has as many completed cells as expected, none failed, and a
    baseline that is complete (or not spoken of).  Counts must be whole numbers from 0 on.  It is clean if besides nothing was recovered and the matrix is not said
    to be unclean.  The problem is the first of these that bars it; of several files the newest counts.
    """
    newest = progress.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in progress.columns if c != "run_id"]), F.struct("written", F.coalesce("completed_cells", F.lit(-1)))).alias("p"))
    j = runs.join(newest, "run_id", "left")
    p = lambda c: F.col(f"p.{c}")
    odd = lambda c: p(c).isNull() | (p(c) < 0)
    problem = (
        F.when(F.col("exit_code").isNull() | (F.col("exit_code") != 0), "exit")
        .when(F.col("p").isNull(), "missing").when(p("broken"), "broken").when(p("written") < F.col("began"), "stale")
        .when(p("bound_to").isNotNull() & (p("bound_to") != F.col("run_id")), "other_run")
        .when(odd("completed_cells") | odd("failed_cells"), "counts")
        .when(F.col("expected").isNull() | (p("completed_cells") != F.col("expected")), "incomplete").when(p("failed_cells") > 0, "failed")
        .when(F.coalesce(p("baseline_status"), F.lit("complete")) != "complete", "baseline")
    )
    out = j.withColumn("problem", problem).withColumn("verified", F.col("problem").isNull())
    clean = F.col("verified") & (F.coalesce(p("recovery_count"), F.lit(0)) == 0) & F.coalesce(p("full_clean_matrix"), F.lit(True))
    return out.select("run_id", "problem", "verified", F.coalesce(clean, F.lit(False)).alias("clean"))
