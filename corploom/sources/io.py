"""Readers and writers; outputs refuse to replace what is there.  `stored` cuts lineage in a shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where none is set, a temporary one if Spark runs on this machine alone; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        alone = master.startswith("local") and not master.startswith("local-cluster")
        if not alone:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corploom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


RUN = uuid.uuid4().hex


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, which goes as the session ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/corploom-{RUN}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{folder}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: it is computed once, and lineage ends here."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20


def shares(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> int:
    """How many parts of at most so many rows, and bytes as text, df has; 1: it can go around."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in df.columns), F.lit(0))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("b")).first()
    return max(1, -(-row["n"] // rows), -(-(row["b"] or 0) // size))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, stored; marked for broadcast if it has at most so many rows, and bytes as text, and left to Spark's joins else."""
    kept = stored(df)
    return F.broadcast(kept) if shares(kept, rows, size) == 1 else kept


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_json_tree(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """One JSON document a file, with the file's name."""
    return spark.read.json(glob, schema=schema, multiLine=True).withColumn("file", F.input_file_name())


def write(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, csv or json; a folder that exists is an error, and a commit is by rename."""
    writer = df.write.mode("errorifexists")
    {"parquet": writer.parquet, "csv": lambda p: writer.csv(p, header=True), "json": writer.json}[kind](path)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (n, mark) that does not hang on the order of rows."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("mark"))


def verified(df: DataFrame, expected: str) -> DataFrame:
    """df, if its fingerprint is the expected one."""
    row = fingerprint(df).first()
    if f"{row['n']}:{row['mark']}" != expected:
        raise ValueError(f"the table has changed: {row['n']}:{row['mark']} is not {expected}")
    return df
