"""Every query that has SQL gives DuckDB's rows, on the smallest tables."""

import math
from pathlib import Path

import pytest

FOLDER = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plans():
    from corploom.plans import catalog

    return catalog


def names():
    return sorted(plans().oracle_sql())


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", names())
def test_rows(spark, duck, name):
    got = plans().queries()[name](spark, str(FOLDER))
    want = duck.execute(plans().oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rows = [[x.asDict(recursive=True) if hasattr(x, "asDict") else x for x in r] for r in got.collect()]
    assert rows_of(got.columns, rows) == rows_of(columns, want.fetchall())


GROUPED = ["cdf", "min_share", "summary_stats", "sparse_domains", "sparse_domains_twice", "record_packs", "table_function_packs", "ks_pairs", "capacity_bound", "cell_stats", "followed_masses", "mixture_bucket_prior", "mixture_cell_tilt", "mixture_rank_tilt", "mixture_shuffled_strata", "band_permutation", "robust_refinement", "marginal_masses"]


@pytest.fixture(scope="module")
def with_nulls(spark, tmp_path_factory):
    """The test tables, with nulls for languages and sources of some documents."""
    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("nulls")
    for t in TABLES.split():
        if t != "documents":
            (folder / f"{t}.parquet").symlink_to(FOLDER / f"{t}.parquet")
    docs = spark.read.parquet(str(FOLDER / "documents.parquet"))
    bent = docs.withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))).withColumn("source", F.when(F.col("doc_id") % 5 < 3, F.col("source")))
    bent.coalesce(1).write.parquet(str(folder / "documents.parquet"))
    return folder


@pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", GROUPED)
def test_null_groups(spark, with_nulls, name):
    """Null groups are groups: none of their rows is lost."""
    import duckdb

    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{with_nulls}/{t}.parquet{'/*.parquet' if t == 'documents' else ''}'")
    want = c.execute(plans().oracle_sql()[name])
    columns = [x[0] for x in want.description]
    df = plans().queries()[name](spark, str(with_nulls))
    rows = [[x.asDict(recursive=True) if hasattr(x, "asDict") else x for x in r] for r in df.collect()]
    assert rows_of(df.columns, rows) == rows_of(columns, want.fetchall())


def test_split_metrics_at_ties(spark, tmp_path):
    """Domain means that lie half-way between two numbers of six digits, and losses that doubles do not hold exactly."""
    import duckdb

    c = duckdb.connect()
    # domain k has 128 labels, k of them 0: its mean is 0.2 + 0.6 k / 128
    c.execute(f"COPY (SELECT k * 128 + i AS doc_id, 'en' AS lang, 's' || k AS source, 10 AS n_chars FROM range(1, 129) a(k), range(128) b(i)) TO '{tmp_path}/documents.parquet'")
    c.execute(f"COPY (SELECT doc_id, (doc_id % 128 >= doc_id // 128)::INT AS quality, 0 AS toxic FROM '{tmp_path}/documents.parquet') TO '{tmp_path}/labels.parquet'")
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    want = c.execute(plans().oracle_sql()["split_metrics"])
    columns = [x[0] for x in want.description]
    got = plans().queries()["split_metrics"](spark, str(tmp_path))
    assert rows_of(got.columns, [list(r) for r in got.collect()]) == rows_of(columns, want.fetchall())
