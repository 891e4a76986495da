"""Null-safe joins, ranks and quantiles by group, and tables that are small enough to send around."""

import random
import statistics

import numpy as np
import pytest

from corploom.operators import numpy_order, order
from corploom.sources import io

rng = random.Random(8)
ROWS = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 0.0, rng.random()])) for i in range(300)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "i long, g string, x double").repartition(3)


def test_null_keys_meet(spark):
    left = spark.createDataFrame([(1, None, "l1"), (None, None, "l2"), (2, "k", "l3"), (3, "z", "l4")], "a int, b string, x string")
    right = spark.createDataFrame([(1, None, "r1"), (None, None, "r2"), (2, "k", "r3"), (4, "q", "r4")], "a int, b string, y string")
    assert {(r["x"], r["y"]) for r in order.joined(left, right, ["a", "b"]).collect()} == {("l1", "r1"), ("l2", "r2"), ("l3", "r3")}
    assert {r["x"] for r in order.joined(left, right, ["a", "b"], "left_anti").collect()} == {"l4"}
    assert order.joined(left, right, ["a", "b"]).columns == ["a", "b", "x", "y"]


def test_ranks_and_quantiles_of_null_groups(rows):
    got = {r["i"]: r["rank"] for r in order.ranked(rows, ["g"], "x").collect()}
    assert set(got) == {i for i, _, x in ROWS if x is not None}
    for g in ("a", "b", None):
        xs = sorted(x for _, h, x in ROWS if h == g and x is not None)
        for i, h, x in ROWS:
            if h == g and x is not None:
                assert got[i] == 1 + xs.index(x) + (xs.count(x) - 1) / 2
    q = {r["g"]: r["q"] for r in order.quantiles(rows, "x", [0.25, 0.5], ["g"]).collect()}
    for g in ("a", "b", None):
        xs = [x for _, h, x in ROWS if h == g and x is not None]
        assert q[g] == pytest.approx([float(np.quantile(xs, 0.25)), statistics.median(xs)])


def test_tables_are_sent_only_if_small(rows):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(rows.join(io.small(rows), "i"))
    assert "strategy=broadcast" not in plan(rows.join(io.small(rows, rows=10), "i"))
    assert "strategy=broadcast" not in plan(rows.join(io.small(rows, size=100), "i"))


def test_numpy_order(spark):
    cells = spark.createDataFrame([(f"c{i:02d}", float(i)) for i in range(37)], "name string, z double").repartition(4)
    from pyspark.sql import functions as F

    got = [r["z"] for r in numpy_order.permuted(cells, [F.col("name")], "z", 10_197).orderBy("name").collect()]
    assert got == np.random.default_rng(10_197).permutation(np.arange(37.0)).tolist()
    with pytest.raises(ValueError, match="too many"):
        numpy_order.permuted(spark.range(5000).withColumnRenamed("id", "z"), [F.col("z")], "z", 1)
    assert numpy_order.permuted(cells.where("false"), [F.col("name")], "z", 1).count() == 0
