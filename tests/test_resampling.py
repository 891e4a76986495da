"""Permutations and bootstraps against plain Python."""

import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corploom.operators import resampling

rng = random.Random(5)
ROWS = [(i, rng.choice([0.0, 0.5, rng.random()]), rng.random() < 0.3) for i in range(300)]


def draw(seed, b, key):
    return hashlib.sha256(f"{seed}:{b // 4}:{key}".encode()).hexdigest()[16 * (b % 4) : 16 * (b % 4) + 16]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, v double, hit boolean").repartition(3)


def test_relabelled_as_plain_python(spark, rows):
    more = spark.createDataFrame([(None, 1.0, True), (900, None, True)], "id long, v double, hit boolean")
    got = {r["b"]: r for r in resampling.relabelled(rows.unionAll(more), "id", "v", F.col("hit"), 9, "s", "digest").collect()}
    m = sum(h for *_, h in ROWS)
    mean = lambda xs: sum(xs) / len(xs)
    for b in range(9):
        order = sorted(ROWS, key=lambda r: (draw("s", b, r[0]), r[1]))
        assert math.isclose(got[b]["stat"], mean([r[1] for r in order[:m]]) - mean([r[1] for r in order[m:]]), abs_tol=1e-12)
        assert math.isclose(got[b]["observed"], mean([r[1] for r in ROWS if r[2]]) - mean([r[1] for r in ROWS if not r[2]]), abs_tol=1e-12)


def test_ten_thousand_choices_spread_as_they_must(rows):
    got = np.array([r["stat"] for r in resampling.relabelled(rows, "id", "v", F.col("hit"), 10_000, "t").collect()])
    v, m, n = np.array([r[1] for r in ROWS]), sum(h for *_, h in ROWS), len(ROWS)
    sd = math.sqrt(v.var(ddof=1) * (1 / m + 1 / (n - m)))  # exact, without replacement
    assert len(got) == 10_000 and abs(got.mean()) < 5 * sd / 100 and abs(got.std(ddof=1) / sd - 1) < 0.05


def test_nothing_inside(spark, rows):
    for column in (F.lit(False), F.lit(True), F.lit(None).cast("boolean") & F.lit(True)):
        assert {r["stat"] for r in resampling.relabelled(rows, "id", "v", column, 4, "s").collect()} == {None}
    assert {r["stat"] for r in resampling.relabelled(rows.where("false"), "id", "v", F.col("hit"), 4, "s").collect()} == {None}


def test_signs_of_few_and_of_many_pairs(spark):
    few = [rng.gauss(0.4, 1) for _ in range(9)]
    many = [rng.gauss(0.05, 1) for _ in range(400)]
    data = [("few", None, x) for x in few] + [("many", 1, x) for x in many] + [("one", 1, 2.0), ("none", 1, None), ("tie", 2, 0.0)]
    got = {r["g"]: r for r in resampling.flipped(spark.createDataFrame(data, "g string, h int, d double").repartition(3), ["g", "h"], "d").collect()}
    t = abs(sum(few))
    want = sum(abs(sum(s * x for s, x in zip(signs, few))) >= t - 1e-9 for signs in itertools.product((1, -1), repeat=9)) / 512
    assert math.isclose(got["few"]["p"], want) and got["few"]["h"] is None and set(got) == {"few", "many", "one", "tie"}
    assert got["one"]["p"] == got["tie"]["p"] == 1.0 and got["many"]["n"] == 400
    z = abs(sum(many)) / math.sqrt(sum(x * x for x in many))
    assert abs(got["many"]["p"] - math.erfc(z / math.sqrt(2))) < 0.03


def test_clusters_as_plain_python(spark):
    data = [(rng.choice("ab"), rng.choice(["x", "y", None]), rng.randint(0, 4), rng.random(), rng.randint(1, 3)) for _ in range(200)]
    df = spark.createDataFrame(data, "g string, d string, s int, t double, c int").repartition(4)
    got = {(r["g"], r["b"]): r["mean"] for r in resampling.clustered(df, "g", ["d", "s"], "t", "c", 40, "q", "digest").collect()}
    for g, b in itertools.product("ab", range(40)):
        top = bottom = 0.0
        for h, d, s, t, c in data:
            u = (int(draw("q", b, f"{d or chr(0)}|{s}"), 16) >> 11) * 2.0**-53
            w = next((k for k in range(13) if u < resampling.POISSON_1[k]), 13)
            top, bottom = top + w * t * (g == h), bottom + w * c * (g == h)
        assert got[g, b] is None if bottom == 0 else math.isclose(got[g, b], top / bottom, rel_tol=1e-9)
