import math
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corploom.functions import stats, text
from corploom.operators import codec, mixtures, order, packing, sampling

ROWS = [(0, "0", 0, .1, .8, .0, .5), (1, "0", 0, .2, .7, .0, .6), (2, "0", 0, .3, .6, .0, .65), (3, "0", 4, .4, .5, .0, .7), (4, "0", 4, .5, .4, .0, .75), (5, "0", 4, .6, .3, .0, .8), (6, "2", 4, .7, .2, .0, .85), (7, "2", 4, .8, .1, .0, 1.2)]


@pytest.fixture(scope="module")
def pool(spark):
    return spark.createDataFrame(ROWS, "doc_id long, domain string, bucket int, score double, mean_score double, wrong double, cr double").cache()


def p_of(df):
    return {r["doc_id"]: r["p"] for r in df.collect()}


@pytest.mark.parametrize("f", [mixtures.population, mixtures.band, mixtures.bucket_prior, mixtures.direct_soft, mixtures.direct_hard, mixtures.cell_tilt, mixtures.rank_tilt, mixtures.contrastive, mixtures.global_tilt])
def test_sums_to_one(pool, f):
    p = p_of(f(pool))
    assert len(p) == 8 and min(p.values()) >= 0 and math.isclose(sum(p.values()), 1, abs_tol=1e-12)


def test_bucket_prior_leaves_empty_buckets_out(pool):
    p = p_of(mixtures.bucket_prior(pool))
    tau = mixtures.TAU
    assert math.isclose(sum(p[i] for i in (0, 1, 2)), (.6 + tau) / (3.6 + 2 * tau))


def test_marginals_stay(pool):
    p, q = p_of(mixtures.rank_tilt(pool)), p_of(mixtures.averaged(mixtures.cell_tilt(pool), "domain"))
    tilt = p_of(mixtures.cell_tilt(pool))
    for cell in ((0, 1, 2), (3, 4, 5), (6, 7)):
        assert math.isclose(sum(p[i] for i in cell), len(cell) / 8)
        assert max(p[i] for i in cell) / min(p[i] for i in cell) <= 4 + 1e-9
    assert math.isclose(sum(q[i] for i in range(6)), sum(tilt[i] for i in range(6)))


def test_empty_support(pool):
    none = mixtures.band(pool, 2.0, 3.0, "unavailable")
    assert set(p_of(none).values()) == {0.0}
    with pytest.raises(Exception, match="no support"):
        mixtures.band(pool, 2.0, 3.0).collect()


def test_strict_prior_refuses_negative(spark, pool):
    with pytest.raises(Exception, match="finite"):
        mixtures.strict_bucket_prior(pool.withColumn("score", F.col("score") - 1)).collect()


def test_shuffle_keeps_the_multiset(pool):
    a = sorted(r["score"] for r in mixtures.shuffled_scores(pool, 7, ["domain"]).collect())
    assert a == sorted(r[3] for r in ROWS)


def test_statistics(spark):
    rows = spark.createDataFrame([(3, 0), (5, 0), (6, 0), (5, 2), (0, 0)], "w long, l long")
    got = [r[0] for r in rows.select(stats.sign_test(F.col("w"), F.col("l"))).collect()]
    assert got == pytest.approx([.25, .0625, .03125, .453125, 1.0])
    tests = spark.createDataFrame([("a", .01), ("b", .04), ("c", None)], "name string, p double")
    assert [r["p_holm"] for r in stats.holm(tests.where("p is not null")).orderBy("name").collect()] == pytest.approx([.02, .04])
    assert [r["p_holm"] for r in stats.holm(tests).orderBy("name").collect()][0] == pytest.approx(.03)


def test_packing(spark):
    rows = spark.createDataFrame([(i, "d", chr(97 + i) * 20) for i in range(8)], "doc_id long, domain string, text string")
    packs = packing.pack_records(rows, 64).collect()
    assert sorted((len(r["member_ids"]), len(r["view"]), r["full_bytes"]) for r in packs) == [(4, 64, 84), (4, 64, 84)]
    tail = packing.pack_records(spark.createDataFrame([(i, "d", "abcdefghij") for i in range(7)], "doc_id long, domain string, text string"), 64).collect()
    assert [r["member_ids"] for r in tail] == [[str(i) for i in range(6)]]


@pytest.mark.parametrize("width", [1, 5, 64, 500, 5000])
def test_packs_over_many_ranges(spark, width):
    """Packs are those of one ordered pass, wherever ranges part."""
    draw = random.Random(width)
    rows = [(i, draw.choice("ab"), None if draw.random() < 0.05 else "x" * draw.choice([0, 1, 3, 10, 40, 200])) for i in range(500)]
    want = []
    for g in "ab":
        ids, data = [], b""
        for i, domain, t in rows:
            if domain == g:
                data, ids = data + (t or "").encode() + b"\n", [*ids, str(i)]
                if len(data) >= width:
                    want.append((g, ids, data[:width], len(data)))
                    ids, data = [], b""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = packing.pack_records(spark.createDataFrame(rows, "doc_id long, domain string, text string"), width).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r["domain"], r["member_ids"], bytes(r["view"]), r["full_bytes"]) for r in got) == sorted(want)


CELLS = dict(domain=[0] * 6 + [1] * 3 + [2] * 3, bucket=[0, 0, 0, 4, 4, 4, 1, 1, 1, 4, 4, 4], score=[.1, .2, .3, .4, .5, -.6, .9, .95, 1., .7, .8, .85], mean_score=[.8, .7, .6, .5, .4, .3, .9, .9, .9, .2, .1, .05])


@pytest.fixture(scope="module")
def twelve(spark):
    rows = list(zip(range(12), map(str, CELLS["domain"]), CELLS["bucket"], CELLS["score"], CELLS["mean_score"], strict=True))
    return spark.createDataFrame(rows, "doc_id long, domain string, bucket int, score double, mean_score double").withColumn("wrong", F.lit(0.0)).cache()


def test_cells_average_the_clipped_score(twelve):
    """The target score, clipped at nought, makes a cell's mean; the mean score has no part in it."""
    got = {(r["domain"], r["bucket"]): (r["mu"], r["z"]) for r in mixtures.cells(twelve).collect()}
    mu = {("0", 0): .2, ("0", 4): .3, ("1", 1): .95, ("2", 4): 2.35 / 3}
    mean = sum(mu.values()) / 4
    sd = math.sqrt(sum((v - mean) ** 2 for v in mu.values()) / 4)
    assert all(math.isclose(got[k][0], v) and math.isclose(got[k][1], (v - mean) / sd) for k, v in mu.items())
    tilt, matched = mixtures.cell_tilt(twelve), mixtures.averaged(mixtures.cell_tilt(twelve), "domain")
    mass = lambda df: {r["domain"]: r["m"] for r in df.groupBy("domain").agg(F.sum("p").alias("m")).collect()}
    a, b = mass(tilt), mass(matched)
    assert all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


def test_rank_tilt_keeps_joint_mass(twelve):
    got = mixtures.rank_tilt(twelve).collect()
    for cell in {(r["domain"], r["bucket"]) for r in got}:
        p = [r["p"] for r in got if (r["domain"], r["bucket"]) == cell]
        assert math.isclose(sum(p), len(p) / 12, abs_tol=1e-12) and max(p) / min(p) <= 4 + 1e-9


def test_packs_are_inherited(spark):
    """Bucket prior and wrong target over two packs of two examples; a band that nothing is in is unavailable."""
    rows = [("a", "0", 0, .7, 3., 1., 0), ("b", "0", 0, .7, 3., 1., 0), ("c", "1", 1, .75, 1., 3., 1), ("d", "1", 1, .75, 1., 3., 1)]
    df = spark.createDataFrame(rows, "doc_id string, domain string, bucket int, cr double, score double, wrong double, pack int")
    p = p_of(mixtures.bucket_prior(df, tau=0.0, on_empty="uniform"))
    assert p == pytest.approx({"a": .375, "b": .375, "c": .125, "d": .125})
    assert p_of(mixtures.bucket_prior(df, "wrong", 0.0, "uniform")) == pytest.approx({"a": .125, "b": .125, "c": .375, "d": .375})
    assert set(p_of(mixtures.band(df.withColumn("cr", F.lit(.4)), on_empty="unavailable")).values()) == {0.0}
    packs = df.groupBy("pack").agg(F.first("domain").alias("domain"), F.first("bucket").alias("bucket"), F.max("score").alias("score"), F.max("wrong").alias("wrong"))
    dealt = {r["pack"]: r["score"] for r in mixtures.shuffled_packs(df, packs, 1405, ["score"]).select("pack", "score").distinct().collect()}
    assert sorted(dealt.values()) == [1., 3.]


def test_clip_before_the_sum(spark):
    """Contrasts are clipped pack by pack, then added."""
    df = spark.createDataFrame([(0, "x", 0, 0., 4.), (1, "x", 0, 3., 1.), (2, "x", 1, 2., 1.)], "doc_id long, domain string, bucket int, score double, wrong double")
    assert p_of(mixtures.contrastive(df)) == pytest.approx({0: 1 / 3, 1: 1 / 3, 2: 1 / 3})
    for bad in (float("nan"), -1.0):
        with pytest.raises(Exception, match="finite"):
            mixtures.strict_bucket_prior(df.withColumn("score", F.when(F.col("doc_id") == 1, F.lit(bad)).otherwise(F.col("score")))).collect()


def test_constant_contrast_is_uniform(spark):
    rows = [(i, str(i % 3), i % 4, i // 5) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, bucket int, pack int").withColumns({"domain": (F.col("pack") % 3).cast("string"), "bucket": F.col("pack") % 4})
    packs = df.select("pack", "domain", "bucket").distinct().withColumns({"score": F.lit(.5), "wrong": F.lit(.2)})
    assert all(math.isclose(p, 1 / 60) for p in p_of(mixtures.pack_rank(df, packs)).values())
    tilted = packs.withColumn("score", F.rand(3))
    for seed in (None, 1707):
        got = mixtures.pack_rank(df, tilted, seed=seed).collect()
        for cell in {(r["domain"], r["bucket"]) for r in got}:
            mine = [r["p"] for r in got if (r["domain"], r["bucket"]) == cell]
            assert math.isclose(sum(mine), len(mine) / 60, abs_tol=1e-12)


def test_order(spark):
    """Places, running sums and ranks are those of one sorted list."""
    draw = random.Random(4)
    rows = [(i, draw.choice("xyz"), draw.randint(0, 5) / 2, draw.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string, v double, w double")
    want = sorted(rows, key=lambda r: (r[3], r[0]))
    got = sorted(order.placed(df, [F.col("w"), F.col("id")], "place", F.col("v"), "before").collect(), key=lambda r: r["place"])
    assert [r["id"] for r in got] == [r[0] for r in want] and [r["place"] for r in got] == list(range(300))
    assert all(math.isclose(r["before"], sum(x[2] for x in want[:i]), abs_tol=1e-9) for i, r in enumerate(got))
    inside = {r["id"]: r["place"] for r in order.placed_within(df, ["g"], [F.col("w"), F.col("id")]).collect()}
    assert all(inside[r[0]] == sum(x[1] == r[1] for x in want[: want.index(r)]) for r in rows)
    ranks = {r["id"]: r["rank"] for r in order.ranked(df, ["g"], "v").collect()}
    for i, g, v, _ in rows:
        mine = sorted(x[2] for x in rows if x[1] == g)
        assert ranks[i] == mine.index(v) + (mine.count(v) + 1) / 2


def test_quantiles(spark):
    import numpy as np

    draw = random.Random(9)
    rows = [(draw.choice("xy"), draw.randint(0, 20) / 4) for _ in range(101)] + [("z", 1.5)]
    df = spark.createDataFrame([*rows, ("x", None)], "g string, v double")
    levels = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in order.quantiles(df, "v", levels, ["g"]).collect()}
    assert all(got[g] == pytest.approx(np.quantile([v for h, v in rows if h == g], levels).tolist()) for g in "xyz")
    assert order.quantiles(df, "v", levels).first()["q"] == pytest.approx(np.quantile([v for _, v in rows], levels).tolist())


def test_draw(spark):
    """Slots fall where the summed probabilities say."""
    p = [0.0, 0.5, 0.1, 0.0, 0.4]
    df = spark.createDataFrame(list(enumerate(p)), "doc_id long, p double")
    slots = spark.createDataFrame([(u,) for u in (0.0, 0.49, 0.5, 0.59, 0.61, 0.999)], "u double")
    assert sorted((r["u"], r["doc_id"]) for r in sampling.draw(df, slots, 4).collect()) == [(0.0, 1), (0.49, 1), (0.5, 2), (0.59, 2), (0.61, 4), (0.999, 4)]


def test_intervals_and_text(spark):
    rows = spark.createDataFrame([(2, .3, .0), (3, .3, .0), (3, None, None)], "n int, mean double, sd double")
    half = stats.interval_half(F.col("n"), F.col("sd"))
    assert [r[0] for r in rows.select(half).collect()] == [None, 0.0, None]
    assert [r[0] for r in rows.select(text.interval_text(F.col("mean"), half, "%.1f")).collect()] == ["0.3", "0.3 [0.3, 0.3]", "n/a"]


def test_capacity(spark):
    """The best share of a target that a prior over buckets can reach."""
    rows = spark.createDataFrame([(0, 6462, 27440), (1, 15292 - 6462, 103123 - 27440)], "bucket int, hits int, n int")
    row = rows.agg(F.max(F.col("hits") / F.col("n")).alias("bound"), (F.sum("hits") / F.sum("n")).alias("share")).first()
    assert math.isclose(row["bound"], .235496, abs_tol=1e-6) and math.isclose(row["share"], .148289, abs_tol=1e-6)


def test_byte_prefix(spark):
    """The first bytes without a character cut in two, at every width."""
    t = "aé日\U0001f600b" * 3
    row = spark.createDataFrame([(t,)], "t string").select(*[text.byte_prefix(F.col("t"), n).alias(f"w{n}") for n in range(1, 34)]).first()
    assert all(row[f"w{n}"] == t.encode()[:n].decode("utf-8", "ignore") for n in range(1, 34))


def test_codec(spark):
    raw = b"abc" * 400
    row = spark.createDataFrame([(raw.decode(),)], "t string").select(codec.compression_ratio(F.col("t")).alias("r"), codec.alignment(F.col("t"), [raw]).alias("a")).first()
    assert row["r"] == codec.lz4_frame_size(raw) / len(raw) and row["a"]["best"] > 0.5


def test_entry_points():
    import __spark_entry__ as e

    assert len(e.queries()) > 55 and set(e.oracle_sql()) <= set(e.queries())


def test_pool_counts_words_where_texts_are_read(spark):
    """Counts as Python has them; neither texts nor words are dealt or sorted across tasks, one row of sums a document is."""
    import re
    from collections import Counter

    from corploom.plans.catalog import scored_pool

    texts = ["a b a c a", "", None, "B b\u00e9 b_1, b", "...", "c " * 500 + "d"]
    docs = spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string")
    known = lambda words, mark: F.broadcast(spark.createDataFrame([(w, 1) for w in words], f"t string, {mark} int"))
    out = scored_pool(docs, known("ab", "b"), known("cd", "w"))
    want = {}
    for i, t in enumerate(texts):
        c = Counter(re.findall(r"\w+", (t or "").lower()))
        if n := sum(c.values()):
            want[i] = (n, len(c) / n, (c["a"] + c["b"]) / n, (c["c"] + c["d"]) / n / 2)
    assert {r["doc_id"]: (r["n_words"], r["cr"], r["score"], r["wrong"]) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString() + out._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan and "Repartition" not in plan and "SortMergeJoin" not in plan


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the test tables are not here")
def test_pool_with_large_vocabularies(spark, monkeypatch):
    """Vocabularies too large to go around are hashed in parts and counted words stream by: the same pool, and no sort of words."""
    from corploom.plans import catalog
    from corploom.sources import io

    plans, stored = [], io.stored

    def spy(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df)

    folder = "/root/testdata/sf0.001"
    want = catalog.pool(spark, folder).collect()
    for f in {io.small, getattr(io, "shares", io.small)}:
        monkeypatch.setattr(f, "__defaults__", (100, 16 << 20))
    monkeypatch.setattr(catalog, "PART_BYTES", 1 << 16, raising=False)
    monkeypatch.setattr(catalog, "stored", spy)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = catalog.pool(spark, folder).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 200
    assert "SortMergeJoin" not in plans[-1] and plans[-1].count("ShuffledHashJoin") == 2


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="the test tables are not here")
def test_pool_deals_words_to_parts_that_are_written_straight_to_files(spark, monkeypatch):
    """Beyond 200 parts Spark's writer keeps all counted words of a task in memory: as many parts as text asks for are not made, and the pool is the same."""
    from corploom.plans import catalog
    from corploom.sources import io

    plans, stored = [], io.stored

    def spy(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return stored(df)

    folder = "/root/testdata/sf0.001"
    want = catalog.pool(spark, folder).collect()
    monkeypatch.setattr(io.shares, "__defaults__", (100, 16 << 20))
    monkeypatch.setattr(catalog, "PART_BYTES", 1 << 10)  # some 700 parts
    monkeypatch.setattr(catalog, "stored", spy)
    got = catalog.pool(spark, folder).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) == 200
    dealt = [int(n) for n in re.findall(r"hashpartitioning\(t#\d+, (\d+)\)|RepartitionByExpression \[t#\d+\], (\d+)", plans[-1]) for n in n if n]
    assert dealt and max(dealt) <= 200


def test_parts_of_words_grow_with_the_text():
    from corploom.plans import catalog

    mb = 1 << 20
    assert [catalog.word_parts(x * mb) for x in (0, 16, 17, 3200, 10_000, 25_600)] == [1, 1, 2, 200, 200, 200]
    assert catalog.word_parts(10 * mb, 7) == 7 and catalog.word_parts(51_200 * mb) == 400
