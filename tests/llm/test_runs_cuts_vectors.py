"""Periodic runs, fill-in-the-middle and the grid order join against plain Python, and on rows of every odd kind."""

import hashlib
import math
import random
import re
import time

import numpy as np
import pytest

from corploom.llm import gridjoin, infill, periodic

rng = random.Random(7)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def runs_by_hand(w, least=12):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + (j == i)
    return sorted((a, b - a, q) for (a, b), q in found.items())


def odd_words():
    n, kinds = rng.randint(0, 300), rng.choice([1, 2, 5, 60])
    w = [rng.randrange(kinds) for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n else 0):
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 9)
        for i in range(a, rng.randint(a, n)):
            w[i] = w[a + (i - a) % p]
    return [f"w{x}" for x in w]


def test_runs(spark):
    texts = [rng.choice([" ", "\n ", "\t"]).join(odd_words()) for _ in range(150)] + [None, "", " \n", "é é é é é é é é é é é é", "a " * 11, "A a " * 6, "x\u00a0x " * 12]
    rows = [(rng.choice([i, None]), t, "clash") for i, t in enumerate(texts)]
    got = periodic.find(spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(4)).collect()
    want = []
    for d, t, _ in rows:
        w = WORD.findall(t or "")
        runs = runs_by_hand(w)
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        want.append((d, len(w), runs, " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert sorted(map(str, ((r["doc_id"], r["n_words"], [(x["start"], x["length"], x["period"]) for x in r["runs"]], r["collapsed"]) for r in got))) == sorted(map(str, want))
    assert sum(bool(x[2]) for x in want) > 50


@pytest.mark.parametrize("direct", [8, 64])
def test_lags_that_recur(direct, monkeypatch):
    """Long stretches are compared at the lags at which windows recur alone: none is missed."""
    monkeypatch.setattr(periodic, "DIRECT", direct)
    for _ in range(150):
        w = np.array([int(x[1:]) for x in odd_words() + odd_words()], np.int64)
        if len(w) >= 12:
            assert periodic.runs_of(w, 12, 2) == runs_by_hand(w.tolist())


def test_very_long_texts_of_few_words():
    begin = time.time()
    for w in (np.random.default_rng(1).integers(0, 2, 200_000), np.zeros(200_000, np.int64), np.arange(200_000) % 7001, np.tile(np.random.default_rng(2).integers(0, 3, 999), 200)):
        runs = periodic.runs_of(w, 12, 2)
        assert all(n >= max(12, 2 * q) and (w[a : a + n - q] == w[a + q : a + n]).all() for a, n, q in runs[:500])
    assert runs[0][1:] == (199_800, 999) or (0, 199_800, 999) in runs
    assert time.time() - begin < 30


def test_no_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find(none).count() == infill.transform(none).count() == 0


def test_cuts(spark):
    texts = ["".join(rng.choice("ab Zé日\U00010d42<PSM>-\n") for _ in range(rng.choice([0, 1, 5, 50, 3000]))) for _ in range(120)] + [None, "", "a<P>b", "a<S>b", "<M>", "ß" * 4000, "word " * 9000]
    rows = [(rng.choice([i, i, i, None]), t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(3)
    made = infill.transform(df, every=16)
    got = sorted(map(str, made.select("*", infill.restored(made["output"], made["form"]).alias("again")).collect()))
    want, forms = [], set()
    from pyspark.sql import Row

    for d, t, _ in rows:
        t = t or ""
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
        h = hashlib.sha256(f"1:{'' if d is None else d}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not t or any(m in t for m in infill.MARKERS) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
        forms.add(form)
        out = {"plain": t, "psm": f"<P>{pre}<S>{suf}<M>{mid}", "spm": f"<S>{suf}<P>{pre}<M>{mid}"}[form]
        plain = form == "plain"
        want.append(str(Row(doc_id=d, n=n, form=form, prefix_chars=None if plain else len(pre), middle_chars=None if plain else len(mid), output=out, again=t)))
    assert got == sorted(want) and forms == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("every", "stretch"), [(1, 1), (3, 7), (16, 64), (256, 1 << 18)])
def test_checkpoints(every, stretch):
    """Cuts are right whatever the index keeps, and however the bytes are counted in stretches; it keeps one place in `every`."""
    texts = ["", "abc déf  gh日本", "", "x", "Zz" * 40 + "é" * 40, ""]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    edges = np.cumsum([0, *[len(t.encode()) for t in texts]])
    index = infill.Index(raw, edges, every, stretch)
    for t, text in enumerate(texts):
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        assert index.counts[t] == len(units)
        byte, char = index.cut(t, 0)
        for x in range(len(units) + 1):
            before = "".join(units[:x])
            assert index.cut(t, x) == (byte + len(before.encode()), char + len(before))
    assert len(index.units) <= len(texts) + 1 + index.counts.sum() / every + 1


def links_by_hand(rows, least):
    """Links, and the least id that they reach, of (id, vector, label) rows."""
    fine = lambda v, label: label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n, links = len(rows), [0] * len(rows)
    low = [r[0] for r in rows]
    pairs = []
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i], rows[j]
            if a == b and fine(v, a) and fine(w, b) and len(v) == len(w):
                x, y = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    pairs.append((i, j))
                    links[i] += 1
                    links[j] += 1
    change = True
    while change:
        change = False
        for i, j in pairs:
            m = min((x for x in (low[i], low[j]) if x is not None), default=None)
            change |= low[i] != m or low[j] != m
            low[i] = low[j] = m
    return sorted(map(str, ((r[0], k, c, r[0] is not None and r[0] == c) for r, k, c in zip(rows, links, low))))


@pytest.mark.parametrize(("spread", "block", "leaf"), [(1.0, 16, 4), (0.3, 7, 2), (8.0, 2048, 256)])
def test_vectors(spark, monkeypatch, spread, block, leaf):
    """Blocks of a few vectors, so that intervals of several levels are joined; vectors that scales of 1e150 do not harm; null and repeated ids."""
    monkeypatch.setattr(gridjoin, "LEAF", leaf)
    base = [[rng.gauss(0, 1) * spread ** -k for k in range(9)] for _ in range(40)]
    rows = [(v, rng.choice(["a", "b"])) for v in base for _ in range(1)]
    rows += [([x + rng.choice([0.02, 0.1, 0.2]) * rng.gauss(0, 1) * spread ** -k for k, x in enumerate(v)], label) for v, label in rows for _ in range(5)]
    rows += [([x * rng.choice([1e150, 1e-150]) for x in v], label) for v, label in rows[:20]]
    rows += [(base[0], "a"), (base[0], "a"), (None, "a"), ([], "a"), ([0.0] * 9, "a"), ([None] * 9, "a"), ([math.nan] * 9, "b"), ([math.inf] + [1.0] * 8, "b"), (base[0], None), (base[0][:4], "a"), (base[0][:4], "a"), ([1.0], "a"), ([-1.0], "a"), ([2.0], "a")]
    rows = [(None if i % 31 == 5 else i - i % 2 if i % 50 == 1 else i, v, label) for i, (v, label) in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(5)
    got = gridjoin.groups(df, 0.93, block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in got.collect()) == links_by_hand(rows, 0.93)


def test_distant_blocks_are_skipped(spark):
    """Vectors that spread over few directions: most pairs of blocks are never joined."""
    import pyspark.sql.functions as F

    data = [(i, [math.cos(a), math.sin(a), 0.01 * rng.gauss(0, 1)], 1) for i in range(4000) for a in [rng.random() * 6.28]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    vectors = df.select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("copies"), F.lit("1").alias("class"), F.col("embedding").alias("unit"))
    unit = vectors.withColumn("unit", F.transform("unit", lambda x: x / F.sqrt(F.aggregate("unit", F.lit(0.0), lambda s, y: s + y * y))))
    epsilon = math.sqrt(0.14)
    basis = gridjoin.directions(unit, 3)
    blocks = gridjoin.blocked(gridjoin.gridded(unit, basis, epsilon), basis, 50).withColumn("code", F.shiftleft(F.col("part").cast("long"), 10) + F.col("seq"))
    from corploom.sources.io import stored

    blocks = stored(blocks)
    n, pairs = blocks.count(), gridjoin.block_pairs(blocks, epsilon).count()
    assert n >= 80 and n <= pairs < 0.4 * n * (n + 1) / 2


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert gridjoin.groups(none).count() == 0
    odd = spark.createDataFrame([(1, None, 1), (2, [0.0], 1), (None, [1.0], None)], "vec_id long, embedding array<float>, label int")
    assert {tuple(r) for r in gridjoin.groups(odd).collect()} == {(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, False)}
