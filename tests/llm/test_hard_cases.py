"""Cases that once lost links or went to one task: common seeds, texts of few words, one component of unlike texts."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corploom.llm import common, jaccard, shared, substring

rng = random.Random(21)


def words(n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def held_elsewhere(holders, passages=20, every=10):
    """Rows of edited copies, and of each its source; before it, `holders` documents have all the passage's 5-word runs in other order."""
    docs, want = [], {}
    for _ in range(passages):
        passage = words(100)
        for _ in range(holders):
            runs = [passage[j : j + 5] for j in range(96)]
            rng.shuffle(runs)
            docs.append(" ".join(w for r in runs for w in r))
        source = len(docs)
        docs.append(" ".join(words(30) + passage + words(30)))
        want[len(docs)] = source
        docs.append(" ".join(words(30) + [f"x{rng.randrange(10**6)}" if j % every == every - 1 else w for j, w in enumerate(passage)] + words(30)))
    return list(enumerate(docs)), want


@pytest.mark.parametrize("holders", [0, 3, 10, 40])
def test_edited_repeats_whose_runs_others_hold(spark, holders):
    docs, want = held_elsewhere(holders)
    got = {r["doc_id"]: r for r in substring.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    hit = sum(any(p["source"] == s and p["end"] - p["begin"] >= 50 for p in got[d]["passages"]) for d, s in want.items())
    assert hit >= 18


def test_texts_of_few_words(spark):
    """Two texts of 200,000 words of two kinds: work does not grow with the product of occurrences; an exact repeat of fresh words among them is found."""
    binary = [[str(rng.randrange(2)) for _ in range(200_000)] for _ in range(2)]
    passage = words(60)
    binary[0][1000:1000], binary[1][77_000:77_000] = passage, passage
    begin = time.time()
    got = {r["doc_id"]: r for r in substring.find(spark.createDataFrame([(i, " ".join(b)) for i, b in enumerate(binary)], "doc_id long, text string").repartition(2)).collect()}
    assert time.time() - begin < 90 and got[0]["n_removed"] == 0
    assert any(p["begin"] <= 77_000 and p["end"] >= 77_060 for p in got[1]["passages"])


def test_crowded_seeds_give_way():
    """Places of one text beyond MANY, evenly spaced ones aside, make a seed crowded; longer runs stand for it until they are not."""
    key = np.zeros(400, np.uint64)
    irregular = np.sort(rng.sample(range(10_000), 400))
    assert substring.crowded(key, np.zeros(400, np.int64), irregular).all()
    assert not substring.crowded(key, np.zeros(400, np.int64), np.arange(400) * 7).any()
    assert not substring.crowded(key, np.arange(400) // 50, irregular).any()
    words_, at = np.array([rng.randrange(2) for _ in range(5000)], np.uint64), np.array([0, 5000])
    key, row, place, size = substring.longer(words_, at, np.zeros(4990, np.int64), np.arange(4990), 6)
    assert len(set(size.tolist())) > 1 and (place + size <= 5000).all()
    order = np.lexsort((place, row, key))
    assert not substring.crowded(key[order], row[order], place[order]).any()


def component_of_unlike(n):
    """Texts of two passages, each the first of the next text, in a ring, each twice but for a word: one component holds all, and links are pairs."""
    passages = [words(30) for _ in range(n)]
    docs = [(i, " ".join(passages[i] + passages[(i + 1) % n])) for i in range(n)]
    return docs + [(n + i, t + " z") for i, t in docs], {n + i: i for i in range(n)}


@pytest.mark.parametrize("n", [1500])
def test_one_component_of_unlike_texts(spark, monkeypatch, tmp_path, n):
    """It is parted by shingles: no task gets more than a few texts, no text is copied to all pivots, and links are found."""
    docs, pairs = component_of_unlike(n)
    sizes = str(tmp_path / "sizes")
    before = jaccard.by_shingles

    def recorded(stuck, prefixes, num, den, max_region, region_bytes):
        out = before(stuck, prefixes, num, den, max_region, region_bytes)
        out.groupBy("region").agg(F.count(F.lit(1)).alias("m")).write.mode("append").parquet(sizes)
        stuck.agg(F.count(F.lit(1)).alias("stuck")).write.mode("append").parquet(sizes + "-stuck")
        return out

    monkeypatch.setattr(jaccard, "by_shingles", recorded)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.groups(df, 3, 50, 100, max_region=200).collect()}
    assert got == {i: pairs.get(i, i) for i, _ in docs}
    assert spark.read.parquet(sizes).agg(F.max("m")).first()[0] <= 200
    assert spark.read.parquet(sizes + "-stuck").agg(F.sum("stuck")).first()[0] <= 1.2 * len(docs)


def test_a_shingle_that_all_unlike_texts_have(spark):
    """What one shingle brings together is cut by size and hash, and every link inside and between sizes is found."""
    docs, want = [], {}
    for i in range(300):
        w = words(rng.choice([14, 15, 16, 30, 31, 33]))
        docs.append((2 * i, " ".join(["a", "b", "c", *w])))
        if i % 3 == 0:
            docs.append((2 * i + 1, " ".join(["a", "b", "c", *w, "q"][: -1 if i % 2 else None])))
            want[2 * i + 1] = 2 * i
    sets = {d: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for d, t in docs}
    want = {d: s for d, s in want.items() if len(sets[d] & sets[s]) * 100 >= 90 * len(sets[d] | sets[s])}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    stuck = df.select(F.lit(1).cast("long").alias("region"), F.lit(True).alias("home"), F.col("doc_id").alias("id"), "text")
    prefixes = spark.createDataFrame([(d, len(s), 7) for d, s in sets.items()], "id long, n long, pivot long")
    parts = jaccard.by_shingles(stuck, prefixes, 90, 100, 40, 1 << 20).collect()
    groups = {}
    for r in parts:
        groups.setdefault(r["region"], set()).add(r["id"])
    assert max(map(len, groups.values())) <= 80 and len(groups) > 10
    assert want and all(any({d, s} <= g for g in groups.values()) for d, s in want.items())


def test_order_of_packed_rows():
    """Rows sorted as packed words come as lexsort has them, also where words have no room for all bits."""
    gen = np.random.default_rng(3)
    for high in (3, 1 << 20, 1 << 47, 1 << 62):
        for n in (0, 1, 2, 5000):
            a, b = gen.integers(-high, high, n), gen.integers(0, 40, n).astype(np.uint64) << np.uint64(3)
            assert (common.ordered(a) == np.argsort(a, kind="stable")).all()
            assert (common.ordered(b, a) == np.lexsort((a, b))).all()
    near = (np.uint64(1) << np.uint64(63)) + gen.permutation(np.repeat(np.arange(700, dtype=np.uint64), 3))
    assert (common.ordered(np.append(near, np.uint64(0))) == np.argsort(np.append(near, np.uint64(0)), kind="stable")).all()


def test_keys_of_messages_take_few_bytes():
    """Ascending keys that lie 25 bits apart take under 3.7 bytes each (4.3 with whole differences one after another)."""
    for n in (0, 1, 80_000):
        keys = np.unique(np.random.default_rng(1).integers(0, 1 << 42, n).astype(np.uint64))
        blob = shared.packed(pa.table({"key": pa.array(keys)}))
        assert (shared.opened_items(blob)["key"].to_numpy() == keys).all()
    assert len(blob) < 3.7 * len(keys)


def test_words_cost_little():
    """The words of a text take the time of lowering and splitting bytes, not that of a table of characters and a pattern."""
    text = " ".join(words(200_000))

    def least(run):
        spent = []
        for _ in range(5):
            begun = time.process_time()
            run()
            spent.append(time.process_time() - begun)
        return min(spent)

    assert least(lambda: substring.words_of(text.encode())) < 3 * least(lambda: text.encode().lower().split())


def test_matches_of_many_pairs_at_once():
    """Pairs laid out together have the segments that each has alone."""
    gen = np.random.default_rng(5)
    pair, x = gen.integers(0, 9, 3000), gen.integers(0, 60, 3000)
    y = x + gen.integers(-3, 4, 3000) + 5
    size = gen.integers(5, 26, 3000)
    got = list(zip(*(v.tolist() for v in substring.segments(x, y, size, pair)), strict=True))
    want = []
    for p in range(9):
        own = pair == p
        for d in range(2, 9):
            runs = sorted((a, a + s) for a, s in zip(x[own & (y - x == d)].tolist(), size[own & (y - x == d)].tolist(), strict=True))
            while runs:
                begin, end = runs.pop(0)
                while runs and runs[0][0] <= end:
                    end = max(end, runs.pop(0)[1])
                want.append((p, begin, begin + d, end - begin))
    assert got == sorted(want)


def test_white_space_and_letters_beyond_ascii(spark):
    """Six characters part words and A-Z alone are lowered; what is kept is cut where the passage lies, whatever its characters take in bytes."""
    passage = [f"{w}\xa0É\x1c {i}\U0001f600" for i, w in enumerate(words(70))]
    one, two = words(40), ["éİ"] + words(30)
    begin, end = "　 \n".join(two) + " \x0b", "\r\n end \xa0 "
    docs = [(1, "\t".join(one + passage)), (2, begin + " ".join(w.replace("w", "W") for w in passage) + end), (3, " ".join(two[:20] + [w.replace("É", "é") for w in passage]))]
    got = {r["doc_id"]: r for r in substring.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[2]["n_words"], got[2]["n_removed"], got[2]["kept"]) == (103, 70, begin + end)
    assert not got[3]["passages"] and got[3]["kept"] == docs[2][1]
