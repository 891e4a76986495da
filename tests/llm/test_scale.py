"""What must hold as the corpus grows: messages, hot keys, ties, long texts, and the guarantee of the rules."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corploom.llm import bpe, common, jaccard, lmscore, rules, sharding, shared, substring, suffix
from corploom.llm.entries import tokenizer_file

rng = random.Random(7)


def fresh(n):
    return [f"w{rng.randint(0, 10**9)}" for _ in range(n)]


def messages(spark, blocks, fan):
    """How many messages, and of which largest group, an exchange of so many blocks and as many buckets sends."""
    docs = spark.range(blocks).select(F.col("id").cast("int").alias("block"), F.lit(b"").alias("rows"))

    def tell(block):
        keys = np.unique(np.random.default_rng(block["block"][0].as_py()).integers(0, 1 << shared.KEY_BITS, 400).astype(np.uint64))
        return pa.table({"key": pa.array(keys), "n": pa.array(np.ones(len(keys), np.uint32))})

    told = shared.exchange(docs, tell, shared.merged_counts, lambda items: items.select(["n"]), blocks, blocks, fan=fan)
    answered = told.groupBy("block").applyInArrow(lambda t: pa.table({"block": t["block"].slice(0, 1), "n": [shared.answers_of(t, len(tell(t)))["n"].to_numpy().sum()], "m": [t.num_rows]}), "block int, n long, m long")
    rows = answered.collect()
    assert len(rows) == blocks
    return sum(r["m"] for r in rows), sum(r["n"] for r in rows)


def test_messages_grow_with_the_root(spark):
    """Through relays a block has about root-of-buckets messages, not one from each; answers are the same."""
    direct, n = messages(spark, 225, 1024)
    relayed, same = messages(spark, 225, 16)
    assert n == same
    assert direct > 225 * 150 and relayed <= 225 * 16


def test_messages_of_some_hundred_blocks(spark):
    """As many blocks as a few gigabytes have: relays are in use by then, and messages are no longer a product."""
    relayed, _ = messages(spark, 300, shared.FAN)
    assert relayed <= 300 * 18


def test_more_blocks_than_partitions(spark, monkeypatch):
    """Tasks that take several blocks give what tasks of one block give."""
    docs = spark.createDataFrame([(i, " ".join(fresh(60))) for i in range(40)] + [(50, None)], "doc_id long, text string")
    path = tokenizer_file("byte_bpe_50k.json")
    want = sorted(map(str, bpe.encode(docs, path, block_bytes=900).collect()))
    monkeypatch.setattr(common, "PARTITIONS", 3)
    few = bpe.encode(docs, path, block_bytes=900)
    assert sorted(map(str, few.collect())) == want


@pytest.mark.parametrize("fan", [1024, 2])
def test_operators_through_relays(spark, fan):
    """Tiny blocks and relays give what one block gives."""
    passage = fresh(70)
    texts = [(i, " ".join(fresh(60) + (passage if i % 4 == 0 else []) + ["the", "of", str(i % 7)])) for i in range(60)] + [(99, None), (100, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = tokenizer_file("byte_bpe_50k.json")
    for f in (
        lambda **o: bpe.encode(docs, path, **o),
        lambda **o: suffix.digests(suffix.remove_repeats(docs, **o)),
        lambda **o: substring.find(docs, **o).select("doc_id", "n_removed", "kept"),
        lambda **o: jaccard.groups(docs, 3, 50, 100, **o),
        lambda **o: lmscore.score(docs, tokenizer_file("piece_bpe_32k.model"), F.col("doc_id") % 2 == 0, **o).select("doc_id", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 6)),
    ):
        assert sorted(map(str, f(block_bytes=1 << 30).collect())) == sorted(map(str, f(block_bytes=900, fan=fan).collect()))


def test_all_characters():
    """Words are cut as the library cuts them, whatever character stands there."""
    path = tokenizer_file("byte_bpe_50k.json")
    cut = bpe.loaded(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for a in range(0, len(points), 40_000):
        text = "\n".join(f"({chr(c)}'s x{chr(c)} {chr(c)}" for c in points[a : a + 40_000])
        assert [w.decode() for w in bpe.split_words([text], path)[0].to_pylist()] == [text[x:y] for _, (x, y) in cut(text)]
    letters = [*"ab'sstmdrevl 1\n\t!", " ", "é", "日", " ", "\U0001f600", "'re", "'ll", " '", "''"]
    for _ in range(3000):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12))) for _ in range(3)]
        words, at = bpe.split_words(texts, path)
        for i, t in enumerate(texts):
            assert [w.decode() for w in words.to_pylist()][at[i] : at[i + 1]] == [t[x:y] for _, (x, y) in cut(t)]


def test_long_text_with_special_tokens(spark):
    """200,000 words with special tokens among them take seconds."""
    path = tokenizer_file("byte_bpe_50k.json")
    text = " ".join(rng.choice(["<|endoftext|>", "word", "it's", "12"]) for _ in range(200_000))
    began = time.time()
    row = bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path).first()
    assert time.time() - began < 60 and row["ids"] == bpe.loaded(path).encode(text, add_special_tokens=False).ids


def test_stretches():
    """A long text cut into stretches has the words of the whole."""
    path = tokenizer_file("byte_bpe_50k.json")
    for most in (1, 5, 40):
        for _ in range(200):
            text = "".join(rng.choice(["a", "'s", " ", "  ", "\n", " \n ", "<|endoftext|>", "1", "!", "\u2003", "é"]) for _ in range(rng.randint(0, 80)))
            pieces = bpe.stretches(text, most)
            assert "".join(pieces) == text
            assert [w for p in pieces for w in bpe.split_words([p], path)[0].to_pylist()] == bpe.split_words([text], path)[0].to_pylist()


def test_word_keys():
    texts = ["Ab aB  c", "", None, "\tx\n", "é É", "y" * 3_000_000 + " z", "ab"]
    keys, at = common.word_keys(common.strings(pa.array(texts)))
    assert np.diff(at).tolist() == [3, 0, 0, 1, 2, 2, 1]
    assert keys[0] == keys[1] == keys[-1] != keys[2] and keys[4] != keys[5] and len(set(keys.tolist())) == 7


def test_rows_equal_in_all(spark):
    """Rows of one id and text, more than fit a shard, still part."""
    rows = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    got = sharding.shard(rows, 8).groupBy("shard").agg(F.sum("size").alias("s"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.count_distinct("slot").alias("n")).collect()
    assert len(got) == 8 and max(r["s"] for r in got) <= 1.1 * min(r["s"] for r in got)
    assert all(r["a"] == 0 and r["b"] + 1 == r["n"] for r in got)
    null = sharding.shard(spark.range(800).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text")), 4)
    assert null.groupBy("shard").count().count() == 4


def test_balance_beside_a_hot_text(spark):
    """A text that fills a third of all rows is spread over shards, the rest evens them out."""
    hot = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("hot " * 20).alias("text"))
    rest = spark.range(4000).select((F.col("id") + 10_000).alias("doc_id"), F.repeat(F.concat(F.lit("text "), F.col("id")), 8).alias("text"))
    got = sharding.shard(hot.unionAll(rest), 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    assert max(r["s"] for r in got) <= 1.05 * min(r["s"] for r in got)


def test_hot_minimizers(spark):
    """Spans of a string that all texts hold are dealt by more of what stands around it; results are those of brute force."""
    line = "this very common licence line stands in every text"
    pool = [fresh(3) for _ in range(12)]
    texts = [(i, " ".join([*pool[rng.randint(0, 11)], line, *pool[rng.randint(0, 11)], line[:20], *pool[rng.randint(0, 11)]])) for i in range(80)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    first, want = {}, {}
    for d, t in texts:
        raw = t.encode()
        gone = {j for i in range(len(raw) - 49) if first.get(raw[i : i + 50], d) < d for j in range(i, i + 50)}
        want[d] = (len(gone), hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest())
        for i in range(len(raw) - 49):
            first.setdefault(raw[i : i + 50], d)
    for hot in (1, 4, 1000):
        got = suffix.digests(suffix.remove_repeats(docs, hot=hot, block_bytes=2000)).collect()
        assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_finer_parts():
    """Each window is in one part, and holds what its part says."""
    for _ in range(200):
        place, length, seed = rng.randint(40, 60), 50, 16
        start = rng.randint(place + seed - length, place)
        count, level = rng.randint(1, place - start + 1), rng.randint(0, 7)
        which, s, c, low, high = suffix.finer(*(np.array([v]) for v in (start, count, place, level)), length, seed)
        windows = [(w, a, b) for x, y, a, b in zip(s.tolist(), c.tolist(), low.tolist(), high.tolist(), strict=True) for w in range(x, x + y)]
        assert sorted(w for w, *_ in windows) == list(range(start, start + count))
        assert all(w <= a <= place and place + seed <= b <= w + length for w, a, b in windows)


def test_multikey_quicksort():
    for _ in range(50):
        n = rng.randint(0, 60)
        a, b = (np.array([rng.randint(0, 4) for _ in range(n)], np.uint64) for _ in range(2))
        order, group = suffix.multikey_order([a, b])
        pairs = [(int(a[i]), int(b[i])) for i in order.tolist()]
        assert pairs == sorted(zip(a.tolist(), b.tolist(), strict=True))
        assert [pairs[i] == pairs[i + 1] for i in range(n - 1)] == [bool(x) for x in group[1:] == group[:-1]]


def test_halves_elsewhere(spark):
    """Exact repeats of 60 words whose halves stand in two earlier documents each."""
    texts, want = [], set()
    for i in range(50):
        p = fresh(60)
        texts += [(10 * i, " ".join(fresh(30) + p[:30] + fresh(30))), (10 * i + 1, " ".join(fresh(30) + p[30:] + fresh(30))), (10 * i + 2, " ".join(fresh(20) + p + fresh(20))), (10 * i + 3, " ".join(fresh(25) + p + fresh(25)))]
        want.add(10 * i + 3)
    got = {r["doc_id"] for r in substring.find(spark.createDataFrame(texts, "doc_id long, text string")).where("n_removed >= 60").select("doc_id").collect()}
    assert got == want


@pytest.mark.parametrize("rate", [0.05, 0.10, 0.15, 0.20])
def test_fuzzy_recall(spark, rate):
    """Of passages of 100 words with words replaced at random, those still similar enough are found, nine in ten at least."""
    texts, places = [], {}
    for i in range(60):
        p = fresh(100)
        edited = [w if rng.random() > rate else "other" for w in p]
        texts += [(2 * i, " ".join(fresh(40) + p + fresh(40))), (2 * i + 1, " ".join(fresh(30) + edited + fresh(30)))]
        if sum(a == b for a, b in zip(p, edited, strict=True)) >= 80:
            places[2 * i + 1] = set(range(30, 130))
    got = substring.find(spark.createDataFrame(texts, "doc_id long, text string")).where("n_removed > 0").collect()
    covered = {r["doc_id"]: {j for p in r["passages"] for j in range(p["begin"], p["end"])} for r in got}
    assert sum(len(covered.get(d, set()) & s) >= 50 for d, s in places.items()) >= 0.9 * len(places)


def test_copies_of_long_texts(spark):
    """Equal texts go as a whole, whatever their number; the first stays."""
    long, short = " ".join(fresh(200)), " ".join(fresh(20))
    rows = [(i, long) for i in range(40)] + [(100 + i, short) for i in range(5)]
    got = {r["doc_id"]: r for r in substring.find(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=4000).collect()}
    assert got[0]["n_removed"] == 0 and all(got[i]["n_removed"] == 200 and got[i]["passages"][0]["source"] == 0 for i in range(1, 40))
    assert all(got[100 + i]["n_removed"] == 0 for i in range(5))


def test_kept_columns_are_as_they_were(spark):
    from datetime import datetime

    rows = spark.createDataFrame([(1, "a b", datetime(2024, 1, 2, 3, 4, 5, 123456), "x"), (None, None, None, None)], "doc_id long, text string, at timestamp, kept string")
    out = substring.find(rows, keep=True)
    assert out.columns == ["doc_id", "text", "at", "kept", "found"]
    assert sorted(map(str, out.drop("found").collect())) == sorted(map(str, rows.collect()))


def test_false_rejections_stay_bounded(spark):
    """Over many samples of labelled texts the share of good texts that are lost exceeds the risk in a few at most."""
    draw = random.Random(1)
    rows, labels, stratum = [], [], {}
    for s in range(24):  # strata are independent trials here: errors divide by one each
        for i in range(700):
            d = len(rows)
            good = draw.random() < 0.8
            symbols = draw.randint(0, 3) if good else draw.randint(0, 12)
            words = [f"w{draw.randint(0, 400)}" for _ in range(30)] + ["#"] * symbols
            rows.append((d, " ".join(words), f"s{s}"))
            stratum[d] = (f"s{s}", good)
            if i % 7 < 5:
                labels.append((d, int(good)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = rules.apply(docs, marks, risk=0.05, error=0.5 * 24).collect()
    lost, n, rejected = {}, {}, 0
    for r in got:
        s, good = stratum[r["doc_id"]]
        gone = bool(r["rejected_by"])
        rejected += gone and not good
        if good:
            n[s], lost[s] = n.get(s, 0) + 1, lost.get(s, 0) + gone
    assert rejected > 100, "cutoffs reject bad texts"
    # even at an error of one half a stratum, the others hold
    assert sum(lost[s] > 0.05 * n[s] for s in n) <= 16


def test_strata_and_copies(spark):
    """A null stratum is one of its own, and copies are one witness."""
    good = [(i, f"text number {i} " + " ".join(fresh(30)), None) for i in range(900)]
    plain = [(1000 + i, " ".join(fresh(30)) + (" #" * 9 if i % 10 == 0 else ""), lang) for i, lang in enumerate([None, "", "en"] * 200)]
    copies = [(5000 + i, "one and the same text of more than twenty words " * 3 + "end", "en") for i in range(900)]
    docs = spark.createDataFrame([*good, *plain, *copies], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(d, 1) for d, *_ in [*good, *copies]], "doc_id long, quality int")
    got = {r["stratum"]: r for r in rules.cutoffs(rules.measured(docs), labels).collect()}
    assert got[None]["n_good"] == 900 and got[None]["steps"] > 0
    assert "" not in got and got["en"]["n_good"] == 1 and got["en"]["steps"] == 0


def test_digest_is_of_the_whole_text(spark):
    text = " ".join(fresh(50_000))
    row = suffix.digests(suffix.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert row["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_spans_go_only_where_a_side_is_shared(spark, monkeypatch):
    """A text that shares a minimizer with others, and no more bytes than that, sends none of its spans; what is repeated is found as before."""
    rng, phrase = np.random.default_rng(5), "sixteen common bytes"
    word = lambda: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 40))
    unlike = [(i, " ".join(x for _ in range(20) for x in (word(), phrase))) for i in range(12)]
    passage = " ".join(word() for _ in range(3))
    alike = [(100 + i, f"{word()} {passage} {word()}") for i in range(3)]
    sent, exchange = [], suffix.exchange

    def spy(blocks, tell, *rest, aside=None, **more):
        count = lambda block, told: pa.table({"n": [tell(block, told).num_rows]})
        sent.append(blocks.groupBy("block").cogroup(aside.groupBy("block")).applyInArrow(count, "n long").agg({"n": "sum"}).first()[0])
        return exchange(blocks, tell, *rest, aside=aside, **more)

    monkeypatch.setattr(suffix, "exchange", spy)
    found = {}
    for name, rows in (("unlike", unlike), ("alike", alike)):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found[name] = sum(r["n_removed"] for r in suffix.digests(suffix.remove_repeats(docs, block_bytes=1000)).collect())
    assert found == {"unlike": 0, "alike": 2 * (len(passage) + 2)}
    assert sent[0] == 0 and sent[1] > 0
