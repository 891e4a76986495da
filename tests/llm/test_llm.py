"""Each operator against brute force, with nulls, empty and long texts, ties, repeated rows and no rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from corploom.llm import bpe, components, decontam, jaccard, langid, lmscore, quality, rules, sharding, substring, suffix
from corploom.llm.entries import tokenizer_file

random.seed(5)
WORDS = ["alpha", "beta", "Gamma", "delta,", "ñandú", "là", "zeta.", "eta", "theta", "日本語", "x1", "$$"]


def prose(n):
    return " ".join(random.choice(WORDS) + str(random.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = [prose(random.randint(5, 200)) for _ in range(40)]
    passage = prose(70)
    texts = [None, "", " \n\t", "one", "one two", *base, *base[:6], base[7], base[7]]
    texts += [t + " tail" for t in base[:4]] + [prose(30) + " " + passage + " " + prose(20) for _ in range(4)] + ["<|endoftext|> a  b", prose(6000)]
    random.shuffle(texts)
    out = [(i, t, "x", random.choice(["en", "fr", None])) for i, t in enumerate(texts)]
    return [*out, (None, base[0], "x", "en"), (3, texts[3], "x", "en")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, block string, lang string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((str(r["doc_id"]), r["ids"], r["decoded"]) for r in bpe.decode(bpe.encode(docs, path, block_bytes=20_000), path).collect())
    want = sorted((str(i), tok.encode(t or "", add_special_tokens=False).ids, t or "") for i, t, *_ in rows)
    assert got == want
    assert bpe.encode(empty, path).count() == 0


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("k,num,limit", [(3, 90, 20_000), (5, 80, 2)])
def test_jaccard(docs, rows, empty, k, num, limit):
    sets = {i: {tuple(w[j : j + min(k, len(w))]) for j in range(len(w) - min(k, len(w)) + 1)} for i, t, *_ in rows if i is not None for w in [words(t)]}
    sets = {i: s - {()} for i, s in sets.items()}
    parent = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if a < b and n and 100 * n >= num * len(sets[a] | sets[b]) and parent[a] != parent[b]:
                    parent[a] = parent[b] = min(parent[a], parent[b])
                    changed = True
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.groups(docs, k, num, 100, max_region=limit, block_bytes=20_000).collect() if r["doc_id"] is not None}
    assert got == {i: (len(sets[i]), parent[i]) for i in sets}
    assert jaccard.groups(empty).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 9)], "u long, v long")
    assert {r["node"]: r["component"] for r in components.components(edges).collect()} == {3: 1, 4: 1, 5: 1, 9: 8}


def test_blind_trie():
    for _ in range(100):
        items = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 6))) for _ in range(random.randint(1, 20))]
        order, prefix = suffix.blind_trie(items)
        assert [items[i] for i in order] == sorted(items)
        assert all(prefix[k] == suffix.common_prefix(items[order[k - 1]], items[order[k]]) for k in range(1, len(order)))


def test_suffix(docs, rows, empty):
    first = {}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        for j in range(len(raw) - 49):
            w = raw[j : j + 50]
            if i is not None:
                first[w] = min(first.get(w, i), i)
    want = []
    for i, t, *_ in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - 49):
            if i is not None and first[raw[j : j + 50]] < i:
                gone[j : j + 50] = [True] * 50
        want.append((str(i), len(raw), sum(gone), sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()))
    got = sorted((str(r["doc_id"]), *r[1:]) for r in suffix.digests(suffix.remove_repeats(docs, block_bytes=20_000)).collect())
    assert got == sorted(want)
    assert suffix.remove_repeats(empty).count() == 0


def test_substring(docs, rows, empty):
    got = [r for r in substring.find(docs, block_bytes=20_000).collect() if r["doc_id"] is not None]
    seen = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(t)
        runs = {tuple(w[j : j + 60]) for j in range(len(w) - 59)}
        r = next(r for r in got if r["doc_id"] == i)
        repeated = any(seen.get(x, i) < i for x in runs)
        assert bool(r["passages"]) >= repeated
        assert all(p["source"] < i and p["similarity"] >= 0.8 for p in r["passages"])
        if not r["passages"]:
            assert r["kept"] == t
        for x in runs:
            seen.setdefault(x, i)
    assert substring.find(empty).count() == 0


def fresh(n):
    return [f"w{random.randint(0, 10**9)}" for _ in range(n)]


def covered(spark, texts, **options):
    """The word places that substring.find takes out of each text, by id."""
    found = substring.find(spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string"), **options)
    return {r["doc_id"]: {j for p in r["passages"] for j in range(p["begin"], p["end"])} for r in found.collect()}


def test_chains_of_separate_passages():
    """Each of several passages that a pair shares is a chain, as brute force has it."""
    import numpy as np

    for gap in (40, 100, 400):
        a, b, c = fresh(60), fresh(60), fresh(60)
        one, two = a + fresh(gap) + b + fresh(gap) + c, fresh(7) + a + fresh(gap) + b + fresh(gap) + c
        x, y = np.array([(i, j) for i in range(len(one) - 4) for j in range(len(two) - 4) if one[i : i + 5] == two[j : j + 5]]).T
        got = {i for x0, x1, *_ in substring.chains(x, y, 5) if x1 - x0 >= 24 for i in range(x0, x1)}
        assert got == {i for i, w in enumerate(one) if w in two}


def test_separate_passages(spark):
    a, b = fresh(60), fresh(60)
    got = covered(spark, [(1, a + fresh(100) + b), (2, a + fresh(100) + b)])
    assert set(range(60)) | set(range(160, 220)) <= got[2] and not got[1]


def test_more_copies_than_the_owner(spark):
    a, b = fresh(60), fresh(30)
    texts = [(1, a + fresh(90)), (2, fresh(9) + a + fresh(80) + a + fresh(70) + a), (3, b * 5 + fresh(50)), (4, b * 12), (5, ["word"] * 90 + fresh(40)), (6, fresh(40) + ["word"] * 300)]
    got = covered(spark, texts)
    assert {j for j, w in enumerate(texts[1][1]) if w in a} <= got[2]
    assert got[4] == set(range(360)) and set(range(40, 340)) <= got[6] and not got[1] | got[3] | got[5]


def test_edited_passages(spark):
    """Passages edited down to a similarity of 0.8 to 0.9 are found."""
    texts, places = [], {}
    for n in (60, 100):
        for every in (6, 7, 8, 10):
            for _ in range(5):
                a, at = fresh(n), random.randint(10, 40)
                texts += [(len(texts), fresh(40) + a + fresh(40)), (len(texts) + 1, fresh(at) + [w if j % every != every - 1 else "edited" for j, w in enumerate(a)] + fresh(40))]
                places[len(texts) - 1] = set(range(at, at + n - n % every))
    got = covered(spark, texts)
    assert sum(len(places[d] & got[d]) >= 0.9 * len(places[d]) for d in places) == len(places)


def test_chance_holders(spark):
    """A repeat is found though earlier documents hold each of its 5-word runs."""
    passage, other = fresh(120), fresh(120)
    texts = [(i, fresh(30) + passage[12 * i : 12 * i + 18] + fresh(20) + other[12 * i : 12 * i + 18] + fresh(30)) for i in range(10)]
    changed = [w if j % 30 else "edited" for j, w in enumerate(other)]
    texts += [(500, fresh(30) + passage + fresh(30) + other), (900, fresh(50) + passage + fresh(60) + changed)]
    got = covered(spark, texts)
    assert set(range(50, 170)) <= got[900] and not got[500] and len(got[900] & set(range(230, 350))) >= 110


def test_decontamination(spark, docs, empty):
    item = prose(30)
    edited = item.split()
    edited[7], edited[20] = "changed", "words"
    more = spark.createDataFrame([(1000, prose(50) + " " + item, "x", "en"), (1001, " ".join(edited) + " " + prose(50), "x", "en")], docs.schema)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, prose(25))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.find(docs.unionAll(more), items).collect()}
    assert set(got) == {(1000, 1), (1001, 1)} and got[1000, 1] == 1.0 and 0.8 < got[1001, 1] < 1
    assert decontam.find(empty, items).count() == 0 and decontam.find(docs, items.where("false")).count() == 0


def test_edited_copies(spark):
    """Copies that keep a few n-grams are found, whether exact copies are there or not."""
    words = lambda n: [f"w{random.randint(0, 3000)}" for _ in range(n)]
    passages, texts, want = [words(40) for _ in range(6)], [], set()
    for i, w in enumerate(passages):
        edited = ["edited" if p % 5 == 3 else x for p, x in enumerate(w)]
        for copy in [edited] + [w] * (i % 3):
            want.add((len(texts), i))
            texts.append((len(texts), " ".join(words(60) + copy + words(60))))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(passages)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, items).collect()} == want


def test_frequent_edited_copies(spark):
    """Edited copies are found however many there are of them beside one exact copy."""
    item = fresh(48)
    copy = " ".join("edited" if j % 6 == 5 else w for j, w in enumerate(item))
    docs = spark.createDataFrame([(0, " ".join(item)), *[(i, copy) for i in range(1, 101)], (101, " ".join(fresh(80)))], "doc_id long, text string")
    got = {r["doc_id"] for r in decontam.find(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == set(range(101))


def test_dense_edits(spark):
    """What Smith-Waterman gives the share is found, as aligning every text with every item has it."""
    import pyarrow as pa

    items = [fresh(n) for n in (5, 12, 30, 48)]
    texts = [fresh(20) + [w if j % every != every - 1 else "edited" for j, w in enumerate(t)] + fresh(20) for t in items for every in (2, 3, 4, 5)]
    texts += [fresh(9) + [v for w in t for v in [w] + ["more"] * extra] + fresh(9) for t in items for extra in (1, 2)]
    texts += [[w for j, w in enumerate(t) if j % every] + fresh(30) for t in items for every in (2, 3, 4)]
    texts += [[w if random.random() > rate else random.choice(["x", "x y", ""]) for w in t] for t in items for rate in (0.2, 0.3, 0.4) for _ in range(5)]
    texts, queries = [" ".join(t) for t in texts], [" ".join(t) for t in items]
    (keys, at), (item_keys, item_at) = decontam.keyed(pa.array(texts)), decontam.keyed(pa.array(queries))
    score = lambda i, d: decontam.smith_waterman(item_keys[item_at[i] : item_at[i + 1]], keys[at[d] : at[d + 1]])[0] / len(items[i])
    want = {(d, i) for d in range(len(texts)) for i in range(len(items)) if score(i, d) >= 0.5}
    found = decontam.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(queries)), "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want


def test_leak_without_id(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(fresh(40))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(None, "some " + item), (None, " ".join(fresh(40))), (None, None), (1, item), (1, " ".join(fresh(40))), (2, "")]
    got = corpus_pipeline.decontaminated(spark, spark.createDataFrame(texts, "doc_id long, text string"), str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {texts[i] for i in (1, 2, 4, 5)}


def test_smith_waterman():
    import numpy as np

    for _ in range(50):
        a, b = np.array([random.randint(0, 3) for _ in range(6)], np.uint64), np.array([random.randint(0, 3) for _ in range(9)], np.uint64)
        h = [[0.0] * 10 for _ in range(7)]
        for i in range(6):
            for j in range(9):
                h[i + 1][j + 1] = max(0, h[i][j] + (1 if a[i] == b[j] else -0.5), h[i][j + 1] - 0.5, h[i + 1][j] - 0.5)
        assert math.isclose(decontam.smith_waterman(a, b)[0], max(map(max, h)))


def test_language(spark, docs, empty):
    train = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 20)] + [(99, None, "en"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    test = spark.createDataFrame([(1, "the dogs"), (2, "les chiens"), (3, None), (4, "12 ?"), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(test, model).collect()}
    assert [got[i][0] for i in range(1, 6)] == ["en", "fr", "und", "und", "und"] and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_quality(spark, docs, empty):
    good, bad = [prose(40) for _ in range(30)], ["BUY!! NOW!! " * 20 + prose(3) for _ in range(30)]
    train = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(5, None)], "doc_id long, quality int")
    w = quality.fit(train, labels)
    s = {r["doc_id"]: r["score"] for r in quality.score(train, w).collect()}
    assert min(s[i] for i in range(30)) > max(s[i] for i in range(30, 60))
    assert quality.score(docs, w).count() == docs.count()
    assert {r["score"] for r in quality.score(docs, quality.fit(empty, labels)).collect()} == {0.5}


def test_lm(docs, rows, empty):
    from pyspark.sql import functions as F

    path = tokenizer_file("piece_bpe_32k.model")
    logs, _, byte, _ = lmscore.piece_weights(path)

    def total(s):
        return 1.0 if not s else sum(math.exp(logs[s[:i]]) * total(s[i:]) for i in range(1, len(s) + 1) if s[:i] in logs) + math.exp(byte * len(s[0].encode())) * total(s[1:])

    for w in ("cat", "日x", "ñandú"):
        assert math.isclose(lmscore.word_log_probability(w, path), math.log(total("▁" + w)), rel_tol=1e-9)
    learn = [r for r in rows if r[0] is not None and r[0] % 2]
    counts = {}
    for r in learn:
        for w in words(r[1]):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()) + len(learn), len(counts) + 1
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in lmscore.score(docs, path, F.col("doc_id") % 2 == 1, block_bytes=20_000).collect())
    base = lambda t: sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words(t)) + math.log10((len(learn) + 1) / (n + v + 1))
    assert got == sorted((str(i), len(words(t)) + 1, sum(w in counts for w in words(t)) + 1, n, round(base(t), 6)) for i, t, *_ in rows)
    assert lmscore.score(empty, path, F.lit(True)).count() == 0


def test_sharding(spark, docs, empty):
    hot = spark.createDataFrame([(10_000 + i, "the same hot text " * 5, "x", "en") for i in range(400)], docs.schema)
    got = sharding.shard(docs.unionAll(hot), 8, ranges_per_shard=8).collect()
    for s in range(8):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len(got) == docs.count() + 400 and sharding.shard(empty).count() == 0


def test_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i is not None] + [(1, None)], "doc_id long, quality int")
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rules.apply(docs, labels).collect())
    want = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[j : j + 8]) for j in range(len(w) - 7)]
        times = Counter(win)
        hit = {p for j, x in enumerate(win) if times[x] > 1 for p in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((str(i), len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)))
    assert got == sorted(want)
    assert rules.apply(empty, labels).count() == 0


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(40, 3)], "n long, k long").select(rules.log_binomial_tail(F.col("n"), F.col("k"), 0.1)).first()[0]
    assert math.isclose(math.exp(row), sum(math.comb(40, i) * 0.1**i * 0.9 ** (40 - i) for i in range(4)))
