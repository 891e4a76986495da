"""The queries as they are registered, over a small folder of tables, against brute force, the library or SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from corploom.llm import decontam, entries, oracles

rng = random.Random(11)
VOCABULARY = {
    "en": ["the", "house", "green", "river", "walks", "Under", "stone", "bright,", "morning", "songs."],
    "fr": ["la", "maison", "verte", "rivière", "marche", "Sous", "pierre", "matin,", "chanson", "été."],
}


def prose(lang, n):
    return " ".join(rng.choice(VOCABULARY[lang]) + (str(rng.randint(0, 400)) if rng.random() < 0.7 else "") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    base = [(prose(lang, rng.randint(30, 160)), lang) for lang in ("en", "fr") for _ in range(40)]
    item = base[3][0].split()
    near = " ".join(w if i % 9 != 4 else "other" for i, w in enumerate(item))
    rows = [*base, *base[:5], (near, "en"), (None, None), ("", "en"), (" \n\t ", None), ("one two", "fr"), ("<|endoftext|> it's (\U00010d42's  x", "en"), ("BUY now!! " * 40, "en"), ("line one is here now\n" * 9, "fr"), (prose("en", 4000), "en"), ("日本語のテキスト # $ %", None)]
    rng.shuffle(rows)
    return [(i * 3, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(rows)]


def vectors():
    """Near and far ones, chains of near ones, copies, other lengths, and all kinds that link with nothing."""
    near = lambda v, by: [x + by * rng.gauss(0, 1) for x in v]
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(v, rng.choice([1, 2])) for v in base]
    rows += [(near(v, rng.choice([0.05, 0.25, 0.4])), label) for v, label in rows for _ in range(4)]
    rows += [rows[0], rows[0], (rows[0][0], 3), ([3 * x for x in rows[1][0]], rows[1][1])]
    rows += [(None, 1), ([], 1), ([0.0] * 12, 1), (rows[0][0][:11] + [None], 1), (rows[0][0][:11] + [float("nan")], 1), (rows[0][0][:11] + [float("inf")], 1), (rows[0][0], None), (rows[0][0][:5], 1), (rows[0][0][:5], 1)]
    rng.shuffle(rows)
    return [(i * 2, v, label) for i, (v, label) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    """Tables whose further columns have the names of the operators' own."""
    from pyspark.sql import functions as F

    path = str(tmp_path_factory.mktemp("tables"))
    clash = ["score", "kept", "n_words", "passages", "block", "rows", "id", "h", "key", "found", "ids", "component", "node", "shard", "stratum", "words"]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *[F.lit("clash").alias(c) for c in clash]).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(d, int("BUY" not in (t or "BUY")), 0) for d, t, *_ in texts if d % 2] + [(texts[1][0], None, None), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, next(t for _, t, *_ in texts if t and len(t.split()) > 40)), (2, None), (3, ""), (4, "never said before at all by anyone here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int").select("*", *[F.lit("clash").alias(c) for c in ("node", "key", "n", "class", "unit", "cells", "part", "code", "low0", "component_id")]).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


def rows_of(spark, folder, name):
    return entries.QUERIES[name](spark, folder).collect()


def held(d, by, rest):
    return zlib.crc32(str(d).encode()) % by == rest


def words(t, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if lower else t or "")


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_sql(spark, folder, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = c.execute(oracles.ORACLES[name])
    columns = [x[0] for x in want.description]
    got = rows_of(spark, folder, name)
    assert sorted(columns) == sorted(got[0].asDict())
    assert sorted(tuple(r[x] for x in columns) for r in got) == sorted(want.fetchall())


def test_op1(spark, folder, texts):
    """All that an earlier text has of fifty words or more in a row goes, and nothing that none has nearly."""
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op1_substring_dedup")}
    assert set(got) == {d for d, *_ in texts}
    seen = set()
    for d, t, *_ in texts:
        w = words(t)
        repeated = {i + j for i in range(len(w) - 49) if tuple(w[i : i + 50]) in seen for j in range(50)}
        gone = {j for p in got[d]["passages"] for j in range(p["begin"], p["end"])}
        assert repeated <= gone and len(gone) == got[d]["n_removed"] and len(w) == got[d]["n_words"]
        assert all(p["source"] < d and p["similarity"] >= 0.8 and p["end"] - p["begin"] >= 50 for p in got[d]["passages"])
        if not gone:
            assert got[d]["kept_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        seen |= {tuple(w[i : i + 50]) for i in range(len(w) - 49)}
    assert any(r["passages"] for r in got.values())


def test_op2(spark, folder, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(entries.tokenizer_file("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t, *_ in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert sorted(tuple(r) for r in rows_of(spark, folder, "op2_bpe")) == sorted(want)


def test_op3(spark, folder, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op3_language_id")}
    assert set(got) == {d for d, *_ in texts} and all(r["held_out"] == held(d, 3, 1) and 0 <= r["score"] <= 1 for d, r in got.items())
    assert all((got[d]["lang_pred"] == "und") == (not any(c.isalpha() for c in t or "")) for d, t, *_ in texts)
    long = [(d, lang) for d, t, lang, *_ in texts if lang and len(words(t)) >= 20 and "BUY" not in t and "line" not in t]
    assert sum(got[d]["lang_pred"] == lang for d, lang in long) >= 0.97 * len(long)


def test_op4(spark, folder, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op4_quality")}
    assert set(got) == {d for d, *_ in texts}
    assert all(r["held_out"] == held(d, 4, 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for d, r in got.items())


def test_op6(spark, folder, texts):
    """Base by counting; the score of a text by listing every segmentation of its words."""
    from corploom.llm import lmscore

    path = entries.tokenizer_file("piece_bpe_32k.model")
    logs, _, byte, end = lmscore.piece_weights(path)
    learn = [(d, t) for d, t, *_ in texts if not held(d, 7, 2)]
    counts = Counter(w for _, t in learn for w in words(t))
    n, v = sum(counts.values()) + len(learn), len(counts) + 1

    def spelt(s):
        """Summed probability of all ways to cut s, the longest suffixes first."""
        total = [1.0]
        for j in range(1, len(s) + 1):
            total.append(sum(total[i] * math.exp(logs[s[i:j]]) for i in range(j) if s[i:j] in logs) + total[j - 1] * math.exp(byte * len(s[j - 1].encode())))
        return total[-1]

    def word(w):
        return (counts[w] + v * spelt("▁" + w)) / (n + v)

    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op6_lm_score")}
    for d, t, *_ in texts:
        w, r = words(t), got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(d, 7, 2), len(w) + 1, sum(x in counts for x in w) + 1, n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((len(learn) + 1) / (n + v + 1)), rel_tol=1e-9)
        if len(w) < 200:
            assert math.isclose(r["score"], sum(math.log10(word(x)) for x in w) + math.log10((len(learn) + v * math.exp(end)) / (n + v)), rel_tol=1e-9)


def test_op7(spark, folder, texts):
    """Every text against every item by Smith-Waterman."""
    import pyarrow as pa

    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["text"]}
    (keys, at), (item_keys, item_at) = decontam.keyed(pa.array([t for _, t, *_ in texts])), decontam.keyed(pa.array(list(items.values())))
    want = {}
    for i, item in enumerate(items):
        w = item_keys[item_at[i] : item_at[i + 1]]
        for j, (d, *_) in enumerate(texts):
            score = decontam.smith_waterman(w, keys[at[j] : at[j + 1]])[0] / len(w)
            if score >= 0.5:
                want[d, item] = score
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in rows_of(spark, folder, "op7_decontamination")}
    assert got == pytest.approx(want) and len(want) >= 1


def test_op8(spark, folder, texts):
    got = {r["doc_id"]: r for r in rows_of(spark, folder, "op8_sharding")}
    assert {r["law"] for r in got.values()} == {"bytes"} and {r["grown_shard"] for r in got.values()} == {None}
    load, home = Counter(), {}
    for d, t, *_ in texts:
        raw, r = (t or "").encode(), got[d]
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        load[r["shard"]] += r["size"]
        home.setdefault(t or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in home.values()), "equal texts stay together"
    # one text holds a third of all bytes: the other shards share the rest
    rest = sorted(load.values())
    assert set(load) == set(range(8)) and rest[-2] <= 1.35 * rest[0]
    for s in range(8):
        assert sorted(r["slot"] for r in got.values() if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got.values())))


def test_pipeline(spark, folder, texts):
    """Every stage keeps the columns, clashing ones too, and works on nulls and empty texts."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, folder)
        assert docs.dtypes == before.dtypes
        rows = docs.collect()
        assert {r["doc_id"] for r in rows} <= kept and all(r["found"] == "clash" and r["score"] == "clash" for r in rows)
        kept = {r["doc_id"] for r in rows}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == kept and all(len(r["ids"]) == r["n_tokens"] for r in out.values())
    item = next(r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r["item_id"] == 1)
    assert not {d for d, t, *_ in texts if t == item} & kept
    equal = Counter(t for _, t, *_ in texts if t and len(t.split()) >= 30)
    assert all(sum(d in kept for d, t, *_ in texts if t == x) <= 1 for x, n in equal.items() if n > 1)


@pytest.mark.parametrize("k", range(5))
def test_empty_stage(spark, folder, k):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    assert corpus_pipeline.STAGES[k][1](spark, docs, folder).count() == 0
