"""op3's backoff and op4's training and scores, as registered, against plain Python over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import regex
import xxhash

from corploom.llm import entries, quality

rng = random.Random(31)
KINDS = {"en": "the house green river walks Under stone bright, morning songs. walking greenest".split(), "fr": "la maison verte rivière marche Sous pierre matin, chanson été. marchant vertement".split(), "de": "das haus grün fluss geht Unter stein hell, morgen lieder. gehend grünlich".split()}


@pytest.fixture(scope="module")
def rows():
    out = []
    for i in range(160):
        lang = rng.choice([*KINDS, None])
        words = [rng.choice(KINDS[lang or "en"]) + (rng.choice(["", "", "s", str(rng.randint(0, 99)), "xq"])) for _ in range(rng.choice([0, 1, 3, 30, 120]))]
        text = rng.choice([" ", "\n ", "\t"]).join(words)
        if rng.random() < 0.3:
            text = " ".join(rng.choice(["BUY!!", "zz#9q" + str(rng.randint(0, 9)), "12345", "WIN"]) for _ in range(rng.randint(1, 60)))
        out.append((i * 5, rng.choice([text, text, text, text, None]) if i % 9 == 0 else text, lang))
    return [*out, (3, "... 12 !!", "en"), (4, "", None), (6, "日本 語", "de"), (11, "unseenwords everywhere quitesoone", None), (13, "strange otherwords", None), (14, "wegen xylophon", None), (16, "jamais vu", None)]


@pytest.fixture(scope="module")
def labels(rows):
    return [(d, None if d % 25 == 0 else int("BUY" not in (t or "") and "12345" not in (t or "")), 0) for d, t, _ in rows if d % 3 == 0] + [(rows[3][0], 1, 0), (rows[3][0], 0, 0), (999_999, 1, 0)]


@pytest.fixture(scope="module")
def folder(spark, rows, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    spark.createDataFrame([(d, t, lang, "s", len(t or "")) for d, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def held(d, by, rest):
    return zlib.crc32(str(d).encode()) % by == rest


def test_backoff_of_op3(spark, folder, rows):
    """Log frequencies of words, and of the n-grams of the longest order that an unseen word has any of; the mean word decides."""
    cut = lambda t: regex.findall(r"[\p{L}\p{M}]+", (t or "").lower())
    words = defaultdict(Counter)
    for d, t, lang in rows:
        if lang and t is not None and not held(d, 3, 1):
            words[lang].update(cut(t))
    languages = sorted({lang for d, t, lang in rows if lang and t is not None and not held(d, 3, 1)})
    grams = {o: defaultdict(Counter) for o in range(1, 6)}
    for lang, c in words.items():
        for w, n in c.items():
            p = f" {w} "
            for o in grams:
                for j in range(len(p) - o + 1):
                    grams[o][lang][p[j : j + o]] += n

    def logs(table, key):
        return [math.log((table[lang][key] + 0.5) / (sum(table[lang].values()) + 0.5 * (len(table[lang]) + 1))) for lang in languages]

    def word(w):
        if any(w in words[lang] for lang in languages):
            return logs(words, w)
        p = f" {w} "
        for o in range(5, 0, -1):
            hits = [g for j in range(len(p) - o + 1) if any((g := p[j : j + o]) in grams[o][lang] for lang in languages)]
            if hits:
                return [sum(x) / len(hits) for x in zip(*(logs(grams[o], g) for g in hits))]
        return [0.0] * len(languages)

    got = {r["doc_id"]: r for r in entries.QUERIES["op3_language_id"](spark, folder).collect()}
    assert len(got) == len(rows)
    backed_off = 0
    for d, t, _ in rows:
        ws = cut(t) if regex.search(r"\p{L}", t or "") else []
        assert got[d]["held_out"] == held(d, 3, 1)
        if not ws:
            assert (got[d]["lang_pred"], got[d]["score"]) == ("und", 0.0)
            continue
        total = [sum(x) for x in zip(*map(word, ws))]
        best = max(total)
        assert got[d]["lang_pred"] == languages[total.index(best)] or abs(sorted(total)[-2] - best) < 1e-3
        assert math.isclose(got[d]["score"], 1 / sum(math.exp((x - best) / math.sqrt(len(ws))) for x in total), rel_tol=1e-3)
        backed_off += any(not any(w in words[lang] for lang in languages) for w in ws)
    assert backed_off >= 3


def spread(x):
    x &= 2**64 - 1
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * by & 2**64 - 1
    return x ^ x >> 31


def test_training_of_op4(spark, folder, rows, labels):
    """Runs of one to three words, rare ones as shapes; FTRL-proximal steps over two passes; a dot product a text."""
    from pyspark.sql import functions as F

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    text = {d: t for d, t, _ in rows}
    order = {r["id"]: r["o"] for r in spark.createDataFrame([(d,) for d in text], "id long").select("id", F.xxhash64(F.lit("quality"), "id").alias("o")).collect()}
    train = sorted(((order[d], y, text[d]) for d, y, _ in labels if y is not None and d in text and not held(d, 4, 2)), key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
    seen = Counter(w for *_, t in train for w in {x.lower() for x in split(t)})
    common = {w for w, n in seen.items() if n >= max(2, 0.02 * len(train))}
    key = lambda w: xxhash.xxh3_64_intdigest(w.lower()) if w.lower() in common else xxhash.xxh3_64_intdigest(quality.shape(w), seed=1)

    def features(t):
        ks, x = [key(w) for w in split(t)], defaultdict(float)
        if not ks:
            x[spread(7) >> 64 - quality.BITS] += 1.0
        for size in (1, 2, 3):
            runs = []
            for i in range(len(ks) - size + 1):
                h = ks[i]
                for s in range(2, size + 1):
                    h = spread(h * 3 + s) + ks[i + s - 1] & 2**64 - 1
                runs.append(h)
            for h in runs:
                x[spread(h + 0x51_7CC1B7_2722_0A95 * size) >> 64 - quality.BITS] += 1.0 / len(runs)
        x["bias"] = 1.0
        return x

    z, n = defaultdict(float), defaultdict(float)
    weight = lambda j: 0.0 if abs(z[j]) <= 1e-4 else (math.copysign(1e-4, z[j]) - z[j]) / (1.0 + math.sqrt(n[j]) + 1e-3)
    for _ in range(2):
        for _, y, t in train:
            x = features(t)
            w = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-sum(w[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - y) * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) * w[j]
                n[j] += g * g
    got = {r["doc_id"]: r for r in entries.QUERIES["op4_quality"](spark, folder).collect()}
    assert len(got) == len(rows)
    for d, t in text.items():
        want = 1 / (1 + math.exp(-sum(weight(j) * v for j, v in features(t).items())))
        assert math.isclose(got[d]["score"], want, abs_tol=1e-5) and got[d]["predicted"] == (got[d]["score"] >= 0.7) and got[d]["held_out"] == held(d, 4, 2)
    good = [got[d]["score"] for d, t in text.items() if split(t) and len(split(t)) > 20 and "12345" not in t and "BUY" not in t]
    bad = [got[d]["score"] for d, t in text.items() if len(split(t)) > 20 and "12345" in t]
    assert good and bad and sum(good) / len(good) > sum(bad) / len(bad) + 0.3
