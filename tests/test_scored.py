"""The queries that need codecs, which SQL has not, against plain Python over a small folder of tables."""

import gzip
import hashlib
import math
import random

import pyarrow as pa
import pytest

from corploom.operators import mixtures
from corploom.plans import catalog

draw = random.Random(6)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scored"))
    words = [f"word{i}" for i in range(60)] + ["é", "日本", "ß"]
    text = lambda n, k: " ".join(draw.choice(words[:k]) for _ in range(n))
    docs = [(i, text(draw.choice([60, 150, 400, 1500]), draw.choice([3, 10, 60])), draw.choice(["a", "b", None])) for i in range(30)]
    docs += [(100, docs[3][1].upper() + "  ", "a"), (101, "too short", "b"), (102, None, "a"), (103, "日" * 3000, "b")]
    items = [(i, text(120, 40)) for i in range(70)] + [(-5, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items


def prefix(t, n):
    return t.encode()[:n].decode("utf-8", "ignore")


def lz4(raw):
    return (len(pa.compress(raw, codec="lz4", asbytes=True)) + 8) / len(raw)


def size(raw):
    return len(gzip.compress(raw, compresslevel=6, mtime=0))


def expected(docs, items):
    """What scoring gives: doc_id to (domain, cr, best, mean, bucket)."""
    views = [t.encode()[:1024] for _, t in sorted((i, t) for i, t in items if t is not None)[:64]]
    seen, out = set(), {}
    for d, t, source in sorted(docs, key=lambda r: r[0]):
        if t is None or len(t.encode()) < 512:
            continue
        identity = hashlib.sha256(" ".join(t.casefold().split()).encode()).hexdigest()
        if identity in seen:
            continue
        seen.add(identity)
        raw = prefix(t, 1024).encode()
        own = size(raw)
        found = [1 - (size(raw + v) - min(own, size(v))) / max(own, size(v)) for v in views]
        cr = lz4(prefix(t, 8192).encode())
        out[d] = (source, cr, max(found), sum(found) / len(found), sum(cr >= e for e in mixtures.FIXED_EDGES))
    return out


def test_profile(spark, tables):
    path, docs, _ = tables
    got = {r["doc_id"]: (r["bytes"], r["cr"]) for r in catalog.queries()["compression_profile"](spark, path).collect()}
    assert got == {d: (len(t.encode()), lz4(t.encode())) for d, t, _ in docs if t and len(t.encode()) >= 512}


def test_alignment(spark, tables):
    path, docs, items = tables
    got = {r["doc_id"]: (r["domain"], r["cr"], r["score"], r["mean_score"], r["bucket"]) for r in catalog.queries()["ncd_alignment"](spark, path).collect()}
    want = expected(docs, items)
    assert set(got) == set(want)
    assert all(got[d][0] == w[0] and got[d][4] == w[4] and got[d][1:4] == pytest.approx(w[1:4]) for d, w in want.items())


def test_report(spark, tables):
    """The flagship: prior and population mass of each bucket."""
    path, docs, items = tables
    rows = expected(docs, items).values()
    mass = {b: sum(max(r[2], 0) for r in rows if r[4] == b) + mixtures.TAU for b in {r[4] for r in rows}}
    got = {r["bucket"]: r for r in catalog.queries()["bucket_prior_report"](spark, path).collect()}
    assert set(got) == set(mass)
    for b, m in mass.items():
        mine = [r for r in rows if r[4] == b]
        assert got[b]["docs"] == len(mine) and math.isclose(got[b]["prior_mass"], m / sum(mass.values())) and math.isclose(got[b]["population_mass"], len(mine) / len(rows))
        assert math.isclose(got[b]["mean_cr"], sum(r[1] for r in mine) / len(mine)) and math.isclose(got[b]["tv_part"], abs(m / sum(mass.values()) - len(mine) / len(rows)) / 2)


def test_heatmap(spark, tables):
    path, docs, items = tables
    rows = expected(docs, items).values()
    got = {(r["domain"], r["bucket"]): (r["n"], r["mass"]) for r in catalog.queries()["aligned_heatmap"](spark, path).collect()}
    want = {k: (sum((r[0], r[4]) == k for r in rows), sum(max(r[2], 0) for r in rows if (r[0], r[4]) == k)) for k in {(r[0], r[4]) for r in rows}}
    assert set(got) == set(want) and all(got[k] == pytest.approx(w) for k, w in want.items())


def test_correlation(spark, tables):
    path, docs, _ = tables
    raws = [t.encode() for _, t, _ in docs if t and len(t.encode()) >= 512]

    def ranks(values):
        ordered = sorted(values)
        return [ordered.index(v) + (ordered.count(v) + 1) / 2 for v in values]

    a, b = ranks([lz4(r) for r in raws]), ranks([size(r) / len(r) for r in raws])
    mean = sum(a) / len(a)
    cov = sum((x - mean) * (y - mean) for x, y in zip(a, b, strict=True))
    rho = cov / math.sqrt(sum((x - mean) ** 2 for x in a) * sum((y - mean) ** 2 for y in b))
    row = catalog.queries()["codec_correlation"](spark, path).first()
    assert row["n"] == len(raws) and math.isclose(row["rho"], rho, rel_tol=1e-9)
