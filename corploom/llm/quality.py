"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates.

Features are runs of one to three words, hashed to 2**bits places; a feature's value is its share of the
text's runs of that length, and a score is one sparse dot product per text.  A word that fewer than
`least_share` of the labelled texts have stands in its runs as its shape (letters, digits and other
characters in their order): what a rare word is says little, that there is one of its kind says much.

Training is a sequence of updates, so it runs in one task on a bounded, hash-chosen sample of
labelled rows (max_docs), which also says which words are common: some of their mean number in a text over
least_share at most.  Scoring covers whole texts of all rows, however long, in memory of some forty times a
batch of about a megabyte or a longer text.

Null and empty texts have one feature of their own, and a score.  A label that is null or a
row whose id has no label teaches nothing; with none at all every score is 0.5.  An id that has
several labels teaches each, and so does each of several rows of one id.  Ties in the order of training fall by
label and text.  An empty table gives an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import ascii_words, free_name, mixed, one, relaxed, slices, spans, strings
from .shared import among

BITS = 18
LONGEST = 3  # words in a run
SHAPES = (("X", re.compile(r"[A-ZÀ-ÖØ-Þ]+")), ("x", re.compile(r"[a-zß-öø-ÿ]+")), ("9", re.compile(r"[0-9]+")))


@dataclass
class Model:
    """Sorted keys of the common words, and weights of hashed places, the bias after them."""

    common: np.ndarray
    weights: np.ndarray


def shape(word: str) -> str:
    for mark, runs in SHAPES:
        word = runs.sub(mark, word)
    return word[:1] if len(set(word)) == 1 else word


def word_key(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.lower())


def common_words(texts: pa.Array, least_share: float, slice_docs: int = 200) -> np.ndarray:
    """Sorted keys of words that at least this share of texts have, and two of them; a slice of texts at a time."""
    each = [np.empty(0, np.uint64)]
    for a in range(0, len(texts), slice_docs):
        words, at = ascii_words(strings(texts.slice(a, slice_docs)), lower=False)
        coded = one(words.dictionary_encode())
        keys = np.fromiter(map(word_key, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        keys, code = np.unique(keys, return_inverse=True)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        once = np.unique(doc * np.int64(len(keys) + 1) + code[coded.indices.to_numpy()])
        each.append(keys[once % (len(keys) + 1)])
    keys, counts = np.unique(np.concatenate(each), return_counts=True)
    return keys[counts >= max(2, least_share * len(texts))]


def features(texts: pa.Array, common: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed places, their values, and offsets per text."""
    words, at = ascii_words(strings(texts), lower=False)
    coded = one(words.dictionary_encode())
    known = coded.dictionary.to_pylist()
    key = np.fromiter(map(word_key, known), np.uint64, len(known))
    for i in np.flatnonzero(~among(key, common)).tolist():
        key[i] = xxhash.xxh3_64_intdigest(shape(known[i]), seed=1)
    word = key[coded.indices.to_numpy()]
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    families, run = [], word
    with np.errstate(over="ignore"):
        for size in range(1, LONGEST + 1):
            if size > 1:
                run = mixed(run[:-1] * np.uint64(3) + np.uint64(size)) + word[size - 1 :]
            inside = doc[size - 1 :] == doc[: max(0, len(doc) - size + 1)]
            families.append((mixed(run[inside] + np.uint64(0x51_7CC1B7_2722_0A95 * size & (2**64 - 1))), doc[size - 1 :][inside]))
    empty = np.flatnonzero(n == 0)
    families.append((mixed(np.full(len(empty), 7, np.uint64)), empty))
    keys, docs = (np.concatenate(c) for c in zip(*families, strict=True))
    sizes = [np.bincount(d, minlength=len(n)) for _, d in families]
    values = np.concatenate([1.0 / s[d] for s, (_, d) in zip(sizes, families, strict=True)])
    order = np.argsort(docs, kind="stable")
    return (keys >> np.uint64(64 - bits)).astype(np.int32)[order], values[order], spans(sum(sizes))


def learn(texts: pa.Array, labels: np.ndarray, common: np.ndarray, bits: int = BITS, epochs: int = 2, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3, slice_docs: int = 200) -> np.ndarray:
    """Weights after FTRL-proximal passes in the given order; the last one is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for a in range(0, len(labels), slice_docs):
            places, values, at = features(texts.slice(a, slice_docs), common, bits)
            for i, y in enumerate(labels[a : a + slice_docs].tolist()):
                j, back = np.unique(places[at[i] : at[i + 1]], return_inverse=True)
                x = np.append(np.bincount(back, values[at[i] : at[i + 1]], len(j)), 1.0)
                j = np.append(j, size - 1)
                zj, nj = z[j], n[j]
                w = np.where(np.abs(zj) <= l1, 0.0, (np.sign(zj) * l1 - zj) / ((beta + np.sqrt(nj)) / alpha + l2))
                p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
                g = (p - y) * x
                z[j] += g - (np.sqrt(nj + g * g) - np.sqrt(nj)) / alpha * w
                n[j] += g * g
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = 12_000, least_share: float = 0.02) -> Model:
    """What the rows of docs that labels marks teach."""
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y is not null"), "id")
    known = labels.where(F.col(label_col).isNotNull()).count()
    order = F.xxhash64(F.lit("quality"), F.col("id"))
    chance = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    # the filter stands on the id, so it is met below the join; the limit makes the bound exact
    sample = marked.where(chance < min(1.0, 1.1 * max_docs / max(known, 1))).select("text", "y", order.alias("o")).orderBy("o", "y", "text").limit(max_docs)

    def train(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("o", "ascending"), ("y", "ascending"), ("text", "ascending")])
        common = common_words(one(rows["text"]), least_share)
        w = learn(one(rows["text"]), rows["y"].to_numpy().astype(float), common)
        return relaxed(pa.table({"w": pa.array([w.tobytes()], pa.binary()), "common": pa.array([common.tobytes()], pa.binary())}))

    got = sample.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(train, "w binary, common binary").collect()
    if not got:
        return Model(np.empty(0, np.uint64), np.zeros((1 << BITS) + 1, np.float32))
    return Model(np.frombuffer(got[0]["common"], np.uint64), np.frombuffer(got[0]["w"], np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """Rows (id, score): the likelihood of label 1.

    With keep, all columns of docs and the score after them, as `score` or with underscores where
    that name is taken.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs if keep else docs.select(F.col(id_col), F.col(text_col))
    names = [*docs.columns, free_name(docs.columns, "score")]
    schema = StructType([*docs.schema.fields, StructField(names[-1], DoubleType())])
    text_at = docs.columns.index(text_col)

    def run(batches):
        w, common = shared.value.weights.astype(np.float64), shared.value.common
        for batch in slices(batches):
            places, values, at = features(batch.column(text_at), common)
            summed = np.concatenate([[0.0], np.cumsum(w[places] * values)])
            dots = summed[at[1:]] - summed[at[:-1]] + w[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(dots, -500, 500))))], names)

    out = docs.mapInArrow(run, schema)
    return out if keep else out.select(F.col(id_col), F.col(names[-1]).alias("score"))
