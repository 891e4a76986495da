"""Language identification by words first, then by shorter and shorter character n-grams.

A known word counts with its log frequency in each language.  An unseen word counts with
the mean log frequency of its known n-grams of the longest order of which it has any.

The model is fitted on a bounded, hash-chosen sample of labelled rows (max_docs for each
language) and keeps every word and n-gram of it; its size hangs on that bound and the number of languages
alone, so it may be broadcast.  Counting runs in Spark; scoring covers whole texts.

Very long texts are cut by Spark and scored as one row of words each, in memory of some tens of times their size.
Null texts and texts without a letter are `und` with score 0; ties go to the language first in
the alphabet; an empty table gives an empty result; without labelled rows all is `und`.  Repeated rows and
ids teach, and are scored, each.  Columns other than those that are named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, one, slices

ORDERS = (5, 4, 3, 2, 1)


def keys_of(words: list[str]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


@dataclass
class LanguageModel:
    """Sorted keys of words and of n-grams of all orders, each with a row of log frequencies by language."""

    languages: list[str]
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)), np.float32)
        at, known = found(self.words, keys_of(words))
        out[known] = self.word_scores[at[known]]
        for i in np.flatnonzero(~known).tolist():
            padded = f" {words[i]} "
            for order in ORDERS:
                at, hit = found(self.grams, keys_of([padded[j : j + order] for j in range(len(padded) - order + 1)]))
                if hit.any():
                    out[i] = self.gram_scores[at[hit]].mean(0)
                    break
        return out


def found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 1_500) -> LanguageModel:
    """Learn from labelled; rows without language or text teach nothing."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = np.zeros(0, np.uint64)
    if not sizes:
        return LanguageModel([], none, np.zeros((0, 0), np.float32), none, np.zeros((0, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, max_docs / n))])
    chance = F.pmod(F.xxhash64(F.lit("langid"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    counts = rows.where(chance < share[F.col("lang")]).select("lang", F.explode(words_of(F.col("text"))).alias("gram")).groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("n"))
    padded = F.concat(F.lit(" "), F.col("gram"), F.lit(" "))

    def pieces(order: int) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.length(padded) - (order - 1)), lambda i: F.substring(padded, i, F.lit(order)))
        return F.when(F.length(padded) >= order, made).otherwise(F.array().cast("array<string>"))

    grams = counts.select("lang", "n", F.explode(F.flatten(F.array(*[pieces(o) for o in ORDERS]))).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    both = counts.withColumn("level", F.lit(0)).unionByName(grams.withColumn("level", F.length("gram"))).toArrow()
    languages = sorted(sizes)
    tables = []
    lang = np.searchsorted(languages, one(both["lang"]).to_numpy(zero_copy_only=False).astype(str))
    level, n = both["level"].to_numpy(), both["n"].to_numpy().astype(np.float64)
    for part in (level == 0, level > 0):
        keys = keys_of(one(both["gram"]).filter(pa.array(part)).to_pylist())
        known, at = np.unique(keys, return_inverse=True)
        scores, of = np.zeros((len(known), len(languages))), np.zeros(len(known), np.int64)
        of[at] = level[part]
        for k in np.unique(level[part]).tolist():
            here = np.flatnonzero(of == k)
            rows_of = np.flatnonzero(level[part] == k)
            for j in range(len(languages)):
                mine = rows_of[lang[part][rows_of] == j]
                below = n[part][mine].sum() + 0.5 * (len(mine) + 1)
                scores[here, j] = np.log(0.5 / below)
                scores[at[mine], j] = np.log((n[part][mine] + 0.5) / below)
        tables += [known, scores.astype(np.float32)]
    return LanguageModel(languages, *tables)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, lang_pred, score): score is the share of the winning language's likelihood, the mean word deciding."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            words, at = flat(batch.column("words"))
            n = np.diff(at)
            coded = one(words.dictionary_encode())
            best, share = np.zeros(len(n), np.int64), np.zeros(len(n))
            if m.languages and len(words):
                each = m.scores(coded.dictionary.to_pylist())
                doc = np.repeat(np.arange(len(n)), n)
                rows = each[coded.indices.to_numpy()]
                total = np.stack([np.bincount(doc, rows[:, j], len(n)) for j in range(len(m.languages))], 1)
                best = total.argmax(1)
                # words of a text depend on each other: their evidence grows as a root
                scaled = (total - total.max(1, keepdims=True)) / np.sqrt(np.maximum(n, 1))[:, None]
                share = 1 / np.exp(scaled).sum(1)
            none = (n == 0) | (not m.languages)
            names = [("und" if x else m.languages[b]) for x, b in zip(none.tolist(), best.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names, pa.string()), pa.array(np.where(none, 0.0, share))], ["id", "lang_pred", "score"])

    lettered = F.col(text_col).rlike(r"\p{L}")
    cut = docs.select(F.col(id_col).alias("id"), F.when(lettered, words_of(F.col(text_col))).alias("words"))
    return cut.mapInArrow(run, f"id {id_type}, lang_pred string, score double").withColumnRenamed("id", id_col)
