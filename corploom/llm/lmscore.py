"""Language-model scores: the probability of a text over all segmentations into pieces.

The vocabulary is a given one.  A piece's probability falls with the rank that its score in
the vocabulary stands for (p ~ 1 / (rank + 1), made to sum to one with the end of text); the
forward recursion sums, in log space, over every segmentation.  Pieces do not cross words, so
a text's probability is the product of its words' and its end's, and each distinct word needs
one recursion.  A word that the corpus taught is one more edge over the whole word: with c of
N training tokens and V kinds it weighs c / (N + V), the pieces' segmentations V / (N + V).
Corpus counts of words give the base score beside it.

Very long texts lie in one block each, in memory of some tens of times their size; a very long word takes time of its length times that of the longest piece.
Words are A-Z lowered runs between ASCII white space.  Null and empty texts have the end
alone.  A character that no piece holds is spelt by its bytes.  Repeated rows count each.  An
empty table gives an empty one; with nothing to learn from, pieces alone score.  Columns other
than id and text matter only as far as learned_from reads them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, arrow_type, ascii_words, block_count, dealt, one, opened, relaxed, stored, strings
from .shared import FAN, answers_of, exchange, merging_words, word_items


@lru_cache(2)
def piece_weights(path: str) -> tuple[dict[str, float], frozenset[str], float, float]:
    """Log probability of each piece, all prefixes of pieces, and that of a byte and of the end."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)) and sp.get_score(i) > -1e8}
    kept = {p: r for p, r in kept.items() if "▁" not in p[1:]}
    last = max(kept.values(), default=0.0) + 1
    total = sum(1 / (r + 1) for r in kept.values()) + 256 / (last + 1) + 1.0
    logs = {p: -math.log(r + 1) - math.log(total) for p, r in kept.items()}
    prefixes = frozenset(p[:i] for p in logs for i in range(1, len(p) + 1))
    return logs, prefixes, -math.log(last + 1) - math.log(total), -math.log(total)


def word_log_probability(word: str, path: str) -> float:
    """Natural log of the sum over all segmentations of one word."""
    logs, prefixes, byte, _ = piece_weights(path)
    text = "▁" + word
    n = len(text)
    into: list[list[float]] = [[] for _ in range(n + 1)]
    into[0].append(0.0)
    log, exp = math.log, math.exp
    for i in range(n):
        terms = into[i]
        most = max(terms)
        here = most if len(terms) == 1 else most + log(sum([exp(t - most) for t in terms]))
        j = i + 1
        while j <= n and (piece := text[i:j]) in prefixes:
            if (p := logs.get(piece)) is not None:
                into[j].append(here + p)
            j += 1
        into[i + 1].append(here + byte * len(text[i].encode("utf-8", "surrogatepass")))
        into[i] = terms[:0]
    terms = into[n]
    most = max(terms)
    return most + log(sum([exp(t - most) for t in terms]))


def score(docs: DataFrame, vocabulary: str, learned_from: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score).

    learned_from marks the rows of docs whose words are counted.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learned_from, F.lit(False)).alias("learn"))
    n = block_count(docs, "text", block_bytes)
    buckets = max(1, n // 3)
    id_type = docs.schema["id"].dataType.simpleString()
    types = {"id": arrow_type(docs.schema["id"].dataType), "text": pa.large_string(), "learn": pa.bool_()}
    blocks = dealt(docs, n, F.xxhash64("id", "text"))
    ends = docs.where("learn").count()

    def coded(block: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray, np.ndarray]:
        """The rows, their distinct words, the word at each place, and offsets per row."""
        rows = opened(block, types)
        words, at = ascii_words(strings(rows["text"]))
        every = one(words.cast(pa.large_binary()).dictionary_encode())
        return rows, every.dictionary, every.indices.to_numpy(), at

    def tell(block: pa.Table) -> pa.Table:
        rows, known, codes, at = coded(block)
        learn = np.repeat(one(rows["learn"]).to_numpy(zero_copy_only=False), np.diff(at))
        counts = np.bincount(codes[learn], minlength=len(known))
        return word_items(known, buckets, counts)[0]

    def solve(items: pa.Table) -> tuple[pa.Table, list[int]]:
        """Counts and log probabilities; of the bucket, how many kinds and tokens were learned from."""
        counts = items["n"].to_numpy()
        logs = [word_log_probability(w.decode(), vocabulary) for w in items["word"].to_pylist()]
        return pa.table({"n": pa.array(counts), "log": pa.array(logs, pa.float64())}), [int((counts > 0).sum()), int(counts.sum())]

    def join_back(block: pa.Table, told: pa.Table) -> pa.Table:
        rows, known, codes, at = coded(block)
        _, place = word_items(known, buckets)
        answers = answers_of(told, len(known))
        size = len(at) - 1
        doc = np.repeat(np.arange(size), np.diff(at))
        if len(codes):
            counts, logs = answers["n"].to_numpy(), answers["log"].to_numpy()
            logs = np.logaddexp(np.log(counts, where=counts > 0, out=np.full(len(counts), -np.inf)), math.log(max(kinds, 1)) + logs)[place[codes]]
            counts = counts[place[codes]]
        else:
            counts, logs = np.zeros(0), np.zeros(0)
        return relaxed(pa.table({
            "id": rows["id"], "n_words": pa.array(np.diff(at)), "known": pa.array(np.bincount(doc, counts > 0, size).astype(np.int64)),
            "logs": pa.array(np.bincount(doc, np.log10(counts + 1.0), size).astype(np.float64)), "model": pa.array(np.bincount(doc, logs, size).astype(np.float64)),
        }))

    told = stored(exchange(blocks, tell, merging_words(buckets), solve, n, buckets, fan=fan))
    sums = told.agg(*[F.sum(F.get("notes", F.lit(i))).alias(c) for i, c in enumerate(("kinds", "tokens"))]).first()
    tokens, kinds = (sums["tokens"] or 0) + ends, (sums["kinds"] or 0) + (ends > 0)
    joined = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(join_back, f"id {id_type}, n_words long, known long, logs double, model double")
    end = math.log(ends + max(kinds, 1) * math.exp(piece_weights(vocabulary)[3]))
    return joined.select(
        F.col("id").alias(id_col),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) - (F.col("n_words") + 1) * math.log10(tokens + kinds + 1)).alias("base_score"),
        ((F.col("model") + end - (F.col("n_words") + 1) * math.log(tokens + max(kinds, 1))) / math.log(10)).alias("score"),
    )
