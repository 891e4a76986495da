"""Benchmark decontamination: a lossless filter of word pairs, then Smith-Waterman alignment.

The pairs of an item are its neighbouring words; a text has a pair where the words are one or two
apart.  Each pair that an alignment breaks costs it 0.75 at least (a change breaks two for 1.5, two
insertions one for 1), so a score of `share` leaves L - 1 - (1 - share) L / 0.75 of them, within
the words that the alignment may span.  Texts with as many, however frequent, are aligned there,
unless too few of the item's words are there; the score over the item's length is its share.

Items are taken in groups of bounded size (items_bytes), each broadcast, so that a large
benchmark costs more passes, not more memory.  Items with fewer than n words are searched as one n-gram of
their own length; items without words, and null items, match nothing.  Null and empty texts
have no passage; repeated rows are found each, with their own id; of equal scores in one text the first counts.
A very long text takes memory of some tens of times its size in one task, and is aligned only where its pairs lie close.
An empty table, of texts or of items, gives an empty one; columns other than those that are named are
ignored.  Words are A-Z lowered, stripped of ASCII punctuation at their ends.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, mixed, one, shingles, slices, strings

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"  # fixed value: ASCII punctuation


def keyed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A key for each word, and offsets per text; words of punctuation alone are left out."""
    import xxhash

    from .common import spans

    words, at = ascii_words(strings(texts))
    coded = one(words.dictionary_encode())
    bare = [w.strip(PUNCTUATION) for w in coded.dictionary.to_pylist()]
    keys = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) if w else 0 for w in bare), np.uint64, len(bare))[coded.indices.to_numpy()]
    full = keys != 0
    return keys[full], spans(full)[at]


def grams(keys: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram keys, text number and place."""
    if len(keys) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    every = shingles(keys, n)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = doc[: len(every)] == doc[n - 1 :]
    place = np.arange(len(every)) - at[doc[: len(every)]]
    return every[ok], doc[: len(every)][ok], place[ok]


def pairs(keys: np.ndarray, at: np.ndarray, apart: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of two words of one text so far apart (as shingles has those of neighbours), text number and place."""
    if len(keys) <= apart:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        every = mixed(mixed(keys[:-apart]) * np.uint64(0x9E3779B97F4A7C15) + keys[apart:])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    ok = np.flatnonzero(doc[:-apart] == doc[apart:])
    return every[ok], doc[ok], ok - at[doc[ok]]


def smith_waterman(item: np.ndarray, text: np.ndarray, match: float = 1.0, mismatch: float = 0.5, gap: float = 0.5) -> tuple[float, int]:
    """Best local score with linear gaps, and where in text it ends (one past)."""
    steps = gap * np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1)
    best, end = 0.0, 0
    for w in item:
        new = np.maximum(row - gap, 0.0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, match, -mismatch))
        row = np.maximum.accumulate(new + steps) - steps  # gaps along the text
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def find(docs: DataFrame, items: DataFrame, n: int = 4, share: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", items_bytes: int = 16 << 20) -> DataFrame:
    """Rows (id, item_id, score, begin, end): texts with at least `share` of an item aligned; places are words."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // items_bytes)
    out = None
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == part).toArrow()
        one_part = search(rows, some, n, share, id_type)
        out = one_part if out is None else out.unionAll(one_part)
    if out is None:
        out = rows.where("false").select("id", *[F.lit(None).cast(t).alias(c) for c, t in (("item", "long"), ("score", "double"), ("begin", "long"), ("end", "long"))])
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "score", "begin", "end")


def search(rows: DataFrame, items: pa.Table, n: int, share: float, id_type: str) -> DataFrame:
    keys, at = keyed(items["text"])
    ids = items["item"].to_pylist()
    words = [keys[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    whole: list[tuple[int, int, int, int]] = []  # key, item, size of the key, weight
    for i, w in enumerate(words):
        if len(w):
            size = 2 if len(w) >= n else len(w)
            whole += [(k, i, -1 if len(w) >= n else size, c) for k, c in zip(*(v.tolist() for v in np.unique(shingles(w, size), return_counts=True)), strict=True)]
    seeds = {}
    for kind in sorted({r[2] for r in whole}):
        some = sorted(r for r in whole if r[2] == kind)
        seeds[kind] = (np.array([r[0] for r in some], np.uint64), np.array([r[1] for r in some], np.int64), np.array([r[3] for r in some], np.int64))
    least = np.array([max(1, int(np.ceil(len(w) - 1 - (1 - share) * len(w) / 0.75 - 1e-9))) if len(w) >= n else 1 for w in words], np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((seeds, words, ids, least))

    def hits(text_keys, text_at, seeds, least):
        """Places of the pairs (or whole short items) in texts that have enough of an item's, by text and item."""
        around: dict[tuple[int, int], list[int]] = {}
        for kind, (mine, item, weight) in seeds.items():
            found = [pairs(text_keys, text_at, 1), pairs(text_keys, text_at, 2)] if kind < 0 else [grams(text_keys, text_at, kind)]
            every, doc, place = (np.concatenate(c) for c in zip(*found, strict=True))
            low = np.searchsorted(mine, every)
            hit = np.flatnonzero(mine[np.minimum(low, len(mine) - 1)] == every)
            low, doc, place = low[hit], doc[hit], place[hit]
            many = np.searchsorted(mine, mine[low], "right") - low
            which = np.repeat(np.arange(len(hit)), many)
            seed = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            pair = doc[which] * len(least) + item[seed]
            order = np.lexsort((place[which], seed, pair))
            pair, seed, place = pair[order], seed[order], place[which][order]
            if not len(pair):
                continue
            new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (seed[1:] != seed[:-1])])
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            had = np.add.reduceat(np.where(new, weight[seed], 0), first)
            for a, b in zip(first[had >= least[pair[first] % len(least)]].tolist(), np.append(first[1:], len(pair))[had >= least[pair[first] % len(least)]].tolist(), strict=True):
                d, i = divmod(int(pair[a]), len(least))
                by_place = np.argsort(place[a:b], kind="stable")
                at, mass = place[a:b][by_place], np.concatenate([[0], np.cumsum(weight[seed[a:b]][by_place])])
                until = np.searchsorted(at, at + span(len(words[i])), "right")
                dense = mass[until] - mass[:-1] >= least[i]
                # all places of each window that is dense enough
                inside = np.zeros(len(at) + 1, np.int64)
                np.add.at(inside, np.flatnonzero(dense), 1)
                np.add.at(inside, until[dense], -1)
                if (near := at[np.cumsum(inside[:-1]) > 0]).size:
                    around[d, i] = near.tolist()
        return around

    def span(length: int) -> int:
        """Words of text that an alignment with the share can cover."""
        return max(2 * length, int(length + (1 - share) * length / 0.5) + 1)

    def align(batches):
        seeds, words, ids, least = shared.value
        for batch in slices(batches):
            text_keys, text_at = keyed(batch.column("text"))
            around = hits(text_keys, text_at, seeds, least)
            found = []
            for (d, i), places in sorted(around.items()):
                text, w = text_keys[text_at[d] : text_at[d + 1]], words[i]
                best = (0.0, 0, 0)
                reach, begin, end = span(len(w)), None, 0
                # seeds near each other share one stretch of text; far ones have their own
                for p in [*places, None]:
                    if begin is not None and (p is None or p - reach > end):
                        # a word of the item matches once at most: this bounds the score
                        score, stop = smith_waterman(w, text[begin:end]) if np.isin(w, text[begin:end]).sum() >= share * len(w) else (0.0, 0)
                        if score / len(w) > best[0]:
                            start = stop - smith_waterman(w[::-1], text[begin : begin + stop][::-1])[1]
                            best = (score / len(w), begin + max(start, 0), begin + stop)
                        begin = None
                    if p is not None:
                        begin = max(0, p - reach) if begin is None else begin
                        end = min(len(text), p + reach)
                if best[0] >= share:
                    found.append((d, ids[i], *best))
            cols = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], ["id", "item", "score", "begin", "end"])

    return rows.mapInArrow(align, f"id {id_type}, item long, score double, begin long, end long")
