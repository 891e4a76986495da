"""Blocks ask, buckets answer: what all documents have to say about a key.

A block of documents sends each of its distinct keys once, with what it knows of it, to the
bucket of the key; the bucket merges what it is sent, works out an answer for each key, and
sends each block the answers for its own keys, in the block's order.

Messages grow with the product of blocks and buckets if each block writes to each bucket.  Beyond
`fan` buckets they pass relays: a relay merges what a group of blocks has for a range of about
the root of all buckets, and asks those buckets in their stead.  A block then writes to the root
of the number of buckets, and a bucket hears from groups; messages keep their size as the corpus
grows, and what a key needs is said once for each group.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import loose, one, ordered, relaxed, squeezed

KEY_BITS = 47
FAN = 256


def turned(numbers: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """As many numbers whose bytes are those of the table of `shape` by column: bytes of one weight compress better side by side, in less time."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(shape).T).ravel().view(np.uint64)


def packed(items: pa.Table) -> bytes:
    """A table as one compressed blob; the ascending column `key`, where there is one, as differences, all their first bytes first, and no `bucket`."""
    if (at := items.schema.get_field_index("bucket")) >= 0:
        items = items.remove_column(at)
    if (at := items.schema.get_field_index("key")) >= 0:
        key = one(items.column(at)).to_numpy()
        steps = key.copy()
        steps[1:] -= key[:-1]
        items = items.set_column(at, "key", pa.array(turned(steps, (-1, 8))))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, items.schema) as out:
        out.write_table(items.combine_chunks())
    return squeezed(sink.getvalue())


def opened_items(blob: bytes) -> pa.Table:
    items = pa.ipc.open_stream(loose(blob)).read_all()
    if (at := items.schema.get_field_index("key")) >= 0:
        items = items.set_column(at, "key", pa.array(np.cumsum(turned(one(items.column(at)).to_numpy(), (8, -1)), dtype=np.uint64)))
    return items


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key of KEY_BITS bits; it rises with the key."""
    return ((keys >> np.uint64(KEY_BITS - 31)) * np.uint64(buckets) >> np.uint64(31)).astype(np.int64)


def route(items: pa.Table, buckets: int) -> np.ndarray:
    return one(items["bucket"]).to_numpy() if "bucket" in items.column_names else bucket_of(one(items["key"]).to_numpy(), buckets)


def parcels(items: pa.Table, node: np.ndarray, sender: int) -> pa.Table:
    """Rows (node, sender, blob) for items whose nodes ascend."""
    ids, starts = np.unique(node, return_index=True)
    blobs = [packed(items.slice(a, b - a)) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=False)]
    return pa.table({"node": pa.array(ids, pa.int64()), "sender": pa.array([sender] * len(ids), pa.int64()), "blob": pa.array(blobs, pa.binary()), "notes": pa.nulls(len(ids), NOTES)})


SCHEMA = "node long, sender long, blob binary, notes array<long>"
NOTES = pa.list_(pa.int64())


def exchange(blocks: DataFrame, tell: Callable, merge: Callable, solve: Callable, senders: int, buckets: int, aside: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """Rows (block, node, blob, notes): answers to a block's items, in the items' order if taken by node.

    tell gives a block's items (from its rows, and those of `aside`): a table whose uint64 column `key`, or
    the bucket itself in a column `bucket`, ascends.
    merge makes one table of several and says where each item of each came to lie.  solve gives
    a table of answers, one for each row, and perhaps numbers about the bucket: the first of its
    answers has them in `notes`, and all of them add up to the corpus's.
    """
    inner = 1 if buckets <= fan else math.ceil(math.sqrt(buckets))
    outer = -(-buckets // inner)
    group = 1 if inner == 1 else max(1, math.ceil(senders / math.ceil(math.sqrt(senders))))

    def send(block: pa.Table, *more: pa.Table) -> pa.Table:
        if not block.num_rows:
            return relaxed(parcels(pa.table({"key": pa.array([], pa.uint64())}), np.empty(0, np.int64), 0))
        items, sender = tell(block, *more), block["block"][0].as_py()
        to = route(items, buckets) // inner
        return relaxed(parcels(items, to if inner == 1 else sender // group * outer + to, sender))

    def gathered(asked: pa.Table) -> tuple[pa.Table, pa.Table, list[np.ndarray]]:
        asked = asked.sort_by("sender")  # one order, whenever it is computed
        return asked, *merge([opened_items(b.as_py()) for b in asked["blob"]])

    def back(asked: pa.Table, answers: pa.Table, notes: list[int] | None, places: list[np.ndarray]) -> pa.Table:
        blobs = [packed(answers.take(pa.array(p))) for p in places]
        return relaxed(pa.table({"node": asked["sender"], "sender": asked["node"], "blob": pa.array(blobs, pa.binary()), "notes": pa.array([notes] + [None] * (len(blobs) - 1), NOTES)}))

    def relay(asked: pa.Table) -> pa.Table:
        asked, items, _ = gathered(asked)
        return relaxed(parcels(items, route(items, buckets), asked["node"][0].as_py()))

    def reply(asked: pa.Table) -> pa.Table:
        asked, items, places = gathered(asked)
        solved = solve(items)
        return back(asked, *(solved if isinstance(solved, tuple) else (solved, None)), places)

    def relay_back(asked: pa.Table, told: pa.Table) -> pa.Table:
        asked, items, places = gathered(asked)
        notes = [n for n in told["notes"].to_pylist() if n]
        return back(asked, answers_of(told, items.num_rows, "sender"), [sum(c) for c in zip(*notes, strict=True)] if notes else None, places)

    grouped = blocks.groupBy("block")
    asked = grouped.applyInArrow(lambda block: send(block), SCHEMA) if aside is None else grouped.cogroup(aside.groupBy("block")).applyInArrow(lambda block, more: send(block, more), SCHEMA)
    if inner == 1:
        told = asked.groupBy("node").applyInArrow(reply, SCHEMA)
    else:
        inward = asked.groupBy("node").applyInArrow(relay, SCHEMA).groupBy("node").applyInArrow(reply, SCHEMA)
        told = asked.groupBy("node").cogroup(inward.groupBy("node")).applyInArrow(relay_back, SCHEMA)
    return told.selectExpr("cast(node as int) as block", "sender as node", "blob", "notes")


def answers_of(told: pa.Table, rows: int, by: str = "node") -> pa.Table:
    """All answers that came, in the order of what was asked."""
    told = told.sort_by(by)
    answers = pa.concat_tables([opened_items(b.as_py()) for b in told["blob"]]) if told.num_rows else pa.table({})
    if answers.num_rows != rows:
        raise RuntimeError(f"{answers.num_rows} answers to {rows} questions")
    return answers


# --- how many documents have a key --------------------------------------------------------------


def distinct_keys(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and how many documents of the block have each."""
    order = np.argsort(keys, kind="stable") if (docs[1:] >= docs[:-1]).all() else np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])
    other = new.copy()
    other[1:] |= docs[1:] != docs[:-1]
    return keys[new], np.add.reduceat(other.astype(np.int64), np.flatnonzero(new))


def merged_counts(parts: list[pa.Table]) -> tuple[pa.Table, list[np.ndarray]]:
    keys = [one(t["key"]).to_numpy() for t in parts]
    every = np.concatenate(keys)
    order = ordered(every)
    every, place = every[order], np.empty(len(order), np.int64)
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    every, place[order] = every[new], np.cumsum(new) - 1
    counts = np.bincount(place, np.concatenate([t["n"].to_numpy() for t in parts]), len(every)).astype(np.int64)
    return pa.table({"key": pa.array(every), "n": pa.array(counts)}), np.split(place, np.cumsum([len(k) for k in keys])[:-1])


def counted(blocks: DataFrame, keys_of: Callable, senders: int, buckets: int, aside: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """For each block, how many documents have each of its keys; keys_of gives keys and document ids."""

    def tell(*tables: pa.Table) -> pa.Table:
        keys, counts = distinct_keys(*keys_of(*tables))
        return pa.table({"key": pa.array(keys), "n": pa.array(counts.astype(np.uint32))})

    return exchange(blocks, tell, merged_counts, lambda items: items.select(["n"]), senders, buckets, aside, fan)


def key_counts(keys: np.ndarray, docs: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of the block, and how many documents of all blocks have each."""
    distinct, _ = distinct_keys(keys, docs)
    answers = answers_of(told, len(distinct))
    return distinct, answers["n"].to_numpy() if len(distinct) else np.empty(0, np.int64)


def among(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return sorted_keys[at] == keys


# --- words ---------------------------------------------------------------------------------------


def word_items(words: pa.Array, buckets: int, n: np.ndarray | None = None) -> tuple[pa.Table, np.ndarray]:
    """Distinct words as items (bucket, word, and perhaps n) by bucket and word, and where each came to lie.

    Neighbours in this order are alike, and so are what is answered of them: both compress well.
    """
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    order = pc.array_sort_indices(words).to_numpy()
    keys = np.fromiter((digest(w) for w in words.to_pylist()), np.uint64, len(words)) >> np.uint64(64 - KEY_BITS)
    to = bucket_of(keys, buckets)
    order = order[np.argsort(to[order], kind="stable")]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    items = {"bucket": pa.array(to[order]), "word": words.take(pa.array(order))}
    return pa.table(items if n is None else items | {"n": pa.array(n[order])}), place


def merging_words(buckets: int) -> Callable:
    """Items of several senders as one table; n is summed."""

    def merge(parts: list[pa.Table]) -> tuple[pa.Table, list[np.ndarray]]:
        coded = one(pa.chunked_array([one(t["word"]) for t in parts]).combine_chunks().dictionary_encode())
        codes, words, n = coded.indices.to_numpy(), coded.dictionary, None
        if "n" in parts[0].column_names:
            n = np.bincount(codes, np.concatenate([t["n"].to_numpy() for t in parts]), len(words)).astype(np.int64)
        items, place = word_items(words, buckets, n)
        return items, np.split(place[codes], np.cumsum([t.num_rows for t in parts])[:-1])

    return merge
