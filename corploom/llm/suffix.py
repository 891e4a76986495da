"""Exact removal of long repeated byte strings by deep-shallow suffix sorting.

A byte goes if a `length`-byte string that covers it also starts in a document with a smaller
id.  Windows of that length are dealt by their minimizer (the least hash of the `seed`-byte
strings in them), so equal windows meet, as runs of windows ("spans") around one
minimizer.  A first exchange finds minimizers that several documents have.  A window holds, of
its bytes beside the minimizer, half at least on one side; a second exchange finds what windows
of a side have in common that several documents have.  Only windows of such sides, each distinct
run of a block once, go to the buckets.  A bucket sorts the spans' suffixes that
start at the minimizer: multikey quicksort over the first `seed` bytes, eight at a time, then
blind tries for the groups that agree so far; their left sides, read backwards, go through
blind tries likewise.  Neighbours' common prefixes to both sides give, for every window, the
least document id that holds it.  Equal texts count once: all but the one of least id go as a whole.

A very long text lies in one block, in memory of some tens of times its size; its spans go to the buckets like others.
Null and short texts lose nothing.  Rows of equal id do not shorten each other; a row with a
null id neither shortens nor is shortened.  Matches never cross documents.  An empty table gives an
empty one; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, dealt, gather, mixed, one, opened, relaxed, spans, stored
from .shared import FAN, KEY_BITS, among, answers_of, counted, exchange, key_counts

CHUNK = 1 << 17
NEVER = np.iinfo(np.int64).max


class Spans:
    """Runs of windows of a block's texts that share a minimizer."""

    def __init__(self, texts: pa.Array, length: int, seed: int):
        texts = one(texts).cast(pa.large_binary())
        _, at, data = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.bytes = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
        self.at = at - at[0]
        whole = np.ones(len(self.bytes), bool)  # does the window that starts here end in its document?
        for a, b in zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True):
            whole[max(a, b - length + 1) : b] = False
        found = []
        for a, b in self.pieces(length):
            start, count, key, place = minimizers(self.bytes[a:b], whole[a : b - length + 1], length, seed)
            found.append((start + a, count, key, place + a))
        found.append(tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64)))
        self.start, self.count, self.key, self.place = (np.concatenate(x) for x in zip(*found, strict=True))
        self.doc = np.searchsorted(self.at, self.start, "right") - 1

    def sides(self, picks: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of spans `picks`: how many windows hold more to the left of the minimizer (the others: to its right), which sides have windows, and their keys in a row: a hash of the bytes that all windows of the side hold."""
        start, count, place, half = self.start[picks], self.count[picks], self.place[picks], (length - seed + 1) // 2
        left = np.clip(place - half + 1 - start, 0, count)
        has, keys = np.stack([left > 0, left < count], 1), np.zeros((len(picks), 2), np.uint64)
        words = np.ndarray((max(len(self.bytes) - 7, 0),), "<u8", self.bytes, strides=(1,))
        for side, (at, size) in enumerate(((place - half, seed + half), (place, length - half + 1))):
            at = at[has[:, side]]
            h = np.full(len(at), side, np.uint64)
            with np.errstate(over="ignore"):
                for k in [*range(0, size - 7, 8), size - 8]:
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[at + k])
            keys[has[:, side], side] = h >> np.uint64(64 - KEY_BITS)
        return left, has, keys[has]

    def pieces(self, length: int):
        """Stretches of at most CHUNK bytes; each window lies in one of them."""
        total = len(self.bytes)
        a = 0
        while a + length <= total:
            b = min(a + CHUNK, total)
            yield a, b
            a = b - length + 1


def minimizers(raw: np.ndarray, whole: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Of each run of whole windows: first window, number of windows, key and place of the minimizer."""
    n = len(raw) - seed + 1
    words = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), strides=(1,))
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(0, seed, 8):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n])
    low = np.uint64(CHUNK - 1)
    value = (h & ~low) | np.arange(n, dtype=np.uint64)
    width, step, least = length - seed + 1, 1, value
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(value) - width + 1], least[width - step : width - step + len(value) - width + 1])
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])]))
    count = np.diff(np.append(first, len(least)))[whole[first]]
    first = first[whole[first]]
    # least hashes crowd at the low end: mixed again, keys fill the buckets alike
    return first, count, mixed(least[first] >> np.uint64(17)) >> np.uint64(64 - KEY_BITS), (least[first] & low).astype(np.int64)


def finer(start: np.ndarray, count: np.ndarray, place: np.ndarray, level: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Which span, first window, number of windows, and the bytes (from, to) that all of them hold, of spans parted `level` times.

    A window of a span holds the minimizer and, of the bytes left in it, half at least on one side:
    by that side the windows part, and what they hold in common grows.
    """
    which, low, high, rest = np.arange(len(start)), place.copy(), place + seed, level.copy()
    while True:
        free = length - (high - low)
        split = (rest > 0) & (free > 0)
        if not split.any():
            return which, start, count, low, high
        half = np.where(split, (free + 1) // 2, 0)
        border = np.where(split, low - half + 1, start + count)  # windows from here on hold more to the right
        left = np.clip(border - start, 0, count)
        parts = [(which, start, left, low - half, high), (which, start + left, count - left, low, high + np.where(split, free - half + 1, 0))]
        rest = np.concatenate([rest - 1, rest - 1])
        which, start, count, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
        some = count > 0
        which, start, count, low, high, rest = (c[some] for c in (which, start, count, low, high, rest))


def distinct_runs(key: np.ndarray, raw: pa.Array, place: np.ndarray, least: np.ndarray) -> tuple[pa.Table, np.ndarray]:
    """Each run of windows once, by key, with the least of its ids; and where each came to lie."""
    pair = (raw.dictionary_encode().indices.to_numpy().astype(np.int64) << 32) | place
    _, first, which = np.unique(pair, return_index=True, return_inverse=True)
    low = np.full(len(first), NEVER)
    np.minimum.at(low, which, least)
    order = np.argsort(key[first], kind="stable")
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    first = first[order]
    return pa.table({"key": pa.array(key[first], pa.uint64()), "raw": raw.take(pa.array(first)), "place": pa.array(place[first], pa.int32()), "least": pa.array(low[order])}), back[which]


def multikey_order(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort over eight-byte symbols: order, and the group of each place (equal in all symbols).

    Each step parts every open group at once in three by its pivot's symbol: less, equal, greater.
    The equal part goes on with the next symbol; a group is closed when it is one item or has no
    symbol left.
    """
    n, deep = len(columns[0]), len(columns)
    order, starts, symbol = np.arange(n), np.zeros(min(n, 1), np.int64), np.zeros(min(n, 1), np.int64)
    while True:
        size = np.diff(np.append(starts, n))
        wide = (size > 1) & (symbol < deep)
        if not wide.any():
            return order, np.repeat(np.arange(len(starts)), size)
        which = np.repeat(np.arange(len(starts)), size)
        places = np.flatnonzero(wide[which])
        at = which[places]
        values, pivot = np.empty(len(places), columns[0].dtype), np.empty(len(starts), columns[0].dtype)
        middle = order[starts + size // 2]
        for k in range(deep):
            mine = symbol[at] == k
            values[mine] = columns[k][order[places[mine]]]
            pivot[symbol == k] = columns[k][middle[symbol == k]]
        side = np.ones(n, np.int64)
        side[places] = (values > pivot[at]).astype(np.int64) - (values < pivot[at]) + 1
        part = which * 3 + side
        inner = np.argsort(part, kind="stable")
        order, part = order[inner], part[inner]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        old = part[starts] // 3
        symbol = symbol[old] + (wide[old] & (part[starts] % 3 == 1))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


class Node:
    """An inner node: texts below agree up to depth, and differ there (-1: a text ends)."""

    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def blind_trie(items: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of items, and the common prefix of each with the one before it (first: 0).

    An item goes down blindly, comparing one byte a node, is compared once with the leaf it
    meets, and its branch is put where the two first differ.  Leaves are lists of equal items.
    """
    root = Node(0, {})
    for i, s in enumerate(items):
        n = len(s)
        if not root.children:
            root.children[s[0] if n else -1] = [i]
            continue
        node = root
        while type(node) is Node:
            d = node.depth
            node = node.children.get(s[d] if d < n else -1) or next(iter(node.children.values()))
        other = items[node[0]]
        depth = common_prefix(s, other)
        if depth == n == len(other):
            node.append(i)
            continue
        node = root
        while True:
            d = node.depth
            key = s[d] if d < n else -1
            child = node.children.get(key)
            if child is None:
                node.children[key] = [i]
                break
            if type(child) is Node and child.depth <= depth:
                node = child
                continue
            node.children[key] = Node(depth, {(s[depth] if depth < n else -1): [i], (other[depth] if depth < len(other) else -1): child})
            break
    order: list[int] = []
    prefix: list[int] = []
    stack: list = [(root, 0)]
    while stack:
        node, lcp = stack.pop()
        if type(node) is Node:
            children = sorted(node.children.items())
            stack.extend((child, node.depth if k else lcp) for k, (_, child) in reversed(list(enumerate(children))))
        else:
            order += node
            prefix += [lcp] + [len(items[node[0]])] * (len(node) - 1)
    return order, prefix


def sorted_groups(items: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Items (already by group) ordered inside each group; common prefixes, -1 at a group's first."""
    order, prefix = np.arange(len(items)), np.full(len(items), -1, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(items)], strict=True):
        if b - a == 2:
            x, y = items[a], items[a + 1]
            prefix[a + 1] = common_prefix(x, y)
            if y < x:
                order[a], order[a + 1] = a + 1, a
        elif b - a > 2:
            inner, lcp = blind_trie(items[a:b])
            order[a:b] = np.array(inner) + a
            prefix[a + 1 : b] = lcp[1:]
    return order, prefix


def least_ids(items: list[bytes], place: np.ndarray, ids: np.ndarray, length: int, seed: int) -> list[np.ndarray]:
    """For each span (its bytes, where its minimizer starts), the least id with each of its windows."""
    n, sizes = len(items), np.array([len(s) for s in items], np.int64)
    seeds = np.frombuffer(b"".join(s[p : p + seed] for s, p in zip(items, place.tolist(), strict=True)), ">u8").reshape(n, seed // 8)
    order, group = multikey_order([seeds[:, k] for k in range(seeds.shape[1])])
    right = [items[i][place[i] + seed :] for i in order.tolist()]
    left = [items[i][: place[i]][::-1] for i in order.tolist()]
    ro, rp = sorted_groups(right, group)
    lo, lp = sorted_groups(left, group)
    room = length - seed
    mine, doc = place[order], ids[order]
    tail = sizes[order] - mine - seed
    out = np.full((n, room + 1), NEVER)
    for a in range(room + 1):  # the window that starts a bytes before the minimizer
        ok = np.flatnonzero((mine >= a) & (tail >= room - a))
        if not len(ok):
            continue
        by_right, by_left = np.empty(n, np.int64), np.empty(n, np.int64)
        by_right[ro] = np.cumsum(rp < room - a)
        by_left[lo] = np.cumsum(lp < a)
        key = by_right[ok] * (n + 1) + by_left[ok]
        inner = np.lexsort((doc[ok], key))
        ok, key = ok[inner], key[inner]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        out[ok, a] = doc[ok][first][np.cumsum(first) - 1]
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    # windows in the order of the text: the first starts `place` bytes before the minimizer
    return [out[back[i], place[i] - (sizes[i] - length) : place[i] + 1][::-1] for i in range(n)]


def remove_repeats(docs: DataFrame, length: int = 50, seed: int = 16, id_col: str = "doc_id", text_col: str = "text", hot: int = 256, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Rows (id, n_bytes, spans array<struct<begin, end>>, kept binary), one for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    hashed = lambda k: F.xxhash64(F.lit(k), "text")
    docs = docs.withColumn("h", hashed(1))
    n = block_count(docs, "text", block_bytes)
    place = F.pmod(F.xxhash64(F.xxhash64("id", "h")), F.lit(n)).cast("int")
    blocks = dealt(docs, n, F.xxhash64("id", "h"))
    # of equal texts all but the one of least id go as a whole, and shorten nothing that it does not
    long = docs.where(f"id is not null and octet_length(text) >= {length}").withColumn("h2", hashed(2)).select("id", "h", "h2")
    first = long.groupBy("h", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = stored(long.join(first, ["h", "h2"]).where("id <> first").select(place.alias("block"), "id", "h").distinct())
    nothing = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    aside = copies.select("block", F.lit(-1).alias("kind"), *nothing("long", "node"), *nothing("binary", "blob"), "id", "h")
    said = lambda df, kind: df.select("block", F.lit(kind).alias("kind"), "node", "blob", *nothing("long", "id", "h"))

    def of_kind(told: pa.Table, kind: int) -> pa.Table:
        return told.filter(pc.equal(told["kind"], kind))

    def laid(block: pa.Table, told: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The block's rows in one order (they come in any, and spans hang on who lies next to whom), copies without text; and the bytes that copies have."""
        rows = opened(block, {"id": pa.int64(), "text": pa.large_binary(), "h": pa.int64()}).sort_by([("id", "ascending"), ("text", "ascending")])
        gone = of_kind(told, -1)
        away = set(zip(gone["id"].to_pylist(), gone["h"].to_pylist(), strict=True))
        mask = np.array([key in away for key in zip(rows["id"].to_pylist(), rows["h"].to_pylist(), strict=True)], bool)
        sizes = np.where(mask, pc.binary_length(rows["text"]).to_numpy(), 0) if rows.num_rows else np.empty(0, np.int64)
        return pa.table({"id": rows["id"], "text": pc.if_else(pa.array(mask), pa.scalar(b"", pa.large_binary()), one(rows["text"]))}), sizes

    def found_in(block: pa.Table) -> tuple[Spans, np.ndarray, np.ndarray]:
        every = Spans(block["text"], length, seed)
        ids = one(block["id"])
        known = ids.is_valid().to_numpy(zero_copy_only=False)[every.doc] if len(every.doc) else np.zeros(0, bool)
        return every, known, ids.fill_null(0).to_numpy()

    def counting(keys: np.ndarray) -> np.ndarray:
        """Keys as they are counted: in a corpus of less than 100 GB 39 bits are enough, and travel shorter; two keys that are then one cost a span sent for nothing."""
        return keys >> np.uint64(8) << np.uint64(8) if n <= 1 << 14 else keys

    def keys_of(block: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        every, known, ids = found_in(laid(block, told)[0])
        return counting(every.key[known]), ids[every.doc[known]]

    def crowded(block: pa.Table, told: pa.Table) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
        """Spans, ids, and those whose minimizer several documents have: which, and how many documents."""
        every, known, ids = found_in(block)
        picks = np.flatnonzero(known)
        mine = counting(every.key[picks])
        keys, counts = key_counts(mine, ids[every.doc[picks]], of_kind(told, 0))
        some = among(mine, keys[counts > 1])
        return every, ids, picks[some], counts[np.searchsorted(keys, mine[some])]

    def side_keys_of(block: pa.Table, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        every, ids, picks, _ = crowded(laid(block, told)[0], told)
        _, has, keys = every.sides(picks, length, seed)
        return counting(keys), np.repeat(ids[every.doc[picks]], has.sum(1))

    def chosen(block: pa.Table, told: pa.Table) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Table]:
        """First window and text of the runs of windows that several documents may have, the distinct one that each is, and these: (key, raw, place, least).

        The more documents have a minimizer, the finer its spans are parted and dealt: by more bytes than it has.
        """
        every, ids, picks, many = crowded(block, told)
        left, has, mine = every.sides(picks, length, seed)
        mine = counting(mine)
        keys, counts = key_counts(mine, np.repeat(ids[every.doc[picks]], has.sum(1)), of_kind(told, 2))
        shared = np.zeros(has.shape, bool)
        shared[has] = among(mine, keys[counts > 1])
        begin, end = np.where(shared[:, 0], 0, left), np.where(shared[:, 1], every.count[picks], left)
        some = begin < end
        picks, many, begin, end = picks[some], many[some], begin[some], end[some]
        level = np.ceil(np.log(np.maximum(many / hot, 1.0)) / math.log(16)).astype(np.int64)
        span, start, count, low, high = finer(every.start[picks] + begin, end - begin, every.place[picks], level, length, seed)
        place, doc, dealt_by = every.place[picks][span], every.doc[picks][span], every.key[picks][span].copy()
        for j in np.flatnonzero(level[span] > 0).tolist():
            dealt_by[j] = xxhash.xxh3_64_intdigest(every.bytes[low[j] : high[j]].tobytes(), seed=int(place[j] - low[j])) >> (64 - KEY_BITS)
        at, raw = spans(count + length - 1), np.empty(0, np.uint8)
        if len(start):
            raw = np.empty(at[-1], np.uint8)
            for a in range(0, len(start), 1 << 14):
                b = min(a + (1 << 14), len(start))
                raw[at[a] : at[b]] = every.bytes[np.arange(at[a], at[b]) + np.repeat(start[a:b] - at[a:b], at[a + 1 : b + 1] - at[a:b])]
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])
        distinct, which = distinct_runs(dealt_by, pieces, place - start, ids[doc])
        return every, ids, start, doc, which, distinct

    def merge(parts: list[pa.Table]) -> tuple[pa.Table, list[np.ndarray]]:
        every = pa.concat_tables(parts)
        merged, where = distinct_runs(one(every["key"]).to_numpy(), one(every["raw"]), one(every["place"]).to_numpy(), one(every["least"]).to_numpy())
        return merged, np.split(where, np.cumsum([t.num_rows for t in parts])[:-1])

    def solve(items: pa.Table) -> pa.Table:
        windows = least_ids(items["raw"].to_pylist(), items["place"].to_numpy().astype(np.int64), items["least"].to_numpy(), length, seed)
        at = spans(np.array([len(w) for w in windows], np.int64))
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *windows])))})

    def cut(block: pa.Table, told: pa.Table) -> pa.Table:
        block, copied = laid(block, told)
        every, ids, start_of, doc_of, which, items = chosen(block, told)
        answers = answers_of(of_kind(told, 1), items.num_rows)
        values = one(answers["ids"]).flatten().to_numpy() if items.num_rows else np.empty(0, np.int64)
        sizes = pc.binary_length(items["raw"]).to_numpy() - length + 1
        at = spans(sizes)
        delta = np.zeros(len(every.bytes) + 1, np.int32)
        for a in range(0, len(which), 1 << 16):
            some, mine = slice(a, a + (1 << 16)), which[a : a + (1 << 16)]
            start = np.repeat(start_of[some], sizes[mine]) + (np.arange(sizes[mine].sum()) - np.repeat(spans(sizes[mine])[:-1], sizes[mine]))
            hit = start[values[gather(at, mine)] < np.repeat(ids[doc_of[some]], sizes[mine])]
            np.add.at(delta, hit, 1)
            np.add.at(delta, hit + length, -1)
        gone = np.cumsum(delta[:-1]) > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        edge = every.at[:-1][every.at[:-1] < len(gone)]
        first[edge] = gone[edge]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        edge = every.at[1:][every.at[1:] > 0] - 1
        last[edge] = gone[edge]
        begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        doc = np.searchsorted(every.at, begins, "right") - 1
        base = every.at[doc]
        whole = np.flatnonzero(copied)
        order = np.argsort(np.concatenate([doc, whole]), kind="stable")
        count = spans(np.bincount(np.concatenate([doc, whole]), minlength=len(every.at) - 1))
        begins, ends = np.concatenate([begins - base, 0 * whole])[order], np.concatenate([ends - base, copied[whole]])[order]
        kept = spans(~gone)[every.at]
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(every.at) - 1, [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(every.bytes[~gone].tobytes())])
        pairs = pa.StructArray.from_arrays([pa.array(begins, pa.int64()), pa.array(ends, pa.int64())], ["begin", "end"])
        return relaxed(pa.table({"id": block["id"], "n_bytes": pa.array(np.diff(every.at) + copied), "spans": pa.ListArray.from_arrays(pa.array(count, pa.int32()), pairs), "kept": data.cast(pa.binary())}))

    known = said(counted(blocks, keys_of, n, max(1, n // 3), aside, fan), 0).unionByName(aside)
    known = said(counted(blocks, side_keys_of, n, max(1, n // 3), known, fan), 2).unionByName(known)
    told = exchange(blocks, lambda block, more: chosen(laid(block, more)[0], more)[-1], merge, solve, n, n, aside=known, fan=fan)
    both = known.unionByName(said(told, 1))
    out = blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(cut, "id long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def digests(removed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return removed.select(
        id_col, "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
