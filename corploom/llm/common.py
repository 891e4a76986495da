"""Helpers that the operators share: blocks of documents, packed blobs, shared tables.

A *block* is a group of documents of bounded text size, dealt by a hash of id and text, so
it holds the same rows whenever it is computed again after a lost executor.  Blocks
pre-aggregate: what a block says about a word or a seed is said once, not once per
occurrence, so that a key which fills a third of all rows costs one entry per block.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import pickle
import resource
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..sources.io import stored, table  # noqa: F401

BLOCK_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
PARTITIONS = 50_000  # blocks are more, at some size, than partitions that a driver can keep: then tasks take several, one by one
LOWERED = np.array([c | 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])  # fixed values: ASCII white space


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, or with as many underscores as make it a name that no column has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def block_count(docs: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks that hold about block_bytes of text each: one pass over sizes alone."""
    row = docs.agg(F.sum(F.octet_length(F.col(text))).alias("b"), F.count(F.lit(1)).alias("n")).first()
    return max(1, math.ceil(((row["b"] or 0) + 64 * row["n"]) / block_bytes))


def dealt(docs: DataFrame, n: int, key: Column) -> DataFrame:
    """Rows (block, rows): blocks 0 to n-1 by a hash of key, those of a block in one partition, which may have several.

    Rows travel as compressed parcels, one for each block that a slice of the input has rows of; `opened`
    gives them back.  Which rows a block has hangs on the key alone, not on how the input came.
    """
    names = docs.columns

    def parcels(batches):
        for batch in slices(batches, 8 * SLICE_BYTES):
            to = batch.column(len(names)).to_numpy()
            order = np.argsort(to, kind="stable")
            ids, starts = np.unique(to[order], return_index=True)
            columns = [batch.column(c).take(pa.array(order)).to_pylist() for c in range(len(names))]
            blobs = [squeezed(pickle.dumps([c[a:b] for c in columns], 5), 5) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["block", "rows"])

    return docs.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).mapInArrow(parcels, "block int, rows binary").repartition(min(n, PARTITIONS), "block")


def opened(block: pa.Table, types: dict[str, pa.DataType]) -> pa.Table:
    """The rows of a block's parcels, in any order."""
    columns: list[list] = [[] for _ in types]
    for blob in block["rows"]:
        for c, more in zip(columns, pickle.loads(loose(blob.as_py())), strict=True):
            c += more
    return pa.table({name: pa.array(c, t) for (name, t), c in zip(types.items(), columns, strict=True)})


def arrow_type(kind: DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def squeezed(data: bytes, level: int = 3) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def loose(blob: bytes) -> bytes:
    n = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=n, codec="zstd", asbytes=True) if n else b""


def slices(batches, most: int = SLICE_BYTES):
    """Arrow batches cut so that each has about `most` bytes, one row at least; memory goes back after each batch."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(batch.nbytes, 1)))
        a = 0
        while a < batch.num_rows:
            part = batch.slice(a, rows)
            while part.num_rows > 1 and part.nbytes > 2 * most:  # long rows lie together
                part = part.slice(0, part.num_rows // 2)
            yield part
            a += part.num_rows
        relaxed()


def relaxed(table: pa.Table | None = None, most: int = 200 << 20) -> pa.Table | None:
    """table; what a group of rows needed on the way goes back to the system where a worker holds much, since workers live on."""
    with contextlib.suppress(OSError, AttributeError, ValueError):
        with open("/proc/self/statm") as f:
            resident = int(f.read().split()[1]) * resource.getpagesize()
        if resident > most:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0)
    return table


def spans(lengths: np.ndarray) -> np.ndarray:
    """Offsets (one more than lengths) of runs laid end to end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def gather(offsets: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Indices of the elements of runs `which`, run after run; runs are given by offsets."""
    size = (offsets[1:] - offsets[:-1])[which]
    start = spans(size)
    return np.arange(start[-1], dtype=np.int64) + np.repeat(offsets[:-1][which] - start[:-1], size)


def laid_out(values: np.ndarray, offsets: np.ndarray, which: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """Elements of runs `which`, run after run, made a slice at a time to keep indices few."""
    size = spans((offsets[1:] - offsets[:-1])[which])
    out = np.empty(size[-1], values.dtype)
    for a in range(0, len(which), step):
        b = min(a + step, len(which))
        out[size[a] : size[b]] = values[gather(offsets, which[a:b])]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
    return x ^ (x >> np.uint64(31))


def flat(list_array: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Values of a list column and its offsets from 0; null lists count as empty."""
    if isinstance(list_array, pa.ChunkedArray):
        list_array = list_array.combine_chunks()
        if isinstance(list_array, pa.ChunkedArray):
            list_array = list_array.chunk(0) if list_array.num_chunks else pa.array([], list_array.type)
    lengths = list_array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return list_array.flatten(), spans(lengths)


def one(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A column in one piece."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
    return array


def ordered(*columns: np.ndarray) -> np.ndarray:
    """Stable order of rows by the first column of integers, then the next.

    Rows are sorted as words of 64 bits that hold the columns and, below them, the row's number, which takes a
    fifth of the time of sorting indices.  Bits that have no room are left out, and what they would tell apart is put right.
    """
    n = len(columns[0])
    if n < 2:
        return np.arange(n)
    low = [int(c.min()) for c in columns]
    bits = [(int(c.max()) - a).bit_length() for c, a in zip(columns, low, strict=True)]
    if sum(bits) > 64:
        return np.lexsort(columns[::-1])
    key, own = np.zeros(n, np.uint64), (n - 1).bit_length()
    with np.errstate(over="ignore"):
        for c, a, b in zip(columns, low, bits, strict=True):
            key = (key << np.uint64(b) if b < 64 else key) | (c.astype(np.uint64) - np.uint64(a % (1 << 64)))
    cut = max(0, sum(bits) + own - 64)
    both = (key >> np.uint64(cut) << np.uint64(own)) | np.arange(n, dtype=np.uint64)
    both.sort()
    order = (both & np.uint64((1 << own) - 1)).astype(np.int64)
    if cut and ((found := key[order])[1:] < found[:-1]).any():
        order = order[np.argsort(found, kind="stable")]
    return order


def strings(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return one(array).cast(pa.large_string()).fill_null("")


def ascii_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Words between the six ASCII white-space characters, A-Z lowered if asked; and offsets per text."""
    texts = one(texts).cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    at = at - at[0]
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
    full = ~WHITE[raw]
    first = full.copy()
    first[1:] &= ~full[:-1]
    edges = at[:-1][at[:-1] < len(raw)]
    first[edges] = full[edges]  # a word ends with its text
    starts = np.cumsum(full, dtype=np.int64)[first] - 1
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, full.sum()).astype(np.int64).tobytes()), pa.py_buffer(raw[full].tobytes()))
    return words, spans(first)[at]


@lru_cache(1)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and those of its inverse."""
    base = 0x9E3779B97F4A7C15
    out = []
    for factor in (base, pow(base, -1, 1 << 64)):
        every = np.full(1 << bits, factor, np.uint64)
        every[0] = 1
        out.append(np.cumprod(every, dtype=np.uint64))
    return out[0], out[1]


def word_edges(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, where words between the six ASCII white-space characters begin and end, and offsets of words per text."""
    texts = one(texts).cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
    at = at - at[0]
    full = (raw != 32) & (raw - np.uint8(9) > 4)
    begin, end = full.copy(), full.copy()
    begin[1:] &= ~full[:-1]
    end[:-1] &= ~full[1:]
    inner = at[(at > 0) & (at < len(raw))]  # a word ends with its text
    begin[inner] = full[inner]
    end[inner - 1] = full[inner - 1]
    begins, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return raw, begins, ends, np.searchsorted(begins, at)


def word_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key for each word between the six ASCII white-space characters, A-Z lowered; and offsets per text.

    A word's key is a polynomial of its bytes modulo 2**64, taken as the difference of two running
    sums and shifted to the word's begin, and its length, mixed: no word is ever laid out.
    """
    raw, begins, ends, offsets = word_edges(texts)
    step, keys = 1 << 17, [np.empty(0, np.uint64)]
    a = 0
    while a < len(begins):
        # a stretch of about `step` bytes; one word, however long, is in one
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + step, "right")))
        low, high = begins[a], ends[b - 1]
        up, down = powers(max(17, int(high - low - 1).bit_length()))
        part = LOWERED[raw[low:high]]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], dtype=np.uint64, out=sums[1:])
            x, y = begins[a:b] - low, ends[a:b] - low
            keys.append(mixed((sums[y] - sums[x]) * down[x] + (y - x).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        a = b
    return np.concatenate(keys), offsets


def shingles(keys: np.ndarray, k: int) -> np.ndarray:
    """Keys of all runs of k words of one text."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(keys) - k + 1, np.uint64)
        for i in range(k):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + keys[i : len(keys) - k + 1 + i])
    return out


def held(crc_of: str, by: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder."""
    return F.pmod(F.crc32(F.col(crc_of).cast("string").cast("binary")), F.lit(by)) == rest
