"""Compression measures: the only part that needs Python workers, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAME_EXTRA = 8  # the frame header's content size, which Arrow's codec leaves out
VIEWS_BYTES = 4 << 20


def lz4_frame_size(raw: bytes) -> int:
    return len(pa.compress(raw, codec="lz4", asbytes=True)) + FRAME_EXTRA


def window(size: int) -> int:
    """zlib's window bits, with a gzip frame, for content of this size: no match can reach beyond, and less memory is set up.

    The smallest window that holds all content, and the 262 bytes that matches keep away from its end, gives
    the bytes of the largest.
    """
    return 16 + max(10, min(15, (size + 262).bit_length()))


def gzip_size(raw: bytes) -> int:
    return len(zlib.compress(raw, 6, window(len(raw))))


def sizes_after(raw: bytes, views: list[bytes]) -> list[int]:
    """The gzip size of raw followed by each view: raw is compressed once, and the state after it copied for each."""
    begun = zlib.compressobj(6, zlib.DEFLATED, window(len(raw) + max(map(len, views), default=0)))
    head, out = len(begun.compress(raw)), []
    for view in views:
        own = begun.copy()
        out.append(head + len(own.compress(view)) + len(own.flush()))
    return out


def distance_to_similarity(both: int, size: int, view_size: int) -> float:
    """1 - normalised compression distance; may be negative."""
    return 1 - (both - min(size, view_size)) / max(size, view_size)


def similarity(raw: bytes, size: int, view: bytes, view_size: int) -> float:
    return distance_to_similarity(gzip_size(raw + view), size, view_size)


def compression_ratio(text: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([lz4_frame_size(b) / len(b) if b else None for b in batch])

    return ratio(F.encode(text, "UTF-8"))


def gzip_ratio(text: Column) -> Column:
    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([gzip_size(b) / len(b) if b else None for b in batch])

    return ratio(F.encode(text, "UTF-8"))


def tiles(views: list[bytes], most: int = VIEWS_BYTES) -> list[list[bytes]]:
    """Views in order, in runs of at most so many bytes, one view at least."""
    out: list[list[bytes]] = []
    size = most + 1
    for v in views:
        if size + len(v) > most:
            out.append([])
            size = 0
        out[-1].append(v)
        size += len(v)
    return out


def tile_alignment(text: Column, views: list[bytes]) -> Column:
    """Struct(best, total) of the similarity with each view of one tile."""

    @F.pandas_udf("best double, total double")
    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own_sizes = [gzip_size(v) for v in views]
        for batch in batches:
            rows = []
            for raw in batch:
                size = gzip_size(raw) if raw else 0
                found = [distance_to_similarity(b, size, s) for b, s in zip(sizes_after(raw, views), own_sizes, strict=True)] if raw else []
                rows.append((max(found), sum(found)) if found else (None, None))
            yield pd.DataFrame(rows, columns=["best", "total"])

    return aligned(F.encode(text, "UTF-8"))


def alignment(text: Column, views: list[bytes], most: int = VIEWS_BYTES) -> Column:
    """Struct(best, mean) of the similarity with each of a set of views, which go to the workers a tile at a time.

    Null for null and empty texts, and where there are no views.
    """
    each = [tile_alignment(text, tile) for tile in tiles(views, most)]
    if not each:
        return F.struct(F.lit(None).cast("double").alias("best"), F.lit(None).cast("double").alias("mean"))
    best = F.greatest(*[x["best"] for x in each]) if len(each) > 1 else each[0]["best"]
    total = each[0]["total"]
    for x in each[1:]:
        total = total + x["total"]
    return F.struct(best.alias("best"), (total / len(views)).alias("mean"))


def target_views(table: DataFrame, key: str, text: str, count: int = 64, width: int = 1024) -> list[bytes]:
    """The first `count` texts by id, cut to `width` bytes."""
    return [r[0].encode()[:width] for r in table.where(F.col(text).isNotNull()).orderBy(key).limit(count).select(text).collect()]
