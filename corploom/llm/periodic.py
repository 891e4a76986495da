"""Periodic runs of words, found by comparing a text with itself at every lag, a machine word of places at a time.

A run is a stretch of consecutive words in which words `period` apart are the same, with the
smallest such period, at least `least` words and `times` periods long, that no neighbouring word
extends.  Word ids of a text are laid out as bit planes, one big integer each.  At a lag q the XOR
of a plane with itself shifted by q marks the places whose words differ in that bit; the OR over
planes marks all mismatches.  AND with copies of itself, shifted by 1, 2, 4, ..., leaves of the
matches only those from which enough further ones follow: a zero stretch of mismatches that is
long enough, and with it a run.  A lag that is a multiple of a run's period gives the same
stretch again, and the smallest keeps it.

Before that, texts are cut where no run can pass: a word of a run occurs in it twice at least, so
a word that a stretch has once parts it in two, again and again until nothing parts.  In a long
stretch a lag q of 32 or more is only compared if windows recur at that distance: with B the
power of two such that B <= q < 2B, a run of period q has matches on q places in a row, so one of
the windows of B/2 words that begin at multiples of B/2 comes again q words on, and so does what
follows it up to q - B/2 words.  Windows are compared by polynomial keys, which may collide, so that
a lag too many is compared but none too few.  Lags inside a run of a divisor of theirs are left
out: they would find that run.  No lag, however large, and no part of a text is left out for its cost.

Null texts have no words, as empty ones.  Very long texts take memory of about twenty times
their size, in one task; repeated rows each come back; ids may be null; an empty table gives an empty one;
columns other than id and text are ignored, whatever their names.  Runs come by start, then period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, mixed, one, powers, slices, spans, strings
from .rules import SPACES

DIRECT = 1024  # stretches up to this length are compared at every lag
FIRST = 32  # of longer ones, lags below this are


def bit_planes(ids: np.ndarray) -> list[int]:
    """Plane b has bit i set where bit b of ids[i] is."""
    width = max(1, int(ids.max()).bit_length())
    return [int.from_bytes(np.packbits((ids >> b) & 1, bitorder="little").tobytes(), "little") for b in range(width)]


def places(bits: int, n: int) -> np.ndarray:
    """Which of the n low bits are set."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little"))


def compared(planes: list[int], n: int, q: int, need: int) -> list[tuple[int, int]]:
    """Maximal stretches [begin, end) of places i, `need` of them at least, where words i and i + q are the same."""
    same = every = (1 << (n - q)) - 1
    for plane in planes:
        same &= every ^ ((plane ^ (plane >> q)) & every)
        if same.bit_count() < need:
            return []
    have = 1
    while have < need and same:
        step = min(have, need - have)
        same &= same >> step
        have += step
    if not same:
        return []
    begins, lasts = places(same & ~(same << 1), n), places(same & ~(same >> 1), n)
    return list(zip(begins.tolist(), (lasts + need).tolist(), strict=True))


def window_key(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, size) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (sums[begin + size] - sums[begin]) * down[begin]


def recurring(sums: np.ndarray, down: np.ndarray, n: int, base: int, known: dict[tuple[int, int], int]) -> list[int]:
    """Lags from base to 2 * base - 1 at which a run may be that is not in known."""
    size = base // 2
    if n < 2 * base:
        return []
    rank = np.unique(window_key(sums, down, np.arange(n - size + 1), size), return_inverse=True)[1]
    order = np.argsort(rank, kind="stable")
    spot = rank[order] * np.int64(n + 1) + order
    anchors = np.arange(0, n - size + 1, size)
    low, high = (np.searchsorted(spot, rank[anchors] * np.int64(n + 1) + np.minimum(anchors + far, n)) for far in (base, 2 * base))
    at = np.repeat(anchors, high - low)
    first = spans(high - low)
    lag = order[np.arange(first[-1]) - np.repeat(first[:-1] - low, high - low)] - at
    fits = at + 2 * lag - size <= n
    at, lag = at[fits], lag[fits]
    again = window_key(sums, down, at, lag - size) == window_key(sums, down, at + lag, lag - size)
    at, lag = at[again], lag[again]
    if known and len(at):
        begins, ends, periods = (np.array(x) for x in zip(*sorted((b, e, p) for (b, e), p in known.items()), strict=True))
        furthest = np.maximum.accumulate(ends * np.int64(len(ends)) + np.arange(len(ends))) % len(ends)
        run = np.searchsorted(begins, at, "right") - 1
        inside = run >= 0
        run = furthest[np.maximum(run, 0)]
        inside &= (ends[run] >= at + lag) & (lag % periods[run] == 0)
        lag = lag[~inside]
    return np.unique(lag).tolist()


def runs_of(ids: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one stretch of word ids, by start and period."""
    n = len(ids)
    ids = np.unique(ids, return_inverse=True)[1]
    planes, found = bit_planes(ids), {}

    def take(lags) -> None:
        for q in lags:
            for begin, end in compared(planes, n, q, max(least - q, (times - 1) * q)):
                found.setdefault((begin, end + q), q)

    if n <= DIRECT or FIRST < least:
        take(range(1, n // times + 1))
    else:
        take(range(1, min(FIRST, n // times + 1)))
        up, down = powers(max(20, n.bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mixed(ids.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64, out=sums[1:])
        base = FIRST
        while base <= n // times:
            take(q for q in recurring(sums, down, n, base, found) if q <= n // times)
            base *= 2
    return sorted((begin, end - begin, q) for (begin, end), q in found.items())


def parted(ids: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words left, and edges of stretches among them, each of at least `least` words that occur twice in it or more."""
    left, stretch = np.arange(len(ids)), text
    while len(left):
        key = np.unique(stretch.astype(np.int64) << 32 | ids[left], return_inverse=True, return_counts=True)
        twice = key[2][key[1]] > 1
        left, stretch = left[twice], stretch[twice]
        if not len(left):
            break
        new = np.concatenate([[True], (left[1:] != left[:-1] + 1) | (stretch[1:] != stretch[:-1])])
        stretch = np.cumsum(new) - 1
        long = np.bincount(stretch)[stretch] >= least
        if twice.all() and long.all():
            return left, np.append(np.flatnonzero(new), len(left))
        left, stretch = left[long], stretch[long]
    return left, np.zeros(1, np.int64)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, times: int = 2) -> DataFrame:
    """Rows (id, n_words, runs, collapsed): all runs of each text, and the text without what follows their first periods.

    collapsed has the words that no run holds after its first period, joined by a space.
    """
    if times < 2 or least < 2:
        raise ValueError("a run is two periods and two words long at least")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in slices(batches):
            words, at = ascii_words(strings(batch.column("text")), lower=False)
            ids = one(words.dictionary_encode()).indices.to_numpy().astype(np.int64)
            n, rows = len(at) - 1, [[] for _ in range(len(at) - 1)]
            kept = np.ones(len(ids), bool)
            left, edges = parted(ids, np.repeat(np.arange(n), np.diff(at)), least)
            text_of = np.searchsorted(at, left[edges[:-1]], "right") - 1
            for a, b, k in zip(edges[:-1].tolist(), edges[1:].tolist(), text_of.tolist(), strict=True):
                first = int(left[a])
                for start, length, period in runs_of(ids[first : first + b - a], least, times):
                    rows[k].append({"start": first + start - int(at[k]), "length": length, "period": period})
                    kept[first + start + period : first + start + length] = False
            offsets = spans(kept)[at]
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), words.filter(pa.array(kept)))
            collapsed = pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(at), pa.int64()), pa.array(rows, RUNS), collapsed], ["id", "n_words", "runs", "collapsed"])

    id_type = docs.schema["id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"id {id_type}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    return out.withColumnRenamed("id", id_col)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, text): the texts, of which one in ten by crc32 of the id repeats a stretch of its words from some place on."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    g = F.floor(h / 10)
    let = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))

    def from_place(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.transform(words, lambda w, i: F.when(i < s["a"], w).otherwise(F.get(words, (s["a"] + F.pmod(i - s["a"], s["p"])).cast("int")))))

    words = F.filter(F.split(F.col(text_col), SPACES), lambda w: w != "")
    changed = F.array_join(let(words, from_place), " ")
    hit = (F.pmod(h, F.lit(10)) == 0) & F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    return docs.select(F.col(id_col), F.when(hit, changed).otherwise(F.col(text_col)).alias(text_col))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the longest run and digests of all runs and of the collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    told = F.concat(lines, F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.withColumn("_best", best).select(
        F.col(id_col), F.size("runs").cast("long").alias("n_runs"),
        F.col("_best.start").alias("start"), (-F.col("_best.less")).alias("length"), F.col("_best.period").alias("period"),
        F.floor(-1000 * F.col("_best.less") / F.col("_best.period")).cast("long").alias("exponent_milli"),
        F.sha2(told.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
