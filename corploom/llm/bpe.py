"""Byte-level BPE over a corpus by way of a distinct-word table.

Texts are cut into words where the tokenizer's own pre-tokenizer cuts them: its rule, over classes of
characters (letter, number, white space, other) that are asked of the tokenizer itself, so
that both know the same Unicode.  Blocks of documents send each of their distinct words once
to the word's bucket; a bucket encodes each of its distinct words once and answers every
block; the block joins ids back by position.  Decoding joins the ids of a batch with the
id-to-piece table, which the tokenizer file bounds.

Null texts count as empty; empty texts have no ids; an empty table gives an empty one; repeated rows are
encoded each; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, arrow_type, block_count, dealt, flat, laid_out, one, opened, relaxed, slices, spans
from .shared import FAN, answers_of, exchange, merging_words, word_items

LETTER, NUMBER, WHITE, OTHER, UNKNOWN = range(5)


@lru_cache(4)
def loaded(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(4)
def special_tokens(path: str) -> tuple[str, ...]:
    with open(path, encoding="utf-8") as f:
        return tuple(sorted((t["content"] for t in json.load(f).get("added_tokens", [])), key=len, reverse=True))


@lru_cache(4)
def piece_table(path: str) -> pa.Table:
    """id and bytes of every piece of the vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(kept))}
    vocab = loaded(path).get_vocab(with_added_tokens=True)
    special = set(special_tokens(path))
    pairs = sorted((i, p.encode() if p in special else bytes(byte_of[c] for c in p)) for p, i in vocab.items())
    return pa.table({"id": pa.array([i for i, _ in pairs], pa.int32()), "piece": pa.array([p for _, p in pairs], pa.binary())})


@lru_cache(2)
def class_table(path: str) -> np.ndarray:
    return np.full(0x110000, UNKNOWN, np.uint8)


def classes(points: np.ndarray, path: str) -> np.ndarray:
    """The class of each code point; those not met before are asked of the tokenizer's pre-tokenizer."""
    table = class_table(path)
    found = table[points]
    if (found == UNKNOWN).any():
        new = np.unique(points[found == UNKNOWN]).tolist()
        cut = loaded(path).pre_tokenizer.pre_tokenize_str
        table[new] = WHITE
        for kind, lead in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            # the character goes on the word that its class has begun, or begins another
            begins = {at for _, (at, _) in cut("".join(f"\n{lead}{chr(c)}" for c in new))}
            table[[c for i, c in enumerate(new) if 3 * i + 2 not in begins]] = kind
        found = table[points]
    return found


def split_words(texts: list[str], path: str) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, as bytes, and offsets per text; special tokens, found first, are words of their own.

    Runs of one class are words.  One space goes with the run after it; of other white space before a run the
    last character stands alone.  's, 't, 'm, 'd, 're, 've and 'll are words where an apostrophe starts one.
    """
    special = special_tokens(path)
    parts, marks, pieces = texts, np.zeros(len(texts), bool), np.ones(len(texts), np.int64)
    if special and any(s in t for t in texts for s in special):
        either = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        cut = [[(p, k % 2) for k, p in enumerate(either.split(t))] for t in texts]
        parts, pieces = [p for c in cut for p, _ in c], np.array([len(c) for c in cut], np.int64)
        marks = np.array([m for c in cut for _, m in c], bool)
    text = "".join(parts)
    raw = text.encode("utf-32-le")
    points = np.frombuffer(raw, np.uint32)
    n = len(points)
    edges = spans(np.fromiter((len(p) for p in parts), np.int64, len(parts)))
    if n:
        kind = classes(points, path)
        first = np.zeros(n + 1, bool)  # of a part
        first[edges] = True
        run = first[:n].copy()
        run[1:] |= kind[1:] != kind[:-1]
        start = run.copy()
        # white space before another run of its part
        end = np.flatnonzero(run[1:] & ~first[1:n] & (kind[:-1] == WHITE)) + 1
        start[end - 1] = True
        start[end[points[end - 1] == 32]] = False
        mark = np.flatnonzero((points == 39) & run & start)
        if len(mark):
            padded = np.concatenate([points, np.zeros(3, np.uint32)])
            inside = lambda k: (mark + k <= n) & ~np.add.reduce([first[np.minimum(mark + j, n)] for j in range(1, k)], dtype=bool)
            a, b = padded[mark + 1], padded[mark + 2]
            short = np.isin(a, [ord(c) for c in "stmd"]) & inside(2)
            long = ((((a == ord("r")) | (a == ord("v"))) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & inside(3)
            start[mark[short | long] + 1] = False
            rest = np.concatenate([mark[short] + 2, mark[long] + 3])
            start[rest[rest < n]] = True
        for i in np.flatnonzero(marks).tolist():
            start[edges[i] : edges[i + 1]] = False
            start[edges[i]] = True
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        at = spans(width)
        offsets = np.append(at[:-1][start], at[-1])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.encode())])
        return words, spans(start)[edges][spans(pieces)]
    return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)


def stretches(text: str, most: int = 1 << 20) -> list[str]:
    """text in pieces of about `most` characters, cut before a space that ends no white space: a word begins there in any case."""
    out, a = [], 0
    while len(text) - a > most:
        b = text.find(" ", a + most)
        while b > 0 and text[b - 1].isspace():
            b = text.find(" ", b + 1)
        if b < 0:
            break
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", out_col: str | None = None, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Rows (id, ids array<int>), one for each row of docs; with out_col also what the ids decode to, as `decode` has it.

    Decoding where the ids are joined spares a second Python worker beside each that joins.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = block_count(docs, "text", block_bytes)
    buckets = max(1, n // 3)
    id_type = docs.schema["id"].dataType.simpleString()
    types = {"id": arrow_type(docs.schema["id"].dataType), "text": pa.large_string()}
    blocks = dealt(docs, n, F.xxhash64("id", "text"))

    def coded(block: pa.Table) -> tuple[pa.Table, pa.Array, np.ndarray, np.ndarray]:
        """The rows, their distinct words, the word at each place, and offsets per row."""
        rows = opened(block, types)
        lists, counts = [pa.array([], pa.large_binary())], [np.zeros(1, np.int64)]
        for part in slices(rows.select(["text"]).combine_chunks().to_batches()):
            texts = [t or "" for t in part.column(0).to_pylist()]
            # one text may be long, and goes a stretch at a time
            groups = [[piece] for piece in stretches(texts[0])] if len(texts) == 1 else [texts]
            cut = [split_words(group, tokenizer) for group in groups]
            lists += [words for words, _ in cut]
            counts.append(np.diff(cut[0][1]) if len(texts) > 1 else np.array([sum(int(at[-1]) for _, at in cut)]))
        every = one(pa.chunked_array(lists).combine_chunks().dictionary_encode())
        return rows, every.dictionary, every.indices.to_numpy(), spans(np.concatenate(counts)[1:])

    def tell(block: pa.Table) -> pa.Table:
        return word_items(coded(block)[1], buckets)[0]

    def solve(items: pa.Table) -> pa.Table:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok, words = loaded(tokenizer), one(items["word"])
        narrow = np.uint16 if tok.get_vocab_size() <= 1 << 16 else np.int32
        ids, lengths = [np.empty(0, narrow)], np.zeros(len(words), np.int64)
        for a in range(0, len(words), 10_000):
            for i, e in enumerate(tok.encode_batch_fast([w.decode() for w in words.slice(a, 10_000).to_pylist()], add_special_tokens=False)):
                ids.append(np.array(e.ids, narrow))
                lengths[a + i] = len(ids[-1])
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(spans(lengths), pa.int32()), pa.array(np.concatenate(ids)))})

    def join_back(block: pa.Table, told: pa.Table) -> pa.Table:
        rows, known, codes, at = coded(block)
        _, place = word_items(known, buckets)
        answers = answers_of(told, len(known))
        if not len(known):
            return finished(rows, pa.array([[]] * rows.num_rows, pa.list_(pa.int32())))
        values, begins = flat(answers["ids"])
        which = place[codes]
        ids = laid_out(values.to_numpy().astype(np.int32), begins, which)
        size = spans(np.diff(begins)[which])
        return relaxed(finished(rows, pa.ListArray.from_arrays(pa.array(size[at], pa.int32()), pa.array(ids))))

    def finished(rows: pa.Table, ids: pa.Array) -> pa.Table:
        out = pa.table({"id": rows["id"], "ids": ids})
        if out_col is None:
            return out
        parts = [pa.array(decoded(b.column(1), tokenizer), pa.string()) for b in slices(out.to_batches())]
        return out.append_column(out_col, pa.chunked_array(parts, pa.string()))

    told = exchange(blocks, tell, merging_words(buckets), solve, n, buckets, fan=fan)
    both = blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(join_back, f"id {id_type}, ids array<int>" + (f", {out_col} string" if out_col else ""))
    return both.withColumnRenamed("id", id_col)


def decoded(lists: pa.Array, tokenizer: str) -> list[str]:
    """The text of each list of ids; bytes that are no UTF-8 become U+FFFD.

    The distinct ids are joined with the id-to-piece table (as many rows as the vocabulary) and
    the pieces laid out by position; an id without a piece adds nothing.
    """
    ids, at = flat(lists)
    ids = ids.cast(pa.int32())
    known = pc.unique(ids)
    seen = pa.table({"id": known, "row": pa.array(range(len(known)), pa.int32())})
    data = one(seen.join(piece_table(tokenizer), "id", join_type="left outer").sort_by("row")["piece"]).fill_null(b"")
    row_of = pc.index_in(ids, value_set=known).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    starts = spans(pc.binary_length(data).to_numpy(zero_copy_only=False))
    ends = spans((starts[1:] - starts[:-1])[row_of])[at]
    flat_bytes = laid_out(raw, starts, row_of).tobytes()
    return [flat_bytes[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def decode(encoded: DataFrame, tokenizer: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with one more column, the text of its ids; null lists give empty texts."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*encoded.schema.fields]).add(out_col, StringType())

    def texts(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded(batch.column(ids_col), tokenizer), pa.string())], [*batch.schema.names, out_col])

    return encoded.mapInArrow(texts, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the query: length, and digests of ids and of the decoded text."""
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
