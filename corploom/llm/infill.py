"""Fill-in-the-middle: texts cut at two units, their parts in the order that a model is to see them.

A unit is a run of ASCII letters or any other code point.  Counting units goes over the bytes of
a batch of texts in stretches of fixed size, and keeps of them only a sparse index: at the first
unit of each text and at every `every`-th unit, the unit's number and its place in bytes and in
code points.  A cut after so many units is found by binary search in the index and by scanning
the few units from that checkpoint on.  What is kept per text is two cuts, however long it is.

A text without units, or that has one of the markers in it, or that its draw says so of, stays
plain; the others become prefix, suffix, middle (psm) or suffix, prefix, middle (spm).  Draws come
from SHA-256 of a seed and the id, so rows of one id are cut by the same draws, and null ids by those of the seed alone.
Null texts are empty.  Very long texts take a few times their size of memory, in one task.
Repeated rows each come back; an empty table gives an empty one; columns other than id and text
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, strings

MARKERS = ("<P>", "<S>", "<M>")  # fixed values: before prefix, suffix and middle
EVERY = 256
STRETCH = 1 << 18


def unit_starts(raw: np.ndarray, edges: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """For bytes low to high of texts laid end to end: where code points begin, and where units do."""
    part = raw[low:high]
    lead = (part & 0xC0) != 0x80
    lower = part | 0x20
    letter = (lower >= 97) & (lower <= 122)
    inner = np.empty(len(part), bool)
    inner[1:] = letter[1:] & letter[:-1]
    inner[:1] = letter[:1] & (low > 0 and chr(raw[low - 1]).isalpha() and raw[low - 1] < 128)
    inner[edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low] = False  # a unit ends with its text
    return lead, lead & ~inner


class Index:
    """Checkpoints of texts laid end to end: units, bytes and code points that lie before each."""

    def __init__(self, raw: np.ndarray, edges: np.ndarray, every: int = EVERY, stretch: int = STRETCH):
        self.raw, self.edges = raw, edges
        units, at, chars = [], [], []
        n_units = n_chars = 0
        for low in range(0, len(raw), stretch):
            high = min(low + stretch, len(raw))
            lead, start = unit_starts(raw, edges, low, high)
            begins = np.flatnonzero(start)
            here = edges[np.searchsorted(edges, low) : np.searchsorted(edges, high)] - low
            kept = np.union1d(begins[-n_units % every :: every], here)
            units.append(n_units + np.searchsorted(begins, kept))
            at.append(low + kept)
            chars.append(n_chars + np.concatenate([[0], np.cumsum(lead)])[kept])
            n_units += len(begins)
            n_chars += int(lead.sum())
        self.units = np.concatenate([*units, [n_units]])
        self.bytes = np.concatenate([*at, [len(raw)]])
        self.chars = np.concatenate([*chars, [n_chars]])
        self.first = np.searchsorted(self.bytes, edges)  # of each text, and of the end
        self.counts = np.diff(self.units[self.first])

    def cut(self, text: int, unit: int) -> tuple[int, int]:
        """Byte and code point, of all texts, at which this unit of the text begins, or the text ends."""
        wanted = self.units[self.first[text]] + unit
        k = int(np.searchsorted(self.units, wanted, "right")) - 1
        byte, char, more = int(self.bytes[k]), int(self.chars[k]), int(wanted - self.units[k])
        if more:
            lead, start = unit_starts(self.raw, self.edges, byte, int(self.bytes[k + 1]))
            gone = int(np.flatnonzero(start)[more])
            byte, char = byte + gone, char + int(lead[:gone].sum())
        return byte, char


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain: int = 10, spm: int = 20, every: int = EVERY) -> DataFrame:
    """Rows (id, n, form, prefix_chars, middle_chars, output); plain and spm are shares in percent, the latter of texts that are cut."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), digest.alias("digest")).select("id", "text", *[draw(k) for k in range(4)])
    marks = [m.encode() for m in MARKERS]

    def run(batches):
        for batch in slices(batches):
            texts = strings(batch.column("text"))
            _, at, data = texts.buffers()
            at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.empty(0, np.uint8)
            edges = at - at[0]
            index, out = Index(raw, edges, every), []
            draws = zip(*[batch.column(f"h{k}").to_pylist() for k in range(1, 5)], strict=True)
            for t, (n, (h1, h2, h3, h4)) in enumerate(zip(index.counts.tolist(), draws, strict=True)):
                whole = raw[edges[t] : edges[t + 1]].tobytes()
                if not n or h3 % 100 >= 100 - plain or any(m in whole for m in marks):
                    out.append((n, "plain", None, None, whole.decode()))
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                (b0, c0), (b1, c1), (b2, c2) = (index.cut(t, x) for x in (0, low, high))
                prefix, middle, suffix = whole[: b1 - b0], whole[b1 - b0 : b2 - b0], whole[b2 - b0 :]
                form = "spm" if h4 % 100 < spm else "psm"
                p, s, m = marks
                made = [s, suffix, p, prefix, m, middle] if form == "spm" else [p, prefix, s, suffix, m, middle]
                out.append((n, form, c1 - c0, c2 - c1, b"".join(made).decode()))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {id_type}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of.  Markers do not occur in texts that are cut, so the parts between them are exact."""
    parts = F.split(output, "|".join(MARKERS), -1)  # what comes before the first marker is empty
    return F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))).when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))).otherwise(output)


def digests(made: DataFrame, id_col: str = "doc_id") -> DataFrame:
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
