"""Near duplicates among vectors: an epsilon grid order join, exact for any data.

Vectors of one class (label and length) link where their cosine is `least` or more, that is,
where unit vectors lie within epsilon = sqrt(2 - 2 * least) of each other.  Equal vectors meet
first and go on as one, with their number.  The second moments of all vectors give principal
directions; along the first few of them a grid of cells of a quarter of epsilon orders the vectors, class
before all, and the order is cut into blocks of bounded size.  A block knows the range of its
vectors along each direction and that of what is left beside these directions; the gaps between
two blocks' ranges bound their distance from below, since a projection shortens no distance the
wrong way.  Intervals of sixteen blocks, of sixteen such intervals, and so on, are joined from
the whole order down: a pair of intervals goes on to the pairs of its parts, but for those that
are of other classes or provably farther apart than epsilon.  Pairs of blocks that are left are
joined by tasks that halve them in the same way and take cosines, in double precision, of what
remains.  Of a pair of blocks a task tells how many links each vector has, and the least vector
that it reaches there: never the links one by one, so a group of near copies costs no more rows
than it has vectors.

Where vectors spread evenly over all directions few blocks are provably distant, and the join
then takes nearly all cosines within a class; that is slow, but still exact.

Vectors that are null, empty or zero, or that hold null or non-finite components, and those with a null label, link
with nothing.  Vectors of different lengths do not link.  Rows that repeat are vectors of their own that link; null
ids come back with a null component if alone, and never name one.  An empty table gives an
empty one.  Columns other than the three that are named are ignored, whatever their names.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, loose, one, relaxed, slices, squeezed, stored
from .components import components

DIRECTIONS = 8
BLOCK = 2048  # vectors, and
BLOCK_BYTES = 4 << 20  # bytes that a block holds at most
LEAF = 256
FAN_BITS = 4  # an interval has 16 parts
WIDEST = 512  # principal directions are sought among so many leading components
SLACK = 1e-9  # on squared distances between blocks, for rounding
SIDES = [f"{side}{k}" for side in ("low", "high") for k in range(DIRECTIONS + 1)]


def unit(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Vectors, laid end to end, divided by their norms; scaled before, so that no square overflows or vanishes."""
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    values = values.astype(np.float64)
    values /= np.maximum.reduceat(np.abs(values), offsets[:-1])[of]
    return values / np.sqrt(np.add.reduceat(values * values, offsets[:-1]))[of]


def leading(values: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """A row a vector: its first components, zeros after its last."""
    out = np.zeros((len(offsets) - 1, width))
    size = np.diff(offsets)
    for n in np.unique(size).tolist():
        rows = np.flatnonzero(size == n)
        out[rows, : min(n, width)] = values[(offsets[:-1][rows, None] + np.arange(min(n, width)))]
    return out


def usable(label: str, vector: str) -> Column:
    """Whether a row can link with others."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(F.col(label).isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def directions(vectors: DataFrame, width: int) -> np.ndarray:
    """Orthonormal columns along which the vectors spread most; sums of products are added up in two steps, a matrix a partition."""

    def products(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for part in slices([batch], 4 << 20):
                values, at = flat(part.column("unit"))
                if len(at) > 1:
                    x = leading(values.to_numpy(), at, width)
                    total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def added(batches):
        total = np.zeros((width, width))
        for batch in batches:
            for m in batch.column("m"):
                total += np.frombuffer(m.as_py()).reshape(width, width)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = vectors.select("unit").mapInArrow(products, "m binary")
    sums = parts.repartition(16).mapInArrow(added, "m binary").collect()  # sixteen matrices
    total = sum((np.frombuffer(r["m"]).reshape(width, width) for r in sums), np.zeros((width, width)))
    _, vectors_by_value = np.linalg.eigh(total)
    return np.ascontiguousarray(vectors_by_value[:, ::-1][:, :DIRECTIONS])


def gridded(vectors: DataFrame, basis: np.ndarray, epsilon: float) -> DataFrame:
    """vectors with their cells along the directions."""
    names = vectors.columns

    def project(batches):
        for batch in slices(batches):
            values, at = flat(batch.column("unit"))
            y = leading(values.to_numpy(), at, len(basis)) @ basis
            cells = np.floor(y * (4 / epsilon)).astype(np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.arange(len(y) + 1) * cells.shape[1]), pa.array(cells.ravel())).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], [*names, "cells"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(project, f"{kinds}, cells array<long>")


def blocked(rows: DataFrame, basis: np.ndarray, block: int = BLOCK) -> DataFrame:
    """Rows in grid order, cut into blocks: (part, seq, first, last, low*, high*, blob)."""
    order = ["class", "cells", "node"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def cut(batches):
        held, size, seq = [], 0, 0

        def told(tables: list[pa.Table], number: int) -> pa.RecordBatch:
            t = pa.concat_tables(tables)
            values, at = flat(t["unit"])
            values = values.to_numpy()
            y = leading(values, at, len(basis)) @ basis
            y = np.concatenate([y, np.zeros((len(y), DIRECTIONS - y.shape[1]))], 1)
            beside = np.sqrt(np.maximum(0.0, 1.0 - (y * y).sum(1)))
            y = np.concatenate([y, beside[:, None]], 1)
            classes = t["class"].to_pylist()
            blob = squeezed(pickle.dumps((one(t["node"]).to_numpy().tobytes(), one(t["copies"]).to_numpy().tobytes(), classes, values.tobytes(), at.tobytes(), y.tobytes()), 5))
            fields = {"part": t["part"][0].as_py(), "seq": number, "first": classes[0], "last": classes[-1]}
            fields |= dict(zip(SIDES, [*y.min(0).tolist(), *y.max(0).tolist()], strict=True)) | {"blob": blob}
            return pa.RecordBatch.from_pylist([fields], BLOCK_SCHEMA)

        for batch in slices(batches):
            a = 0
            while a < batch.num_rows:
                width = len(batch.column("unit")[a])
                room = max(1, min(block, BLOCK_BYTES // (8 * width)) - size)
                held.append(pa.Table.from_batches([batch.slice(a, room)]))
                a, size = a + held[-1].num_rows, size + held[-1].num_rows
                if size >= min(block, max(1, BLOCK_BYTES // (8 * width))):
                    yield told(held, seq)
                    held, size, seq = [], 0, seq + 1
        if held:
            yield told(held, seq)

    kinds = ", ".join(f"{s} double" for s in SIDES)
    return rows.select("part", "node", "copies", "class", "unit").mapInArrow(cut, f"part int, seq int, first string, last string, {kinds}, blob binary")


BLOCK_SCHEMA = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.string()), ("last", pa.string()), *[(s, pa.float64()) for s in SIDES], ("blob", pa.binary())])


def near(a: str, b: str, epsilon: float) -> Column:
    """Whether two intervals may hold vectors of one class within epsilon."""
    gap = lambda k: F.greatest(F.lit(0.0), F.col(f"{a}.low{k}") - F.col(f"{b}.high{k}"), F.col(f"{b}.low{k}") - F.col(f"{a}.high{k}"))
    square = sum((F.pow(gap(k), 2) for k in range(DIRECTIONS + 1)), F.lit(0.0))
    return (F.col(f"{a}.first") <= F.col(f"{b}.last")) & (F.col(f"{b}.first") <= F.col(f"{a}.last")) & (square <= epsilon * epsilon + SLACK)


def block_pairs(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs (a, b) of blocks, a <= b, that may hold links: intervals are joined from the whole order down."""
    facts = ["first", "last", *SIDES]
    low, high = F.min, F.max
    sums = [low("first").alias("first"), high("last").alias("last"), *[(low if s.startswith("low") else high)(s).alias(s) for s in SIDES]]
    levels = [blocks.select("code", *facts)]
    last = blocks.agg(F.max("code")).first()[0] or 0
    while last:
        levels.append(stored(levels[-1].groupBy(F.shiftright("code", FAN_BITS).alias("code")).agg(*sums)))
        last >>= FAN_BITS
    pairs = levels[-1].select(F.col("code").alias("a"), F.col("code").alias("b"))
    for parts in levels[-2::-1]:
        below = parts.withColumn("up", F.shiftright("code", FAN_BITS))
        wide = pairs.alias("p").join(below.alias("x"), F.col("p.a") == F.col("x.up")).join(below.alias("y"), F.col("p.b") == F.col("y.up"))
        pairs = stored(wide.where((F.col("x.code") <= F.col("y.code")) & near("x", "y", epsilon)).select(F.col("x.code").alias("a"), F.col("y.code").alias("b")))
    return pairs


class Block:
    """A block's vectors as they came, in grid order."""

    def __init__(self, blob: bytes):
        node, copies, classes, values, at, y = pickle.loads(loose(blob))
        self.node, self.copies, self.values, self.at = (np.frombuffer(x, kind) for x, kind in ((node, np.int64), (copies, np.int64), (values, np.float64), (at, np.int64)))
        self.y = np.frombuffer(y).reshape(len(self.node), DIRECTIONS + 1)
        self.runs: dict[str, tuple[int, int]] = {}
        edges = [0, *[i for i in range(1, len(classes)) if classes[i] != classes[i - 1]], len(classes)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            self.runs[classes[a]] = (a, b)

    def rows(self, a: int, b: int) -> np.ndarray:
        return self.values[self.at[a] : self.at[b]].reshape(b - a, -1)


def linked(x: Block, y: Block, same: bool, least: float, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of all links between two blocks, or within one; intervals are halved, and skipped where they are too far apart."""
    left, right = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for name in x.runs.keys() & y.runs.keys():
        todo = [(*x.runs[name], *y.runs[name])]
        while todo:
            a, b, c, d = todo.pop()
            if same and c < a:
                continue  # the mirror image of another part
            p, q = x.y[a:b], y.y[c:d]
            gap = np.maximum(0.0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
            if gap @ gap > epsilon * epsilon + SLACK:
                continue
            if b - a > LEAF or d - c > LEAF:
                ends = lambda u, v: [(u, v)] if v - u <= LEAF else [(u, (u + v) // 2), ((u + v) // 2, v)]
                todo += [(*i, *j) for i in ends(a, b) for j in ends(c, d)]
                continue
            i, j = np.nonzero(x.rows(a, b) @ y.rows(c, d).T >= least)
            i, j = i + a, j + c
            keep = i < j if same else slice(None)
            left.append(i[keep].astype(np.int32))
            right.append(j[keep].astype(np.int32))
    return np.concatenate(left), np.concatenate(right)


def told_links(x: Block, y: Block, same: bool, least: float, epsilon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links here, how many vectors they link with, and the least node that each reaches here."""
    i, j = linked(x, y, same, least, epsilon)
    n = len(x.node)
    j = j + (0 if same else n)
    nodes = x.node if same else np.concatenate([x.node, y.node])
    copies = x.copies if same else np.concatenate([x.copies, y.copies])
    counts = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
    low = nodes.copy()
    while len(i):
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            break
        low = new
    some = counts > 0
    return nodes[some], counts[some].astype(np.int64), low[some]


def links(blocks: DataFrame, pairs: DataFrame, least: float, epsilon: float) -> DataFrame:
    """Rows (node, n, low), one for each node with links in a pair of blocks."""
    held = blocks.select("code", "blob")
    both = pairs.join(held.withColumnsRenamed({"code": "a", "blob": "x"}), "a").join(held.withColumnsRenamed({"code": "b", "blob": "y"}), "b").select("a", "b", "x", "y")

    def join(batches):
        for batch in slices(batches, 1):  # a pair at a time
            a, b, x, y = (c[0].as_py() for c in batch.columns)
            left = Block(x)
            node, n, low = told_links(left, left if a == b else Block(y), a == b, least, epsilon)
            yield relaxed(pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(low)], ["node", "n", "low"]))

    return both.mapInArrow(join, "node long, n long, low long")


def groups(table: DataFrame, least: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """Rows (id, n_links, component_id, kept): how many other vectors each links with, and the least id that links reach."""
    if not 0 < least < 1:
        raise ValueError("least is a cosine between 0 and 1")
    epsilon = math.sqrt(2 - 2 * least)
    id_type = table.schema[id_col].dataType.simpleString()
    same = F.struct(F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = table.select(F.col(id_col).alias("id"), F.when(usable(label_col, vector_col), same).alias("s"))
    key = F.when(F.col("s").isNotNull(), F.sha2(F.concat_ws("|", F.col("s.label"), F.xxhash64(F.lit(1), "s"), F.xxhash64(F.lit(2), "s"), F.xxhash64(F.lit(3), "s")).cast("binary"), 256))
    rows = stored(rows.withColumn("key", key))
    alike = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least_id"), F.any_value("s").alias("s"))
    alike = alike.withColumn("class", F.concat_ws("|", F.size("s.v"), F.col("s.label")))

    def normal(batches):
        for batch in slices(batches):
            values, at = flat(batch.column("v"))
            made = pa.LargeListArray.from_arrays(pa.array(at), pa.array(unit(values.to_numpy(), at))).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("node", "key", "copies", "least_id", "class")], made], ["node", "key", "copies", "least_id", "class", "unit"])

    numbered = alike.select(F.monotonically_increasing_id().alias("node"), "key", "copies", "least_id", "class", F.col("s.v").alias("v"))
    vectors = stored(numbered.mapInArrow(normal, f"node long, key string, copies long, least_id {id_type}, class string, unit array<double>"))
    width = min(WIDEST, vectors.agg(F.max(F.size("unit"))).first()[0] or 1)
    basis = directions(vectors, width)
    blocks = stored(blocked(gridded(vectors.select("node", "copies", "class", "unit"), basis, epsilon), basis, block))
    most = blocks.agg(F.max("seq")).first()[0] or 0
    blocks = blocks.withColumn("code", F.shiftleft(F.col("part").cast("long"), most.bit_length()) + F.col("seq"))
    found = stored(links(blocks, block_pairs(blocks, epsilon), least, epsilon))
    reach = components(found.select(F.col("node").alias("u"), F.col("low").alias("v")))
    known = vectors.select("node", "key", "copies", "least_id").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(reach, "node", "left")
    known = known.withColumn("component", F.coalesce("component", "node"))
    names = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    known = known.join(names, "component").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = rows.select("id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
