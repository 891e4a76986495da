"""Exact Jaccard join of shingle sets by pivots, and the groups that its links make.

The space splits first where it must: shingles, ranked by how few texts have them, are pivots, and
two texts that link share one among the first |x| - ceil(t |x|) + 1 of each, so texts that no
chain of shared pivots connects lie in different blocks.  Inside a block distances say something, and
the metric join runs: pivot texts make Voronoi regions, a text is also copied to every region
whose pivot is at most 2 eps further than its nearest (the triangle inequality: a link's other
end cannot lie elsewhere), and a region joins by itself, or splits again.  What a pivot settles
(all within eps of it are linked through it) is not compared again.

Blocks beyond max_region texts are split across the cluster by the same rule before any task holds them.  Equal texts count once.

Parts that pivots do not make smaller (texts that are alike to none of them) lie in one region, the far one, and go by the shingles of
their prefixes; what one shingle brings together is cut by size and hash into pieces that meet in pairs, so
that no task gets more than max_region texts, but for a single very long one, which takes memory of some tens of times its size.

Null and empty texts, and texts without words, have no shingles and link with nothing.  Fewer
than k words make one shingle.  Null ids and repeated ids: ids are taken as keys, rows of one
id with equal text are one node, and null ids come back as their own group.  An empty table gives an
empty one; ties in rank fall by hash; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, block_count, dealt, mixed, one, opened, relaxed, shingles, slices, stored, strings, word_keys
from .components import components
from .shared import FAN, KEY_BITS, counted, key_counts


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle keys."""
    keys, at = word_keys(strings(texts))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        out.append(np.unique(shingles(keys[a:b], min(k, b - a))) if b > a else np.empty(0, np.uint64))
    return out


def linked(inter: np.ndarray, na: np.ndarray, nb: np.ndarray, num: int, den: int) -> np.ndarray:
    return (inter > 0) & (den * inter >= num * (na + nb - inter))


class Region:
    """Texts of one region in a task, and the links found between them."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int, leaf: int = 24, fan: int = 6):
        self.sets, self.num, self.den, self.leaf, self.fan = sets, num, den, leaf, fan
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.eps = 1 - num / den
        self.parent = list(range(len(sets)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)

    def shared(self, p: int, members: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of p with each of members."""
        parts = [self.sets[m] for m in members.tolist()]
        ends = np.cumsum([len(x) for x in parts])
        every, mine = np.concatenate(parts), self.sets[p]
        at = np.searchsorted(mine, every)
        at[at == len(mine)] = 0
        total = np.concatenate([[0], np.cumsum(mine[at] == every)])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])]

    def compare(self, p: int, members: np.ndarray) -> None:
        """Link p with those of members that it links with, of components that it isn't in."""
        low, high = self.sizes[p] * self.num, self.sizes[p] * self.den
        fit = members[(self.sizes[members] * self.den >= low) & (self.sizes[members] * self.num <= high)]
        root = self.find(p)
        other = np.array([m for m in fit.tolist() if self.find(m) != root], np.int64)
        if len(other):
            inter = self.shared(p, other)
            for m in other[linked(inter, self.sizes[p], self.sizes[other], self.num, self.den)].tolist():
                self.union(p, m)

    def join(self, home: np.ndarray, guest: np.ndarray, depth: int = 0) -> None:
        """Find what connects home texts with each other and with guests."""
        if not len(home):
            return
        every = np.concatenate([home, guest])
        if len({self.find(i) for i in every.tolist()}) <= 1:
            return
        if len(every) <= self.leaf or depth >= 12:
            for i, p in enumerate(home.tolist()):
                self.compare(p, np.concatenate([home[i + 1 :], guest]))
            return
        # the first pivot is the first text, each next one the text furthest from those before
        pivots, apart = [int(home[0])], []
        for _ in range(min(self.fan, len(home))):
            p = pivots[-1]
            inter = self.shared(p, every)
            apart.append(1 - inter / (self.sizes[every] + self.sizes[p] - inter))
            for m in every[linked(inter, self.sizes[p], self.sizes[every], self.num, self.den)].tolist():
                self.union(p, m)
            far = np.min(apart, axis=0)[: len(home)]
            if far.max() <= 0:
                break
            pivots.append(int(home[far.argmax()]))
        pivots = pivots[: len(apart)]
        d = np.array(apart)
        nearest = d.argmin(0)
        reach = d.min(0) + 2 * self.eps + 1e-9
        for q in range(len(pivots)):
            mine = np.flatnonzero(nearest[: len(home)] == q)
            near = np.flatnonzero((d[q] <= reach) & ~((nearest == q) & (np.arange(len(every)) < len(home))))
            inside = np.concatenate([mine, near])
            if not len(mine) or not len(inside):
                continue
            # texts whose window around the pivot holds one component only have nothing to find
            dist, roots = d[q][inside], np.array([self.find(i) for i in every[inside].tolist()])
            order = np.argsort(dist, kind="stable")
            dist, roots = dist[order], roots[order]
            change = np.concatenate([[0], np.cumsum(roots[1:] != roots[:-1])])
            low = np.searchsorted(dist, dist - self.eps - 1e-9, "left")
            high = np.searchsorted(dist, dist + self.eps + 1e-9, "right") - 1
            open_ = np.zeros(len(inside), bool)
            open_[order] = change[high] != change[low]
            a, b = every[mine[open_[: len(mine)]]], every[near[open_[len(mine) :]]]
            if len(a) and len(a) + len(b) < 0.9 * len(every):
                self.join(a, b, depth + 1)
            elif len(a):  # no smaller: texts that are alike to no pivot
                self.meet(a, b)

    def meet(self, home: np.ndarray, guest: np.ndarray) -> None:
        """Compare home texts with each other and with guests where they share one of the shingles that are rarest here: two that link share one among the first |x| - ceil(t |x|) + 1 of each."""
        every = np.concatenate([home, guest])
        sets = [self.sets[i] for i in every.tolist()]
        known, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((known, counts))] = np.arange(len(known))
        order, at, of, what = rank[code], 0, [], []
        for i, n in enumerate(len(x) for x in sets):
            mine = order[at : at + n]
            first = n - -(-n * self.num // self.den) + 1
            of.append(np.full(first, i))
            what.append(np.partition(mine, first - 1)[:first] if first < n else mine)
            at += n
        of, what = np.concatenate(of), np.concatenate(what)
        by = np.lexsort((of, what))
        of, what = of[by], what[by]
        edges = np.append(np.flatnonzero(np.concatenate([[True], what[1:] != what[:-1]])), len(what))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                group = of[a:b]  # home texts come first
                for k, i in enumerate(group[group < len(home)].tolist()):
                    if k + 1 < len(group):
                        self.compare(int(every[i]), every[group[k + 1 :]])


def groups(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", max_region: int = 20_000, block_bytes: int = BLOCK_BYTES, fan: int = FAN) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = block_count(docs, "text", block_bytes)
    blocks = dealt(docs, n, F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id")))
    types = {"id": pa.int64(), "text": pa.large_string()}

    # equal texts are one text: all but the least id stand aside until the end
    hashed = docs.where("id is not null and text is not null").select("id", F.xxhash64(F.lit(1), "text").alias("h1"), F.xxhash64(F.lit(2), "text").alias("h2"))
    same = hashed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("top")).where("rep < top").select("h1", "h2", "rep")
    copies = stored(hashed.join(same, ["h1", "h2"]).where("id <> rep").select("id", "rep").groupBy("id").agg(F.min("rep").alias("rep")))
    aside = copies.select(F.pmod(F.xxhash64(F.xxhash64("id")), F.lit(n)).cast("int").alias("block"), F.lit(-1).cast("long").alias("node"), F.lit(None).cast("binary").alias("blob"), "id")

    def own_sets(block: pa.Table, more: pa.Table) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
        rows = opened(block, types)
        ids = one(rows["id"])
        out = ~np.isin(ids.fill_null(0).to_numpy(), more["id"].drop_null().to_numpy())
        return ids, sets_of(rows["text"], k), out & ids.is_valid().to_numpy(zero_copy_only=False)

    def keyed(ids: pa.Array, sets: list[np.ndarray], own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mine = [s if o else s[:0] for s, o in zip(sets, own.tolist(), strict=True)]
        return np.concatenate([np.empty(0, np.uint64), *mine]) >> np.uint64(64 - KEY_BITS), np.repeat(ids.fill_null(0).to_numpy(), [len(s) for s in mine])

    def pivots(block: pa.Table, told: pa.Table) -> pa.Table:
        ids, sets, own = own_sets(block, told)
        known, counts = key_counts(*keyed(ids, sets, own), told.filter(pc.greater_equal(told["node"], 0)))
        prefixes = []
        for s, o in zip(sets, own.tolist(), strict=True):
            if not o or not len(s):
                prefixes.append(np.empty(0, np.int64))
                continue
            rank = counts[np.searchsorted(known, s >> np.uint64(64 - KEY_BITS))]
            first = len(s) - -(-len(s) * num // den) + 1
            if (rank == 1).sum() >= first:  # pivots that nobody shares: nothing to meet
                prefixes.append(np.empty(0, np.int64))
                continue
            order = np.lexsort((mixed(s), rank))[:first]
            prefixes.append(s[order][rank[order] > 1].view(np.int64))
        at = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
        return relaxed(pa.table({"id": ids, "n": pa.array([len(s) for s in sets], pa.int64()), "pivots": lists}))

    known = counted(blocks, lambda block, more: keyed(*own_sets(block, more)), n, max(1, n // 3), aside, fan)
    both = known.select("block", "node", "blob", F.lit(None).cast("long").alias("id")).unionByName(aside)
    seen = stored(blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(pivots, "id long, n long, pivots array<long>"))
    entries = seen.select("id", F.explode("pivots").alias("pivot"))
    hubs = entries.groupBy("pivot").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top")
    near = entries.join(hubs.select("pivot", "hub"), "pivot").where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v"))
    block = components(near)
    block = stored(block.unionAll(block.select(F.col("component").alias("node"), "component")).distinct())
    prefixes = seen.select("id", "n", F.explode("pivots").alias("pivot"))
    joined = components(metric_links(docs.where('id is not null'), block, prefixes, k, num, den, max_region))
    named = seen.join(copies, "id", "left").withColumn("rep", F.coalesce("rep", "id"))
    out = named.join(joined, named["rep"] == joined["node"], "left")
    linked_to = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), linked_to.alias("component_id"))


def placing(shared, k: int, num: int, den: int):
    """A function of batches that puts each text in the region of each pivot that may matter to it; without pivots it stays.

    Texts farther than 1 - eps from every pivot make a region of their own, the far one, to which those farther than 1 - 2 eps are copied.
    """
    eps = 1 - num / den
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.bool_())

    def place(batches):
        for batch in slices(batches):
            rows = []
            for region, home, node, text, mine in zip(*(batch.column(c).to_pylist() for c in ("region", "home", "id", "text")), sets_of(batch.column("text"), k), strict=True):
                ps = shared.value.get(region)
                if ps is None:
                    rows.append((region, None, home, node, text, None, False, False))
                    continue
                inter = np.array([len(np.intersect1d(mine, s, assume_unique=True)) for _, s in ps])
                size = np.array([len(s) for _, s in ps])
                d = 1 - inter / (size + len(mine) - inter)
                ok = linked(inter, len(mine), size, num, den)
                best = int(d.argmin())
                far = d[best] > 1 - eps
                if d[best] > 1 - 2 * eps - 1e-9:
                    rows.append((region, 0, bool(home and far), node, text, 2.0, False, True))
                if not far:
                    for q in np.flatnonzero((d <= d[best] + 2 * eps + 1e-9) | ok).tolist():
                        rows.append((region, ps[q][0], bool(home and q == best), node, text, float(d[q]), bool(ok[q]), False))
            cols = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["region", "pivot", "home", "id", "text", "d", "ok", "far"])

    return place


def by_shingles(stuck: DataFrame, prefixes: DataFrame, num: int, den: int, max_region: int, region_bytes: int) -> DataFrame:
    """Rows (region, home, id, text) of regions that pivots do not part, by the shingles of their texts' prefixes (id, n, pivot).

    Texts that link share one of them, and shingles that the same texts of a region have are one.  What a shingle brings together
    beyond max_region texts or region_bytes is cut by size and hash: texts that link have sizes of the same or of
    neighbouring powers of den / num, so each piece meets the pieces of its own power and of the next.
    """
    held = stored(stuck.select("region", "id").distinct().join(prefixes, "id"))
    lists = held.groupBy("region", "pivot").agg(F.count(F.lit(1)).alias("m"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x")).where("m > 1")
    chosen = lists.groupBy("region", "m", "s", "x").agg(F.min("pivot").alias("pivot")).select("region", "pivot")
    texts = stuck.select("region", "id", "text").distinct()
    power = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num)) + 1e-9).cast("int")
    met = held.join(chosen, ["region", "pivot"]).select("region", "id", F.xxhash64("region", "pivot").alias("part"), power.alias("power"))
    sizes = stored(met.join(texts.select("region", "id", F.octet_length("text").alias("b")), ["region", "id"]).groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.sum("b").alias("b")))
    pieces = sizes.select("part", F.when((F.col("m") <= max_region) & (F.col("b") <= region_bytes), 0).otherwise(F.ceil(F.greatest(2 * F.col("m") / max_region, 2 * F.col("b") / region_bytes))).cast("int").alias("pieces"))
    dealt = met.join(pieces, "part").withColumn("piece", F.when(F.col("pieces") > 0, F.pmod(F.xxhash64(F.lit(2), "id"), F.col("pieces"))).otherwise(0).cast("int"))
    whole = F.array(F.col("part"))
    others = F.sequence(F.lit(0), F.col("pieces") - 1)
    same = F.transform(others, lambda j: F.xxhash64("part", "power", F.least("piece", j), F.lit(0), F.greatest("piece", j)))
    above = F.transform(others, lambda j: F.xxhash64("part", "power", "piece", F.lit(1), j))
    below = F.transform(others, lambda j: F.xxhash64("part", F.col("power") - 1, j, F.lit(1), "piece"))
    to = F.when(F.col("pieces") == 0, whole).otherwise(F.concat(same, above, below))
    spread = dealt.select("region", "id", F.explode(to).alias("to")).distinct()
    return spread.join(texts, ["region", "id"]).select(F.col("to").alias("region"), F.lit(True).alias("home"), "id", "text")


def metric_links(docs: DataFrame, block: DataFrame, prefixes: DataFrame, k: int, num: int, den: int, max_region: int, pivots_each: int = 16, region_bytes: int = 64 << 20, pivot_bytes: int = 64 << 20) -> DataFrame:
    """Edges (u, v) that connect what links connect inside each block (node, component).

    A region of more than max_region texts or region_bytes of text splits by pivots, again and again, as long as that makes its parts
    smaller; a part that is hardly smaller splits by the shingles of its texts' prefixes.  No task gets a larger region than
    that, but for single texts.  Pivots go to the executors pivot_bytes at a time, so that more of them cost passes, not memory.
    """
    members = stored(docs.join(block, docs["id"] == block["node"]).select(F.col("component").alias("region"), F.lit(True).alias("home"), "id", "text"))
    eps, found, done, level = 1 - num / den, [], None, 0
    pivot_type = "region long, id long, n long, keys binary"

    def as_sets(batches):
        for batch in batches:
            sets = sets_of(batch.column("text"), k)
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["region", "id", "n", "keys"])

    while True:
        sizes = members.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
        sizes = sizes.where((F.col("n") > max_region) | ((F.col("bytes") > region_bytes) & (F.col("n") > 2))).drop("bytes")
        big = members.join(stored(sizes), "region")
        order = F.xxhash64(F.lit(level), "id")
        # some 40 times the wanted number pass the threshold, whatever the region's size
        share = F.pmod(order, F.lit(1 << 30)) < (F.lit(40.0 * pivots_each * (1 << 30)) / F.col("n"))
        place = F.row_number().over(Window.partitionBy("region").orderBy(order, "id"))
        picked = stored(big.where("home").where(share).withColumn("place", place).where(F.col("place") <= pivots_each).select("region", "id", "text").mapInArrow(as_sets, pivot_type))
        row = picked.agg(F.count(F.lit(1)), F.sum(F.octet_length("keys"))).first()
        if not row[0]:
            break
        parts, placed = max(1, -(-row[1] // pivot_bytes)), None
        for part in range(parts):
            mine = F.pmod(F.xxhash64("region"), F.lit(parts)) == part
            chosen: dict = {}
            for r in picked.where(mine).collect():  # pivot_bytes, about
                chosen.setdefault(r["region"], []).append((r["id"], np.frombuffer(r["keys"], np.uint64)))
            for ps in chosen.values():
                ps.sort(key=lambda p: p[0])
            more = members.where(mine).mapInArrow(placing(docs.sparkSession.sparkContext.broadcast(chosen), k, num, den), "region long, pivot long, home boolean, id long, text string, d double, ok boolean, far boolean")
            placed = more if placed is None else placed.unionAll(more)
        placed = stored(placed)
        found.append(placed.where("ok").select(F.col("id").alias("u"), F.col("pivot").alias("v")))
        outer = placed.where("pivot is not null and not ok").groupBy("region", "pivot", "far").agg(F.min("d").alias("least"))
        # texts within eps of the pivot are one component; of them only those that an outer text can reach stay
        kept = placed.join(outer, ["region", "pivot", "far"]).where((~F.col("ok")) | (F.col("d") >= F.col("least") - eps - 1e-9))
        split = stored(kept.select(F.xxhash64("region", "pivot", "far").alias("region"), "home", "id", "text", F.col("region").alias("of")))
        # a part that is hardly smaller than what it is of would split for ever: it goes by shingles
        whole = stored(split.groupBy("region", "of").agg(F.count(F.lit(1)).alias("m")).join(sizes.withColumnRenamed("region", "_of"), F.col("of") == F.col("_of")).where("m > 0.9 * n").select("region"))
        rest = placed.where("pivot is null").select("region", "home", "id", "text")
        stuck = split.join(whole, "region", "left_semi").select("region", "home", "id", "text")
        done = stuck if done is None else done.unionAll(stuck)
        members = stored(rest.unionAll(split.join(whole, "region", "left_anti").select("region", "home", "id", "text")))
        level += 1
    if done is not None:
        members = members.unionAll(by_shingles(stored(done), prefixes, num, den, max_region, region_bytes))

    def join_region(rows: pa.Table) -> pa.Table:
        ids = rows["id"].to_numpy()
        home = rows["home"].to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, ~home))
        region = Region([s for s in sets_of(rows["text"].take(pa.array(order)), k)], num, den)
        n = int(home.sum())
        region.join(np.arange(n), np.arange(n, len(ids)))
        roots = np.array([region.find(i) for i in range(len(ids))], np.int64)
        moved = roots != np.arange(len(ids))
        ids = ids[order]
        return relaxed(pa.table({"u": pa.array(ids[moved]), "v": pa.array(ids[roots[moved]])}))

    links = members.groupBy("region").applyInArrow(join_region, "u long, v long")
    for more in found:
        links = links.unionAll(more)
    return links
