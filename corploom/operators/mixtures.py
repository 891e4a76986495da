"""Selectors: each takes a pool and returns it with a column p, non-negative, that sums to one.

A pool has id, domain, bucket, score, mean_score, wrong, cr; it should be stored, since selectors read it
more than once.  Sums over the pool are one row and sums over groups one row a group, joined
back; no window spans the whole pool, nor a group of unbounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numpy_order import permuted
from .order import joined, placed, placed_within, quantiles, ranked

TAU = 1e-3
BAND = (0.65, 0.80)
FIXED_EDGES = (0.50, 0.60, 0.67, 0.73, 0.80, 0.90)  # fixed values: bucket boundaries


def with_total(df: DataFrame, **aggs: Column) -> DataFrame:
    """df with sums over all its rows: an aggregate of exactly one row."""
    return df.crossJoin(F.broadcast(df.agg(*[a.alias(n) for n, a in aggs.items()])))


def with_quantiles(df: DataFrame, value: str, levels: list[float], name: str) -> DataFrame:
    """df with the exact quantiles of value over all its rows, as an array."""
    return df.crossJoin(F.broadcast(quantiles(df, value, levels, name=name)))


def with_group(df: DataFrame, keys: list[str], **aggs: Column) -> DataFrame:
    """df with sums over its rows of the same keys; null keys are a group too."""
    return joined(df, df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggs.items()]), keys)


def clipped(column: str) -> Column:
    return F.greatest(F.col(column), F.lit(0.0))


def normalize(df: DataFrame, weight: Column, on_empty: str = "error") -> DataFrame:
    """p = weight / sum.  An empty sum: error, unavailable (all zero) or uniform."""
    out = with_total(df.withColumn("_w", weight), _t=F.sum("_w"), _n=F.count(F.lit(1)))
    otherwise = {"unavailable": F.lit(0.0), "uniform": 1.0 / F.col("_n"), "error": F.raise_error(F.lit("the selector has no support")).cast("double")}[on_empty]
    return out.withColumn("p", F.when(F.col("_t") > 0, F.col("_w") / F.col("_t")).otherwise(otherwise)).drop("_w", "_t", "_n")


def population(df: DataFrame) -> DataFrame:
    return normalize(df, F.lit(1.0))


def uniform_groups(df: DataFrame, key: str) -> DataFrame:
    return normalize(with_group(df, [key], _g=F.count(F.lit(1))), 1.0 / F.col("_g")).drop("_g")


def band(df: DataFrame, low: float = BAND[0], high: float = BAND[1], on_empty: str = "error") -> DataFrame:
    return normalize(df, F.col("cr").between(low, high).cast("double"), on_empty)


def bucket_prior(df: DataFrame, score: str = "score", tau: float = TAU, on_empty: str = "error") -> DataFrame:
    """Mass of a bucket: its clipped scores plus tau; uniform inside.  Buckets without rows have none."""
    inside = with_group(df, ["bucket"], _s=F.sum(clipped(score)), _m=F.count(F.lit(1)))
    return normalize(inside, (F.col("_s") + tau) / F.col("_m"), on_empty).drop("_s", "_m")


def strict_bucket_prior(df: DataFrame, score: str = "score") -> DataFrame:
    """No tau; a negative or missing score is refused; no mass at all is unavailable."""
    bad = F.col(score).isNull() | F.isnan(score) | (F.col(score) < 0)
    checked = df.withColumn(score, F.when(bad, F.raise_error(F.lit("scores must be finite and not negative")).cast("double")).otherwise(F.col(score)))
    return bucket_prior(checked, score, 0.0, "unavailable")


def direct_soft(df: DataFrame, tau: float = TAU) -> DataFrame:
    return normalize(df, clipped("mean_score") + tau)


def direct_hard(df: DataFrame, share: float = 0.25, key: str = "doc_id") -> DataFrame:
    """Uniform over the best ceil(share * n) by mean score, then id."""
    sized = with_total(placed(df, [F.col("mean_score").desc(), F.col(key)], "_r"), _k=F.ceil(F.count(F.lit(1)) * share))
    return normalize(sized, (F.col("_r") < F.col("_k")).cast("double")).drop("_k", "_r")


def cells(df: DataFrame) -> DataFrame:
    """One row a (domain, bucket): n, mean of the clipped score, and z of the mean over cells (0 where they do not vary)."""
    table = with_total(df.groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n_cell"), F.avg(clipped("score")).alias("mu")), _a=F.avg("mu"), _s=F.stddev_pop("mu"))
    return table.withColumn("z", F.when(F.col("_s") > 1e-12, (F.col("mu") - F.col("_a")) / F.col("_s")).otherwise(0.0)).drop("_a", "_s")


def cell_tilt(df: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Cells weigh n * exp(z), rows of one alike."""
    table = cells(df) if table is None else table
    return normalize(df.join(table, ["domain", "bucket"]), F.exp("z")).drop("n_cell", "mu", "z")


def shuffled_cell_tilt(df: DataFrame, seed: int = 1405) -> DataFrame:
    """cell_tilt with z dealt anew over the cells, by hash order."""
    table = cells(df)
    by_name, by_hash = Window.partitionBy().orderBy("domain", "bucket"), Window.partitionBy().orderBy("_h", "domain", "bucket")  # a row a cell
    hashed = table.withColumn("_h", F.sha2(F.concat_ws(":", F.lit(str(seed)), "domain", "bucket").cast("binary"), 256))
    both = hashed.withColumns({"_i": F.row_number().over(by_name), "_j": F.row_number().over(by_hash)})
    dealt = both.select("domain", "bucket", "n_cell", "mu", "_i").join(both.select(F.col("_j").alias("_i"), "z"), "_i").drop("_i")
    return cell_tilt(df, dealt)


def numpy_cell_tilt(df: DataFrame, seed: int) -> DataFrame:
    """cell_tilt with z dealt anew over the sorted cells by NumPy's generator; its seed is `seed` + 10,197."""
    return cell_tilt(df, permuted(cells(df), [F.col("domain"), F.col("bucket")], "z", seed + 10_197))


def averaged(df: DataFrame, key: str) -> DataFrame:
    """p averaged inside groups: the same marginals, nothing else of the selector."""
    return with_group(df, [key], _p=F.avg("p")).withColumn("p", F.col("_p")).drop("_p")


def centred_rank(df: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """Average rank in the stratum, centred: (rank - 0.5) / m - 0.5, 0 in a constant stratum."""
    sized = with_group(ranked(df, keys, value, "_rank"), keys, _n=F.count(F.lit(1)))
    return sized.withColumn(name, F.when(F.col("_m") == F.col("_n"), 0.0).otherwise((F.col("_rank") - 0.5) / F.col("_n") - 0.5)).drop("_rank", "_m", "_upto", "_n")


def tilted(df: DataFrame, value: Column, tilt: float) -> DataFrame:
    """tilt^z inside each cell, z the centred rank of value; cells keep their population mass."""
    z = centred_rank(df.withColumn("_c", value), ["domain", "bucket"], "_c", "_z").withColumn("_w", F.pow(F.lit(tilt), F.col("_z")))
    inside = with_group(z, ["domain", "bucket"], _s=F.sum("_w"), _k=F.count(F.lit(1)))
    return normalize(inside, F.col("_k") * F.col("_w") / F.col("_s")).drop("_c", "_z", "_s", "_k")


def rank_tilt(df: DataFrame, score: str = "score", tilt: float = 4.0) -> DataFrame:
    """Inside each cell 4^z of the clipped score's rank."""
    return tilted(df, clipped(score), tilt)


def contrastive(df: DataFrame) -> DataFrame:
    return strict_bucket_prior(df.withColumn("_a", F.greatest(F.col("score") - F.col("wrong"), F.lit(0.0))), "_a").drop("_a")


def conditional_rank(df: DataFrame, tilt: float = 4.0) -> DataFrame:
    """As rank_tilt, over the signed contrast."""
    return tilted(df, F.col("score") - F.col("wrong"), tilt)


def global_tilt(df: DataFrame, tilt: float = 4.0) -> DataFrame:
    c = F.col("score") - F.col("wrong")
    out = with_total(df, _a=F.avg(c), _s=F.stddev_pop(c))
    return normalize(out, F.pow(F.lit(tilt), F.when(F.col("_s") > 1e-12, (c - F.col("_a")) / F.col("_s")).otherwise(0.0))).drop("_a", "_s")


def only_domain(df: DataFrame, domain: str, other: bool = False) -> DataFrame:
    hit = F.col("domain") == domain
    return normalize(df, F.when(~hit if other else hit, 1.0).otherwise(0.0) + 1e-12)


def by_weights(df: DataFrame, weights: DataFrame, key: str = "domain") -> DataFrame:
    """Group masses given (key, w), uniform inside; groups without a weight get none."""
    inside = with_group(df, [key], _m=F.count(F.lit(1))).join(weights, key, "left")
    return normalize(inside, F.coalesce("w", F.lit(0.0)) / F.col("_m")).drop("_m", "w")


def shuffled_scores(df: DataFrame, seed: int, keys: list[str] = (), key: str = "doc_id", score: str = "score") -> DataFrame:
    """Scores dealt anew inside each stratum (or the pool), by hash order; the multiset stays.

    A row takes the score of the row whose place by hash is its own place by id.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"), 256)
    mine = placed_within(df, list(keys), [F.col(key)], "_i")
    theirs = placed_within(df.select(*keys, key, F.col(score).alias("_v")).withColumn("_h", h), list(keys), [F.col("_h"), F.col(key)], "_i")
    return joined(mine, theirs.select(*keys, "_i", "_v"), [*keys, "_i"]).withColumn(score, F.col("_v")).drop("_i", "_v")


def length_quartile(df: DataFrame, length: str = "n_words", name: str = "quartile") -> DataFrame:
    """df with the quartile (0 to 3) of its length, edges exact and interpolated, bins closed on the left."""
    cut = with_quantiles(df, length, [0.25, 0.5, 0.75], "_e")
    return cut.withColumn(name, sum(((F.col(length) >= F.col("_e")[i]).cast("int") for i in range(3)), F.lit(0))).drop("_e")


def mixed_prior(df: DataFrame, lam: float = 0.5) -> DataFrame:
    """(1 - lam) * population + lam * the clipped-score share."""
    out = with_total(df, _s=F.sum(clipped("score")), _n=F.count(F.lit(1)))
    return normalize(out, (1 - lam) / F.col("_n") + lam * clipped("score") / F.col("_s")).drop("_s", "_n")


def token_prior(df: DataFrame, lam: float = 0.5, tokens: str = "n_words") -> DataFrame:
    """Bucket masses (1 - lam) q + lam r, q the share of tokens and r as q times the mean clipped score; uniform inside."""
    inside = with_group(df, ["bucket"], _q=F.sum(tokens), _u=F.avg(clipped("score")), _b=F.count(F.lit(1)))
    both = with_total(inside, _tq=F.sum(F.col("_q") / F.col("_b")), _tr=F.sum(F.col("_q") * F.col("_u") / F.col("_b")))
    mass = (1 - lam) * F.col("_q") / F.col("_tq") + lam * F.col("_q") * F.col("_u") / F.col("_tr")
    return normalize(both, mass / F.col("_b")).drop("_q", "_u", "_b", "_tq", "_tr")


# --- packs: rows of one pack share its scores ---------------------------------------------------


def inherited(df: DataFrame, packs: DataFrame, columns: list[str], key: str = "pack") -> DataFrame:
    """df with columns of its packs in place of its own."""
    return df.drop(*columns).join(packs.select(key, *columns), key)


def shuffled_packs(df: DataFrame, packs: DataFrame, seed: int, columns: list[str], keys: list[str] = (), key: str = "pack") -> DataFrame:
    """df with the columns of another pack: packs are dealt anew inside each stratum, by hash order."""
    one, rest = columns[0], columns[1:]
    joined = F.struct(*columns) if rest else F.col(one)
    dealt = shuffled_scores(packs.select(*keys, key, joined.alias("_x")), seed, list(keys), key, "_x")
    unpacked = dealt.select(key, *([F.col("_x")[c].alias(c) for c in columns] if rest else [F.col("_x").alias(one)]))
    return inherited(df, unpacked, columns, key)


def pack_rank(df: DataFrame, packs: DataFrame, tilt: float = 4.0, key: str = "pack", seed: int | None = None) -> DataFrame:
    """conditional_rank over packs: z of the signed contrast among the packs of a cell, inherited by rows; cells of rows keep their mass.

    With a seed, z is dealt anew among the packs of a cell first.
    """
    z = centred_rank(packs.withColumn("_c", F.col("score") - F.col("wrong")), ["domain", "bucket"], "_c", "_z")
    if seed is not None:
        z = shuffled_scores(z, seed, ["domain", "bucket"], key, "_z")
    out = df.join(z.select(key, "_z"), key).withColumn("_w", F.pow(F.lit(tilt), F.col("_z")))
    inside = with_group(out, ["domain", "bucket"], _s=F.sum("_w"), _k=F.count(F.lit(1)))
    return normalize(inside, F.col("_k") * F.col("_w") / F.col("_s")).drop("_z", "_s", "_k")
