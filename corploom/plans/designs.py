"""Analyses that go over several ways to bucket, weigh or sample the pool."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import codec, mixtures, sampling
from ..operators.order import placed_within
from ..sources.io import stored, table
from .catalog import GRAMS, POOL, SELECTORS, pool, query, r6, selector_sql, sharing_grams
from .results import U, scored

UNIFORM, QUANTILE, TOP = (3, 5, 7, 10), (3, 5, 7, 10), 1.1


def bucketings(rows: DataFrame) -> DataFrame:
    """rows once for each of nine bucketings: (config, m, bucket) beside their columns."""
    levels = sorted({i / m for m in QUANTILE for i in range(1, m)})
    wide = mixtures.with_quantiles(rows, "cr", levels, "_e")
    at_least = lambda edges: sum([(F.col("cr") >= e).cast("int") for e in edges], F.lit(0))
    made = [F.struct(F.lit("F7").alias("config"), F.lit(7).alias("m"), at_least(mixtures.FIXED_EDGES).alias("bucket"))]
    made += [F.struct(F.lit(f"U{m}").alias("config"), F.lit(m).alias("m"), F.least(F.lit(m - 1), F.floor(F.col("cr") / (TOP / m))).cast("int").alias("bucket")) for m in UNIFORM]
    made += [F.struct(F.lit(f"QT{m}").alias("config"), F.lit(m).alias("m"), at_least([F.col("_e")[levels.index(i / m)] for i in range(1, m)]).alias("bucket")) for m in QUANTILE]
    return wide.withColumn("_b", F.explode(F.array(*made))).select(*rows.columns, "_b.config", "_b.m", F.col("_b.bucket").alias("bin"))


LEVELS = sorted({i / m for m in QUANTILE for i in range(1, m)})
NINE = (
    f"{POOL}, q AS (SELECT quantile_cont(cr, {LEVELS}) AS e FROM pool), nine AS (SELECT pool.*, 'F7' AS config, 7 AS m, bucket AS bin FROM pool "
    + "".join(f"UNION ALL SELECT pool.*, 'U{m}', {m}, least({m - 1}, floor(cr / ({TOP} / {m})))::INT FROM pool " for m in UNIFORM)
    + "".join(f"UNION ALL SELECT pool.*, 'QT{m}', {m}, {' + '.join(f'(cr >= e[{LEVELS.index(i / m) + 1}])::INT' for i in range(1, m))} FROM pool, q " for m in QUANTILE)
    + ")"
)


@query(f"WITH {NINE}, c AS (SELECT config, m, lang, bin, count(*) AS n FROM nine GROUP BY 1, 2, 3, 4), g AS (SELECT config, lang, any_value(m) AS m, count(*) AS used, min(n) AS least, sum(n) AS total FROM c GROUP BY 1, 2) SELECT config, lang, used::INT AS used_bins, round(CASE WHEN used < m THEN 0 ELSE least / total END, 6) AS min_share FROM g")
def nine_bucketings(spark, d):
    """Fixed, uniform and quantile bins of several sizes by language: how many are used, and the least share, 0 where one is empty."""
    c = bucketings(pool(spark, d)).groupBy("config", "m", "lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("config", "lang").agg(F.first("m").alias("m"), F.count(F.lit(1)).alias("used"), F.min("n").alias("least"), F.sum("n").alias("total"))
    return g.select("config", "lang", F.col("used").cast("int").alias("used_bins"), r6(F.when(F.col("used") < F.col("m"), 0.0).otherwise(F.col("least") / F.col("total"))).alias("min_share"))


@query(f"WITH {NINE}, c AS (SELECT config, bin, count(*) AS n, sum(greatest(score, 0)) + 0.001 AS s, sum(greatest(wrong, 0)) + 0.001 AS w FROM nine GROUP BY 1, 2) SELECT config, bin, round(s / sum(s) OVER (PARTITION BY config), 6) AS benchmark, round(w / sum(w) OVER (PARTITION BY config), 6) AS conversations, round(n / sum(n) OVER (PARTITION BY config), 6) AS population FROM c")
def prior_heatmap(spark, d):
    """The prior of each bin under each target suite, for all nine bucketings."""
    mass = lambda c: F.sum(mixtures.clipped(c)) + mixtures.TAU
    c = bucketings(pool(spark, d)).groupBy("config", "bin").agg(F.count(F.lit(1)).alias("n"), mass("score").alias("s"), mass("wrong").alias("w"))
    share = lambda x: r6(F.col(x) / F.sum(x).over(Window.partitionBy("config")))  # noqa: E731  ten rows a config
    return c.select("config", "bin", share("s").alias("benchmark"), share("w").alias("conversations"), share("n").alias("population"))


QUARTILES = f"{POOL}, e AS (SELECT quantile_cont(n_words, [0.25, 0.5, 0.75]) AS e FROM pool), lq AS (SELECT pool.*, (n_words >= e[1])::INT + (n_words >= e[2])::INT + (n_words >= e[3])::INT AS quartile FROM pool, e)"


@query(f"WITH {QUARTILES}, c AS (SELECT quartile, bucket, sum(greatest(score, 0)) + 0.001 AS s, count(*)::BIGINT AS n FROM lq GROUP BY 1, 2) SELECT quartile, bucket, n, round(s / sum(s) OVER (PARTITION BY quartile), 6) AS prior FROM c")
def length_priors(spark, d):
    """The bucket prior inside each quartile of length."""
    c = mixtures.length_quartile(pool(spark, d)).groupBy("quartile", "bucket").agg((F.sum(mixtures.clipped("score")) + mixtures.TAU).alias("s"), F.count(F.lit(1)).alias("n"))
    return c.select("quartile", "bucket", "n", r6(F.col("s") / F.sum("s").over(Window.partitionBy("quartile"))).alias("prior"))  # seven rows a quartile


@query(f"WITH {POOL}, q AS (SELECT quantile_cont(cr, [0.2, 0.4, 0.6, 0.8]) AS e FROM pool), s AS (SELECT doc_id, (cr >= e[1])::INT + (cr >= e[2])::INT + (cr >= e[3])::INT + (cr >= e[4])::INT AS quintile FROM pool, q) SELECT doc_id, quintile FROM (SELECT *, row_number() OVER (PARTITION BY quintile ORDER BY sha256('sub:' || doc_id::VARCHAR), doc_id) AS r FROM s) WHERE r <= 15")
def stratified_subsample(spark, d):
    """The first 15 of each quintile of the ratio by salted hash."""
    wide = mixtures.with_quantiles(pool(spark, d), "cr", [0.2, 0.4, 0.6, 0.8], "e")
    s = wide.select("doc_id", sum([(F.col("cr") >= F.col("e")[i]).cast("int") for i in range(4)], F.lit(0)).alias("quintile"), text.salted_key("sub", F.col("doc_id")).alias("k"))
    w = Window.partitionBy("quintile").orderBy("k", "doc_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 15").select("doc_id", "quintile")


ARMS = ["population", "bucket_prior", "direct_soft"]


@query(f"WITH {POOL}, {GRAMS}, arms AS (" + " UNION ALL ".join(f"SELECT '{a}' AS arm, doc_id, {SELECTORS[a][1]} AS p FROM pool" for a in ARMS) + f"), c AS (SELECT arm, doc_id, sum(p) OVER (PARTITION BY arm ORDER BY doc_id) AS hi, sum(p) OVER (PARTITION BY arm ORDER BY doc_id) - p AS lo FROM arms), u AS (SELECT i, {U.format('arm', 'i')} AS u FROM range(1500) t(i)), drawn AS (SELECT arm, doc_id FROM u JOIN c ON u.u >= c.lo AND u.u < c.hi) SELECT arm, count(*)::BIGINT AS draws, count(bad.doc_id)::BIGINT AS hits FROM drawn LEFT JOIN bad USING (doc_id) GROUP BY 1")
def sampled_contamination(spark, d):
    """Of what each arm draws, how many rows share a 13-gram with the benchmark."""
    rows, out = pool(spark, d), None
    slots = spark.range(1500).select(text.uniform("arm", F.col("id")).alias("u"))
    for a in ARMS:
        one = sampling.draw(SELECTORS[a][0](rows).select("doc_id", "p"), slots, 1500).select(F.lit(a).alias("arm"), "doc_id")
        out = one if out is None else out.unionByName(one)
    out = stored(out)
    docs = table(spark, d, "documents").select("doc_id", "text").join(out.select("doc_id").distinct(), "doc_id", "left_semi")
    bad = sharing_grams(docs, table(spark, d, "benchmark").select("text"), "doc_id").withColumn("hit", F.lit(1))
    return out.join(bad, "doc_id", "left").groupBy("arm").agg(F.count(F.lit(1)).alias("draws"), F.count("hit").alias("hits"))


@query(f"WITH {selector_sql(SELECTORS['bucket_prior'][1])}, r AS (SELECT o.doc_id, bucket, o.p * (SELECT count(*) FROM pool) AS weight, abs(score - wrong) AS loss FROM out o JOIN (SELECT doc_id, score, wrong FROM pool) USING (doc_id)) SELECT bucket, round(sum(weight * loss) / sum(weight), 6) AS reweighted, round(avg(loss), 6) AS plain, round(avg(weight), 6) AS mean_weight FROM r GROUP BY 1")
def loss_reweighting(spark, d):
    """Uniform draws whose losses weigh n * p instead: the sampled arm's expectation without its draws."""
    rows = mixtures.with_total(mixtures.bucket_prior(pool(spark, d)), n=F.count(F.lit(1)))
    r = rows.select("bucket", (F.col("p") * F.col("n")).alias("weight"), F.abs(F.col("score") - F.col("wrong")).alias("loss"))
    return r.groupBy("bucket").agg(r6(F.sum(F.col("weight") * F.col("loss")) / F.sum("weight")).alias("reweighted"), r6(F.avg("loss")).alias("plain"), r6(F.avg("weight")).alias("mean_weight"))


@query("WITH a AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY sha256(trim(regexp_replace(lower(replace(coalesce(text, ''), 'ß', 'ss')), '\\s+', ' ', 'g'))) ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source, lang) AS n FROM documents), b AS (SELECT *, count(*) OVER (PARTITION BY source, lang) AS m FROM a WHERE n >= 10 AND r = 1) SELECT doc_id, source FROM b WHERE m >= 8")
def sparse_domains_twice(spark, d):
    """Domains with enough rows, and with enough left after equal texts have gone."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", text.content_id(F.coalesce("text", F.lit(""))).alias("id"))
    first = docs.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    many = lambda df, n: df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n).select("source", "lang")
    same = lambda a, b: a.join(b, a["source"].eqNullSafe(b["source"]) & a["lang"].eqNullSafe(b["lang"]), "left_semi")
    left = stored(same(docs, many(docs, 10)).join(first, ["id", "doc_id"], "left_semi"))
    return same(left, many(left, 8)).select("doc_id", "source")


@query()
def codec_correlation(spark, d):
    """Rank correlation of the two codecs' ratios over the corpus."""
    docs = table(spark, d, "documents").where(F.octet_length("text") >= 512).select(codec.compression_ratio(F.col("text")).alias("lz4"), codec.gzip_ratio(F.col("text")).alias("gzip"))
    return stats.spearman(stored(docs), "lz4", "gzip")


@query()
def aligned_heatmap(spark, d):
    """The flagship's own scores by domain and bucket: mass of best alignments."""
    return scored(spark, d).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(mixtures.clipped("score")).alias("mass"), F.avg("cr").alias("mean_cr"))


@query(f"WITH {POOL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY cr, doc_id) AS i, count(*) OVER (PARTITION BY domain) AS n FROM pool) SELECT domain, doc_id FROM r WHERE i = (n + 1) // 2")
def median_documents(spark, d):
    """The document in the middle of each domain by ratio, whatever a domain's size."""
    rows = mixtures.with_group(placed_within(pool(spark, d), ["domain"], [F.col("cr"), F.col("doc_id")], "i"), ["domain"], n=F.count(F.lit(1)))
    return rows.where(F.col("i") + 1 == F.floor((F.col("n") + 1) / 2)).select("domain", "doc_id")
