"""Queries on study results, sampling, codecs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import codec, mixtures, packing
from ..operators.order import placed_within
from ..sources.io import scratch, stored, table
from ..streaming import events as stream
from .catalog import CELLS, POOL, SELECTORS, edges_bucket, pool, query, r6, selector_sql

U = "('0x' || substr(sha256('{}:' || {}::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


def cells(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), (F.col("l_linenumber") - 1).cast("int").alias("seed"), F.col("l_linestatus").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("metric"), F.avg("l_discount").alias("broad"))


T = "(CASE n - 1 " + " ".join(f"WHEN {i + 1} THEN {x}" for i, x in enumerate(stats.T_975)) + " ELSE 1.959964 END)"


@query(f"WITH {CELLS}, g AS (SELECT arm, split, count(*)::BIGINT AS n, avg(metric) AS mean, stddev_samp(metric) AS sd FROM cells GROUP BY 1, 2) SELECT arm, split, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN n >= 3 THEN {T} * sd / sqrt(n) END, 6) AS half FROM g")
def arm_summary(spark, d):
    g = cells(spark, d).groupBy("arm", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("metric").alias("mean"), F.stddev_samp("metric").alias("sd"))
    return g.select("arm", "split", "n", r6("mean").alias("mean"), r6("sd").alias("sd"), r6(stats.interval_half(F.col("n"), F.col("sd"))).alias("half"))


PAIRS = "pairs AS (SELECT a.split, b.arm AS other, a.seed, a.metric - b.metric AS diff, a.broad - b.broad AS broad FROM cells a JOIN cells b ON a.split = b.split AND a.seed = b.seed AND a.arm = 'R' AND b.arm <> 'R')"
SIGN = "CASE WHEN w + l = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(factorial((w + l)::INT) / (factorial(i::INT) * factorial((w + l - i)::INT))) FROM range(least(w, l)::BIGINT + 1) t(i)) / 2.0 ** (w + l)) END"
TESTS = f"{CELLS}, {PAIRS}, s AS (SELECT split, other, count(*)::BIGINT AS n, avg(diff) AS mean, stddev_samp(diff) AS sd, count_if(diff > 0)::BIGINT AS w, count_if(diff < 0)::BIGINT AS l FROM pairs GROUP BY 1, 2), tests AS (SELECT split || ':' || other AS name, split, other, n, mean, sd, w, l, {SIGN} AS p FROM s)"


def contrasts(spark, d):
    c = cells(spark, d)
    a = c.where("arm = 'R'").select("split", "seed", F.col("metric").alias("ma"), F.col("broad").alias("ba"))
    b = c.where("arm <> 'R'").select("split", "seed", F.col("arm").alias("other"), F.col("metric").alias("mb"), F.col("broad").alias("bb"))
    return a.join(b, ["split", "seed"]).select("split", "other", "seed", (F.col("ma") - F.col("mb")).alias("diff"), (F.col("ba") - F.col("bb")).alias("broad"))


def tested(spark, d):
    g = contrasts(spark, d).groupBy("split", "other").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("sd"), F.count_if(F.col("diff") > 0).alias("w"), F.count_if(F.col("diff") < 0).alias("l"))
    return g.withColumn("p", stats.sign_test(F.col("w"), F.col("l"))).withColumn("name", F.concat_ws(":", "split", "other"))


@query(f"WITH {TESTS} SELECT name, n, round(mean, 6) AS mean, round(CASE WHEN n >= 3 THEN {T} * sd / sqrt(n) END, 6) AS half, w, l, round(p::DOUBLE, 9) AS p FROM tests")
def paired_contrast(spark, d):
    return tested(spark, d).select("name", "n", r6("mean").alias("mean"), r6(stats.interval_half(F.col("n"), F.col("sd"))).alias("half"), "w", "l", F.round("p", 9).alias("p"))


@query(f"WITH {TESTS}, q AS (SELECT name, p, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS q FROM tests) SELECT name, round(least(1.0, max(q) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING))::DOUBLE, 9) AS p_holm FROM q")
def holm_family(spark, d):
    return stats.holm(tested(spark, d)).select("name", F.round("p_holm", 9).alias("p_holm"))


@query(f"WITH {CELLS}, {PAIRS} SELECT split, bool_and(ok) AS advance, count(*)::BIGINT AS controls FROM (SELECT split, other, avg(diff) >= 0.02 AND count_if(diff > 0) >= 4 AND avg(broad) <= 0.02 AS ok FROM pairs GROUP BY 1, 2) GROUP BY 1")
def advance_rule(spark, d):
    each = contrasts(spark, d).groupBy("split", "other").agg(((F.avg("diff") >= 0.02) & (F.count_if(F.col("diff") > 0) >= 4) & (F.avg("broad") <= 0.02)).alias("ok"))
    return each.groupBy("split").agg(F.bool_and("ok").alias("advance"), F.count(F.lit(1)).alias("controls"))


@query(f"WITH {CELLS}, m AS (SELECT arm, avg(metric) AS m, avg(broad) AS b FROM cells GROUP BY 1), e AS (SELECT * FROM m WHERE b <= 0.06), k AS (SELECT arm, m FROM e WHERE m >= (SELECT max(m) FROM e) - 2) SELECT arm, round(m, 6) AS m FROM k ORDER BY arm DESC LIMIT 1")
def tie_band_choice(spark, d):
    m = cells(spark, d).groupBy("arm").agg(F.avg("metric").alias("m"), F.avg("broad").alias("b")).where("b <= 0.06")
    return mixtures.with_total(m, top=F.max("m")).where("m >= top - 2").orderBy(F.desc("arm")).limit(1).select("arm", r6("m").alias("m"))


@query(f"WITH {CELLS}, want AS (SELECT * FROM (VALUES ('A'), ('N'), ('R'), ('X')) a(arm), range(8) s(seed), (VALUES ('F'), ('O')) p(split)) SELECT coalesce(w.arm, c.arm) AS arm, coalesce(w.seed, c.seed)::INT AS seed, coalesce(w.split, c.split) AS split, CASE WHEN c.n IS NULL THEN 'missing' WHEN w.arm IS NULL THEN 'unexpected' ELSE 'complete' END AS status, round(c.metric, 6) AS metric FROM want w FULL JOIN cells c ON w.arm = c.arm AND w.seed = c.seed AND w.split = c.split")
def missing_cells(spark, d):
    want = spark.createDataFrame([(a, s, p) for a in "ANRX" for s in range(8) for p in "FO"], "arm string, seed int, split string").withColumn("want", F.lit(1))
    both = want.join(cells(spark, d), ["arm", "seed", "split"], "full")
    return both.select("arm", "seed", "split", F.when(F.col("n").isNull(), "missing").when(F.col("want").isNull(), "unexpected").otherwise("complete").alias("status"), r6("metric").alias("metric"))


@query(f"WITH {CELLS}, w AS (SELECT l_returnflag AS arm, sum(l_extendedprice / l_quantity) / count(*) AS again FROM lineitem GROUP BY 1), r AS (SELECT arm, sum(metric * n) / sum(n) AS told FROM cells GROUP BY 1) SELECT arm, abs(told - again) <= 1e-8 * abs(again) AS agrees FROM w JOIN r USING (arm)")
def audit_recompute(spark, d):
    again = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg((F.sum(F.col("l_extendedprice") / F.col("l_quantity")) / F.count(F.lit(1))).alias("again"))
    told = cells(spark, d).groupBy("arm").agg((F.sum(F.col("metric") * F.col("n")) / F.sum("n")).alias("told"))
    return told.join(again, "arm").select("arm", (F.abs(F.col("told") - F.col("again")) <= 1e-8 * F.abs("again")).alias("agrees"))


@query("WITH j AS (SELECT source, lang, quality, toxic FROM labels JOIN documents USING (doc_id)), g AS (SELECT source, lang, avg(quality) AS acc FROM j GROUP BY 1, 2) SELECT source, round(avg(acc), 6) AS macro, round(min(acc), 6) AS worst, round(exp(avg(1 - acc)), 6) AS perplexity FROM g GROUP BY 1")
def macro_and_worst(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    g = j.groupBy("source", "lang").agg(F.avg("quality").alias("acc"))
    return g.groupBy("source").agg(r6(F.avg("acc")).alias("macro"), r6(F.min("acc")).alias("worst"), r6(F.exp(F.avg(1 - F.col("acc")))).alias("perplexity"))


@query("SELECT source, sum(quality)::BIGINT AS correct, count(*)::BIGINT AS n, count_if(quality = 1 AND toxic = 0)::BIGINT AS wins, count_if(quality = 0 AND toxic = 1)::BIGINT AS losses, round(avg((quality <> toxic)::INT), 6) AS flips, round(stddev_samp(quality - toxic) / sqrt(count(*)), 6) AS se, round(2.8 * stddev_samp(quality - toxic) / sqrt(count(*)), 6) AS mde FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def discordance(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    q, t = F.col("quality"), F.col("toxic")
    se = F.stddev_samp(q - t) / F.sqrt(F.count(F.lit(1)))
    return j.groupBy("source").agg(F.sum(q).alias("correct"), F.count(F.lit(1)).alias("n"), F.count_if((q == 1) & (t == 0)).alias("wins"), F.count_if((q == 0) & (t == 1)).alias("losses"), r6(F.avg((q != t).cast("int"))).alias("flips"), r6(se).alias("se"), r6(2.8 * se).alias("mde"))


@query("SELECT o_orderstatus AS status, count(*)::BIGINT AS n, bool_and(o_totalprice > 0) AS clean, round(sum(6 * o_totalprice + 2 * o_orderkey), 2) AS cost FROM orders GROUP BY 1")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("o_totalprice") > 0).alias("clean"), F.round(F.sum(6 * F.col("o_totalprice") + 2 * F.col("o_orderkey")), 2).alias("cost"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_checkpoint(spark, d):
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id"))
    return table(spark, d, "events").groupBy("user_id").agg(best.alias("x")).select("user_id", "x.event_id", "x.event_type")


@query("SELECT s::BIGINT AS step, count(*)::BIGINT AS orders, round(CASE WHEN s < 10 THEN 0.001 * (s + 1) / 10.0 ELSE 0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(pi() * (s - 10) / 90.0))) END, 9) AS rate FROM (SELECT o_orderkey % 100 AS s FROM orders) GROUP BY s")
def learning_rates(spark, d):
    """The rate at each step that a log has (here: of orders), and how many entries it has of it."""
    steps = table(spark, d, "orders").groupBy((F.col("o_orderkey") % 100).alias("step")).agg(F.count(F.lit(1)).alias("orders"))
    return steps.select("step", "orders", F.round(stats.cosine_rate(F.col("step"), 100, 10, 0.001), 9).alias("rate"))


# --- sampling and updates -------------------------------------------------------------------

@query(f"WITH {selector_sql(SELECTORS['bucket_prior'][1])} SELECT doc_id FROM out ORDER BY -ln({U.format('draw', 'doc_id')} + 1e-12) / p, doc_id LIMIT 100")
def weighted_sample(spark, d):
    p = mixtures.bucket_prior(pool(spark, d))
    return p.orderBy(-F.log(text.uniform("draw", F.col("doc_id")) + 1e-12) / F.col("p"), "doc_id").limit(100).select("doc_id")


@query(f"WITH {POOL}, m AS (SELECT bucket, sum(greatest(score, 0)) + 0.001 AS w FROM pool GROUP BY 1), c AS (SELECT bucket, sum(w) OVER (ORDER BY bucket) / sum(w) OVER () AS hi, (sum(w) OVER (ORDER BY bucket) - w) / sum(w) OVER () AS lo FROM m), u AS (SELECT i, {U.format('bucket', 'i')} AS u, {U.format('row', 'i')} AS v FROM range(2000) t(i)), k AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY bucket) AS n FROM pool) SELECT doc_id, count(*)::BIGINT AS draws FROM u JOIN c ON u.u >= c.lo AND u.u < c.hi JOIN k ON k.bucket = c.bucket AND k.r = floor(v * n) GROUP BY 1")
def hierarchical_draw(spark, d):
    """A bucket by its mass, then a row of it uniformly: with replacement, exposures counted."""
    p = pool(spark, d)
    w = Window.partitionBy().orderBy("bucket")  # one row a bucket
    mass = p.groupBy("bucket").agg((F.sum(mixtures.clipped("score")) + 0.001).alias("w"), F.count(F.lit(1)).alias("n"))
    total = F.sum("w").over(Window.partitionBy())
    bounds = mass.select("bucket", "n", (F.sum("w").over(w) / total).alias("hi"), ((F.sum("w").over(w) - F.col("w")) / total).alias("lo"))
    draws = spark.range(2000).select(text.uniform("bucket", F.col("id")).alias("u"), text.uniform("row", F.col("id")).alias("v"))
    hit = draws.join(F.broadcast(bounds), (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("bucket", F.floor(F.col("v") * F.col("n")).alias("r"))
    rows = placed_within(p.select("doc_id", "bucket"), ["bucket"], [F.col("doc_id")], "r")
    return hit.join(rows, ["bucket", "r"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("draws"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {U.format('batch', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 4")
def balanced_batch(spark, d):
    w = Window.partitionBy("source").orderBy(text.uniform("batch", F.col("doc_id")), "doc_id")
    return table(spark, d, "documents").select("doc_id", "source", F.row_number().over(w).alias("r")).where("r <= 4").drop("r")


EG = "WITH g AS (SELECT l_returnflag AS domain, avg(greatest(l_tax - 0.03, 0)) AS loss FROM lineitem GROUP BY 1), s AS (SELECT domain, loss, 1.0 / count(*) OVER () * exp(5 * loss) AS e, count(*) OVER () AS k FROM g)"


@query(f"{EG} SELECT domain, round(loss, 6) AS loss, round(0.9 * e / sum(e) OVER () + 0.1 / k, 6) AS w FROM s")
def gradient_update(spark, d):
    """One exponentiated-gradient step with smoothing over clipped excess losses."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("domain")).agg(F.avg(F.greatest(F.col("l_tax") - 0.03, F.lit(0))).alias("loss"))
    all_ = Window.partitionBy()  # one row a domain
    s = F.exp(5 * (F.col("loss") - F.max("loss").over(all_)))
    return g.withColumn("e", s).select("domain", r6("loss").alias("loss"), r6(0.9 * F.col("e") / F.sum("e").over(all_) + 0.1 / F.count(F.lit(1)).over(all_)).alias("w"))


@query("SELECT label, round(avg(list_dot_product(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1))), 4) AS dot FROM embeddings GROUP BY 1")
def gradient_alignment(spark, d):
    e = table(spark, d, "embeddings")
    target = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("target"))
    dot = F.aggregate(F.zip_with("embedding", "target", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return e.crossJoin(F.broadcast(target)).groupBy("label").agg(F.round(F.avg(dot), 4).alias("dot"))


# --- codecs, packing, streams ------------------------------------------------------------------

def scored(spark, d):
    docs = table(spark, d, "documents").where(F.octet_length("text") >= 512)
    clean = docs.withColumn("identity", text.content_id(F.col("text")))
    kept = clean.groupBy("identity").agg(F.min("doc_id").alias("doc_id"))
    clean = clean.join(kept, ["identity", "doc_id"], "left_semi")
    views = codec.target_views(table(spark, d, "benchmark"), "item_id", "text")
    cut = clean.select("doc_id", F.col("source").alias("domain"), text.byte_prefix(F.col("text"), 1024).alias("view"), text.byte_prefix(F.col("text"), 8192).alias("text"))
    both = cut.repartition(F.col("doc_id")).withColumn("cr", codec.compression_ratio(F.col("text"))).withColumn("a", codec.alignment(F.col("view"), views))
    return stored(both.select("doc_id", "domain", "cr", F.col("a.best").alias("score"), F.col("a.mean").alias("mean_score"), edges_bucket(F.col("cr"), mixtures.FIXED_EDGES).alias("bucket")))


@query()
def compression_profile(spark, d):
    docs = table(spark, d, "documents").where(F.octet_length("text") >= 512)
    return docs.select("doc_id", "source", F.octet_length("text").alias("bytes"), codec.compression_ratio(F.col("text")).alias("cr"))


@query()
def ncd_alignment(spark, d):
    return scored(spark, d)


@query()
def bucket_prior_report(spark, d):
    """Flagship: clean, score, bucket and weigh the corpus; what the prior moves, by bucket."""
    p = mixtures.with_total(mixtures.bucket_prior(scored(spark, d)), t=F.count(F.lit(1)))
    g = p.groupBy("bucket").agg(F.count(F.lit(1)).alias("docs"), F.sum("p").alias("prior_mass"), (F.count(F.lit(1)) / F.first("t")).alias("population_mass"), F.avg("cr").alias("mean_cr"))
    return g.withColumn("tv_part", F.abs(F.col("prior_mass") - F.col("population_mass")) / 2)


RECORD_PACKS = """WITH RECURSIVE n AS (SELECT lang AS domain, doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS i FROM documents),
r AS (SELECT domain, i, size AS total, 1 AS pack FROM n WHERE i = 1 UNION ALL SELECT n.domain, n.i, CASE WHEN r.total >= 4096 THEN n.size ELSE r.total + n.size END, CASE WHEN r.total >= 4096 THEN r.pack + 1 ELSE r.pack END FROM r JOIN n ON n.domain IS NOT DISTINCT FROM r.domain AND n.i = r.i + 1),
g AS (SELECT n.domain, pack, string_agg(doc_id::VARCHAR, ',' ORDER BY r.i) AS ids, count(*)::INT AS members, max(total) AS full_bytes, string_agg(t || chr(10), '' ORDER BY r.i) AS whole FROM r JOIN n ON n.domain IS NOT DISTINCT FROM r.domain AND n.i = r.i GROUP BY 1, 2)
SELECT domain, sha256(ids) AS pack_id, members, full_bytes::BIGINT AS full_bytes, sha256(unhex(substr(hex(encode(whole)), 1, 8192))) AS view_sha FROM g WHERE full_bytes >= 4096"""


@query(RECORD_PACKS)
def record_packs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("domain"), "text")
    return packing.pack_records(docs, 4096).select("domain", "pack_id", F.size("member_ids").alias("members"), "full_bytes", F.sha2("view", 256).alias("view_sha"))


@query(RECORD_PACKS)
def table_function_packs(spark, d):
    """The same packs by a table function over a table parted where packs begin."""
    packing.register_packs(spark)
    docs = packing.parted(table(spark, d, "documents").select(F.col("lang").alias("domain"), "doc_id", "text"), 4096)
    found = spark.sql("SELECT * FROM packs(TABLE({docs}) PARTITION BY (domain, began, part) ORDER BY (doc_id), 4096)", docs=docs)
    return found.select("domain", "pack_id", F.size("member_ids").alias("members"), "full_bytes", F.sha2("view", 256).alias("view_sha"))


@query()
def streamed_counts(spark, d):
    """The windowed counts of the event log, run as a stream to its end; each batch tells what it changed."""
    path, checkpoint = scratch(spark), scratch(spark)
    counts = stream.windowed_counts(stream.source(spark, d), late="1 day")
    stream.ended(stream.updates(counts, path, checkpoint))
    last = stream.current(spark, path, counts.schema, ["window", "event_type"])
    return last.select(F.col("window.start").alias("start"), "event_type", "n", r6("total").alias("total"))


ORACLE_STREAM = "SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2"
query(ORACLE_STREAM)(streamed_counts)
