"""All queries over the test tables, by name, each with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from ..operators import mixtures, packing
from ..operators.numpy_order import permutation
from ..operators.order import joined, quantiles, ranked
from ..sources.io import shares, small, stored, table

PART_BYTES = 16 << 20  # of text, whose words a task has at a time where a vocabulary is too large to go around
DIRECT = 200  # so many parts Spark writes straight to files (spark.shuffle.sort.bypassMergeThreshold); for more, a task keeps its rows in memory
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The pool that mixtures stand on: stand-ins that both engines can compute.
POOL = r"""
w AS (SELECT doc_id, coalesce(source, 'unknown') AS domain, lang, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents),
bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS t FROM benchmark),
cw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')) AS t FROM conversations),
tok AS (SELECT doc_id, unnest(ws) AS t FROM w),
hits AS (SELECT tok.doc_id, count(*) AS n, count(DISTINCT tok.t) AS nd, count(bw.t) AS hb, count(cw.t) AS hc FROM tok LEFT JOIN bw ON tok.t = bw.t LEFT JOIN cw ON tok.t = cw.t GROUP BY 1),
raw AS (SELECT w.doc_id, domain, lang, n AS n_words, nd / n::DOUBLE AS cr, hb / n::DOUBLE AS score, hc / n::DOUBLE / 2 AS wrong, (2 * hb - n) / n::DOUBLE AS mean_score FROM w JOIN hits USING (doc_id)),
pool AS (SELECT *, (cr >= 0.5)::INT + (cr >= 0.6)::INT + (cr >= 0.67)::INT + (cr >= 0.73)::INT + (cr >= 0.8)::INT + (cr >= 0.9)::INT AS bucket FROM raw)
"""
# Results of a made-up study: arm, seed, split and metric from line items.
CELLS = """
cells AS (SELECT l_returnflag AS arm, (l_linenumber - 1)::INT AS seed, l_linestatus AS split, count(*)::BIGINT AS n, avg(l_extendedprice / l_quantity) AS metric, avg(l_discount) AS broad FROM lineitem GROUP BY 1, 2, 3)
"""


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def r6(c) -> F.Column:
    return F.round(c, 6)


def edges_bucket(x, edges) -> F.Column:
    """Left-closed bins, the last one open: how many edges are at most x."""
    out = F.lit(0)
    for e in edges:
        out = out + (x >= e).cast("int")
    return out


def known_words(spark: SparkSession, d: str, name: str, mark: str) -> DataFrame:
    """The distinct words of a table's texts, marked."""
    return table(spark, d, name).select(F.explode(text.words(F.col("text"))).alias("t")).distinct().withColumn(mark, F.lit(1))


def scored_pool(docs: DataFrame, target: DataFrame, wrong: DataFrame, parts: int = 0) -> DataFrame:
    """Documents measured against the words of a target (t, b) and of a wrong one (t, w): rows (doc_id, domain, lang, counts and scores, bucket).

    A row counts its own words where it is read; texts and single words are neither dealt nor sorted where both vocabularies are
    small, only sums, a row a document.  Large vocabularies meet the counted words in joins, with `parts` dealt by word.
    """
    docs = docs.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("domain"), "lang", text.words(F.col("text")).alias("ws"))
    each = docs.select("doc_id", "domain", "lang", F.explode(text.word_counts(F.col("ws"))).alias("e")).select("doc_id", "domain", "lang", "e.t", "e.c")
    if parts:
        each = each.repartition(parts, "t")
    joined = each.join(target, "t", "left").join(wrong, "t", "left")
    sums = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.col("c"))), F.lit(0))
    # domain and lang hang on the id; as keys they leave a state of numbers alone, which needs no sort
    hits = joined.groupBy("doc_id", "domain", "lang").agg(F.sum("c").alias("n_words"), F.count(F.lit(1)).alias("nd"), sums("b").alias("hb"), sums("w").alias("hc"))
    n = F.col("n_words")
    out = hits.select("doc_id", "domain", "lang", "n_words", (F.col("nd") / n).alias("cr"), (F.col("hb") / n).alias("score"), (F.col("hc") / n / 2).alias("wrong"), ((2 * F.col("hb") - n) / n).alias("mean_score"))
    return out.withColumn("bucket", edges_bucket(F.col("cr"), mixtures.FIXED_EDGES))


def word_parts(size: int, least: int = 1) -> int:
    """Parts for the words of `size` bytes of text: PART_BYTES each while Spark writes them straight to files, then that many parts, which grow to eight times this before there are more."""
    most = max(DIRECT, -(-size // (8 * PART_BYTES)))
    return min(most, max(least, -(-size // PART_BYTES)))


def pool(spark: SparkSession, d: str) -> DataFrame:
    """The pool, computed once and stored: one scan of documents."""
    docs = table(spark, d, "documents")
    words = [stored(known_words(spark, d, *x)) for x in (("benchmark", "b"), ("conversations", "w"))]
    n = [shares(w) for w in words]
    if max(n) == 1:
        return stored(scored_pool(docs, *map(F.broadcast, words)))
    # a task holds its part of a vocabulary hashed, and streams the counted words of its part of the text: nothing is sorted
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    marked = [F.broadcast(w) if k == 1 else w.hint("shuffle_hash") for w, k in zip(words, n, strict=True)]
    return stored(scored_pool(docs, *marked, parts=word_parts(size, max(n))))


# --- scans, filters, text -------------------------------------------------------------

@query("SELECT doc_id, sha256('scan:' || doc_id::VARCHAR) AS k FROM documents WHERE strlen(text) >= 512 ORDER BY k LIMIT 100")
def hash_ordered_scan(spark, d):
    return table(spark, d, "documents").where(F.octet_length("text") >= 512).select("doc_id", text.salted_key("scan", F.col("doc_id")).alias("k")).orderBy("k").limit(100)


@query("SELECT (strlen(text) >= 512) AS long_enough, count(*)::BIGINT AS n, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY 1")
def min_bytes(spark, d):
    return table(spark, d, "documents").groupBy((F.octet_length("text") >= 512).alias("long_enough")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).cast("long").alias("bytes"))


LONGEST = "CASE WHEN strlen(text) <= 8192 THEN text ELSE left(text, (SELECT max(n)::INT FROM range(2048, 8193) t(n) WHERE strlen(left(text, n::INT)) <= 8192)) END"


@query(f"SELECT doc_id, strlen(t)::INT AS bytes, sha256(t) AS sha FROM (SELECT doc_id, {LONGEST} AS t FROM documents) WHERE strlen(t) >= 1024")
def byte_prefixes(spark, d):
    cut = table(spark, d, "documents").select("doc_id", text.byte_prefix(F.col("text"), 8192).alias("text"))
    return cut.where(F.octet_length("text") >= 1024).select("doc_id", F.octet_length("text").alias("bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


@query("SELECT doc_id, source FROM (SELECT *, count(*) OVER (PARTITION BY source, lang) AS n FROM documents) WHERE n >= 10")
def sparse_domains(spark, d):
    docs = table(spark, d, "documents")
    kept = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    return joined(docs, kept.select("source", "lang"), ["source", "lang"], "left_semi").select("doc_id", "source")


@query("SELECT coalesce(json_extract_string(props, '$.k'), json_extract_string(props, '$.page'), 'unknown') AS domain, count(*)::BIGINT AS n FROM events GROUP BY 1")
def json_domains(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.coalesce(F.get_json_object("props", "$.k"), text.json_domain(F.col("props"), "page")).alias("domain")).agg(F.count(F.lit(1)).alias("n"))


NORM = r"trim(regexp_replace(lower(replace(coalesce(text, ''), 'ß', 'ss')), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, id FROM (SELECT doc_id, sha256({NORM}) AS id, row_number() OVER (PARTITION BY sha256({NORM}) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def normalized_dedup(spark, d):
    ids = table(spark, d, "documents").select("doc_id", text.content_id(F.coalesce("text", F.lit(""))).alias("id"))
    return ids.groupBy("id").agg(F.min("doc_id").alias("doc_id"))


@query(r"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT coalesce(CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN role NOT IN ('user', 'assistant') THEN 'role' WHEN length(t) > 1500 THEN 'overlength' END, 'kept') AS reason, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def canonical_records(spark, d):
    c = table(spark, d, "conversations").withColumn("t", F.trim(F.regexp_replace("text", r"\s+", " ")))
    reason = F.when(F.col("t").isNull() | (F.col("t") == ""), "empty").when(~F.col("role").isin("user", "assistant"), "role").when(F.length("t") > 1500, "overlength").otherwise("kept")
    return c.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, string_agg(turn::VARCHAR, ',' ORDER BY sha256(conv_id::VARCHAR || ':' || turn::VARCHAR)) AS shuffled, list_position(list(turn ORDER BY sha256(conv_id::VARCHAR || ':' || turn::VARCHAR)), min(turn))::BIGINT AS answer FROM conversations GROUP BY 1")
def option_shuffle(spark, d):
    h = F.sha2(F.concat_ws(":", "conv_id", "turn").cast("binary"), 256)
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(h.alias("h"), "turn"))).alias("o"), F.min("turn").alias("first"))
    turns = F.transform("o", lambda x: x["turn"])
    return g.select("conv_id", F.array_join(turns.cast("array<string>"), ",").alias("shuffled"), F.array_position(turns, F.col("first")).alias("answer"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, b::INT AS block, sha256(array_to_string(list_slice(ws, (b * 64 + 1)::BIGINT, (b * 64 + 65)::BIGINT), ' ')) AS sha FROM (SELECT doc_id, list_slice(ws, 1, 2048) AS ws FROM w), LATERAL (SELECT unnest(range(((len(ws) - 1) // 64)::BIGINT)) AS b)""")
def word_blocks(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", text.words(F.col("text")).alias("ws"))
    return packing.token_blocks(docs.select("doc_id", "ws"), F.col("ws"), 64).select("doc_id", "block", F.sha2(F.array_join("tokens", " ").cast("binary"), 256).alias("sha"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_slice(ws, 66, 130), ' ') AS second FROM w WHERE len(ws) >= 130""")
def second_window(spark, d):
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", text.words(F.col("text")).alias("ws"))
    return docs.where(F.size("ws") >= 130).select("doc_id", F.array_join(F.slice("ws", 66, 65), " ").alias("second"))


# --- splits and leakage ---------------------------------------------------------------

ROLE = "CASE WHEN r <= 5 THEN 'dev' WHEN r <= 15 THEN 'test' ELSE 'train' END"


@query(f"SELECT doc_id, source, {ROLE} AS role FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('role:' || doc_id::VARCHAR)) AS r FROM documents)")
def hash_roles(spark, d):
    return roles(table(spark, d, "documents")).select("doc_id", "source", "role")


def roles(docs: DataFrame) -> DataFrame:
    """The first 5 of a source by salted hash are dev, the next 10 test: only those are ranked, the rest is train."""
    w = Window.partitionBy("source").orderBy(text.salted_key("role", F.col("doc_id")))
    first = docs.select("doc_id", "source").withColumn("r", F.row_number().over(w)).where("r <= 15").select("doc_id", F.when(F.col("r") <= 5, "dev").otherwise("test").alias("role"))
    return docs.join(first, "doc_id", "left").withColumn("role", F.coalesce("role", F.lit("train")))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('cap:' || doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 20")
def cap_per_domain(spark, d):
    w = Window.partitionBy("source").orderBy(text.salted_key("cap", F.col("doc_id")))
    return table(spark, d, "documents").select("doc_id", "source", F.row_number().over(w).alias("r")).where("r <= 20").drop("r")


@query("WITH res AS (SELECT doc_id FROM labels WHERE toxic = 1 ORDER BY doc_id LIMIT 20) SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM res)")
def reserve_and_exclude(spark, d):
    labels = table(spark, d, "labels")
    return labels.join(labels.where("toxic = 1").orderBy("doc_id").limit(20).select("doc_id"), "doc_id", "left_anti").select("doc_id", "quality")


GRAMS = r"""
g AS (SELECT doc_id, source, unnest([array_to_string(list_slice(ws, i, i + 12), ' ') FOR i IN range(1, (len(ws) - 11)::BIGINT)]) AS g FROM (SELECT doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM documents)),
h AS (SELECT DISTINCT unnest([array_to_string(list_slice(ws, i, i + 12), ' ') FOR i IN range(1, (len(ws) - 11)::BIGINT)]) AS g FROM (SELECT regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+') AS ws FROM benchmark)),
bad AS (SELECT DISTINCT doc_id FROM g SEMI JOIN h USING (g))
"""


def contaminated(spark, d) -> DataFrame:
    """Ids of documents that share a 13-gram with the benchmark: 64-bit hashes of word runs sift, SHA-256 of the few that hit decides."""
    return sharing_grams(table(spark, d, "documents"), table(spark, d, "benchmark").select("text"), "doc_id")


def sharing_grams(docs: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Keys of docs that share a 13-gram with held: by 64-bit hashes first, then by the grams that these point to.

    The hashes of held, and the rows that they hit, are sent around where they are small, so that no gram of docs is shuffled.
    """
    runs = lambda df, *c: df.select(*c, F.posexplode(text.gram_keys(text.words(F.col("text")))).alias("i", "h"))
    keys = small(runs(held).select("h").distinct())
    hits = small(runs(docs, key).join(keys, "h", "left_semi").groupBy(key).agg(F.collect_set("i").alias("at")))
    sure = docs.join(hits, key).select(key, F.explode(text.grams_at(text.words(F.col("text")), F.col("at"))).alias("g"))
    return sure.join(held.select(F.explode(text.grams(text.words(F.col("text")))).alias("g")).distinct(), "g", "left_semi").select(key).distinct()


@query(f"WITH {GRAMS} SELECT doc_id, source FROM documents ANTI JOIN bad USING (doc_id)")
def gram_decontaminate(spark, d):
    return table(spark, d, "documents").join(contaminated(spark, d), "doc_id", "left_anti").select("doc_id", "source")


@query(f"WITH {GRAMS} SELECT source, count(*)::BIGINT AS n, count(bad.doc_id)::BIGINT AS hit FROM documents LEFT JOIN bad USING (doc_id) GROUP BY 1")
def contamination_by_source(spark, d):
    hit = contaminated(spark, d).withColumn("h", F.lit(1))
    return table(spark, d, "documents").join(hit, "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("hit"))


@query(f"WITH r AS (SELECT doc_id, sha256({NORM}) AS id, {ROLE} AS role FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('role:' || doc_id::VARCHAR)) AS r FROM documents)) SELECT a.role AS a, b.role AS b, count(DISTINCT a.id)::BIGINT AS n FROM r a JOIN r b ON a.id = b.id AND a.role < b.role GROUP BY 1, 2")
def role_overlap(spark, d):
    r = roles(table(spark, d, "documents")).select(text.content_id(F.coalesce("text", F.lit(""))).alias("id"), "role").distinct()
    return r.select("id", F.col("role").alias("a")).join(r.select("id", F.col("role").alias("b")), "id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT item_id FROM benchmark))::BIGINT AS both, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels))::BIGINT AS unlabelled")
def set_operations(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    both = docs.intersect(table(spark, d, "benchmark").select("item_id")).agg(F.count(F.lit(1)).alias("both"))
    return both.crossJoin(docs.subtract(table(spark, d, "labels").select("doc_id")).agg(F.count(F.lit(1)).alias("unlabelled")))


# --- buckets and distributions ----------------------------------------------------------

@query(f"WITH {POOL} SELECT b::INT AS bucket, count(doc_id)::BIGINT AS n, round(coalesce(sum(greatest(score, 0)), 0), 6) AS mass FROM range(7) t(b) LEFT JOIN pool ON bucket = b GROUP BY 1")
def bucket_fixed(spark, d):
    made = pool(spark, d).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(mixtures.clipped("score")).alias("mass"))
    dense = spark.range(7).select(F.col("id").cast("int").alias("bucket"))
    return dense.join(made, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), r6(F.coalesce("mass", F.lit(0.0))).alias("mass"))


@query(f"WITH {POOL} SELECT m::INT AS m, least(m - 1, floor(cr / (1.1 / m)))::INT AS bucket, count(*)::BIGINT AS n FROM pool, (VALUES (3), (5), (7), (10)) t(m) GROUP BY 1, 2")
def bucket_uniform(spark, d):
    m = F.col("m")
    return pool(spark, d).select("cr", F.explode(F.array(*map(F.lit, (3, 5, 7, 10)))).alias("m")).groupBy("m", F.least(m - 1, F.floor(F.col("cr") / (1.1 / m))).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {POOL}, q AS (SELECT quantile_cont(cr, [0.2, 0.4, 0.6, 0.8]) AS e FROM pool) SELECT ((cr >= e[1])::INT + (cr >= e[2])::INT + (cr >= e[3])::INT + (cr >= e[4])::INT) AS bucket, count(*)::BIGINT AS n, round(min(cr), 6) AS low, round(count(*) / (SELECT count(*) FROM pool)::DOUBLE, 6) AS share FROM pool, q GROUP BY 1")
def bucket_quantile(spark, d):
    p = mixtures.with_total(mixtures.with_quantiles(pool(spark, d), "cr", [0.2, 0.4, 0.6, 0.8], "e"), t=F.count(F.lit(1)))
    return p.groupBy(edges_bucket(F.col("cr"), [F.col("e")[i] for i in range(4)]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.min("cr")).alias("low"), r6(F.count(F.lit(1)) / F.first("t")).alias("share"))


_sevenths = ", ".join(f"count_if(bucket = {b})" for b in range(7))


@query(f"WITH {POOL} SELECT lang, round(least({_sevenths}) / count(*), 6) AS min_share FROM pool GROUP BY 1")
def min_share(spark, d):
    counts = pool(spark, d).groupBy("lang").agg(*[F.sum((F.col("bucket") == b).cast("long")).alias(f"b{b}") for b in range(7)])
    each = [F.col(f"b{b}") for b in range(7)]
    return counts.select("lang", r6(F.least(*each) / sum(each, F.lit(0))).alias("min_share"))


@query(f"""WITH {POOL}, m AS (SELECT lang, avg(cr) AS mu FROM pool GROUP BY 1), k AS (SELECT pool.lang AS lang, avg((cr - mu) ** 2) AS m2, avg((cr - mu) ** 3) AS m3 FROM pool JOIN m ON pool.lang IS NOT DISTINCT FROM m.lang GROUP BY pool.lang)
SELECT pool.lang AS lang, count(*)::BIGINT AS n, round(avg(cr), 6) AS mean, round(stddev_samp(cr), 6) AS std, round(quantile_cont(cr, 0.25), 6) AS q1, round(quantile_cont(cr, 0.5), 6) AS median, round(quantile_cont(cr, 0.75), 6) AS q3, round(quantile_cont(cr, 0.75) - quantile_cont(cr, 0.25), 6) AS iqr, round(any_value(m3) / any_value(m2) ** 1.5, 6) AS skew, round(avg((cr BETWEEN 0.65 AND 0.8)::INT), 6) AS in_band FROM pool JOIN k ON pool.lang IS NOT DISTINCT FROM k.lang GROUP BY pool.lang""")
def summary_stats(spark, d):
    rows = pool(spark, d)
    sums = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("cr")).alias("mean"), r6(F.stddev_samp("cr")).alias("std"), r6(F.skewness("cr")).alias("skew"), r6(F.avg(F.col("cr").between(0.65, 0.8).cast("int"))).alias("in_band"))
    q = lambda i: F.col("q")[i]
    return joined(sums, quantiles(rows, "cr", [0.25, 0.5, 0.75], ["lang"]), ["lang"]).select("lang", "n", "mean", "std", r6(q(0)).alias("q1"), r6(q(1)).alias("median"), r6(q(2)).alias("q3"), r6(q(2) - q(0)).alias("iqr"), "skew", "in_band")


@query(f"""WITH {POOL}, s AS (SELECT lang, count(*) AS n, avg(cr) AS mu, var_samp(cr) AS v FROM pool GROUP BY 1), pr AS (SELECT a.lang AS a, b.lang AS b, a.n AS na, b.n AS nb, a.mu AS ma, b.mu AS mb, a.v AS va, b.v AS vb FROM s a JOIN s b ON a.lang < b.lang),
x AS (SELECT a, b, cr, sum((lang = a)::INT) / any_value(na)::DOUBLE AS fa, sum((lang = b)::INT) / any_value(nb)::DOUBLE AS fb FROM pool JOIN pr ON lang = a OR lang = b GROUP BY 1, 2, 3), c AS (SELECT a, b, abs(sum(fa) OVER w - sum(fb) OVER w) AS g FROM x WINDOW w AS (PARTITION BY a, b ORDER BY cr))
SELECT a, b, round(max(g), 6) AS ks_d, round(greatest(0, least(1, 2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * j * j * max(g) * max(g) * any_value(na * nb / (na + nb)::DOUBLE)) FOR j IN range(1, 101)]))), 6) AS p, round(any_value((ma - mb) / sqrt((va + vb) / 2)), 6) AS cohens_d FROM c JOIN pr USING (a, b) GROUP BY 1, 2""")
def ks_pairs(spark, d):
    return stats.ks_pairs(pool(spark, d), "lang", "cr").select("a", "b", r6("ks_d").alias("ks_d"), r6("p").alias("p"), r6("cohens_d").alias("cohens_d"))


@query(f"WITH {POOL} SELECT doc_id, lang, round(cume_dist() OVER (PARTITION BY lang ORDER BY cr), 6) AS cdf FROM pool")
def cdf(spark, d):
    return mixtures.with_group(ranked(pool(spark, d), ["lang"], "cr"), ["lang"], n=F.count(F.lit(1))).select("doc_id", "lang", r6(F.col("_upto") / F.col("n")).alias("cdf"))


@query(f"WITH {POOL}, r AS (SELECT rank() OVER (ORDER BY cr) + (count(*) OVER (PARTITION BY cr) - 1) / 2.0 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS b FROM pool) SELECT count(*)::BIGINT AS n, round(corr(a, b), 6) AS rho FROM r")
def spearman(spark, d):
    return stats.spearman(pool(spark, d), "cr", "score").select("n", r6("rho").alias("rho"))


@query(f"WITH {POOL}, b AS (SELECT bucket, avg((lang = 'fr')::INT) AS f FROM pool GROUP BY 1) SELECT round(max(f), 6) AS bound, round((SELECT avg((lang = 'fr')::INT) FROM pool), 6) AS share FROM b")
def capacity_bound(spark, d):
    french = (F.col("lang") == "fr").cast("int")  # null where lang is: such rows count in no share
    p = pool(spark, d).groupBy("bucket").agg(F.avg(french).alias("f"), F.sum(french).alias("h"), F.count(french).alias("n"))
    return p.agg(r6(F.max("f")).alias("bound"), r6(F.sum("h") / F.nullif(F.sum("n"), F.lit(0))).alias("share"))


@query(f"WITH {POOL} SELECT domain, bucket, count(*)::BIGINT AS n, round(avg(greatest(score, 0)), 6) AS mean, round(stddev_pop(greatest(score, 0)), 6) AS sd, count(DISTINCT score - wrong)::BIGINT AS n_raw, count(DISTINCT greatest(score - wrong, 0))::BIGINT AS n_clipped FROM pool GROUP BY 1, 2")
def cell_stats(spark, d):
    return pool(spark, d).groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(mixtures.clipped("score"))).alias("mean"), r6(F.stddev_pop(mixtures.clipped("score"))).alias("sd"), F.count_distinct(F.col("score") - F.col("wrong")).alias("n_raw"), F.count_distinct(F.greatest(F.col("score") - F.col("wrong"), F.lit(0.0))).alias("n_clipped"))


# --- mixtures ------------------------------------------------------------------------------

SELECTORS: dict[str, tuple[Callable[[DataFrame], DataFrame], str]] = {
    "population": (mixtures.population, "1.0 / count(*) OVER ()"),
    "uniform_domain": (lambda p: mixtures.uniform_groups(p, "domain"), "1.0 / (SELECT count(DISTINCT domain) FROM pool) / count(*) OVER (PARTITION BY domain)"),
    "uniform_bucket": (lambda p: mixtures.uniform_groups(p, "bucket"), "1.0 / (SELECT count(DISTINCT bucket) FROM pool) / count(*) OVER (PARTITION BY bucket)"),
    "band": (mixtures.band, "(cr BETWEEN 0.65 AND 0.8)::INT / sum((cr BETWEEN 0.65 AND 0.8)::INT) OVER ()"),
    "bucket_prior": (mixtures.bucket_prior, "(sum(greatest(score, 0)) OVER (PARTITION BY bucket) + 0.001) / count(*) OVER (PARTITION BY bucket) / (sum(greatest(score, 0)) OVER () + 0.001 * (SELECT count(DISTINCT bucket) FROM pool))"),
    "bucket_prior_plain": (lambda p: mixtures.bucket_prior(p, tau=0.0, on_empty="uniform"), "sum(greatest(score, 0)) OVER (PARTITION BY bucket) / count(*) OVER (PARTITION BY bucket) / sum(greatest(score, 0)) OVER ()"),
    "bucket_prior_strict": (mixtures.strict_bucket_prior, "sum(score) OVER (PARTITION BY bucket) / count(*) OVER (PARTITION BY bucket) / sum(score) OVER ()"),
    "wrong_target": (lambda p: mixtures.bucket_prior(p, "wrong", 0.0, "uniform"), "sum(wrong) OVER (PARTITION BY bucket) / count(*) OVER (PARTITION BY bucket) / sum(wrong) OVER ()"),
    "direct_soft": (mixtures.direct_soft, "(greatest(mean_score, 0) + 0.001) / sum(greatest(mean_score, 0) + 0.001) OVER ()"),
    "direct_hard": (mixtures.direct_hard, "(row_number() OVER (ORDER BY mean_score DESC, doc_id) <= ceil(0.25 * (SELECT count(*) FROM pool)))::INT / ceil(0.25 * (SELECT count(*) FROM pool))"),
    "cell_tilt": (mixtures.cell_tilt, "TILT"),
    "domain_matched": (lambda p: mixtures.averaged(mixtures.cell_tilt(p), "domain"), "MATCHED"),
    "rank_tilt": (mixtures.rank_tilt, "RANK greatest(score, 0)"),
    "conditional_rank": (mixtures.conditional_rank, "RANK score - wrong"),
    "contrastive": (mixtures.contrastive, "sum(greatest(score - wrong, 0)) OVER (PARTITION BY bucket) / count(*) OVER (PARTITION BY bucket) / sum(greatest(score - wrong, 0)) OVER ()"),
    "source_matched": (lambda p: mixtures.averaged(mixtures.contrastive(p), "domain"), "SOURCE"),
    "global_tilt": (mixtures.global_tilt, "GLOBAL"),
    "oracle_domain": (lambda p: mixtures.only_domain(p, "src1"), "((domain = 'src1')::INT + 1e-12) / sum((domain = 'src1')::INT + 1e-12) OVER ()"),
    "anti_domain": (lambda p: mixtures.only_domain(p, "src1", True), "((domain <> 'src1')::INT + 1e-12) / sum((domain <> 'src1')::INT + 1e-12) OVER ()"),
    "token_prior": (mixtures.token_prior, "TOKEN"),
    "shuffled_cell_tilt": (lambda p: mixtures.shuffled_cell_tilt(p, 1405), "DEALT"),
    "numpy_cell_tilt": (lambda p: mixtures.numpy_cell_tilt(p, 0), "NUMPY"),
    "shuffled": (lambda p: mixtures.bucket_prior(mixtures.shuffled_scores(p, 1405)), "SHUFFLED"),
    "shuffled_strata": (lambda p: mixtures.bucket_prior(mixtures.shuffled_scores(mixtures.length_quartile(p).withColumn("score", mixtures.clipped("score")), 1405, ["domain", "quartile"]), tau=0.0, on_empty="uniform"), "STRATA"),
    "learned_weights": (lambda p: mixtures.by_weights(p, p.groupBy("domain").agg(F.avg("score").alias("w"))), "LEARNED"),
    "mixed_prior": (mixtures.mixed_prior, "0.5 / count(*) OVER () + 0.5 * greatest(score, 0) / sum(greatest(score, 0)) OVER ()"),
}


def selector_sql(form: str) -> str:
    tilt = "cl AS (SELECT domain, bucket, avg(greatest(score, 0)) AS mu FROM pool GROUP BY 1, 2), z AS (SELECT domain, bucket, exp(coalesce((mu - avg(mu) OVER ()) / nullif(stddev_pop(mu) OVER (), 0), 0)) AS e FROM cl), t AS (SELECT pool.*, e / sum(e) OVER () AS q FROM pool JOIN z USING (domain, bucket))"
    if form == "TILT":
        return f"{POOL}, {tilt}, out AS (SELECT doc_id, domain, bucket, q AS p FROM t)"
    if form == "MATCHED":
        return f"{POOL}, {tilt}, out AS (SELECT doc_id, domain, bucket, avg(q) OVER (PARTITION BY domain) AS p FROM t)"
    if form == "SOURCE":
        return f"{POOL}, t AS (SELECT *, {SELECTORS['contrastive'][1]} AS q FROM pool), out AS (SELECT doc_id, domain, bucket, avg(q) OVER (PARTITION BY domain) AS p FROM t)"
    if form == "GLOBAL":
        return f"{POOL}, t AS (SELECT *, 4.0 ** ((score - wrong - avg(score - wrong) OVER ()) / stddev_pop(score - wrong) OVER ()) AS e FROM pool), out AS (SELECT doc_id, domain, bucket, e / sum(e) OVER () AS p FROM t)"
    prior = "(sum(greatest(v, 0)) OVER (PARTITION BY bucket) + 0.001) / count(*) OVER (PARTITION BY bucket) / (sum(greatest(v, 0)) OVER () + 0.001 * (SELECT count(DISTINCT bucket) FROM pool))"
    if form == "SHUFFLED":
        return f"{POOL}, i AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i, row_number() OVER (ORDER BY sha256('1405:' || doc_id::VARCHAR), doc_id) AS j FROM pool), t AS (SELECT a.doc_id, a.domain, a.bucket, b.score AS v FROM i a JOIN i b ON a.i = b.j), out AS (SELECT doc_id, domain, bucket, {prior} AS p FROM t)"
    if form == "STRATA":
        return f"{POOL}, e AS (SELECT quantile_cont(n_words, [0.25, 0.5, 0.75]) AS e FROM pool), s AS (SELECT pool.*, (n_words >= e[1])::INT + (n_words >= e[2])::INT + (n_words >= e[3])::INT AS quartile FROM pool, e), i AS (SELECT *, row_number() OVER (PARTITION BY domain, quartile ORDER BY doc_id) AS i, row_number() OVER (PARTITION BY domain, quartile ORDER BY sha256('1405:' || doc_id::VARCHAR), doc_id) AS j FROM s), t AS (SELECT a.doc_id, a.domain, a.bucket, greatest(b.score, 0) AS v FROM i a JOIN i b ON a.domain = b.domain AND a.quartile = b.quartile AND a.i = b.j), out AS (SELECT doc_id, domain, bucket, sum(v) OVER (PARTITION BY bucket) / count(*) OVER (PARTITION BY bucket) / sum(v) OVER () AS p FROM t)"
    if form == "DEALT":
        dealt = tilt.split(", t AS")[0].replace("exp(coalesce(", "(coalesce(").replace(" AS e FROM cl", " AS z FROM cl")
        return f"{POOL}, {dealt}, o AS (SELECT *, row_number() OVER (ORDER BY domain, bucket) AS i, row_number() OVER (ORDER BY sha256('1405:' || domain || ':' || bucket::VARCHAR), domain, bucket) AS j FROM z), m AS (SELECT a.domain, a.bucket, exp(b.z) AS e FROM o a JOIN o b ON a.i = b.j), out AS (SELECT doc_id, domain, bucket, e / sum(e) OVER () AS p FROM pool JOIN m USING (domain, bucket))"
    if form == "NUMPY":
        dealt = tilt.split(", t AS")[0].replace("exp(coalesce(", "(coalesce(").replace(" AS e FROM cl", " AS z FROM cl")
        # the order that the generator gives for every number of cells that there may be
        orders = [permutation(n, 10_197) for n in range(1, 201)]
        return f"{POOL}, {dealt}, o AS (SELECT *, row_number() OVER (ORDER BY domain, bucket) AS i, count(*) OVER () AS n FROM z), m AS (SELECT a.domain, a.bucket, exp(b.z) AS e FROM o a JOIN o b ON b.i = ({orders})[a.n][a.i] + 1), out AS (SELECT doc_id, domain, bucket, e / sum(e) OVER () AS p FROM pool JOIN m USING (domain, bucket))"
    if form == "TOKEN":
        return f"{POOL}, g AS (SELECT bucket, count(*) AS b, sum(n_words) AS q, avg(greatest(score, 0)) AS u FROM pool GROUP BY 1), m AS (SELECT bucket, (0.5 * q / sum(q) OVER () + 0.5 * q * u / sum(q * u) OVER ()) / b AS p FROM g), out AS (SELECT doc_id, domain, bucket, p FROM pool JOIN m USING (bucket))"
    if form == "LEARNED":
        return f"{POOL}, g AS (SELECT domain, count(*) AS m, avg(score) AS w FROM pool GROUP BY 1), out AS (SELECT doc_id, domain, bucket, w / m / (SELECT sum(w) FROM g) AS p FROM pool JOIN g USING (domain))"
    if form.startswith("RANK"):
        return f"""{POOL}, v AS (SELECT *, {form[5:]} AS x FROM pool), k AS (SELECT *, count(*) OVER (PARTITION BY domain, bucket) AS m, count(*) OVER (PARTITION BY domain, bucket, x) AS ties, rank() OVER (PARTITION BY domain, bucket ORDER BY x) AS r FROM v),
e AS (SELECT *, CASE WHEN ties = m THEN 1.0 ELSE 4.0 ** ((r + (ties - 1) / 2.0 - 0.5) / m - 0.5) END AS e FROM k), out AS (SELECT doc_id, domain, bucket, m * e / sum(e) OVER (PARTITION BY domain, bucket) / count(*) OVER () AS p FROM e)"""
    return f"{POOL}, out AS (SELECT doc_id, domain, bucket, {form} AS p FROM pool)"


def _register(name: str, run, form: str) -> None:
    # nine places: pools of some millions of rows at most have probabilities to show; at any scale compare p times the number of rows
    QUERIES[f"mixture_{name}"] = lambda spark, d: run(pool(spark, d)).select("doc_id", F.round("p", 9).alias("p"))
    ORACLES[f"mixture_{name}"] = f"WITH {selector_sql(form)} SELECT doc_id, round(p::DOUBLE, 9) AS p FROM out"


for _name, (_run, _form) in SELECTORS.items():
    _register(_name, _run, _form)


# --- diagnostics ----------------------------------------------------------------------------

def _long(spark, d, names) -> DataFrame:
    base, out = pool(spark, d), None
    for n in names:
        one = SELECTORS[n][0](base).select(F.lit(n).alias("method"), "doc_id", "domain", "bucket", "n_words", "p")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {selector_sql('TILT')}, a AS (SELECT out.*, n_words FROM out JOIN pool USING (doc_id)) SELECT round(1 / sum(p * p), 4) AS ess, round(1 / sum(p * p) / count(*), 6) AS ess_share, count_if(p > 0)::BIGINT AS support, round(sum(p * n_words), 4) AS expected_words, round(sum(abs(p - 1.0 / (SELECT count(*) FROM pool))) / 2, 6) AS tv, round(-sum(p * ln(p)), 6) AS entropy, round((SELECT -sum(w * ln(w)) FROM (SELECT (sum(greatest(score, 0)) + 0.001) / (SELECT sum(greatest(score, 0)) + 0.001 * count(DISTINCT bucket) FROM pool) AS w FROM pool GROUP BY bucket)), 6) AS prior_entropy FROM a")
def mixture_diagnostics(spark, d):
    rows = pool(spark, d)
    p = mixtures.with_total(mixtures.cell_tilt(rows), t=F.count(F.lit(1)))
    x = F.col("p")
    mass = mixtures.normalize(rows.groupBy("bucket").agg((F.sum(mixtures.clipped("score")) + mixtures.TAU).alias("w")), F.col("w"))
    entropy = mass.agg(r6(-F.sum(F.col("p") * F.log("p"))).alias("prior_entropy"))
    return F.broadcast(entropy).crossJoin(p.agg(F.round(1 / F.sum(x * x), 4).alias("ess"), r6(1 / F.sum(x * x) / F.count(F.lit(1))).alias("ess_share"), F.count_if(x > 0).alias("support"), F.round(F.sum(x * F.col("n_words")), 4).alias("expected_words"), r6(F.sum(F.abs(x - 1 / F.col("t"))) / 2).alias("tv"), r6(-F.sum(x * F.log(x))).alias("entropy")))


@query(f"WITH {selector_sql(SELECTORS['bucket_prior'][1])} SELECT domain, bucket, round(sum(p), 6) AS mass, count(*)::BIGINT AS n FROM out GROUP BY GROUPING SETS ((domain), (bucket), (domain, bucket))")
def marginal_masses(spark, d):
    domain, bucket = F.col("domain"), F.col("bucket")
    sets = mixtures.bucket_prior(pool(spark, d)).groupingSets([[domain], [bucket], [domain, bucket]], domain, bucket)
    return sets.agg(r6(F.sum("p")).alias("mass"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {POOL}, m AS (SELECT doc_id, {SELECTORS['population'][1]} AS a, {SELECTORS['bucket_prior'][1]} AS b, {SELECTORS['direct_soft'][1]} AS c FROM pool) SELECT 'bucket_prior' AS a, 'direct_soft' AS b, round(sum(abs(b - c)) / 2, 6) AS tv FROM m UNION ALL SELECT 'bucket_prior', 'population', round(sum(abs(b - a)) / 2, 6) FROM m UNION ALL SELECT 'direct_soft', 'population', round(sum(abs(c - a)) / 2, 6) FROM m")
def total_variation(spark, d):
    names = ["bucket_prior", "direct_soft", "population"]
    wide = _long(spark, d, names).groupBy("doc_id").pivot("method", names).agg(F.first("p"))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    sums = wide.agg(*[(F.sum(F.abs(F.col(a) - F.col(b))) / 2).alias(f"{a}|{b}") for a, b in pairs])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r6(F.col(f"`{a}|{b}`")).alias("tv")) for a, b in pairs])).alias("x")).select("x.*")


GATED = ["rank_tilt", "conditional_rank"]
GATES = "SELECT '{m}' AS method, (SELECT max(gap) FROM (SELECT abs(sum(p) - count(*) / (SELECT count(*)::DOUBLE FROM pool)) AS gap FROM out GROUP BY domain, bucket)) <= 1e-12 AS joint_ok, 1 / sum(p * p) / count(*) >= 0.8 AS ess_ok, sum(abs(p - 1 / (SELECT count(*)::DOUBLE FROM pool))) / 2 >= 0.05 AS tv_ok FROM out"


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {selector_sql(SELECTORS[m][1])} {GATES.format(m=m)})" for m in GATED))
def admission_gates(spark, d):
    """May a selector that should keep the joint masses be trained on: it does, it does not waste the pool, and it differs from it."""
    rows, out = mixtures.with_total(pool(spark, d), _all=F.count(F.lit(1))), None
    for m in GATED:
        p = SELECTORS[m][0](rows)
        cells = p.groupBy("domain", "bucket").agg(F.abs(F.sum("p") - F.count(F.lit(1)) / F.first("_all")).alias("gap"), F.sum(F.col("p") * F.col("p")).alias("sq"), F.sum(F.abs(F.col("p") - 1 / F.col("_all"))).alias("dev"), F.first("_all").alias("t"))
        one = cells.agg(F.lit(m).alias("method"), (F.max("gap") <= 1e-12).alias("joint_ok"), (1 / F.sum("sq") / F.first("t") >= 0.8).alias("ess_ok"), (F.sum("dev") / 2 >= 0.05).alias("tv_ok"))
        out = one if out is None else out.unionByName(one)
    return out


from . import designs, feeds, packs, records, results, studies  # noqa: E402, F401  add their queries
