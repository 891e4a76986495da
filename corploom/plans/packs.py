"""Selectors over packs: rows inherit their pack's scores; what is ranked or dealt anew are packs.

The stand-in packs of the test tables are the documents of a domain whose ids leave one remainder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import mixtures
from ..sources.io import stored
from .catalog import POOL, edges_bucket, pool, query

EDGES = " + ".join(f"(cr >= {e})::INT" for e in mixtures.FIXED_EDGES)
PACKS = f"""{POOL}, k AS (SELECT *, domain || ':' || (doc_id % 13)::VARCHAR AS pack FROM pool),
packs AS (SELECT *, {EDGES} AS bucket FROM (SELECT domain, pack, avg(cr) AS cr, max(score) AS score, max(wrong) AS wrong FROM k GROUP BY 1, 2)),
members AS (SELECT doc_id, pack, packs.domain, packs.bucket, packs.score, packs.wrong FROM k JOIN packs USING (pack))"""
DEALT = "dealt AS (SELECT a.pack, b.x FROM (SELECT pack, row_number() OVER (ORDER BY pack) AS i FROM packs) a JOIN (SELECT {x} AS x, row_number() OVER (ORDER BY sha256('{seed}:' || pack), pack) AS i FROM packs) b USING (i))"
PRIOR = "sum({x}) OVER (PARTITION BY bucket) / count(*) OVER (PARTITION BY bucket) / sum({x}) OVER ()"


def packed(spark, d):
    """Members with their pack's domain, bucket and scores; and the packs."""
    k = pool(spark, d).withColumn("pack", F.concat_ws(":", "domain", F.col("doc_id") % 13))
    packs = k.groupBy("domain", "pack").agg(F.avg("cr").alias("cr"), F.max("score").alias("score"), F.max("wrong").alias("wrong"))
    packs = stored(packs.withColumn("bucket", edges_bucket(F.col("cr"), mixtures.FIXED_EDGES)))
    return mixtures.inherited(k, packs, ["bucket", "score", "wrong"]), packs


def p9(df):
    return df.select("doc_id", F.round("p", 9).alias("p"))


@query(f"WITH {PACKS} SELECT doc_id, round({PRIOR.format(x='greatest(score, 0)')}, 9) AS p FROM members")
def pack_prior(spark, d):
    """Scores gathered from packs, then the bucket prior without tau."""
    members, _ = packed(spark, d)
    return p9(mixtures.bucket_prior(members, tau=0.0, on_empty="uniform"))


@query(f"WITH {PACKS}, {DEALT.format(x='score', seed=1405)}, m AS (SELECT doc_id, bucket, greatest(x, 0) AS x FROM members JOIN dealt USING (pack)) SELECT doc_id, round({PRIOR.format(x='x')}, 9) AS p FROM m")
def pack_shuffled(spark, d):
    members, packs = packed(spark, d)
    return p9(mixtures.bucket_prior(mixtures.shuffled_packs(members, packs, 1405, ["score"]), tau=0.0, on_empty="uniform"))


@query(f"WITH {PACKS} SELECT doc_id, round({PRIOR.format(x='greatest(score - wrong, 0)')}, 9) AS p FROM members")
def pack_contrastive(spark, d):
    """The clipped contrast of a pack, inherited; no mass at all is unavailable."""
    members, _ = packed(spark, d)
    return p9(mixtures.contrastive(members))


@query(f"WITH {PACKS}, {DEALT.format(x='greatest(score - wrong, 0)', seed=1606)}, m AS (SELECT doc_id, bucket, x FROM members JOIN dealt USING (pack)) SELECT doc_id, round({PRIOR.format(x='x')}, 9) AS p FROM m")
def pack_contrastive_shuffled(spark, d):
    members, packs = packed(spark, d)
    contrast = packs.withColumn("a", F.greatest(F.col("score") - F.col("wrong"), F.lit(0.0)))
    return p9(mixtures.strict_bucket_prior(mixtures.shuffled_packs(members, contrast, 1606, ["a"]), "a"))


RANKED = "z AS (SELECT *, CASE WHEN ties = m THEN 0.0 ELSE (r + (ties - 1) / 2.0 - 0.5) / m - 0.5 END AS z FROM (SELECT *, count(*) OVER (PARTITION BY domain, bucket) AS m, count(*) OVER (PARTITION BY domain, bucket, score - wrong) AS ties, rank() OVER (PARTITION BY domain, bucket ORDER BY score - wrong) AS r FROM packs))"
TILT = "SELECT doc_id, round(count(*) OVER (PARTITION BY domain, bucket) * 4.0 ** z / sum(4.0 ** z) OVER (PARTITION BY domain, bucket) / count(*) OVER (), 9) AS p FROM t"


@query(f"WITH {PACKS}, {RANKED}, t AS (SELECT doc_id, members.domain, members.bucket, z FROM members JOIN z USING (pack)) {TILT}")
def pack_rank(spark, d):
    """The rank of the signed contrast among the packs of a domain and bucket tilts their rows; the joint mass stays."""
    return p9(mixtures.pack_rank(*packed(spark, d)))


@query(f"WITH {PACKS}, {RANKED}, o AS (SELECT *, row_number() OVER (PARTITION BY domain, bucket ORDER BY pack) AS i, row_number() OVER (PARTITION BY domain, bucket ORDER BY sha256('1707:' || pack), pack) AS j FROM z), n AS (SELECT a.pack, b.z FROM o a JOIN o b ON a.domain = b.domain AND a.bucket = b.bucket AND a.i = b.j), t AS (SELECT doc_id, members.domain, members.bucket, z FROM members JOIN n USING (pack)) {TILT}")
def pack_rank_permuted(spark, d):
    return p9(mixtures.pack_rank(*packed(spark, d), seed=1707))
