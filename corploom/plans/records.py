"""Question records: canonical fields with reasons for refusal, keys, prompts, roles and leaks.

The stand-in records of the test tables are conversations: the first user turn is the question, and
the sentences of the turn after it are the options, of which the first is right.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, tokens
from ..sources.io import stored, table
from .catalog import query

CLEAN = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
RECORDS = rf"""
q AS (SELECT conv_id, {CLEAN.format('arg_min(text, turn)')} AS question, arg_min(role, turn) AS role FROM conversations GROUP BY 1),
a AS (SELECT conv_id, list_filter(list_transform(string_split({CLEAN.format('arg_max(text, turn)')}, '.'), lambda x: trim(x)), lambda x: x <> '') AS options FROM conversations GROUP BY 1),
rec AS (SELECT conv_id, question, options, CASE WHEN question = '' THEN 'empty' WHEN role <> 'user' THEN 'role' WHEN len(options) < 2 THEN 'few_options' WHEN len(options) > 5 THEN 'many_options' WHEN len(list_distinct(list_transform(options, lambda x: lower(replace(x, 'ß', 'ss'))))) < len(options) THEN 'duplicate_options' WHEN len(regexp_extract_all(lower(question), '[\p{{L}}\p{{M}}\p{{N}}_]+')) + 1 > 256 THEN 'overlength' ELSE 'kept' END AS reason FROM q JOIN a USING (conv_id))
"""
LETTERS = "ABCDE"  # fixed value: labels of options


def clean(c):
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def records(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, question, options, reason): mapped fields, white space collapsed, and why a record is refused, or `kept`."""
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("first"), F.min_by("role", "turn").alias("role"), F.max_by("text", "turn").alias("last"))
    options = F.filter(F.transform(F.split(clean(F.col("last")), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    r = g.select("conv_id", clean(F.col("first")).alias("question"), options.alias("options"), "role")
    alike = F.array_distinct(F.transform("options", text.normalized))
    reason = (
        F.when(F.col("question") == "", "empty").when(F.col("role") != "user", "role").when(F.size("options") < 2, "few_options").when(F.size("options") > 5, "many_options")
        .when(F.size(alike) < F.size("options"), "duplicate_options").when(F.size(text.words(F.col("question"))) + 1 > 256, "overlength").otherwise("kept")
    )
    return r.select("conv_id", "question", "options", reason.alias("reason"))


@query(f"WITH {RECORDS} SELECT reason, count(*)::BIGINT AS n FROM rec GROUP BY 1")
def record_reasons(spark, d):
    return records(spark, d).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


CANONICAL = """'{"choices":[' || array_to_string(list_transform(options, lambda x: to_json(x)::VARCHAR), ',') || '],"question":' || to_json(question)::VARCHAR || '}'"""


@query(f"WITH {RECORDS} SELECT conv_id, sha256({CANONICAL}) AS id FROM rec WHERE reason = 'kept'")
def record_ids(spark, d):
    """Content ids: SHA-256 of canonical JSON, keys in order and without spaces."""
    r = records(spark, d).where("reason = 'kept'")
    return r.select("conv_id", text.canonical_hash(F.struct(F.col("options").alias("choices"), "question")).alias("id"))


PROMPT = "question || chr(10) || array_to_string([substr('ABCDE', i::INT, 1) || '. ' || options[i] FOR i IN range(1, len(options) + 1)], chr(10)) || chr(10) || 'Answer:'"


@query(f"WITH {RECORDS} SELECT conv_id, {PROMPT} AS prompt, len(options)::INT AS n_options FROM rec WHERE reason = 'kept'")
def record_prompts(spark, d):
    r = records(spark, d).where("reason = 'kept'")
    return r.select("conv_id", text.prompt(F.col("question"), F.col("options"), LETTERS).alias("prompt"), F.size("options").alias("n_options"))


@query(f"WITH {RECORDS} SELECT count(*)::BIGINT AS n, bool_and(len(regexp_extract_all(prompt || ' ' || substr('ABCDE', 1, 1), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) = len(regexp_extract_all(prompt, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) + 1) AS boundary_ok, true AS labels_ok FROM (SELECT {PROMPT} AS prompt FROM rec WHERE reason = 'kept')")
def label_boundaries(spark, d):
    """Checks before training: labels are distinct single words, and a label after its prompt adds just its own word."""
    r = records(spark, d).where("reason = 'kept'").select(text.prompt(F.col("question"), F.col("options"), LETTERS).alias("prompt"))
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(text.WORD), F.lit(0)))
    labels = F.array(*[F.lit(x) for x in LETTERS])
    ok = (F.size(F.array_distinct(labels)) == len(LETTERS)) & F.forall(labels, lambda x: words(x) == 1)
    return r.agg(F.count(F.lit(1)).alias("n"), F.bool_and(words(F.concat("prompt", F.lit(" A"))) == words(F.col("prompt")) + 1).alias("boundary_ok"), F.bool_and(ok).alias("labels_ok"))


FIELDS = r"""
fields AS (SELECT conv_id, question AS f FROM rec UNION ALL SELECT conv_id, unnest(options) FROM rec),
fg AS (SELECT DISTINCT conv_id, unnest([array_to_string(list_slice(ws, i, i + 12), ' ') FOR i IN range(1, (len(ws) - 11)::BIGINT)]) AS g FROM (SELECT conv_id, regexp_extract_all(lower(f), '[\p{L}\p{M}\p{N}_]+') AS ws FROM fields))
"""


def field_grams(r: DataFrame) -> DataFrame:
    """(conv_id, g): 13-grams of each field by itself, never across two."""
    fields = r.select("conv_id", F.explode(F.concat(F.array("question"), F.col("options"))).alias("f"))
    return fields.select("conv_id", F.explode(text.grams(text.words(F.col("f")))).alias("g")).distinct()


@query(f"WITH {RECORDS}, {FIELDS} SELECT conv_id, count(*)::BIGINT AS n_grams FROM fg GROUP BY 1")
def record_field_grams(spark, d):
    return field_grams(records(spark, d)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_grams"))


ROLES = "role AS (SELECT conv_id, CASE WHEN r <= 8 THEN 'dev' WHEN r <= 24 THEN 'test' ELSE 'train' END AS role FROM (SELECT conv_id, row_number() OVER (ORDER BY sha256('records:' || conv_id::VARCHAR)) AS r FROM rec))"


def record_roles(r: DataFrame) -> DataFrame:
    """(conv_id, role): the first 8 by salted hash are dev, the next 16 test."""
    first = r.select("conv_id", text.salted_key("records", F.col("conv_id")).alias("k")).orderBy("k").limit(24)
    w = Window.partitionBy().orderBy("k")  # 24 rows
    named = first.select("conv_id", F.when(F.row_number().over(w) <= 8, "dev").otherwise("test").alias("role"))
    return r.select("conv_id").join(named, "conv_id", "left").withColumn("role", F.coalesce("role", F.lit("train")))


@query(f"WITH {RECORDS}, {FIELDS}, {ROLES}, held AS (SELECT DISTINCT g FROM fg JOIN role USING (conv_id) WHERE role <> 'train'), hq AS (SELECT DISTINCT lower(replace(question, 'ß', 'ss')) AS q FROM rec JOIN role USING (conv_id) WHERE role <> 'train') SELECT conv_id, exact, gram FROM (SELECT rec.conv_id, lower(replace(question, 'ß', 'ss')) IN (SELECT q FROM hq) AS exact, coalesce(hit, false) AS gram FROM rec JOIN role USING (conv_id) LEFT JOIN (SELECT DISTINCT conv_id, true AS hit FROM fg SEMI JOIN held USING (g)) h USING (conv_id) WHERE role = 'train')")
def record_leaks(spark, d):
    """Training records that a held-out one gives away: by the same question, or by a shared 13-gram of a field."""
    r = stored(records(spark, d))
    role = stored(record_roles(r))
    held = role.where("role <> 'train'").select("conv_id")
    grams = stored(field_grams(r))
    hit = grams.join(grams.join(held, "conv_id").select("g").distinct(), "g", "left_semi").select("conv_id").distinct().withColumn("hit", F.lit(True))
    keyed = r.select("conv_id", text.normalized(F.col("question")).alias("q"))
    same = keyed.join(keyed.join(held, "conv_id").select("q").distinct(), "q", "left_semi").select("conv_id").withColumn("same", F.lit(True))
    train = role.where("role = 'train'").select("conv_id")
    return train.join(same, "conv_id", "left").join(hit, "conv_id", "left").select("conv_id", F.coalesce("same", F.lit(False)).alias("exact"), F.coalesce("hit", F.lit(False)).alias("gram"))


@query("WITH res AS (SELECT doc_id FROM labels WHERE toxic = 1), src AS (SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0) SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM res) AND source NOT IN (SELECT source FROM src WHERE source IS NOT NULL)")
def two_key_exclusion(spark, d):
    """Rows of which neither the id nor the question (here: the source) is protected."""
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents").select("doc_id", "source")
    ids = labels.where("toxic = 1").select("doc_id").distinct()
    keys = docs.join(labels.where("toxic = 1 and quality = 0").select("doc_id"), "doc_id", "left_semi").select("source").distinct()
    return docs.join(ids, "doc_id", "left_anti").join(keys, "source", "left_anti").where("source is not null").select("doc_id", "source")


PAIRS = "ids AS (SELECT conv_id, role, lower(replace(question, 'ß', 'ss')) AS k, 'exact' AS kind FROM rec JOIN role USING (conv_id) UNION ALL SELECT conv_id, role, g, 'gram' FROM fg JOIN role USING (conv_id))"


# some records stand there again under other ids, so that roles do share
TWICE = RECORDS.replace("\nrec AS", "\nrec0 AS").rstrip() + ", rec AS (SELECT * FROM rec0 UNION ALL SELECT conv_id + 1000000 * k, question, options, reason FROM rec0, range(1, 4) t(k) WHERE conv_id % 3 = 0)"


@query(f"WITH {TWICE}, {FIELDS}, {ROLES}, {PAIRS}, grid AS (SELECT * FROM (VALUES ('exact'), ('gram')) k(kind), (VALUES ('dev', 'test'), ('dev', 'train'), ('test', 'train')) r(a, b)), found AS (SELECT a.kind, a.role AS a, b.role AS b, count(DISTINCT a.conv_id)::BIGINT AS n FROM ids a JOIN ids b ON a.kind = b.kind AND a.k = b.k AND a.role < b.role GROUP BY 1, 2, 3) SELECT kind, a, b, coalesce(n, 0)::BIGINT AS n FROM grid LEFT JOIN found USING (kind, a, b)")
def role_leaks(spark, d):
    """How many records of a role share a question or a 13-gram with each other role; pairs that share nothing too."""
    once = records(spark, d)
    more = once.where("conv_id % 3 = 0").withColumn("conv_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.col("conv_id") + 1_000_000 * k)))
    r = stored(once.unionByName(more))
    role = stored(record_roles(r))
    exact = r.select("conv_id", text.normalized(F.col("question")).alias("k"), F.lit("exact").alias("kind"))
    keys = stored(exact.unionAll(field_grams(r).select("conv_id", F.col("g").alias("k"), F.lit("gram").alias("kind"))).join(role, "conv_id"))
    # a key is held by three roles at most, so that pairs are with roles, not with records
    theirs = keys.select("kind", "k", F.col("role").alias("b")).distinct()
    found = keys.withColumnRenamed("role", "a").join(theirs, ["kind", "k"]).where("a < b").groupBy("kind", "a", "b").agg(F.count_distinct("conv_id").alias("n"))
    roles = ("dev", "test", "train")
    grid = spark.createDataFrame([(k, a, b) for k in ("exact", "gram") for a in roles for b in roles if a < b], "kind string, a string, b string")
    return grid.join(found, ["kind", "a", "b"], "left").select("kind", "a", "b", F.coalesce("n", F.lit(0)).alias("n"))


# --- tokens ------------------------------------------------------------------------------------


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def prompts(spark, d):
    r = records(spark, d).where("question <> '' and size(options) between 2 and 5")
    return r.select("conv_id", text.prompt(F.col("question"), F.col("options"), LETTERS).alias("prompt"))


@query()
def record_tokens(spark, d):
    """How many tokens each record's prompt has, and whether a label would be one too many."""
    ids = prompts(spark, d).select("conv_id", tokens.token_ids(F.col("prompt"), tokenizer_file()).alias("ids"))
    return ids.select("conv_id", F.size("ids").alias("n_tokens"), tokens.overlength(F.col("ids")).alias("overlength"))


@query()
def token_boundaries(spark, d):
    """For each label, a distinct single token, how many prompts keep their own tokens before it, and how many do not."""
    path = tokenizer_file()
    labels = list(tokens.single_labels([f" {x}" for x in LETTERS], path))
    asked = prompts(spark, d)
    out = None
    for label in labels:
        told = asked.select(tokens.boundary_kept(F.col("prompt"), label, path).alias("ok"))
        one = told.agg(F.lit(label.strip()).alias("label"), F.count_if("ok").alias("kept"), F.count_if(~F.col("ok")).alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out
