"""Quality rules whose cutoffs carry a guarantee, in DataFrame functions alone.

Each rule measures a text; a text is rejected where some measure lies above its rule's cutoff in the
text's stratum.  Cutoffs of all rules tighten together along a path: step c would reject, by each rule, at
most a share of PATH[c] of the stratum's texts without a label.  On the labelled good texts, which had no say in the path,
each step is tested: its exact (Clopper-Pearson) upper bound on the share of good texts that any
rule rejects must stay within `risk`.  Steps are tested from the loosest on and the first that fails
ends the walk (fixed-sequence testing, which needs no further correction along the path); the level is divided by the number of
strata (Bonferroni).  With probability 1 - error no stratum loses more than `risk` of its good texts.
A stratum without enough labelled good texts, or without texts that have no label, rejects nothing.

Equal texts of a stratum count once, on either side: copies are no independent witnesses.  Null texts have no words,
and fail the base rule as empty ones do.  A null stratum is one of its own.  Labels that are null
are ignored; a text labelled good and bad counts as good.  Null ids have no label.  Rows that repeat each come back.
A very long text is an array of words in one row, in memory of some tens of times its size.
An empty table gives an empty one; columns other than the three that are named are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"  # fixed value: the symbols that are counted
WINDOW = 8
BINS = 1000
# Shares of unlabelled texts that a rule may reject, step by step.
PATH = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2)


def repeated_words(words: Column) -> Column:
    """How many words lie in WINDOW-word runs that occur twice or more."""
    n = F.size(words)
    keys = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(covered(keys)).cast("long")


def covered(keys: Column) -> Column:
    """keys: of windows by start.  The union of the windows whose key occurs again."""
    placed = lambda k: F.sort_array(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    pairs = lambda s: F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]))
    starts = lambda s: F.sort_array(F.transform(pairs(s), lambda x: x["i"]))
    # an array of one stands for a let: what it holds is computed once
    held = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    union = lambda p: F.aggregate(
        p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("end")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i + WINDOW - a["end"])).alias("n"), (i + WINDOW).alias("end")),
        lambda a: a["n"],
    )
    return held(keys, lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0)).otherwise(held(placed(k), lambda s: held(starts(s), union))))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Rows (id, stratum) and the counts that rules are made of."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stage = docs.select(F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), text.alias("text"), F.xxhash64(F.lit(1), text).alias("h1"), F.xxhash64(F.lit(2), text).alias("h2"))
    stage = stage.withColumn("words", F.filter(F.split("text", SPACES), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stage = stage.withColumn("lines", lines)
    return stage.select(
        "id", "stratum", "h1", "h2",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_kinds"),
    )


def rules() -> dict[str, Column]:
    """Measures from 0 to 1; the higher the worse."""
    part = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0).cast("long")), F.lit(0.0))
    return {
        "symbols": F.least(F.lit(1.0), part("n_symbols", "word_chars")),
        "dup_lines": part("n_dup_lines", "n_lines"),
        "repeats": part("n_repeat_words", "n_words"),
        "sameness": 1 - part("n_kinds", "n_words"),
    }


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(X <= k), X binomial of n and p, by the recurrence of its terms; n >= 1, 0 < p < 1."""
    odds = math.log(p) - math.log1p(-p)
    step = lambda a, i: a["t"] + F.log((n - i + 1) / i.cast("double")) + odds
    join = lambda x, y: F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y)))
    first = n * math.log1p(-p)
    return F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")),
        F.struct(first.alias("t"), first.alias("s")),
        lambda a, i: F.struct(step(a, i).alias("t"), join(a["s"], step(a, i)).alias("s")),
        lambda a: a["s"],
    )


def binned(x: Column) -> Column:
    """The least number of BINS-ths that is at least x."""
    return F.ceil(x * BINS).cast("int")


def paths(measures: DataFrame) -> DataFrame:
    """Rows (stratum, path): for each rule an array of cutoffs in BINS-ths, one a step, from the texts given."""
    long = measures.dropDuplicates(["stratum", "h1", "h2"]).select("stratum", F.explode(F.create_map(*[F.lit(x) if isinstance(x, str) else x for pair in rules().items() for x in pair])).alias("rule", "x"))
    bins = long.groupBy("stratum", "rule", binned(F.col("x")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # BINS + 1 rows a rule at most
    of = Window.partitionBy("stratum", "rule")
    above = bins.withColumn("above", (F.coalesce(F.sum("n").over(of.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("n").over(of))
    cuts = [F.min(F.when(F.col("above") <= share, F.col("bin"))) for share in PATH]
    each = above.groupBy("stratum", "rule").agg(F.array(*cuts).alias("cuts"))
    return each.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cuts"))).alias("path"))


def first_step(path: Column) -> Column:
    """The step that first rejects a text, len(PATH) if none does: cutoffs fall along the path."""
    spared = lambda name, x: F.size(F.filter(path[name], lambda c: binned(x) <= c))
    return F.least(*[spared(name, x) for name, x in rules().items()])


def cutoffs(measures: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Rows (stratum, path, steps, n_good, n_rejected), one a stratum: the first `steps` steps of its path are safe."""
    marked = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col)).alias("y"))
    seen = measures.join(marked.select("id"), "id", "left_semi").select("stratum", "h1", "h2").distinct()
    same = lambda a, b: a["stratum"].eqNullSafe(b["stratum"])
    fresh = measures.join(seen, same(measures, seen) & (measures["h1"] == seen["h1"]) & (measures["h2"] == seen["h2"]), "left_anti")
    path = stored(paths(fresh))
    good = measures.join(marked.where("y = 1").select("id"), "id", "left_semi").dropDuplicates(["stratum", "h1", "h2"])
    at = good.join(path.withColumnRenamed("stratum", "s"), F.col("stratum").eqNullSafe(F.col("s"))).select("stratum", "path", first_step(F.col("path")).alias("step"))
    counts = at.groupBy("stratum").agg(F.first("path").alias("path"), F.count(F.lit(1)).alias("n_good"), *[F.count_if(F.col("step") <= c).alias(f"r{c}") for c in range(len(PATH))])
    level = math.log(error / max(1, path.count()))
    # beyond the mean the tail is over a third: no bound can hold there
    rejected = F.array(*[F.col(f"r{c}") for c in range(len(PATH))])
    safe = F.transform(rejected, lambda k: F.when(k <= F.col("n_good") * risk, log_binomial_tail(F.col("n_good"), k, risk) <= level).otherwise(F.lit(False)))
    steps = F.coalesce(F.nullif(F.array_position(safe, False), F.lit(0)) - 1, F.lit(len(PATH))).cast("int")
    return counts.select("stratum", "path", "n_good", rejected.alias("rejected"), steps.alias("steps")).select("stratum", "path", "steps", "n_good", F.coalesce(F.get("rejected", F.col("steps") - 1), F.lit(0)).alias("n_rejected"))


def apply(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row for each of docs: counts, base_failed, kept, rejected_by (rules, by name, between commas)."""
    measures = stored(measured(docs, id_col, text_col, stratum_col))
    chosen = cutoffs(measures, labels, risk, error, id_col=id_col).select(F.col("stratum").alias("s"), "path", "steps")
    joined = measures.join(F.broadcast(chosen), measures["stratum"].eqNullSafe(chosen["s"]), "left") if chosen.count() <= 10_000 else measures.join(chosen, measures["stratum"].eqNullSafe(chosen["s"]), "left")
    cut = lambda name: F.get(F.col("path")[name], F.col("steps") - 1)
    over = F.filter(F.array(*[F.when(binned(x) > cut(name), F.lit(name)) for name, x in sorted(rules().items())]), lambda r: r.isNotNull())
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (F.size(over) == 0)).alias("kept"), F.array_join(over, ",").alias("rejected_by"),
    )
