"""Text functions: normalising, hashing, words, n-grams.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"


def normalized(text: Column) -> Column:
    """Case-folded, with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("ß"), F.lit("ss"))), r"(?U)\s+", " "))


def content_id(text: Column) -> Column:
    return F.sha2(normalized(text).cast("binary"), 256)


def salted_key(salt: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(salt + ":"), key.cast("string")).cast("binary"), 256)


def uniform(salt: str, key: Column) -> Column:
    """A number in [0, 1) that hangs on salt and key alone."""
    return F.conv(F.substring(salted_key(salt, key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def word_counts(w: Column) -> Column:
    """Array of (t, c): each distinct word and how often it occurs; sorted words are alike in runs, whose begins are told apart by their neighbours."""
    begins = lambda v: F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1)))
    runs = lambda v, b: F.transform(b, lambda i, k: F.struct(F.get(v, i).alias("t"), (F.coalesce(F.get(b, k + 1), F.size(v)) - i).cast("long").alias("c")))
    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return bound(F.sort_array(w), lambda v: F.when(F.size(v) > 0, bound(begins(v), lambda b: runs(v, b))))


def grams(w: Column, n: int = 13) -> Column:
    """Hashes of n words in a row; none where there are fewer."""
    gram = lambda v, i: F.substring(F.sha2(F.array_join(F.slice(v, i, n), " ").cast("binary"), 256), 1, 24)
    made = lambda v: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: gram(v, i)))
    # an array of one binds the words, which would else be cut again for every gram
    return F.get(F.transform(F.array(w), lambda v: F.when(F.size(v) >= n, made(v)).otherwise(F.array().cast("array<string>"))), F.lit(0))


def gram_keys(w: Column, n: int = 13) -> Column:
    """64-bit hashes of n words in a row, by place; none where there are fewer."""
    made = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - (n - 1)), lambda i: F.xxhash64(F.slice(v, i, n)))
    return F.get(F.transform(F.array(w), lambda v: F.when(F.size(v) >= n, made(v)).otherwise(F.array().cast("array<bigint>"))), F.lit(0))


def grams_at(w: Column, places: Column, n: int = 13) -> Column:
    """As grams, of the runs that begin at the given places, from 0."""
    gram = lambda v, i: F.substring(F.sha2(F.array_join(F.slice(v, i + 1, n), " ").cast("binary"), 256), 1, 24)
    return F.get(F.transform(F.array(w), lambda v: F.transform(places, lambda i: gram(v, i))), F.lit(0))


def byte_prefix(text: Column, width: int) -> Column:
    """The first `width` bytes of UTF-8, without a character cut in two."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, width)
    # U+FFFD stands for a broken tail; three bytes back are always enough
    whole = [F.when(F.is_valid_utf8(F.substring(raw, 1, width - k).cast("string")), F.substring(raw, 1, width - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= width, text).otherwise(F.coalesce(*whole))


def json_domain(meta: Column, key: str, default: str = "unknown") -> Column:
    return F.coalesce(F.get_json_object(meta, f"$.{key}"), F.lit(default))


def failure_kind(message: Column) -> Column:
    m = F.lower(message)
    return F.when(m.rlike("interrupt|signal|preempt"), "interrupted").when(m.rlike("nan|inf|finite|overflow"), "numerical").otherwise("runtime")


def canonical_hash(record: Column) -> Column:
    """SHA-256 of a struct as JSON: give its fields in the order of their names; no spaces, absent fields written as null."""
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}).cast("binary"), 256)


def prompt(question: Column, options: Column, letters: str) -> Column:
    """The question, its lettered options a line each, and the call for an answer."""
    lines = F.transform(options, lambda x, i: F.concat(F.substring(F.lit(letters), i + 1, F.lit(1)), F.lit(". "), x))
    return F.concat_ws("\n", question, F.array_join(lines, "\n"), F.lit("Answer:"))


def receipt(raw: Column, schema: str, most: int = 256 << 10) -> Column:
    """The JSON object in raw by its schema; null where it is none, is broken or has over `most` bytes."""
    body = F.trim(raw)
    return F.when((F.octet_length(raw) <= most) & body.startswith("{") & body.endswith("}"), F.from_json(raw, schema, {"mode": "PERMISSIVE"}))


def interval_text(mean: Column, half: Column, form: str = "%.4f") -> Column:
    """`x [low, high]`; `x` alone without a width, `n/a` without a mean."""
    return F.when(mean.isNull(), "n/a").when(half.isNull(), F.format_string(form, mean)).otherwise(F.format_string(f"{form} [{form}, {form}]", mean, mean - half, mean + half))
