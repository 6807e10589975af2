"""Bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the K smallest 64-bit hashes of a text's
distinct shingles of WORDS words (a shorter text is one shingle).  Sketches of
parts merge to the sketch of the whole, and estimate resemblance, containment
and the number of distinct shingles; with fewer than K shingles they are exact.

Edge cases: a null or empty text has an empty sketch; two empty sketches have
likeness 1, an empty and a filled one 0; repeated rows are rows of their own;
null ids sort as the smallest; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

WORDS = 5
K = 128
ROWS_PER_BUCKET = 256
MOST_BUCKETS = 10_000

_HASHES = 2.0**64


def word_hashes(text: Column) -> Column:
    found = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, length: int = WORDS) -> Column:
    """Hashes of all shingles of an array of word hashes, in order."""
    n = F.size(words)
    each = F.transform(F.sequence(F.lit(0), n - length), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(length))))
    return F.when(n >= length, each).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """``df`` with the sketch of a text column; intermediate columns are structs of one step each."""
    words = df.select("*", word_hashes(F.col(text)).alias("__words"))
    return words.select(*df.columns, bottom(shingle_hashes(F.col("__words")), k).alias(name))


def sketch(docs: DataFrame, k: int = K) -> DataFrame:
    """``doc_id, sketch`` per document."""
    return with_sketch(docs.select("doc_id", F.col("text").cast("string").alias("text")), "text", "sketch", k).drop("text")


def merge(sketches: DataFrame, key: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per key from the sketches of its parts.

    A hot key's hashes are reduced to K in each of ``salts`` groups first, so no
    task holds more than K rows per group after the first step.
    """
    rows = sketches.select(F.col(key).alias("key"), F.explode("sketch").alias("h"))
    rows = rows.withColumn("salt", F.pmod("h", F.lit(salts))).distinct()
    few = lambda parts: Window.partitionBy(*parts).orderBy("h")
    rows = rows.withColumn("r", F.row_number().over(few(["key", "salt"]))).filter(F.col("r") <= k)
    rows = rows.withColumn("r", F.row_number().over(few(["key"]))).filter(F.col("r") <= k)
    return rows.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both."""
    both = bottom(F.concat(a, b), k)
    common = F.size(F.array_intersect(both, F.array_intersect(a, b)))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    last = F.element_at(a, k).cast("double") + F.lit(_HASHES / 2)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit((k - 1) * _HASHES) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the first text's shingles that the second has."""
    both = distinct_shingles(bottom(F.concat(a, b), k), k)
    found = resemblance(a, b, k) * both / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), found))


def as_text(a: Column) -> Column:
    """The sketch as lower-case hex, 16 digits a hash."""
    return F.concat_ws("", F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))))


def _bucket(column: Column, bounds: list[int]) -> Column:
    """How many of the ascending bounds a value reaches, looked up in two steps."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    literal = lambda values: F.expr(f"array({', '.join(f'{v}L' for v in values)})")
    reach = lambda values: F.size(F.filter(values, lambda b: b <= column))
    part = reach(literal([p[0] for p in parts]))
    inner = F.expr(f"array({', '.join('array(' + ', '.join(f'{v}L' for v in p) + ')' for p in parts)})")
    return F.when(part == 0, 0).otherwise((part - 1) * step + reach(F.get(inner, part - 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, sketch, next_text, next_sketch`` in descending order of ids.

    The document after the last is the first; equal ids are ordered by text.  Rows
    are dealt into buckets of consecutive ids between approximate percentiles,
    and each bucket also gets the first row of the one after it, so the text
    moves once and no task orders more than its bucket.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    parts = min(MOST_BUCKETS, ids.count() // ROWS_PER_BUCKET)
    shares = [k / (parts + 1) for k in range(1, parts + 1)]
    found = ids.agg(F.percentile_approx("doc_id", shares, 20 * parts).alias("b")).first()["b"] if parts else None
    bounds = sorted(set(found or []))
    dealt = rows.select("doc_id", "text", _bucket(F.col("doc_id"), bounds).alias("bucket"), F.lit(False).alias("ghost"))
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("largest"))
    above = Window.orderBy("bucket")
    target = F.coalesce(F.lead("bucket").over(above), F.first("bucket").over(above))
    heads = heads.select("largest", F.col("bucket").alias("own"), target.alias("to"))
    # At most MOST_BUCKETS + 1 rows are broadcast, and as many texts found by them.
    ghosts = dealt.join(F.broadcast(heads), (dealt.bucket == heads.own) & dealt.doc_id.eqNullSafe(heads.largest))
    ghosts = ghosts.groupBy("to", "doc_id").agg(F.max("text").alias("text"))
    ghosts = ghosts.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    all_rows = with_sketch(dealt.unionByName(ghosts), "text", "sketch")
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("text"))
    following = all_rows.select("*", F.lead("text").over(order).alias("next_text"), F.lead("sketch").over(order).alias("next_sketch"))
    return following.filter(~F.col("ghost")).drop("bucket", "ghost")


def edited(text: Column, other: Column) -> Column:
    """The text with its last half replaced by the start of another."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(other, F.lit(1), half))
