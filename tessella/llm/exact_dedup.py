"""Exact duplicates, with frequent texts split off by Misra-Gries counters.

Texts are equal when their SHA-256 without white space is.  Rows are numbered and
reduced to their digest and length once.  Counters find the frequent digests:
each block of rows counts its digests and keeps the COUNTERS largest counts less
the next one; summaries merge by adding their counts and cutting again, in a
tree of MERGED summaries a task.  Any digest on more than 1/(COUNTERS+1) of all rows is
among the counters left.  These at most COUNTERS digests get their exact size
and the row that stays by a second count over all rows; that table is broadcast,
so rows of frequent texts are decided where they are.  All other rows meet by an
ordinary shuffle on their digest, in groups of a bounded share of all rows.

Edge cases: a null text equals an empty one and one of white space only; of rows
that tie in length the smallest id stays, a null id only if there is no other,
and of rows that repeat an id the first read; other columns are ignored by
``groups`` and kept by ``keep``, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.llm.shared import written

COUNTERS = 1024
BLOCK_BITS = 12  # rows of a block, as a power of two
MERGED = 16

# The characters that don't count.
SPACE = " \t\n\x0b\x0c\r"


def digest(text: Column) -> Column:
    """SHA-256 of a text without its white space, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACE, "").cast("binary"), 256))


def _cut(counts: DataFrame, counters: int) -> DataFrame:
    """``part, counters`` from ``part, digest, n``: the largest counts, less the first that has no counter."""
    every = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("n", "digest")), asc=False).alias("every"))
    next_one = F.coalesce(F.get("every", F.lit(counters))["n"], F.lit(0).cast("long"))
    less = lambda c: F.struct((c["n"] - next_one).alias("n"), c["digest"].alias("digest"))
    return every.select("part", F.filter(F.transform("every", less), lambda c: c["n"] > 0).alias("counters"))


def frequent(marks: DataFrame, counters: int = COUNTERS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``digest``: at most ``counters`` of them, with all that are on more than a ``counters + 1``-th of the rows."""
    part = F.shiftright("row", block_bits)
    found = _cut(marks.groupBy(part.alias("part"), "digest").agg(F.count("*").alias("n")), counters)
    parts = marks.select(part.alias("part")).distinct().count()
    while parts > 1:
        parts = -(-parts // MERGED)
        deal = F.pmod(F.xxhash64("part"), F.lit(parts)).alias("part")
        each = found.select(deal, F.explode("counters").alias("c")).groupBy("part", "c.digest").agg(F.sum("c.n").alias("n"))
        found = _cut(each, counters)
    return found.select(F.explode("counters").alias("c")).select("c.digest")


def _winners(marks: DataFrame) -> DataFrame:
    """``digest, best, group_size``: the row that stays and how many there are."""
    order = F.struct((-F.col("n_chars")).alias("shorter"), F.isnull("doc_id").alias("nameless"), "doc_id", "row")
    return marks.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))


def _decided(marks: DataFrame, counters: int, block_bits: int) -> DataFrame:
    # At most ``counters`` rows of 32 bytes are broadcast, and as many winners.
    candidates = written(frequent(marks, counters, block_bits), "frequent")
    heavy = written(_winners(marks.join(F.broadcast(candidates), "digest", "left_semi")), "winners")
    split = marks.join(F.broadcast(heavy), "digest", "left")
    light = marks.join(F.broadcast(candidates), "digest", "left_anti")
    rows = split.filter(F.col("best").isNotNull()).unionByName(light.join(_winners(light), "digest"))
    return rows.select(
        "row", "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _numbered(docs: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    value = F.col(text).cast("string")
    length = F.char_length(F.coalesce(value, F.lit(""))).cast("long")
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("doc_id"), length.alias("n_chars"), digest(value).alias("digest"), *more
    )


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row."""
    return _decided(written(_numbered(docs, id, text), "digests"), counters, block_bits).drop("row")


def keep(docs: DataFrame, id: str = "doc_id", text: str = "text", counters: int = COUNTERS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = written(_numbered(docs, id, text, F.struct("*").alias("doc")), "rows")
    found = _decided(rows.drop("doc"), counters, block_bits)
    return rows.join(found.filter("kept").select("row"), "row", "left_semi").select("doc.*")
