"""Joins of a large table with a lookup table of any size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from tessella.session import written

SALTS = 32


def lookup_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table with a lookup table on ``on``.

    Nothing is measured while the plan is made.  Spark broadcasts the lookup
    where its statistics, or the shuffled bytes of its own aggregation, are below
    the session's threshold; otherwise both sides meet in a sort-merge join whose
    hot keys adaptive execution splits.  ``salted_join`` splits them beforehand.
    """
    return df.join(table, on, how)


def _row_number() -> Column:
    """A number that differs between rows of a partition, equal ones too."""
    return F.monotonically_increasing_id()


def salted_join(df: DataFrame, table: DataFrame, on: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Equi join that splits every key of ``df`` into ``salts`` parts.

    Rows are dealt to the salts in turn within their task, so equal rows part
    and columns of any type may be there.  They are written with their salts to the scratch
    folder first: a map task that is lost and run again reads the salts that
    it had, so no row meets its partner twice or not at all.  Rows of ``table`` are repeated once per salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"A salted join cannot be {how}.")
    salt = f"salt_{uuid.uuid4().hex}"
    spread = written(df.withColumn(salt, F.pmod(_row_number(), F.lit(salts)).cast("int")), "salted")
    copies = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*on, salt], how).drop(salt)


MOST_ROWS = 100_000  # rows of a key that stay together
MOST_KEYS = 4096  # keys that are split at most


def split_join(df: DataFrame, table: DataFrame, on: list[str], popularity: DataFrame, by: list[str], how: str = "inner", most: int = MOST_ROWS) -> DataFrame:
    """Join ``df`` on ``on`` with its popular keys split into blocks of about ``most`` rows.

    ``popularity`` counts the rows ``n`` of ``df`` for each key.  Keys with more than ``most``
    rows and more than one in MOST_KEYS of all are therefore at most MOST_KEYS, and
    are broadcast; their rows are dealt to blocks by a hash of the columns ``by``, so a
    recomputed task deals them alike, and the table's rows are repeated once per block.
    """
    block, blocks = f"block_{uuid.uuid4().hex}", f"blocks_{uuid.uuid4().hex}"
    total = popularity.agg(F.sum("n")).scalar()
    popular = popularity.filter((F.col("n") > most) & (F.col("n") * MOST_KEYS > total))
    popular = F.broadcast(popular.select(*on, F.ceil(F.col("n") / most).cast("long").alias(blocks)))
    count = F.coalesce(F.col(blocks), F.lit(1).cast("long"))
    dealt = df.join(popular, on, "left").withColumn(block, F.pmod(F.xxhash64(*by), count)).drop(blocks)
    copies = table.join(popular, on, "left").withColumn(block, F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop(blocks)
    return dealt.join(copies, [*on, block], how).drop(block)
