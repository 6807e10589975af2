"""Long forms of ordered groups: ranks, and texts in segments with their offsets.

A group of any size is spread: rows are dealt into ranges of group and order,
counted per range and group, and a row's rank is its place in its range plus the
counts of the ranges before.  A text is made segment by segment, each of a fixed
number of lines by its own task, at the offset that the lengths before it add up to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tessella.session import written

LINES = 4096  # of a segment
_BEFORE = (Window.unboundedPreceding, -1)
_INDEX_BITS = 33  # monotonically_increasing_id() has a row's place in its partition in these


def _before(c: str, *window: str, order: str) -> Column:
    return F.coalesce(F.sum(c).over(Window.partitionBy(*window).orderBy(order).rowsBetween(*_BEFORE)), F.lit(0))


def ranked(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rank") -> DataFrame:
    """``df`` with each row's place in its group, from 0 on; rows that tie in ``order`` follow one another in any way.

    Null groups are a group.  The sorted rows are kept in the scratch folder.
    """
    keys = [*group, *order]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = written(ordered.withColumn("__place", F.monotonically_increasing_id()), "ordered")
    index = F.col("__place") - F.shiftleft(F.shiftright("__place", _INDEX_BITS), _INDEX_BITS)
    rows = rows.withColumns({"__part": F.shiftright("__place", _INDEX_BITS), "__index": index})
    starts = rows.groupBy("__part", *group).agg(F.min("__index").alias("__first"), F.count("*").alias("__n"))
    starts = starts.withColumn("__earlier", _before("__n", *group, order="__part"))
    starts = starts.select("__part", "__first", "__earlier", *(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    found = rows.withColumnRenamed("__part", "__of").join(starts, [F.col("__of") == F.col("__part"), *same])
    return found.select(*df.columns, (F.col("__earlier") + F.col("__index") - F.col("__first")).alias(name))


def group_values(df: DataFrame, by: str | Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Q33 in long form: the different values of each group with their place in its order; unbound values are left out."""
    group = [by] if isinstance(by, str) else list(by)
    return ranked(df.select(*group, value).filter(F.col(value).isNotNull()).distinct(), group, [value], name)


def segments(lines: DataFrame, group: Sequence[str], rank: str, line: str, size: int = LINES) -> DataFrame:
    """The groups' lines as text: ``group, segment, offset, text``.

    ``rank`` counts a group's lines from 0 on without gaps.  Segment k has the lines
    from k * size on; ``offset`` is the number of characters before it.  Lengths are summed
    over ``size`` segments first, then over those sums, so no task sees all segments of a group.
    """
    group = list(group)
    at = F.floor(F.col(rank) / size).cast("long")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(line).alias("line")))), lambda x: x["line"]), "")
    made = lines.groupBy(*group, at.alias("segment")).agg(text.alias("text"), F.sum(F.length(line)).alias("__length"))
    made = made.withColumn("__stretch", F.floor(F.col("segment") / size).cast("long"))
    sums = made.groupBy(*group, "__stretch").agg(F.sum("__length").alias("__length"))
    sums = sums.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(group)), F.col("__stretch").alias("__s"), _before("__length", *group, order="__stretch").alias("__base"))
    same = [F.col(g).eqNullSafe(F.col(f"__g{i}")) for i, g in enumerate(group)]
    made = made.withColumn("__within", _before("__length", *group, "__stretch", order="segment"))
    found = made.join(sums, [*same, F.col("__stretch") == F.col("__s")])
    return found.select(*group, "segment", (F.col("__base") + F.col("__within")).alias("offset"), "text")


def joined_values(df: DataFrame, by: str | Sequence[str], value: str, sep: str = ", ", size: int = LINES) -> DataFrame:
    """Q33: the text of a group's different values in segments; put together by offset they are ``group_concat``."""
    group = [by] if isinstance(by, str) else list(by)
    rows = group_values(df, group, value)
    line = F.concat(F.when(F.col("rank") == 0, "").otherwise(sep), F.col(value).cast("string"))
    return segments(rows.withColumn("__line", line), group, "rank", "__line", size)
