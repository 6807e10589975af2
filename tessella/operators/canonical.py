"""From notebook cells to canonical question and gold-query rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import BLANK, WS, has_text, strip, unify_lines
from tessella.operators.lookup import lookup_join

MARKDOWN, QUERY = 1, 2

# Language markers, ordinal and the lines the converter removes.
ENGLISH = rf"(?s)\bEN:[{WS}]*(.*?)[{WS}]*(?:\bDE:|\z)"
GERMAN = rf"(?s)\bDE:[{WS}]*(.*?)[{WS}]*(?:\bEN:|\z)"
MARKER = rf"\b(?:DE|EN):[{WS}]*"
ORDINAL = rf"\A[{WS}]*([0-9]+)\)[{WS}]*"
FULL_COMMENT = rf"(?md)^[{BLANK}]*#.*(?:\n|\z)"
AFTER_PREFIXES = rf"(?imsud)^(?![{BLANK}]*(?:PREFIX[{WS}]|$))(.*)"

REQUIRED = ("family", "question", "gold_query")


def pair_cells(cells: DataFrame, by: str = "file", pos: str = "pos") -> DataFrame:
    """Each question cell with the query cell right after it.

    ``cells`` has ``by, pos, kind, value``.  The two kinds meet in a join on
    notebook and position, which spreads one very long notebook over all tasks.
    """
    asked = cells.filter(F.col("kind") == MARKDOWN).select(by, F.col(pos), F.col("value").alias("question_text"))
    given = cells.filter(F.col("kind") == QUERY).select(
        by, (F.col(pos) - 1).alias(pos), F.col("value").alias("query_text")
    )
    return asked.join(given, [by, pos])


def english(text: Column) -> Column:
    """Struct of the question text and whether German had to stand in.

    With both markers present the English part is taken; when it is empty the
    German part is, and the row is flagged.  Otherwise markers are removed.
    """
    both = text.rlike(r"\bEN:") & text.rlike(r"\bDE:")
    en = F.regexp_extract(text, ENGLISH, 1)
    fallback = both & (en == "")
    chosen = (
        F.when(fallback, F.regexp_extract(text, GERMAN, 1)).when(both, en).otherwise(F.regexp_replace(text, MARKER, ""))
    )
    return F.struct(strip(chosen).alias("text"), fallback.alias("fallback"))


def ordinal(text: Column) -> Column:
    """The leading ``12) `` as an integer; null when there is none or it fits no integer."""
    return F.nullif(F.regexp_extract(text, ORDINAL, 1), F.lit("")).try_cast("int")


def drop_ordinal(text: Column) -> Column:
    """The text after the leading ordinal."""
    return F.regexp_replace(text, ORDINAL, "")


def drop_comment_lines(query: Column) -> Column:
    """C5."""
    return F.regexp_replace(unify_lines(query), FULL_COMMENT, "")


def drop_leading_prefixes(query: Column) -> Column:
    """C4: PREFIX lines at the head only; a later one stays."""
    return strip(F.regexp_extract(unify_lines(query), AFTER_PREFIXES, 1))


def make_uid(prefix: Column, source_id: Column) -> Column:
    """``<prefix>-0001``; null when the prefix is."""
    return F.when(prefix.isNotNull(), F.format_string("%s-%04d", prefix, source_id))


def attach_registry(df: DataFrame, registry: DataFrame) -> DataFrame:
    """``source_dataset, family, uid_prefix`` for the row's ``dataset``."""
    return lookup_join(df, registry, ["dataset"])


def canonicalise(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """C1-C7 as one plan: notebook cells to canonical rows.

    ``cells`` carries the ``dataset`` key of its notebook.  A question without an
    ordinal is numbered by its position, ``pos / 2 + 1``.
    """
    pairs = pair_cells(cells.withColumn("file", F.struct("dataset", "file")))
    named = pairs.select(
        F.col("file.dataset").alias("dataset"),
        F.coalesce(ordinal(F.col("question_text")), F.floor(F.col("pos") / 2).cast("int") + 1).alias("source_id"),
        english(drop_ordinal(F.col("question_text"))).alias("q"),
        drop_leading_prefixes(drop_comment_lines(F.col("query_text"))).alias("gold_query"),
    )
    return attach_registry(named, registry).select(
        make_uid(F.col("uid_prefix"), F.col("source_id")).alias("uid"),
        "source_dataset",
        "source_id",
        "family",
        F.col("q.text").alias("question"),
        "gold_query",
        F.nullif(F.regexp_extract("gold_query", r"\b(orkgc:\w+)", 1), F.lit("")).alias("contribution_class"),
        F.col("q.fallback").alias("question_fallback"),
    )


def merge(*parts: DataFrame) -> DataFrame:
    """All rows of all parts; duplicates stay and are reported by C9."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def canonical_findings(df: DataFrame) -> DataFrame:
    """One row per finding, ``severity, rule, uid, n``.

    A required field without text is an error; a uid or question occurring more
    than once is a warning with its count.  Values are grouped by their hash, so
    one hash and one number per value move, however long and frequent it is.
    """
    missing = F.array_compact(
        F.array(*[F.when(~has_text(F.col(c)), F.lit(f"missing_{c}")) for c in REQUIRED])
    )
    errors = df.select(
        F.lit("error").alias("severity"), F.explode(missing).alias("rule"), F.col("uid"), F.lit(1).cast("bigint").alias("n")
    )

    def repeated(column: str) -> DataFrame:
        return (
            df.filter(has_text(F.col(column)))
            .groupBy(F.sha2(F.col(column), 256))
            .agg(F.min("uid").alias("first_uid"), F.count("*").alias("n"))
            .filter("n > 1")
            .select(F.lit("warning").alias("severity"), F.lit(f"duplicate_{column}").alias("rule"), F.col("first_uid").alias("uid"), "n")
        )

    return errors.unionByName(repeated("uid")).unionByName(repeated("question"))


def canonical_report(df: DataFrame) -> DataFrame:
    """One row with entry, error and warning counts and the pass flag."""
    total = df.agg(F.count("*").alias("total_entries"))
    counts = canonical_findings(df).agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") == "warning").alias("warning_count"),
    )
    return counts.select(
        total.scalar().alias("total_entries"),
        "error_count",
        "warning_count",
        (F.col("error_count") == 0).alias("validation_passed"),
    )
