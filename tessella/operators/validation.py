"""Row report and summary over extracted queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.functions import checks

REPORT_COLUMNS = (
    "benchmark_entry_id uid source_id source_dataset family question extracted_query gold_query "
    "has_extracted_query is_empty_query has_valid_query_start looks_truncated parse_ok parse_error_raw "
    "parse_error_line parse_error_column parse_error_char parse_error_hint is_repair_candidate "
    "repair_candidate_reason validation_status"
).split()


def validate(results: DataFrame, parse_error: str | None = None) -> DataFrame:
    """The 21-column report, one row per result.

    The syntax verdict is the lexical check.  A column of grammar-parser
    messages named by ``parse_error`` overrides it: null there means it parsed.
    """
    q = F.col("extracted_query")
    text = results.withColumn("extracted_query", F.coalesce(q, F.lit("")))
    if parse_error:
        message = F.when(~F.col("has_extracted_query"), F.lit(checks.EMPTY_QUERY)).otherwise(F.col(parse_error))
    else:
        text = checks.with_lexical_issues(text, "extracted_query")
        message = F.get("lexical_issues", F.lit(0))
    # flags first: each is read many times below and must be computed once
    flags = text.withColumn("has_extracted_query", checks.has_query(q)).withColumns(
        {
            "has_valid_query_start": checks.valid_start(q),
            "looks_truncated": checks.truncated(
                F.col("has_extracted_query"), checks.balanced_braces(q), checks.ends_suspiciously(q)
            ),
            "parse_error_raw": message,
        }
    )
    raw = F.col("parse_error_raw")
    verdict = flags.withColumn("parse_ok", raw.isNull())
    given = [F.col(c) for c in ("has_extracted_query", "has_valid_query_start", "looks_truncated", "parse_ok")]
    repair = checks.repair(*given)
    return verdict.withColumns(
        {
            "is_empty_query": ~F.col("has_extracted_query"),
            "parse_error_line": checks.error_position(raw, "line:"),
            "parse_error_column": checks.error_position(raw, "col:"),
            "parse_error_char": checks.error_position(raw, "char "),
            "parse_error_hint": checks.error_hint(raw),
            "is_repair_candidate": repair["candidate"],
            "repair_candidate_reason": repair["reason"],
            "validation_status": checks.status(*given),
        }
    ).select(*REPORT_COLUMNS, *[c for c in ("run",) if c in results.columns])


def validation_summary(validated: DataFrame, *by: str) -> DataFrame:
    """The counters per group; rows without a query count as syntax errors."""
    n = lambda c: F.count_if(c)
    return validated.groupBy(*by).agg(
        F.count("*").alias("total_items"),
        n(F.col("has_extracted_query")).alias("items_with_query"),
        n(F.col("is_empty_query")).alias("empty_query_items"),
        n(F.col("has_valid_query_start")).alias("valid_query_start_items"),
        n(F.col("looks_truncated")).alias("truncated_items"),
        n(F.col("parse_ok")).alias("parse_ok_items"),
        n(~F.col("parse_ok")).alias("syntax_error_items"),
        n(F.col("is_repair_candidate")).alias("repair_candidate_items"),
        n(~F.col("is_repair_candidate")).alias("non_repair_candidate_items"),
    )
