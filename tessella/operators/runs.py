"""Benchmark runs: entries joined with recorded model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.extract import extract_queries, strip_echo
from tessella.functions.text import first_with_text, has_text, strip

ID_FIELDS = ("uid", "id", "source_id")
QUERY_FIELDS = ("gold_query", "sparql", "query")


def _present(df: DataFrame, names: tuple[str, ...]) -> list[Column]:
    return [F.col(n).cast("string") for n in names if n in df.columns]


def entry_id(df: DataFrame, pos: str = "pos") -> Column:
    """First id field with text, else ``item-<pos>`` with pos from 1."""
    made = F.concat(F.lit("item-"), F.col(pos).cast("string"))
    cols = _present(df, ID_FIELDS)
    return F.coalesce(first_with_text(*cols), made) if cols else made


def gold_query(df: DataFrame) -> Column:
    """R2: first query field with text, trimmed; '' when there is none."""
    cols = _present(df, QUERY_FIELDS)
    return F.coalesce(strip(first_with_text(*cols)), F.lit("")) if cols else F.lit("")


def entry_problem(eid: Column, family: Column, question: Column) -> Column:
    """The message for an entry that cannot be run; null when it can."""
    # The two messages.
    return F.when(
        ~has_text(family), F.format_string("Entry %s has no valid 'family'.", eid)
    ).when(~has_text(question), F.format_string("Entry %s has no valid 'question'.", eid))


def score_run(entries: DataFrame, outputs: DataFrame) -> DataFrame:
    """One ok or error row per entry; a bad entry never fails the job.

    ``outputs`` has ``benchmark_entry_id, raw_model_output,
    response_time_seconds`` and may have ``error`` and ``prompt``.  An entry
    without an output is an error row.  Where both sides have ``run`` or ``pos``
    these belong to the key, so several runs and repeated ids stay apart; of
    outputs that share a key one is taken, so no entry is ever repeated.
    """
    keyed = entries.withColumn("benchmark_entry_id", entry_id(entries)).withColumn("gold", gold_query(entries))
    key = ["benchmark_entry_id", *(c for c in ("run", "pos") if c in entries.columns and c in outputs.columns)]
    made = outputs.select(
        *key,
        "raw_model_output",
        F.col("response_time_seconds"),
        (F.col("error") if "error" in outputs.columns else F.lit(None).cast("string")).alias("run_error"),
        (F.col("prompt") if "prompt" in outputs.columns else F.lit(None).cast("string")).alias("prompt"),
    )
    fields = [c for c in made.columns if c not in key]
    made = made.groupBy(*key).agg(F.min(F.struct(*fields)).alias("made")).select(*key, "made.*")
    joined = keyed.join(made, key, "left")
    error = F.coalesce(
        entry_problem(F.col("benchmark_entry_id"), F.col("family"), F.col("question")),
        F.col("run_error"),
        F.when(F.col("raw_model_output").isNull(), F.format_string("Entry %s has no model output.", F.col("benchmark_entry_id"))),
    )
    marked = joined.withColumn("error", error).withColumn(
        "raw_model_output", F.when(F.col("error").isNull(), strip_echo(F.col("raw_model_output"), F.col("prompt")))
    )
    ok = F.col("error").isNull()
    return extract_queries(marked, F.col("raw_model_output")).select(
        F.when(ok, "ok").otherwise("error").alias("status"),
        *[c for c in ("run", "pos") if c in key],
        "benchmark_entry_id",
        *[F.col(c) if c in entries.columns else F.lit(None).cast("string").alias(c) for c in ("uid", "source_id", "source_dataset")],
        "family",
        "question",
        F.col("gold").alias("gold_query"),
        "raw_model_output",
        F.when(ok, F.col("extracted_query")).alias("extracted_query"),
        F.when(ok, F.round("response_time_seconds", 4)).alias("response_time_seconds"),
        "error",
    )


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Totals per run and family, times rounded to four digits."""
    t = F.col("response_time_seconds")
    return results.groupBy(*by).agg(
        F.count("*").alias("total_items"),
        F.count_if(F.col("status") == "ok").alias("successful_items"),
        F.count_if(F.col("status") == "error").alias("failed_items"),
        F.round(F.coalesce(F.sum(t), F.lit(0.0)), 4).alias("total_runtime_seconds"),
        F.round(F.avg(t), 4).alias("mean_response_seconds"),
    )
