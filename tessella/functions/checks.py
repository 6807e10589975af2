"""Checks on extracted queries (V1-V10), one column expression each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import WS, first_line_col, has_text, rstrip

# Accepted starts, suspicious endings, message texts and hints.
QUERY_START = rf"(?iu)\A[{WS}]*(?:SELECT|ASK|CONSTRUCT|DESCRIBE)"
SUSPICIOUS_END = r"(?:\?|or|and|prefix|select|where|\{|\(|,|;)\z"
LONGEST_END = 6
EMPTY_QUERY = "Empty query"
HINT_EMPTY = "No SPARQL query could be extracted from the model output."
HINT_SPACE = (
    "Likely missing whitespace before a variable or malformed triple pattern, "
    "e.g. use 'SELECT ?x' instead of 'SELECT?x' and 'orkgc:P29 ?year' instead of 'orkgc:P29?year'."
)
HINT_DEFAULT = "SPARQL parser could not parse the extracted query."


def has_query(q: Column) -> Column:
    """V1."""
    return has_text(q)


def valid_start(q: Column) -> Column:
    """V2: prefix test without a word boundary."""
    return F.coalesce(q.rlike(QUERY_START), F.lit(False))


def _balanced(text: Column, opening: str, closing: str) -> Column:
    """Never below zero and zero at the end, over the brackets of ``text`` only."""
    brackets = F.regexp_replace(text, rf"[^\{opening}\{closing}]+", "")
    step = lambda ch: F.when(ch == opening, 1).when(ch == closing, -1).otherwise(0)
    walked = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, ch: F.struct(
            (acc["depth"] + step(ch)).alias("depth"),
            F.least(acc["low"], acc["depth"] + step(ch)).alias("low"),
        ),
        lambda acc: (acc["depth"] == 0) & (acc["low"] == 0),
    )
    # equal counts are necessary, and cheaper than the walk
    same = F.length(F.replace(brackets, F.lit(opening), F.lit(""))) * 2 == F.length(brackets)
    return same & walked


def balanced_braces(q: Column) -> Column:
    """V3: counts every brace, also inside literals."""
    return _balanced(F.coalesce(q, F.lit("")), "{", "}")


def ends_suspiciously(q: Column) -> Column:
    """V4: only the last characters can decide, so only they are matched."""
    tail = F.lower(F.right(rstrip(q), F.lit(LONGEST_END)))
    return F.coalesce(tail.rlike(SUSPICIOUS_END), F.lit(False))


def truncated(has: Column, balanced: Column, suspicious: Column) -> Column:
    """V5."""
    return has & (~balanced | suspicious)


def bare(q: Column) -> Column:
    """The query without escapes, string literals and IRIs."""
    unescaped = F.when(F.contains(q, F.lit("\\")), F.regexp_replace(q, r"\\.", "")).otherwise(q)
    return F.regexp_replace(unescaped, r'"[^"\n]*"|\'[^\'\n]*\'|<[^<>"{}|^`\s]*>', "")


def glued_select(q: Column) -> Column:
    """0-based place of a variable's mark right after SELECT; 5 when there is none."""
    return F.regexp_instr(q, F.lit(r"(?i)\bSELECT\?")) + 5


def lexical_issues(q: Column, bare_q: Column, glued: Column) -> Column:
    """V6: lexical well-formedness, an approximation of a grammar check.

    Brackets must balance and quotes must close outside literals and IRIs, a
    query other than DESCRIBE needs a group, and SELECT must not run into its
    first variable.  Queries that pass may still fail a full grammar.
    """
    line, col = first_line_col(q, glued)
    return F.when(~has_text(q), F.array(F.lit(EMPTY_QUERY))).otherwise(
        F.array_compact(
            F.array(
                F.when(
                    glued > 5,
                    F.format_string("Expected a blank, found '?'  (at char %d), (line:%d, col:%d)", glued, line, col),
                ),
                F.when(~F.contains(bare_q, F.lit("{")) & ~q.rlike(rf"(?iu)\A[{WS}]*DESCRIBE"), F.lit("Missing group")),
                F.when(~_balanced(bare_q, "{", "}"), F.lit("Unbalanced braces")),
                F.when(~_balanced(bare_q, "(", ")"), F.lit("Unbalanced parentheses")),
                F.when(bare_q.rlike("[\"']"), F.lit("Unclosed quote")),
            )
        )
    )


def with_lexical_issues(df: DataFrame, query: str, out: str = "lexical_issues") -> DataFrame:
    """V6 as its own projections, since its parts are read several times."""
    parts = df.withColumns({"__bare": bare(F.col(query)), "__glued": glued_select(F.col(query))})
    return parts.withColumn(out, lexical_issues(F.col(query), F.col("__bare"), F.col("__glued"))).drop("__bare", "__glued")


def error_position(message: Column, label: str) -> Column:
    """V7: the number after ``line:``, ``col:`` or ``char `` in a message."""
    return F.nullif(F.regexp_extract(message, rf"{label}(\d+)", 1), F.lit("")).try_cast("int")


def error_hint(message: Column) -> Column:
    """V8: null for no message."""
    return (
        F.when(F.coalesce(F.length(message), F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(F.contains(F.lower(message), F.lit("empty query")), HINT_EMPTY)
        .when(F.contains(message, F.lit("found '?'")), HINT_SPACE)
        .otherwise(HINT_DEFAULT)
    )


def status(has: Column, start: Column, cut: Column, parse_ok: Column) -> Column:
    """V9: the first case that applies."""
    return (
        F.when(~has, "empty")
        .when(~start, "invalid_start")
        .when(~parse_ok, "syntax_error")
        .when(cut, "needs_review")
        .otherwise("looks_ok")
    )


def repair(has: Column, start: Column, cut: Column, parse_ok: Column) -> Column:
    """Struct of the candidate flag and its reason."""
    reason = (
        F.when(~has, "empty_query")
        .when(~start, "invalid_query_start")
        .when(parse_ok, "query_already_parseable")
        .when(cut, "non_empty_query_with_valid_start_but_truncated")
        .otherwise("non_empty_query_with_valid_start_but_syntax_error")
    )
    return F.struct((has & start & ~parse_ok).alias("candidate"), reason.alias("reason"))
