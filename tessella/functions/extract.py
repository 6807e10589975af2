"""Query extraction from recorded model output.

Every step is one column expression on JVM string functions, so a partition of
outputs is cleaned without leaving generated code.  ``extract_queries`` lays the
steps out as separate projections: a regular expression whose result is read
several times is then evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import BLANK, BLANK_RUN, WS, strip, unify_lines

# What marks reasoning, labels, fences and query starts.
THINK_BLOCK = r"(?isu)<think>.*?</think>"
LABEL_LINES = (
    rf"(?imud)^##[{WS}]*Output[{WS}]*$",
    rf"(?imud)^SPARQL[{WS}]*Query[{WS}]*:?[{WS}]*$",
    rf"(?imud)^Output[{WS}]*:?[{WS}]*$",
)
QUERY_FENCE = r"(?isu)```sparql.*?```"
ANY_FENCE = r"(?s)```.*?```"
REGION = (
    rf"(?imsud)^[{BLANK}]*((?:PREFIX [{BLANK}]*[^{WS}]|SELECT|ASK|CONSTRUCT|DESCRIBE).*)"
)
# a comment line with its newline, or a run of blanks that ends its line, with
# or without a comment: one pass finds both
COMMENTS = rf"(?md)^[{BLANK}]*#.*(?:\n|\z)|{BLANK_RUN}(?:#.*)?$"
PREFIX_LINE = (
    rf"(?imud)^[{BLANK}]*PREFIX[{BLANK}]+[\p{{L}}\p{{N}}_]+:[{BLANK}]*<[^>\n]+>[{BLANK}]*(?:\n|\z)"
)
EMPTY_LINES = r"\n{3,}"


def strip_echo(output: Column, prompt: Column) -> Column:
    """Drop the prompt when the output starts by repeating it."""
    echoed = F.coalesce(F.startswith(output, prompt), F.lit(False))
    rest = F.when(echoed, F.substring(output, F.length(prompt) + 1, F.length(output)))
    return strip(F.coalesce(rest, output))


def drop_thinking(text: Column) -> Column:
    """Remove reasoning blocks."""
    return F.regexp_replace(text, THINK_BLOCK, "")


def drop_label_lines(text: Column) -> Column:
    """Remove lines that only announce the output."""
    for pattern in LABEL_LINES:
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def code_block(text: Column) -> Column:
    """The first query fence, else the first fence, else the whole text."""
    query = F.regexp_replace(F.regexp_substr(text, F.lit(QUERY_FENCE)), r"(?i)\A```sparql|```\z", "")
    other = F.regexp_replace(F.regexp_substr(text, F.lit(ANY_FENCE)), r"\A```|```\z", "")
    return strip(F.coalesce(query, other, text))


def query_region(text: Column) -> Column:
    """From the first line that starts a query, up to the next fence."""
    tail = F.regexp_extract(unify_lines(text), REGION, 1)
    return strip(F.substring_index(tail, "```", 1))


def drop_comments(text: Column, unified: bool = False) -> Column:
    """Drop comment lines, cut comments after white space, trim line ends.

    ``unified`` says the lines already end in plain newlines.
    """
    return strip(F.regexp_replace(text if unified else unify_lines(text), COMMENTS, ""))


def drop_prefixes(text: Column, unified: bool = False) -> Column:
    """Drop complete PREFIX lines; the empty prefix stays."""
    return strip(F.regexp_replace(text if unified else unify_lines(text), PREFIX_LINE, ""))


def squeeze_blank_lines(text: Column) -> Column:
    """At most one blank line in a row."""
    return strip(F.regexp_replace(text, EMPTY_LINES, "\n\n"))


def extract_queries(df: DataFrame, raw: str, out: str = "extracted_query") -> DataFrame:
    """The whole chain over column ``raw``; null input gives the empty string."""
    labelled, block = f"__{out}_text", f"__{out}_block"
    # the region step leaves plain newlines, so the steps after it need not unify them
    cleaned = drop_prefixes(drop_comments(query_region(F.col(block)), unified=True), unified=True)
    return (
        df.withColumn(labelled, drop_label_lines(drop_thinking(strip(F.coalesce(raw, F.lit(""))))))
        .withColumn(block, code_block(F.col(labelled)))
        .withColumn(out, squeeze_blank_lines(cleaned))
        .drop(labelled, block)
    )
