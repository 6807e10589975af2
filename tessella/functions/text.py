"""Whitespace, line and fallback helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space when text is trimmed.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as the body of a regular-expression class, and without "\n".
WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BLANK = r"\t\x0b-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# One blank that starts a run and the rest of the run.  Testing the character
# before looking back keeps the scan cheap, and never retries inside a run.
BLANK_RUN = rf"[{BLANK}](?<![{BLANK}][{BLANK}])[{BLANK}]*+"
LINE_BREAK = r"\r\n|[\x0b-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def has_text(c: Column) -> Column:
    """True when the column holds a character that is not white space."""
    return F.coalesce(c.cast("string").rlike(f"[^{WS}]"), F.lit(False))


def unify_lines(c: Column) -> Column:
    """Every line separator becomes a plain newline."""
    return F.regexp_replace(c, LINE_BREAK, "\n")


def first_with_text(*cols: Column) -> Column:
    """The first column holding text, untrimmed; null when none does."""
    return F.coalesce(*[F.when(has_text(c), c) for c in cols])


def first_line_col(text: Column, position: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based character position."""
    before = F.substring(text, F.lit(1), position)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    col = F.length(F.substring_index(before, "\n", -1)) + 1
    return line, col
