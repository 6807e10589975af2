"""Quality rules: every rule is evaluated once and kept as a bit beside its measurements.

``ledger`` makes one row per document with the measurements and ``failed``, a
bitmask with bit r set where rule r fails.  Policies are versioned masks, so
applying another policy, or asking what each rule costs, reads only the bits.

Edge cases: a null or empty text has no words, all counts 0, and fails
``few_words``; rows are judged one by one, so repeated rows and repeated or null
ids each keep their row; other columns, whatever their names, are passed
through by ``keep`` and ignored by ``ledger``; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tessella.llm import arrays
from tessella.llm.shared import beside

# What counts as a symbol, and the length of a repeated window.
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marked_words")

# Rule r owns bit r for good: a rule is never renumbered, a new one takes the next bit.
# The measurements are counts, so every rule is exact integer arithmetic.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbol_words": "100 * n_marked_words > 30 * n_words",
    "symbols": "100 * n_symbols > 10 * word_chars",
    "repeated_lines": "n_dup_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_upper > 45 * word_chars",
    "long_words": "word_chars > 25 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "mostly_repeated": "100 * n_repeat_words > 85 * n_words",
    "no_words": "n_words < 1",
}
BITS = {name: 1 << r for r, name in enumerate(RULES)}


def mask(*names: str) -> int:
    return reduce(or_, (BITS[n] for n in names), 0)


# A policy version is a mask of rules that reject; versions are kept, never changed.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_windows"),
    "v1": mask("few_words", "repeated_windows", "symbol_words", "symbols", "repeated_lines"),
    "v2": mask("few_words", "repeated_windows", "symbol_words", "symbols", "repeated_lines", "shouting", "long_words", "short_words"),
    # Leaves short texts, and texts that repeat a passage, alone.
    "v3": mask("symbol_words", "symbols", "repeated_lines", "shouting", "long_words", "short_words", "mostly_repeated", "no_words"),
}
POLICY = "v2"


def measured(table: pa.Table) -> dict[str, np.ndarray]:
    """The measurements of every text of one chunk."""
    data, off = arrays.text_bytes(table["text"])
    n = len(off) - 1
    starts, ends, doc = arrays.words(data, off)
    inside = np.zeros(len(data) + 1, np.int32 if len(data) < 2**31 else np.int64)
    np.cumsum(((data & 0xC0) != 0x80) & ~arrays.SPACE[data], out=inside[1:])
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    marks = np.flatnonzero(symbol[data])
    marked = np.unique(np.searchsorted(starts, marks, side="right") - 1)
    per = lambda at: np.diff(np.searchsorted(at, off))
    code, _ = arrays.coded(arrays.cut(data, starts, ends))
    return {
        "n_words": np.bincount(doc, minlength=n)[:n],
        "word_chars": np.diff(inside[off].astype(np.int64)),
        "n_symbols": per(marks),
        "n_repeat_words": arrays.sums(repeated(code, doc), doc, n),
        "n_upper": per(np.flatnonzero((data >= 65) & (data <= 90))),
        "n_marked_words": np.bincount(doc[marked], minlength=n)[:n],
    } | line_counts(data, off, inside)


def repeated(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the words inside windows of WINDOW words that the same text holds twice or more.

    Only windows whose every word comes twice in the text are compared.
    """
    if len(code) < WINDOW:
        return np.zeros(len(code), bool)
    word, found = arrays.renumber(doc, code)
    again = np.bincount(word, minlength=found)[word] > 1
    last = len(code) - WINDOW + 1
    whole = doc[:last] == doc[WINDOW - 1 :]
    for k in range(WINDOW):
        whole &= again[k : last + k]
    whole = np.flatnonzero(whole)
    change = np.zeros(len(code) + 1, np.int32)
    if len(whole):
        window, found = arrays.renumber(*(word[whole + k] for k in range(WINDOW)))
        twice = whole[np.bincount(window, minlength=found)[window] > 1]
        np.add.at(change, twice, 1)
        np.add.at(change, twice + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def line_counts(data: np.ndarray, off: np.ndarray, inside: np.ndarray) -> dict[str, np.ndarray]:
    starts, ends, doc = arrays.lines(data, off)
    n = len(off) - 1
    full = inside[ends] > inside[starts]
    starts, ends, doc = starts[full], ends[full], doc[full]
    if not len(starts):
        return {"n_lines": np.zeros(n, np.int64), "n_dup_lines": np.zeros(n, np.int64)}
    code, _ = arrays.coded(arrays.cut(data, starts, ends))
    line, found = arrays.renumber(doc, code)
    first = np.zeros(len(line), bool)
    first[np.unique(line, return_index=True)[1]] = True
    return {"n_lines": np.bincount(doc, minlength=n), "n_dup_lines": arrays.sums(~first, doc, n)}


def failed_bits() -> Column:
    """The bitmask of failed rules, each rule evaluated once over the measurements."""
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")


def measured_rows(docs: DataFrame, key: Column) -> DataFrame:
    """``key`` and the measurements, one row per row of ``docs``."""
    rows = docs.select(key.alias("key"), F.col("text").cast("string").alias("text"))
    schema = StructType([rows.schema["key"], *(StructField(m, LongType()) for m in MEASURES)])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches):
            found = measured(table)
            columns = [table["key"], *(pa.array(found[m], pa.int64()) for m in MEASURES)]
            yield from pa.Table.from_arrays(columns, ["key", *MEASURES]).to_batches()

    return rows.mapInArrow(measure, schema)


def ledger(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measurements and ``failed``, one row per document."""
    return measured_rows(docs, F.col("doc_id")).withColumnRenamed("key", "doc_id").withColumn("failed", failed_bits())


def passes(policy: str = POLICY, bits: str = "failed") -> Column:
    """True where no rule of the policy version failed."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy])) == 0


def keep(docs: DataFrame, policy: str = POLICY) -> DataFrame:
    """The documents that a policy version keeps, with their columns; ``text`` is a string."""
    fields = [StructField(m, LongType()) for m in MEASURES]
    rows, names = beside(docs, lambda table: [pa.array(found, pa.int64()) for found in _in_order(measured(table))], fields)
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns]
    row, told = F.struct(*quoted), F.struct(*(F.col(n).alias(m) for n, m in zip(names, MEASURES)))
    rows = rows.select(row.alias("row"), told.alias("told")).select("row", "told.*").select("row", failed_bits().alias("failed"))
    return rows.filter(passes(policy)).select("row.*")


def _in_order(found: dict) -> list:
    return [found[m] for m in MEASURES]


def ablation(rows: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """Per policy version and rule, what the rule costs; one row each.

    ``n_failed`` documents fail the rule, ``n_only`` are rejected by nothing else
    of the policy (the gain of dropping the rule), ``n_kept`` pass the policy.
    Rows are counted per bitmask first, so at most 2^rules rows are looked at.
    """
    policies = POLICIES if policies is None else policies
    counts = rows.groupBy(F.col("failed").alias("bits")).agg(F.count("*").alias("n"))
    pairs = [(p, m, r, BITS[r]) for p, m in policies.items() for r in RULES if m & BITS[r]]
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(m).alias("mask"), F.lit(r).alias("rule"), F.lit(b).alias("bit")) for p, m, r, b in pairs)))
    hit = F.col("bits").bitwiseAND(F.col("mask"))
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return counts.withColumn("g", grid).select("bits", "n", "g.*").groupBy("policy", "rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(hit == F.col("bit")).alias("n_only"),
        total(hit == 0).alias("n_kept"),
    )
