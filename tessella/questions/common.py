"""Patterns that many questions share."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators import graph as g

Question = Callable[[g.Triples], DataFrame]
QUESTIONS: dict[str, Question] = {}

CONTRIBUTION, YEAR, VENUE = "orkgp:P31", "orkgp:P29", "orkgp:P135046"


def question(uid: str) -> Callable[[Question], Question]:
    def add(fn: Question) -> Question:
        QUESTIONS[uid] = fn
        return fn

    return add


def contributions(t: g.Triples, cls: str, year: bool = False, venue: str | None = None) -> DataFrame:
    """``paper, contribution`` of a class, with ``year`` and of one venue if asked."""
    df = g.of_class(g.pattern(t, CONTRIBUTION, "paper", "contribution"), t, "contribution", cls)
    if venue is not None:
        named = g.pattern(t, g.LABEL, "venue", None, obj=venue, kind=VENUE)
        at = g.pattern(t, VENUE, "contribution", "venue").join(named, ["venue"], "left_semi")
        df = df.join(at.select("contribution"), ["contribution"])
    return df.join(g.pattern(t, YEAR, "paper", "year"), ["paper"]) if year else df


def follow(df: DataFrame, t: g.Triples, start: str, *hops: str) -> DataFrame:
    """Follow hops written as ``predicate variable``."""
    return g.path(df, t, start, [tuple(h.split()) for h in hops])


def has(df: DataFrame, t: g.Triples, var: str, p: str | Sequence[str], kind: str | None = None) -> DataFrame:
    """Keep rows whose variable has the predicate, or one of several."""
    return df.join(g.pattern(t, p, var, None, kind=kind), [var], "left_semi")


def kinds(*variables: str, **led: str) -> dict[str, str | None]:
    """Variables, in order, with what leads to them where that is given; every paper is the subject of its contribution."""
    return {v: f"^{CONTRIBUTION}" if v == "paper" else None for v in variables} | led


def named(df: DataFrame, t: g.Triples, *variables: str, **led: str) -> DataFrame:
    """The optional label of each variable as ``<variable>Label``.

    ``variable=predicate`` tells which predicate leads to the variable, so that only labels of its objects are read.
    """
    for v, kind in kinds(*variables, **led).items():
        df = g.label_of(df, t, v, kind=kind)
    return df


def labelled(df: DataFrame, t: g.Triples, *variables: str, unless: str | None = None, **led: str) -> DataFrame:
    """The required label of each variable; ``unless`` is a label to leave out."""
    for v, kind in kinds(*variables, **led).items():
        df = df.join(g.pattern(t, g.LABEL, v, f"{v}Label", kind=kind), [v])
        if unless is not None:
            df = df.filter(differs(F.col(f"{v}Label"), unless))
    return df


def differs(c: Column, text: str) -> Column:
    """Case-normalised inequality; an unbound value is dropped by a filter."""
    return F.lower(c) != text.lower()


def in_decade(df: DataFrame, out: str = "decade") -> DataFrame:
    return df.withColumn(out, g.decade(g.as_decimal(F.col("year"))))


def between_years(df: DataFrame, first: int, last: int) -> DataFrame:
    return df.filter(g.as_int(F.col("year")).between(first, last))


def listed(df: DataFrame, columns: str, *order: str | Column) -> DataFrame:
    """DISTINCT projection in order."""
    rows = df.select(*columns.split()).distinct()
    return rows.orderBy(*order) if order else rows


def counted(df: DataFrame, by: str, *order: str | Column, name: str = "paper_count", of: str = "paper") -> DataFrame:
    return g.count_per(df, by.split(), of, name).orderBy(*order)


def counted_named(
    df: DataFrame, t: g.Triples, by: str, variables: str, *order: str | Column, name: str = "paper_count", of: str = "paper", **led: str
) -> DataFrame:
    """``counted`` with the optional labels of some of the group's variables.

    Papers are counted per ids, and labels joined to the few groups, so a label
    shared by very many facts moves once per group.
    """
    shown = [f"{v}Label" for v in variables.split()]
    groups = g.count_per(df, [k for k in by.split() if k not in shown], of, name)
    return named(groups, t, *variables.split(), **led).select(*by.split(), name).orderBy(*order)


def joined(df: DataFrame, by: str, *order: str | Column, sep: str = " | ", **values: str) -> DataFrame:
    """Per group the texts of several columns, given as ``name="column"``."""
    return g.group_concats(df, by.split(), {c: n for n, c in values.items()}, sep).orderBy(*order)


def top_with_papers(df: DataFrame, t: g.Triples, by: str, *order: str | Column, within: str | None = None, labels: str = "", **led: str) -> DataFrame:
    """The groups of most papers, ties kept, with the labels of their papers.

    ``df`` has ``paper`` and the group columns; ``labels`` names those of them
    that get an optional label.  Only rows of winning groups reach the texts.
    """
    keys = by.split()
    best = g.most_frequent(g.count_per(df, keys, "paper", "paperCount"), "paperCount", within)
    members = named(df.select("paper", *keys).distinct().join(best, keys), t, "paper", *labels.split(), **led)
    shown = keys + [f"{v}Label" for v in labels.split()]
    return joined(members, " ".join([*shown, "paperCount"]), *order, papers="paperLabel")
