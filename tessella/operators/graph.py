"""Analytic questions over triples (Q1-Q56).

``t`` is a table of triples ``s, p, o, o_kind, dtype, lang``, or one table per
predicate.  Patterns select from it; every other operator takes and returns
tables whose columns are the question's variables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tessella.session import written
from tessella.sources.readers import TripleTables

Triples = DataFrame | TripleTables

TYPE = "rdf:type"
LABEL = "rdfs:label"


# ------------------------------------------------------------------- patterns


def pattern(
    t: Triples,
    p: str | Sequence[str],
    s: str | None = "s",
    o: str | None = "o",
    subject: str | None = None,
    obj: str | Sequence[str] | None = None,
    lang: str | None = None,
    tag: str | None = None,
    kind: str | None = None,
) -> DataFrame:
    """Q1, Q5, Q6, Q50: one triple pattern with its variables as columns.

    Constants become filters on the scan, and a predicate prunes partitions of
    a store kept by predicate.  ``s=None`` or ``o=None`` leaves that variable
    out; several predicates may be given, ``tag`` then names the matched one.
    ``kind`` promises that the pattern meets only subjects that are objects of that predicate,
    or subjects of it if written ``^predicate``; tables that can't hold those are left out.
    """
    wanted = [p] if isinstance(p, str) else list(p)
    if kind is not None and isinstance(t, TripleTables):
        t = t.about(kind)
    rows = t.only(wanted) if isinstance(t, TripleTables) else t.filter(F.col("p").isin(wanted))
    if subject is not None:
        rows = rows.filter(F.col("s") == subject)
    if obj is not None:
        rows = rows.filter(F.col("o") == obj if isinstance(obj, str) else F.col("o").isin(list(obj)))
    if lang is not None:
        rows = rows.filter(F.col("lang") == lang)
    kept = [F.col("s").alias(s)] if s else []
    kept += [F.col("o").alias(o)] if o else []
    kept += [F.col("p").alias(tag)] if tag else []
    return rows.select(*kept)


def of_class(df: DataFrame, t: Triples, var: str, cls: str) -> DataFrame:
    """Q2: keep rows whose ``var`` has the class."""
    return df.join(pattern(t, TYPE, var, None, obj=cls), [var], "left_semi")


def instances(t: Triples, cls: str, var: str) -> DataFrame:
    """Q2: the instances of a class."""
    return pattern(t, TYPE, var, None, obj=cls)


def class_counts(t: Triples) -> DataFrame:
    """Q8: subjects per class."""
    return pattern(t, TYPE, "s", "type").groupBy("type").agg(F.count("*").alias("count"))


def star(df: DataFrame, t: Triples, var: str, wanted: Mapping[str, str]) -> DataFrame:
    """Q3: several predicates of one subject, each to its own column."""
    return reduce(lambda d, po: d.join(pattern(t, po[0], var, po[1]), [var]), wanted.items(), df)


def wide(t: Triples, var: str, wanted: Mapping[str, str]) -> DataFrame:
    """Q3: a star of single-valued predicates in one pass and one shuffle.

    A subject with two values of a predicate fails the job; ``star`` gives all
    combinations.
    """
    rows = pattern(t, list(wanted), var, "__o", tag="__p")

    def single(p: str, c: str) -> Column:
        value = F.when(F.col("__p") == p, F.col("__o"))
        several = F.raise_error(F.concat(F.lit(f"several values of {p} for "), F.col(var)))
        return F.when(F.min(value) != F.max(value), several).otherwise(F.max(value)).alias(c)

    packed = rows.groupBy(var).agg(*[single(p, c) for p, c in wanted.items()])
    return packed.dropna(subset=list(wanted.values()))


MOST_VALUES = 10_000  # rows of a subject that one task may hold


def star_once(t: Triples, var: str, wanted: Mapping[str, str], most: int = MOST_VALUES) -> DataFrame:
    """Q3: a star of predicates with any number of values, its rows moved once.

    Every subject's values are gathered as one array per predicate, and their
    product comes out of one generator after the other.  A sketch of frequent
    subjects finds those with more than ``most`` rows; the values of such a one's largest predicate are dealt
    over blocks, each with all values of the others, so no task holds the subject.
    """
    rows = pattern(t, list(wanted), var, "__o", tag="__p")
    heavy = _heavy_subjects(rows, var, most)
    largest = rows.join(F.broadcast(heavy), [var]).groupBy(var, "__blocks", "__p").agg(F.count("*").alias("__n"))
    largest = largest.groupBy(var, "__blocks").agg(F.max_by("__p", "__n").alias("__dealt"))
    dealt = F.array(F.pmod(F.xxhash64("__o"), F.col("__blocks")))
    block = F.when(F.col("__blocks").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("__p") == F.col("__dealt"), dealt)
    block = block.otherwise(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))
    rows = rows.join(F.broadcast(largest), [var], "left").select(var, "__p", "__o", F.explode(block).alias("__block"))
    values = {c: F.collect_list(F.when(F.col("__p") == p, F.col("__o"))).alias(c) for p, c in wanted.items()}
    packed = rows.groupBy(var, "__block").agg(*values.values())
    for c in wanted.values():
        packed = packed.filter(F.size(c) > 0)
    for c in wanted.values():
        packed = packed.withColumn(c, F.explode(c))
    return packed.drop("__block")


def _heavy_subjects(rows: DataFrame, var: str, most: int, tracked: int = 1 << 16, named: int = 4096) -> DataFrame:
    """At most ``named`` subjects that may have more than ``most`` rows, with the number of blocks for each."""
    found = rows.agg(F.call_function("approx_top_k", F.col(var), F.lit(named), F.lit(tracked)).alias("found")).select(F.explode("found").alias("f"))
    blocks = F.ceil(F.col("f.count") / most).cast("long")
    return found.filter(F.col("f.count") > most).select(F.col("f.item").alias(var), blocks.alias("__blocks"))


def path(df: DataFrame, t: Triples, start: str, hops: Sequence[tuple[str, str]]) -> DataFrame:
    """Q4: follow ``(predicate, variable)`` hops from column ``start``."""
    kind = None
    for p, var in hops:
        df = df.join(pattern(t, p, start, var, kind=kind), [start])
        start, kind = var, p
    return df


def reduced_path(
    df: DataFrame, t: Triples, start: str, hops: Sequence[tuple[str, str]], where: Mapping[str, Column] | None = None
) -> DataFrame:
    """Q4: ``path`` whose variables have conditions, without rows that lead nowhere.

    Before any wide row is made, each hop is cut to what goes on: from the last hop back to
    triples whose object starts one of the next, and from ``start`` on to triples
    whose subject ends one of the last.  ``where`` has a condition for any variable.
    What each pass keeps is written to the scratch folder.
    """
    conditions = dict(where or {})
    df = df.filter(conditions[start]) if start in conditions else df
    names = [start, *(var for _, var in hops)]
    found: list[DataFrame] = []
    for k in reversed(range(len(hops))):
        hop = pattern(t, hops[k][0], names[k], names[k + 1])
        for var in {names[k], names[k + 1]} & conditions.keys():
            hop = hop.filter(conditions[var])
        if found:
            hop = hop.join(found[0].select(names[k + 1]).distinct(), [names[k + 1]], "left_semi")
        found.insert(0, written(hop.select(names[k], names[k + 1]), f"back-{k}"))
    reached = df.select(start).distinct()
    for k, hop in enumerate(found):
        found[k] = written(hop.join(reached, [names[k]], "left_semi"), f"forth-{k}")
        reached = found[k].select(names[k + 1]).distinct()
    return reduce(lambda d, k: d.join(found[k], [names[k]]), range(len(hops)), df)


# ----------------------------------------------------------- optional, exists


def optional(df: DataFrame, part: Triples, on: str | Sequence[str]) -> DataFrame:
    """Q9-Q12: keep rows without a match.  Build a group of patterns, a filter,
    an aggregate or a flag column in ``part`` first: it matches whole or not."""
    return df.join(part, [on] if isinstance(on, str) else list(on), "left")


def label_of(df: DataFrame, t: Triples, var: str, out: str | None = None, kind: str | None = None) -> DataFrame:
    """Q9: the optional label of a variable, whose values may be known to be of a kind."""
    return optional(df, pattern(t, LABEL, var, out or f"{var}Label", kind=kind), var)


def without(df: DataFrame, part: Triples, on: str | Sequence[str]) -> DataFrame:
    """Q16, Q17: NOT EXISTS; apply it twice for a conjunction."""
    return df.join(part, [on] if isinstance(on, str) else list(on), "left_anti")


def exists_flag(df: DataFrame, part: Triples, on: str | Sequence[str], name: str) -> DataFrame:
    """Q19: EXISTS as a boolean column."""
    keys = [on] if isinstance(on, str) else list(on)
    found = part.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(found, keys, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def lacking_any(df: DataFrame, parts: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """Q18: keep rows for which at least one of the parts has no match."""
    flags = [f"__has{i}" for i in range(len(parts))]
    for part, flag in zip(parts, flags):
        df = exists_flag(df, part, on, flag)
    return df.filter(reduce(lambda a, b: a | b, [~F.col(f) for f in flags])).drop(*flags)


def if_any(df: DataFrame, part: Triples) -> DataFrame:
    """Q55: a pattern sharing no variable only asks whether it matches at all.

    An uncorrelated EXISTS: ``part`` is evaluated once, rows are not multiplied.
    """
    return df.filter(part.limit(1).exists())


def ask(df: DataFrame, name: str = "answer") -> DataFrame:
    """Q24, Q25: one row telling whether there is any match."""
    return df.limit(1).agg((F.count("*") > 0).alias(name))


# ------------------------------------------------- sets of values per subject


def with_all_values(t: Triples, p: str, values: Sequence[str], var: str = "s") -> DataFrame:
    """Q7: subjects having every one of the values of ``p``."""
    rows = pattern(t, p, var, "__o", obj=list(values))
    return rows.groupBy(var).agg(F.count_distinct("__o").alias("__n")).filter(F.col("__n") == len(set(values))).select(var)


def divided(rows: DataFrame, divisor: DataFrame, subject: str, value: str, by: str | Sequence[str] = (), most: int = MOST_VALUES) -> DataFrame:
    """Q7: subjects that have every value of ``divisor``, or of each of its groups ``by``.

    The divisor's different values are counted once; the subjects' values that are in it
    are counted per subject and group and compared with that.  Without groups an empty
    divisor asks for nothing, so every subject has it; a group is there by its values, so none is empty.
    A null value is had by none: a divisor with one has no subjects.

    Subjects of the same values are one case: groups are compared with each set of values that occurs,
    not with each subject.  Subjects of more than about ``most`` asked values are counted by themselves, so no task holds their set.
    """
    keys = [by] if isinstance(by, str) else list(by)
    asked = divisor.select(*keys, value).distinct()
    needed = asked.groupBy(*keys).agg(F.count("*").alias("__needed"))
    has = rows.select(subject, value).join(asked.select(value).distinct(), [value], "left_semi").distinct()
    if not keys:
        wanted = needed.select("__needed").scalar()
        everyone = rows.select(subject).distinct().filter(wanted == 0)
        return has.groupBy(subject).agg(F.count("*").alias("__has")).filter(F.col("__has") == wanted).select(subject).unionByName(everyone)

    def met(has: DataFrame, owner: str) -> DataFrame:
        """Each group with the owners that have all of its values."""
        found = has.join(asked, [value]).groupBy(*keys, owner).agg(F.count("*").alias("__has"))
        same = [F.col(f"has.{k}").eqNullSafe(F.col(f"needed.{k}")) for k in keys]
        whole = found.alias("has").join(needed.alias("needed"), [*same, F.col("__has") == F.col("__needed")], "left_semi")
        return whole.select(*keys, owner)

    many = F.broadcast(_heavy_subjects(has, subject, most).select(subject))
    # a null subject is one like any other, and never among those
    few = has.join(many, [subject], "left_anti").groupBy(subject).agg(F.array_sort(F.collect_set(value)).alias("__set"))
    sets = few.select("__set").distinct()
    fitting = met(sets.select("__set", F.explode("__set").alias(value)), "__set")
    light = few.join(fitting, ["__set"]).select(*keys, subject)
    return light.unionByName(met(has.join(many, [subject], "left_semi"), subject))


def with_several(df: DataFrame, var: str, value: str, at_least: int = 2) -> DataFrame:
    """Q44: keys with at least so many different values, without any pairs."""
    if at_least == 2:
        # two different values exist exactly when the smallest is not the largest
        ends = df.groupBy(var).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        return ends.filter("__lo != __hi").select(var)
    return df.groupBy(var).agg(F.count_distinct(value).alias("__n")).filter(F.col("__n") >= at_least).select(var)


def sharing_with(t: Triples, p: str, subject: str, var: str = "s") -> DataFrame:
    """Q13: other subjects sharing a value of ``p`` with ``subject``, once each."""
    given = pattern(t, p, None, "__o", subject=subject)
    others = pattern(t, p, var, "__o").filter(F.col(var) != subject)
    return others.join(given, ["__o"], "left_semi").select(var).distinct()


# ---------------------------------------------------------------- union, tags


def union(*parts: DataFrame) -> DataFrame:
    """Q14: all rows of all alternatives."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def tagged(t: Triples, tags: Mapping[str, str], s: str = "s", o: str | None = "o", tag: str = "category") -> DataFrame:
    """Q15: alternatives on several predicates, each with its category, in one scan."""
    rows = pattern(t, list(tags), s, o, tag="__p")
    names = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    return rows.withColumn(tag, names[F.col("__p")]).drop("__p")


# -------------------------------------------------------------------- numbers


def as_int(c: Column) -> Column:
    """Q52: a literal that is no integer counts as unbound."""
    return c.try_cast("int")


def as_decimal(c: Column) -> Column:
    """Q49, Q52."""
    return c.try_cast("decimal(18,4)")


def as_float(c: Column) -> Column:
    """Q52."""
    return c.try_cast("double")


def as_date(c: Column) -> Column:
    """Q49."""
    return c.try_cast("date")


def same_text(c: Column, text: str) -> Column:
    """Q47: comparison without regard to case."""
    return F.lower(c) == text.lower()


def decade(year: Column) -> Column:
    """Q42, Q53: ``1994`` to ``1990s``."""
    return F.concat((F.floor(year / 10) * 10).try_cast("bigint").cast("string"), F.lit("s"))


def interval(value: Column, bounds: Sequence[tuple[int, int, str]]) -> Column:
    """Q43: the label of the closed interval holding the value, else null."""
    return reduce(lambda w, b: w.when(value.between(b[0], b[1]), b[2]), bounds[1:], F.when(value.between(*bounds[0][:2]), bounds[0][2]))


def pieces_of(low: Column, high: Column) -> Column:
    """The aligned pieces of a closed interval of whole numbers, as ``level, piece``: 2**level numbers from piece * 2**level on.

    At most two pieces of each size are needed, one at either end.
    """
    from_, to = low.cast("long"), high.cast("long") + 1

    def at(level: Column) -> Column:
        first, end = -F.call_function("shiftright", -from_, level), F.call_function("shiftright", to, level)
        piece = lambda n: F.struct(level.alias("level"), n.alias("piece"))
        left = F.when((first < end) & (first % 2 != 0), piece(first))
        right = F.when((first < end) & (end % 2 != 0), piece(end - 1))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), at))


def interval_join(df: DataFrame, value: str, bounds: DataFrame, low: str, high: str, how: str = "inner") -> DataFrame:
    """Q43: rows with every interval of a table that holds their value.

    Intervals are cut into aligned pieces of sizes that are powers of two, and a value lies in one
    piece of each size, so that the condition is an equality.  Only the different
    values are looked up, in the sizes that occur.  Intervals may overlap; a value in none is left out, or
    with ``how="left"`` kept with nulls.  An interval without a bound or that ends before it begins holds nothing.
    """
    cut = bounds.filter(F.col(low) <= F.col(high)).select("*", F.explode(pieces_of(F.col(low), F.col(high))).alias("__c"))
    cut = cut.select(*bounds.columns, F.col("__c.level").alias("__level"), F.col("__c.piece").alias("__piece"))
    levels = cut.agg(F.collect_set("__level").alias("l")).scalar()
    values = df.select(value).filter(F.col(value).isNotNull()).distinct().select(value, F.explode(levels).alias("__level"))
    values = values.withColumn("__piece", F.expr(f"shiftright(cast(`{value}` as bigint), __level)"))
    found = values.join(cut, ["__level", "__piece"]).drop("__level", "__piece")
    return df.join(found, [value], how)


def classify(cases: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """Q41: the first case that applies."""
    chain = reduce(lambda w, c: w.when(c[0], c[1]), cases[1:], F.when(*cases[0]))
    return chain.otherwise(otherwise) if otherwise is not None else chain


# ----------------------------------------------------------------- aggregates


def count_per(df: DataFrame, by: str | Sequence[str], var: str, name: str = "n") -> DataFrame:
    """Q26, Q27: different values of ``var`` per group."""
    return df.groupBy(*([by] if isinstance(by, str) else by)).agg(F.count_distinct(var).alias(name))


def group_concat(df: DataFrame, by: str | Sequence[str], value: str, name: str, sep: str = ", ") -> DataFrame:
    """Q33: the different values of each group as one sorted text."""
    return group_concats(df, by, {value: name}, sep)


def group_concats(df: DataFrame, by: str | Sequence[str], values: Mapping[str, str], sep: str = ", ") -> DataFrame:
    """Q33: several columns of each group as sorted texts of their different values.

    Each task keeps a group's different values only, before they meet, so a hot
    group is reduced across all tasks, and no table of all groups and values is held.
    A column whose values are all unbound gives an empty text.
    """
    keys = [by] if isinstance(by, str) else list(by)
    held = {n: F.col(v) if len(values) == 1 else F.col(v).cast("string") for v, n in values.items()}
    return df.groupBy(*keys).agg(*[F.array_join(F.array_sort(F.collect_set(c)), sep).alias(n) for n, c in held.items()])


def sample(c: str) -> Column:
    """Q32: one bound value of the group, the smallest so that reruns agree."""
    return F.min(c)


def flag_sum(c: str) -> Column:
    """Q29: an unbound flag adds nothing."""
    return F.sum(F.coalesce(F.col(c), F.lit(0)))


def share(flag: str) -> Column:
    """Q35: percentage of the group's rows with the flag set."""
    return F.lit(100.0) * flag_sum(flag) / F.count("*")


def missing_share(c: Column, marker: str = "Not reported") -> Column:
    """Q54: percentage of rows whose value is unbound or the marker."""
    return F.lit(100.0) * F.count_if(c.isNull() | (c == marker)) / F.count("*")


def flags_per(rows: DataFrame, key: str, tag: str, flags: Mapping[str, str]) -> DataFrame:
    """Q30, Q40: one row of 0/1 flags per key from tagged rows, in one pass."""
    return rows.groupBy(key).agg(
        *[F.coalesce(F.max(F.when(F.col(tag) == t, 1)), F.lit(0)).alias(name) for t, name in flags.items()]
    )


def most_frequent(counts: DataFrame, n: str = "n", within: str | Sequence[str] | None = None) -> DataFrame:
    """Q38, Q39: the rows with the largest count, ties kept, overall or per group.

    ``counts`` is an aggregate.  Its maximum is taken by a second aggregate over
    the same exchange and matched back on group and count, so ties spread by
    that pair and no group is ranked in one task.
    """
    if within is None:
        return counts.filter(F.col(n) == counts.agg(F.max(n)).scalar())
    keys = [within] if isinstance(within, str) else list(within)
    best = counts.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(n).alias(f"__{n}"))
    # an unbound key is a group like any other
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col(n) == F.col(f"__{n}")]
    return counts.join(best, same, "left_semi")


def coverage(df: DataFrame, facts: DataFrame, key: str, category: str, name: str = "score") -> DataFrame:
    """Q56: how many categories each key reports, zero kept."""
    scores = facts.groupBy(key).agg(F.count_distinct(category).alias(name))
    return df.join(scores, [key], "left").withColumn(name, F.coalesce(name, F.lit(0).cast("bigint")))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """Q21, Q23: the first ``k`` rows of an order; only ``k`` rows per task move."""
    return df.orderBy(*order).limit(k)
