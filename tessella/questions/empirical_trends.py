"""The 16 questions on how empirical research practice evolves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators import graph as g
from tessella.questions import empirical as e
from tessella.questions.common import follow, question

# The output names of the validity threats.
THREAT_NAMES = {
    "orkgp:P55034": "external", "orkgp:P55035": "internal", "orkgp:P55037": "construct", "orkgp:P55036": "conclusion",
    "orkgp:P59109": "reliability", "orkgp:P60006": "generalizability", "orkgp:P68005": "content", "orkgp:P97000": "descriptive",
    "orkgp:P97001": "theoretical", "orkgp:P97002": "repeatability", "orkgp:P145000": "mentioned",
}


def uid(n: int) -> str:
    return f"empirical_trends/{n:02d}"


def part(t: g.Triples, p: str, label: str, *hops: str) -> DataFrame:
    """What a contribution's collection or analysis offers, whole or not at all."""
    return follow(g.pattern(t, p, "contribution", "x").join(g.pattern(t, g.LABEL, "x", label, kind=p), ["x"]), t, "x", *hops)


def labels_of_both(t: g.Triples) -> DataFrame:
    df = g.optional(e.at_conference(t, True), part(t, e.COLLECTION, "dc_label").drop("x"), "contribution")
    df = g.optional(df, part(t, e.ANALYSIS, "da_label").drop("x"), "contribution")
    return df.select("paper", "year", "dc_label", "da_label")


def method_types(t: g.Triples, *columns: str) -> DataFrame:
    """The filter on an optional label keeps only papers that have it."""
    found = part(t, e.COLLECTION, "dc_label", f"{e.METHOD} m", f"{e.METHOD_TYPE} mt", f"{g.LABEL} dc_method_type_label")
    df = e.at_conference(t, True).join(found.filter(F.col("dc_label") != "no collection"), ["contribution"])
    return df.select(*columns)


def tests(t: g.Triples, *columns: str) -> DataFrame:
    """Analyses with their inferential statistics and tests where there are any."""
    named_test = g.pattern(t, e.TECHNIQUE, "stats", "stats_test")
    named_test = named_test.join(g.pattern(t, g.LABEL, "stats_test", "test", kind=e.TECHNIQUE), ["stats_test"]).select("stats", "test")
    df = part(t, e.ANALYSIS, "da_label").filter(F.col("da_label") == "analysis")
    df = g.optional(df, g.pattern(t, e.INFERENTIAL, "x", "stats"), "x")
    df = e.at_conference(t, True).join(g.optional(df, named_test, "stats"), ["contribution"])
    return df.select(*columns)


def secondary(t: g.Triples, *columns: str) -> DataFrame:
    df = part(t, e.COLLECTION, "dc_label", f"{e.METHOD} m")
    df = follow(g.star(df, t, "m", {e.METHOD_TYPE: "mt", e.METHOD_NAME: "dc_method_name"}), t, "mt", f"{g.LABEL} dc_method_type_label")
    df = df.filter(F.col("dc_method_type_label") == "secondary research")
    return e.at_conference(t, True).join(df, ["contribution"]).select(*columns)


@question(uid(1))
def empirical_share(t):
    return labels_of_both(t)


@question(uid(2))
def methods_over_time(t):
    return method_types(t, "paper", "year", "dc_method_type_label")


@question(uid(3))
def non_empirical_share(t):
    return labels_of_both(t)


@question(uid(4))
def methods_used(t):
    return method_types(t, "paper", "dc_method_type_label")


@question(uid(5))
def kinds_of_methods_over_time(t):
    return method_types(t, "paper", "year", "dc_method_type_label")


@question(uid(6))
def statistics_used(t):
    return tests(t, "paper", "da_label", "test")


@question(uid(7))
def statistics_over_time(t):
    return tests(t, "paper", "year", "da_label", "test")


@question(uid(8))
def threats_over_time(t):
    """One value per threat, from one scan of all threats instead of eleven joins."""
    facts = g.pattern(t, e.THREATS, "contribution", "threats").join(g.tagged(t, THREAT_NAMES, "threats", "v", "tag"), ["threats"])
    df = g.optional(e.at_conference(t, True), facts.select("contribution", "tag", "v"), "contribution")
    held = [F.min(F.when(F.col("tag") == name, F.col("v"))).alias(name) for name in THREAT_NAMES.values()]
    return df.groupBy("paper", "year").agg(*held)


@question(uid(9))
def threats_reported(t):
    found = g.pattern(t, e.THREATS, "contribution", "threats")
    for p, name in THREAT_NAMES.items():
        found = g.optional(found, g.pattern(t, p, "threats", name.capitalize()), "threats")
    df = g.optional(e.at_conference(t, True), found, "contribution")
    return df.select("paper", "year", *[name.capitalize() for name in THREAT_NAMES.values()])


@question(uid(10))
def case_studies_over_time(t):
    return method_types(t, "paper", "year", "dc_method_type_label")


@question(uid(11))
def data_provision(t):
    data = g.optional(g.pattern(t, e.DATA, "x", "data"), g.pattern(t, e.URL, "data", "url"), "data")
    found = g.optional(part(t, e.COLLECTION, "dc_label").filter(F.col("dc_label") != "no collection"), data, "x")
    return e.at_conference(t, True).join(found, ["contribution"]).select("paper", "year", "data", "url")


@question(uid(12))
def questions_and_answers(t):
    rq = g.optional(g.pattern(t, e.RQ, "contribution", "rq"), g.pattern(t, e.WORDING, "rq", "question"), "rq")
    rq = g.optional(rq, g.pattern(t, e.HIGHLIGHTED, "rq", "highlighted_q"), "rq")
    answer = g.optional(g.pattern(t, e.RQ_ANSWER, "contribution", "answer"), g.pattern(t, e.HIGHLIGHTED, "answer", "highlighted_a"), "answer")
    df = g.optional(g.optional(e.at_conference(t, True), rq, "contribution"), answer, "contribution")
    return df.select("paper", "year", "question", "highlighted_q", "highlighted_a")


@question(uid(13))
def secondary_methods(t):
    return secondary(t, "paper", "dc_method_type_label", "dc_method_name")


@question(uid(14))
def secondary_methods_over_time(t):
    return secondary(t, "paper", "year", "dc_method_type_label", "dc_method_name")


@question(uid(15))
def methods_per_paper(t):
    rows = method_types(t, "paper", "year", "dc_method_type_label")
    return rows.groupBy("paper", "year").agg(F.count("dc_method_type_label").alias("number_of_dc_methods"))


@question(uid(16))
def methods_per_paper_over_time(t):
    return methods_per_paper(t)
