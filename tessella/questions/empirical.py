"""The 61 questions on empirical research practice."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators import graph as g
from tessella.questions.common import (
    VENUE, contributions, counted, counted_named, differs, follow, has, in_decade, joined, labelled, listed, named, question,
)

# The class, the venue and the predicates of the template.
CLASS = "orkgc:C27001"
CONFERENCE = "IEEE International Requirements Engineering Conference"
PARADIGM, RQ, RQ_ANSWER, THREATS = "orkgp:P57003", "orkgp:P37330", "orkgp:P57004", "orkgp:P39099"
WORDING, QUESTION_TYPE, SUBQUESTION = "orkgp:P44139", "orkgp:P41928", "orkgp:P57000"
HIDDEN, HIGHLIGHTED, MENTIONED = "orkgp:P55038", "orkgp:P55039", "orkgp:P145000"
COLLECTION, DATA, DATA_TYPE, URL = "orkgp:P56008", "orkgp:DATA", "orkgp:P7055", "orkgp:url"
QUALITATIVE, QUANTITATIVE = "orkgp:P57038", "orkgp:P57039"
METHOD, METHOD_NAME, METHOD_TYPE = "orkgp:P1005", "orkgp:P145012", "orkgp:P94003"
ANALYSIS, INFERENTIAL, DESCRIPTIVE, LEARNING = "orkgp:P15124", "orkgp:P56043", "orkgp:P56048", "orkgp:P57016"
HYPOTHESIS, STATEMENT, HYPOTHESIS_TYPE, TECHNIQUE = "orkgp:P30001", "orkgp:P56046", "orkgp:P41703", "orkgp:P35133"
ALGORITHM, METRIC = "orkgp:P2001", "orkgp:P2006"
METRICS = {"orkgp:P5073": "recall", "orkgp:P3004": "precision", "orkgp:P18048": "accuracy", "orkgp:P59137": "f-score"}
VALIDITY = {
    "orkgp:P55037": "construct validity", "orkgp:P55035": "internal validity", "orkgp:P55034": "external validity",
    "orkgp:P55036": "conclusion validity", "orkgp:P59109": "reliability", "orkgp:P60006": "generalizability",
    "orkgp:P97002": "repeatability", "orkgp:P68005": "content validity", "orkgp:P97000": "descriptive validity",
    "orkgp:P97001": "theoretical validity",
}
PERIODS = [(1993, 1999, "1993–1999"), (2000, 2009, "2000–2009"), (2010, 2019, "2010–2019"), (2020, 2025, "2020–2025")]


def uid(n: int) -> str:
    return f"empirical/{n:02d}"


def at_conference(t: g.Triples, year: bool = False) -> DataFrame:
    return contributions(t, CLASS, year, CONFERENCE)


def collected(t: g.Triples, year: bool = False, df: DataFrame | None = None) -> DataFrame:
    """Contributions with a data collection that is one."""
    df = follow(at_conference(t, year) if df is None else df, t, "contribution", f"{COLLECTION} data_collection", f"{g.LABEL} dc_label")
    return df.filter(F.col("dc_label") != "no collection")


def analysed(t: g.Triples, year: bool = False, df: DataFrame | None = None) -> DataFrame:
    """Contributions with a data analysis that is one."""
    df = follow(at_conference(t, year) if df is None else df, t, "contribution", f"{ANALYSIS} data_analysis", f"{g.LABEL} da_label")
    return df.filter(F.col("da_label") != "no analysis")


def with_data(df: DataFrame, t: g.Triples, *hops: str) -> DataFrame:
    return follow(follow(df, t, "data_collection", f"{DATA} research_data"), t, "research_data", *hops)


def with_methods(df: DataFrame, t: g.Triples) -> DataFrame:
    return follow(df, t, "data_collection", f"{METHOD} dc_method", f"{METHOD_TYPE} method_type")


def asking(t: g.Triples, year: bool = False) -> DataFrame:
    return follow(at_conference(t, year), t, "contribution", f"{RQ} research_question")


def flagged(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(1))


@question(uid(1))
def venue_series(t):
    df = follow(contributions(t, CLASS), t, "contribution", f"{VENUE} venue")
    return listed(named(df, t, "paper", venue=VENUE), "paper paperLabel venue venueLabel", "paperLabel", "venueLabel")


@question(uid(2))
def paradigms(t):
    df = follow(at_conference(t), t, "contribution", f"{PARADIGM} researchParadigm")
    return listed(named(df, t, "paper", "researchParadigm"), "paper paperLabel researchParadigm researchParadigmLabel", "paperLabel", "researchParadigmLabel")


@question(uid(3))
def question_wordings(t):
    df = follow(at_conference(t), t, "contribution", f"{RQ} researchQuestion", f"{WORDING} questionWording")
    return listed(named(df, t, "paper", "researchQuestion"), "paper paperLabel researchQuestion researchQuestionLabel questionWording", "paperLabel", "questionWording")


@question(uid(4))
def question_types(t):
    df = named(follow(asking(t), t, "research_question", f"{QUESTION_TYPE} type"), t, "paper", type=QUESTION_TYPE)
    return joined(df, "paper paperLabel", "paperLabel", questionTypes="typeLabel")


@question(uid(5))
def data_types(t):
    df = follow(at_conference(t), t, "contribution", f"{COLLECTION} dataCollection", f"{DATA} researchData", f"{DATA_TYPE} dataType")
    return listed(named(df, t, "paper", "dataType"), "paper paperLabel dataType dataTypeLabel", "paperLabel", "dataTypeLabel")


@question(uid(6))
def collection_methods(t):
    df = follow(contributions(t, CLASS), t, "contribution", f"{COLLECTION} dc", f"{METHOD} method", f"{METHOD_NAME} methodName")
    df = named(df.filter(differs(F.col("methodName"), "no method")), t, "paper")
    return joined(df, "paper paperLabel", "paperLabel", dataCollectionMethods="methodName")


@question(uid(7))
def analysis_methods(t):
    df = named(follow(analysed(t), t, "data_analysis", f"{METHOD} method"), t, "paper", method=METHOD)
    return joined(df.filter(differs(F.col("methodLabel"), "no method")), "paper paperLabel", "paperLabel", dataAnalysisMethods="methodLabel")


@question(uid(8))
def statistical_tests(t):
    df = named(follow(analysed(t), t, "data_analysis", f"{INFERENTIAL} inferential", f"{TECHNIQUE} test"), t, "paper", "test")
    return joined(df, "paper paperLabel", "paperLabel", statisticalTests="testLabel")


def subquestions(t: g.Triples, *hops: str) -> DataFrame:
    df = follow(at_conference(t), t, "contribution", f"{RQ} researchQuestion", f"{SUBQUESTION} subquestion")
    return g.star(df, t, "subquestion", dict(h.split() for h in hops))


@question(uid(9))
def questions_with_subquestions(t):
    df = g.star(subquestions(t, f"{WORDING} subqWording"), t, "researchQuestion", {WORDING: "rqWording", QUESTION_TYPE: "rqType"})
    columns = "paper paperLabel researchQuestion rqWording rqType rqTypeLabel subquestion subqWording"
    return listed(labelled(df, t, "rqType", "paper"), columns, "paperLabel", "rqWording", "subqWording")


@question(uid(10))
def subquestion_types(t):
    df = subquestions(t, f"{WORDING} subquestionWording", f"{QUESTION_TYPE} subquestionType")
    df = named(g.star(df, t, "researchQuestion", {WORDING: "rqw"}), t, "paper", "subquestionType")
    columns = "paper paperLabel researchQuestion rqw subquestion subquestionWording subquestionType subquestionTypeLabel"
    return listed(df, columns, "paperLabel", "subquestionWording", "subquestionTypeLabel")


@question(uid(11))
def wording_and_type(t):
    df = follow(at_conference(t), t, "contribution", f"{RQ} researchQuestion")
    df = named(g.star(df, t, "researchQuestion", {WORDING: "questionWording", QUESTION_TYPE: "questionType"}), t, "paper", "questionType")
    columns = "paper paperLabel researchQuestion questionWording questionType questionTypeLabel"
    return listed(df, columns, "paperLabel", "questionWording", "questionTypeLabel")


@question(uid(12))
def typed_subquestions(t):
    df = named(subquestions(t, f"{WORDING} subquestionWording", f"{QUESTION_TYPE} subquestionType"), t, "paper", "subquestionType")
    columns = "paper paperLabel researchQuestion subquestion subquestionWording subquestionType subquestionTypeLabel"
    return listed(df, columns, "paperLabel", "subquestionWording", "subquestionTypeLabel")


@question(uid(13))
def several_urls(t, at_least: int = 2):
    df = g.star(with_data(collected(t), t), t, "research_data", {DATA_TYPE: "dataType", URL: "url"})
    by = ["paper", "paperLabel", "dataType", "dataTypeLabel"]
    # the counts follow from the distinct urls that make up the text
    once = labelled(df, t, "paper", dataType=DATA_TYPE).select(*by, "url").distinct()
    rows = once.groupBy(*by).agg(F.count("url").alias("urlCount"), F.array_join(F.array_sort(F.collect_list("url")), " | ").alias("urls"))
    return rows.filter(F.col("urlCount") >= at_least).orderBy("paperLabel")


@question(uid(14))
def hypotheses_and_techniques(t):
    df = follow(analysed(t), t, "data_analysis", f"{INFERENTIAL} inferential")
    df = labelled(g.star(df, t, "inferential", {HYPOTHESIS: "hypothesis", TECHNIQUE: "technique"}), t, "paper", technique=TECHNIQUE)
    return joined(df, "paper paperLabel", "paperLabel", hypotheses="hypothesis", statisticalTechniques="techniqueLabel")


@question(uid(15))
def count_and_percent(t):
    df = follow(analysed(t), t, "data_analysis", f"{DESCRIPTIVE} descriptive", "orkgp:P56049 frequency")
    df = has(has(df, t, "frequency", "orkgp:P55023"), t, "frequency", "orkgp:P56050")
    return listed(labelled(df, t, "paper"), "paper paperLabel", "paperLabel")


@question(uid(16))
def central_tendency(t):
    """The measures are linked to no contribution: they only have to exist."""
    measures = g.pattern(t, DESCRIPTIVE, "analysis", "descriptive")
    measures = follow(measures, t, "descriptive", "orkgp:P57005 tendency")
    for p in ("orkgp:P47000", "orkgp:P57006", "orkgp:P57007", "orkgp:P44107", "orkgp:P44108"):
        measures = has(measures, t, "tendency", p)
    return listed(g.if_any(labelled(at_conference(t), t, "paper"), measures), "paper paperLabel", "paperLabel")


def answered(t: g.Triples) -> DataFrame:
    return follow(at_conference(t), t, "contribution", f"{RQ_ANSWER} answer")


@question(uid(17))
def any_hidden_answer(t):
    return g.ask(has(answered(t), t, "answer", HIDDEN))


@question(uid(18))
def any_highlighted_answer(t):
    return g.ask(has(answered(t), t, "answer", HIGHLIGHTED))


@question(uid(19))
def any_typed_data_with_url(t):
    return g.ask(has(has(with_data(collected(t), t), t, "research_data", DATA_TYPE), t, "research_data", URL))


@question(uid(20))
def any_two_hypotheses(t):
    df = follow(analysed(t), t, "data_analysis", f"{INFERENTIAL} inferential", f"{HYPOTHESIS} hypothesis")
    return g.ask(g.count_per(df, ["paper", "inferential"], "hypothesis").filter("n >= 2"))


def typed(t: g.Triples, var: str) -> DataFrame:
    """Questions whose type has a label."""
    return has(g.pattern(t, QUESTION_TYPE, var, "type"), t, "type", g.LABEL, QUESTION_TYPE).select(var)


@question(uid(21))
def untyped_questions(t):
    df = follow(at_conference(t), t, "contribution", f"{RQ} researchQuestion")
    df = g.optional(df, g.pattern(t, WORDING, "researchQuestion", "questionWording"), "researchQuestion")
    df = g.without(labelled(df, t, "paper"), typed(t, "researchQuestion"), "researchQuestion")
    return listed(df, "paper paperLabel researchQuestion questionWording", "paperLabel", "questionWording")


@question(uid(22))
def untyped_subquestions(t):
    df = g.optional(subquestions(t), g.pattern(t, WORDING, "subquestion", "subquestionWording"), "subquestion")
    df = g.without(labelled(df, t, "paper"), typed(t, "subquestion"), "subquestion")
    return listed(df, "paper paperLabel researchQuestion subquestion subquestionWording", "paperLabel", "subquestionWording")


@question(uid(23))
def data_without_url(t):
    df = with_data(collected(t), t, f"{DATA_TYPE} dataType")
    df = g.without(labelled(df, t, "paper", "dataType"), g.pattern(t, URL, "research_data", None), "research_data")
    return listed(df.withColumnRenamed("research_data", "researchData"), "paper paperLabel researchData dataType dataTypeLabel", "paperLabel", "dataTypeLabel")


@question(uid(24))
def untyped_hypotheses(t):
    df = follow(analysed(t), t, "data_analysis", f"{INFERENTIAL} inferential", f"{HYPOTHESIS} hypothesis", f"{STATEMENT} hypothesisStatement")
    df = g.optional(df, named(g.pattern(t, HYPOTHESIS_TYPE, "hypothesis", "hypothesisType"), t, hypothesisType=HYPOTHESIS_TYPE), "hypothesis")
    label = F.col("hypothesisTypeLabel")
    df = labelled(df.filter(label.isNull() | g.same_text(label, "no type")), t, "paper")
    return listed(df, "paper paperLabel hypothesis hypothesisStatement hypothesisTypeLabel", "paperLabel", "hypothesisStatement")


@question(uid(25))
def subquestion_counts(t):
    part = follow(g.pattern(t, RQ, "contribution", "rq"), t, "rq", f"{SUBQUESTION} subquestion").select("contribution", "subquestion")
    df = g.optional(at_conference(t), part, "contribution")
    return counted_named(df, t, "paper paperLabel", "paper", F.desc("subquestionCount"), "paperLabel", name="subquestionCount", of="subquestion")


@question(uid(26))
def url_counts(t):
    df = with_data(collected(t), t, f"{URL} url")
    return counted_named(df, t, "paper paperLabel", "paper", F.desc("number_of_reported_urls"), "paperLabel", name="number_of_reported_urls", of="url")


@question(uid(27))
def collection_method_counts(t):
    df = follow(collected(t), t, "data_collection", f"{METHOD} dc_method")
    name = "number_of_reported_data_collection_methods"
    return counted_named(df, t, "paper paperLabel", "paper", F.desc(name), "paperLabel", name=name, of="dc_method")


@question(uid(28))
def method_type_counts(t):
    name = "number_of_different_reported_method_types"
    return counted_named(with_methods(collected(t), t), t, "paper paperLabel", "paper", F.desc(name), "paperLabel", name=name, of="method_type")


@question(uid(29))
def hypothesis_counts(t):
    df = follow(analysed(t), t, "data_analysis", f"{INFERENTIAL} inferential", f"{HYPOTHESIS} hypothesis")
    name = "number_of_reported_hypotheses"
    return counted_named(df, t, "paper paperLabel", "paper", F.desc(name), "paperLabel", name=name, of="hypothesis")


def with_paradigm(t: g.Triples, year: bool = False) -> DataFrame:
    return follow(at_conference(t, year), t, "contribution", f"{PARADIGM} research_paradigm")


@question(uid(30))
def paradigm_counts(t):
    df = labelled(with_paradigm(t), t, "research_paradigm")
    return counted(df, "research_paradigm research_paradigmLabel", F.desc("paper_count"))


def with_question_type(t: g.Triples, year: bool = False) -> DataFrame:
    return follow(asking(t, year), t, "research_question", f"{QUESTION_TYPE} question_type")


@question(uid(31))
def question_type_counts(t):
    df = named(with_question_type(t), t, "question_type").filter(differs(F.col("question_typeLabel"), "no type"))
    return counted(df, "question_type question_typeLabel", F.desc("paper_count"))


@question(uid(32))
def data_types_over_years(t):
    df = named(with_data(collected(t, True), t, f"{DATA_TYPE} data_type"), t, "paper", data_type=DATA_TYPE)
    return df.select("paper", "paperLabel", "year", "data_type", "data_typeLabel").orderBy("year", "paperLabel", "data_typeLabel")


@question(uid(33))
def algorithms_over_decades(t):
    df = follow(analysed(t, True), t, "data_analysis", f"{LEARNING} machine_learning", f"{ALGORITHM} ml_algorithm")
    by = "decade ml_algorithm ml_algorithmLabel"
    return counted_named(in_decade(df), t, by, "ml_algorithm", "decade", F.desc("paper_count"), "ml_algorithmLabel", ml_algorithm=ALGORITHM)


@question(uid(34))
def collection_and_analysis(t):
    return counted(analysed(t, df=collected(t, True)), "year", "year")


@question(uid(35))
def paradigms_over_decades(t):
    df = in_decade(with_paradigm(t, True))
    return counted_named(df, t, "decade research_paradigm research_paradigmLabel", "research_paradigm", "decade", F.desc("paper_count"), "research_paradigmLabel")


@question(uid(36))
def questions_per_year(t):
    return counted(asking(t, True), "year", "year")


@question(uid(37))
def question_types_per_year(t):
    df = with_question_type(t, True)
    return counted_named(df, t, "year question_type question_typeLabel", "question_type", "year", F.desc("paper_count"), "question_typeLabel")


@question(uid(38))
def typed_data_with_url(t):
    df = has(has(with_data(collected(t, True), t), t, "research_data", DATA_TYPE), t, "research_data", URL)
    return counted(in_decade(df), "decade", "decade")


@question(uid(39))
def mentioned_threats(t):
    df = has(follow(at_conference(t, True), t, "contribution", f"{THREATS} threats"), t, "threats", MENTIONED)
    df = df.withColumn("interval", g.interval(g.as_int(F.col("year")), PERIODS)).filter("interval is not null")
    return counted(df, "interval", "interval")


@question(uid(40))
def questions_or_answers(t):
    rq = g.count_per(has(at_conference(t, True), t, "contribution", RQ), "year", "paper", "rq_paper_count")
    rqa = g.count_per(has(at_conference(t, True), t, "contribution", RQ_ANSWER), "year", "paper", "rqa_paper_count")
    a, b = F.col("rq_paper_count"), F.col("rqa_paper_count")
    more = g.classify([(a > b, "research question"), (b > a, "research question answer")], "tie")
    return rq.join(rqa, ["year"]).withColumn("more_reported", more).orderBy("year")


@question(uid(41))
def paradigm_and_question_type(t):
    df = follow(with_paradigm(t), t, "contribution", f"{RQ} research_question", f"{QUESTION_TYPE} question_type")
    by = "research_paradigm research_paradigmLabel question_type question_typeLabel"
    return counted_named(df, t, by, "research_paradigm question_type", F.desc("paper_count"), "research_paradigmLabel", "question_typeLabel")


@question(uid(42))
def data_and_method_type(t):
    df = with_methods(with_data(collected(t), t, f"{DATA_TYPE} data_type"), t)
    by = "data_type data_typeLabel method_type method_typeLabel"
    return counted_named(df, t, by, "data_type method_type", F.desc("paper_count"), "data_typeLabel", "method_typeLabel", data_type=DATA_TYPE, method_type=METHOD_TYPE)


@question(uid(43))
def hidden_or_highlighted_answers(t):
    return listed(named(has(answered(t), t, "answer", [HIDDEN, HIGHLIGHTED]), t, "paper"), "paper paperLabel", "paperLabel")


@question(uid(44))
def any_question_type(t):
    own = has(asking(t), t, "research_question", QUESTION_TYPE).select("paper")
    sub = has(subquestions(t), t, "subquestion", QUESTION_TYPE).select("paper")
    return listed(named(g.union(own, sub), t, "paper"), "paper paperLabel", "paperLabel")


@question(uid(45))
def leading_paradigms(t):
    df = labelled(with_data(collected(t, df=with_paradigm(t, True)), t, f"{DATA_TYPE} data_type"), t, research_paradigm=PARADIGM, data_type=DATA_TYPE)
    df = labelled(with_methods(df.filter(F.col("data_typeLabel").isin("qualitative", "quantitative")), t), t, method_type=METHOD_TYPE)
    group = ["decade", "data_type", "data_typeLabel"]
    by = [*group, "research_paradigm", "research_paradigmLabel", "method_type", "method_typeLabel"]
    best = g.most_frequent(g.count_per(in_decade(df), by, "paper", "paper_count"), "paper_count", group)
    return best.orderBy("decade", "data_typeLabel", F.desc("paper_count"), "research_paradigmLabel", "method_typeLabel")


@question(uid(46))
def metrics_with_algorithms(t):
    df = follow(analysed(t), t, "data_analysis", f"{LEARNING} machine_learning")
    df = g.star(df, t, "machine_learning", {ALGORITHM: "ml_algorithm", METRIC: "metric"})
    df = df.join(g.tagged(t, METRICS, "metric", None, "metric_value"), ["metric"])
    df = g.exists_flag(df, g.pattern(t, INFERENTIAL, "data_analysis", None), "data_analysis", "inferential")
    group = F.when(F.col("inferential"), "with inferential statistics").otherwise("without inferential statistics")
    by = "inferential_statistics_group ml_algorithm ml_algorithmLabel metric_value"
    return counted_named(df.withColumn("inferential_statistics_group", group), t, by, "ml_algorithm", "inferential_statistics_group", F.desc("paper_count"), "ml_algorithmLabel", "metric_value", ml_algorithm=ALGORITHM)


@question(uid(47))
def both_highlighted(t):
    def marked(p: str) -> DataFrame:
        return has(g.pattern(t, p, "contribution", "x"), t, "x", HIGHLIGHTED, p)

    both = at_conference(t, True).join(marked(RQ), ["contribution"], "left_semi").join(marked(RQ_ANSWER), ["contribution"], "left_semi")
    open_data = g.pattern(t, COLLECTION, "contribution", "dc").join(g.pattern(t, g.LABEL, "dc", "dc_label", kind=COLLECTION), ["dc"])
    open_data = open_data.filter(F.col("dc_label") != "no collection")
    open_data = has(follow(open_data, t, "dc", f"{DATA} data"), t, "data", URL)
    threats = has(g.pattern(t, THREATS, "contribution", "x"), t, "x", MENTIONED)
    full = open_data.select("contribution").join(threats, ["contribution"], "left_semi").distinct()
    df = g.optional(both, flagged(full, "all_conditions"), "contribution")
    per_paper = df.groupBy("paper", "year").agg(F.max(F.lit(1)).alias("both"), F.max("all_conditions").alias("all_conditions"))
    return per_paper.groupBy("year").agg(
        F.sum("both").alias("papers_with_both_highlighted"),
        g.flag_sum("all_conditions").alias("papers_with_both_highlighted_and_also_data_url_and_threats_mentioned"),
    ).orderBy("year")


def reporting(df: DataFrame, by: list[str], first: str, second: str, names: tuple[str, str, str, str]) -> DataFrame:
    """Papers per exclusive case of two optional flags, ``both, first, second, none``."""
    flags = df.groupBy("paper", *by).agg(F.max(first).alias("a"), F.max(second).alias("b"))
    a, b = F.coalesce("a", F.lit(0)) == 1, F.coalesce("b", F.lit(0)) == 1
    return flags.withColumn("reporting_case", g.classify([(a & b, names[0]), (a, names[1]), (b, names[2])], names[3]))


def flag_of(t: g.Triples, p: str, var: str, name: str) -> DataFrame:
    return flagged(g.pattern(t, p, var, None).distinct(), name)


@question(uid(48))
def question_and_answer_cases(t):
    df = g.optional(at_conference(t, True), flag_of(t, RQ, "contribution", "rq"), "contribution")
    df = g.optional(df, flag_of(t, RQ_ANSWER, "contribution", "rqa"), "contribution")
    names = ("both reported", "only research question reported", "only research question answer reported", "neither reported")
    return counted(reporting(df, ["year"], "rq", "rqa", names), "year reporting_case", "year", "reporting_case")


@question(uid(49))
def analysis_cases(t):
    df = g.optional(in_decade(analysed(t, True)), flag_of(t, INFERENTIAL, "data_analysis", "inferential"), "data_analysis")
    df = g.optional(df, flag_of(t, LEARNING, "data_analysis", "learning"), "data_analysis")
    names = ("both", "inferential-statistics only", "machine-learning only", "neither")
    return counted(reporting(df, ["decade"], "inferential", "learning", names), "decade reporting_case", "decade", "reporting_case")


def threat_categories(t: g.Triples, tags: dict[str, str]) -> DataFrame:
    return g.pattern(t, THREATS, "contribution", "threats").join(g.tagged(t, tags, "threats", None), ["threats"]).select("contribution", "category")


@question(uid(50))
def validity_coverage(t):
    facts = threat_categories(t, VALIDITY | {MENTIONED: "mentioned"}).distinct()
    df = named(g.optional(at_conference(t), facts, "contribution"), t, "paper")
    score = F.col("validity_coverage_score")
    classes = g.classify([(score == 0, "0"), (score <= 2, "1–2"), (score <= 4, "3–4")], "5+")
    rows = g.count_per(df, ["paper", "paperLabel"], "category", "validity_coverage_score").withColumn("coverage_class", classes)
    return rows.orderBy("coverage_class", F.desc("validity_coverage_score"), "paperLabel")


@question(uid(51))
def subquestion_share(t):
    df = g.optional(asking(t, True), flag_of(t, SUBQUESTION, "research_question", "sub"), "research_question")
    per_paper = df.groupBy("paper", "year").agg(F.max("sub").alias("sub"))
    total, some = F.count("*"), g.flag_sum("sub")
    return per_paper.groupBy("year").agg(
        total.alias("papers_with_research_question"),
        some.alias("papers_with_at_least_one_subquestion"),
        (total - some).alias("papers_without_subquestion"),
        g.share("sub").alias("percentage_with_subquestion"),
        (F.lit(100.0) * (total - some) / total).alias("percentage_without_subquestion"),
    ).orderBy("year")


@question(uid(52))
def question_styles(t):
    def marked(p: str, name: str) -> DataFrame:
        return flagged(has(g.pattern(t, RQ, "contribution", "x"), t, "x", p).select("contribution").distinct(), name)

    df = follow(contributions(t, CLASS), t, "contribution", "orkgp:P135046 venue", f"{g.LABEL} venue_name")
    df = g.optional(g.optional(df, marked(HIDDEN, "hidden"), "contribution"), marked(HIGHLIGHTED, "highlighted"), "contribution")
    names = ("both hidden and highlighted", "hidden only", "highlighted only", "neither flag reported")
    return counted(reporting(df, ["venue", "venue_name"], "hidden", "highlighted", names), "venue venue_name reporting_case", "venue_name", "reporting_case")


@question(uid(53))
def typed_with_two_subquestions(t):
    several = g.with_several(g.pattern(t, SUBQUESTION, "research_question", "sub"), "research_question", "sub")
    df = has(asking(t), t, "research_question", QUESTION_TYPE).join(several, ["research_question"], "left_semi")
    return listed(named(df, t, "paper"), "paper paperLabel", "paperLabel")


@question(uid(54))
def paradigm_and_threats(t, at_least: int = 10):
    df = has(at_conference(t, True), t, "contribution", PARADIGM).join(threat_categories(t, VALIDITY).distinct(), ["contribution"])
    return counted(g.count_per(df, ["paper", "year"], "category").filter(F.col("n") >= at_least), "year", "year")


@question(uid(55))
def mixed_data_many_methods(t, more_than: int = 2):
    df = with_data(collected(t), t, f"{DATA_TYPE} data_type")
    df = named(with_methods(has(has(df, t, "data_type", QUALITATIVE), t, "data_type", QUANTITATIVE), t), t, "paper")
    rows = g.count_per(df, ["paper", "paperLabel"], "method_type").filter(F.col("n") > more_than)
    return listed(rows, "paper paperLabel", "paperLabel")


def methods_with(t: g.Triples, kind: str) -> DataFrame:
    df = has(with_data(collected(t, True), t, f"{DATA_TYPE} data_type"), t, "data_type", kind)
    df = in_decade(with_methods(df, t))
    return counted_named(df, t, "decade method_type method_typeLabel", "method_type", "decade", F.desc("paper_count"), "method_typeLabel")


@question(uid(56))
def methods_with_qualitative(t):
    return methods_with(t, QUALITATIVE)


@question(uid(57))
def methods_with_quantitative(t):
    return methods_with(t, QUANTITATIVE)


@question(uid(58))
def subquestions_without_answer(t):
    df = has(asking(t, True), t, "research_question", SUBQUESTION)
    return counted(g.without(df, g.pattern(t, RQ_ANSWER, "contribution", None), "contribution"), "year", "year")


@question(uid(59))
def highlighted_share(t):
    marked = flagged(has(g.pattern(t, RQ_ANSWER, "contribution", "x"), t, "x", HIGHLIGHTED).select("contribution").distinct(), "flag")
    df = named(g.optional(with_paradigm(t), marked, "contribution"), t, "research_paradigm")
    by = ["research_paradigm", "research_paradigmLabel"]
    per_paper = df.groupBy("paper", *by).agg(F.max("flag").alias("flag"))
    return per_paper.groupBy(*by).agg(
        F.count("*").alias("total_papers"),
        g.flag_sum("flag").alias("papers_with_rqa_highlighted"),
        g.share("flag").alias("percentage_with_rqa_highlighted"),
    ).orderBy(F.desc("percentage_with_rqa_highlighted"), "research_paradigmLabel")


@question(uid(60))
def strategies_over_years(t):
    tags = {INFERENTIAL: "inferential statistics", DESCRIPTIVE: "descriptive statistic", LEARNING: "machine learning"}
    df = analysed(t, df=with_data(collected(t, df=with_paradigm(t, True)), t, f"{DATA_TYPE} data_type"))
    df = df.join(g.tagged(t, tags, "data_analysis", None, "analysis_strategy"), ["data_analysis"])
    by = "year research_paradigm research_paradigmLabel data_type data_typeLabel analysis_strategy"
    return counted_named(df, t, by, "research_paradigm data_type", "year", F.desc("paper_count"), "research_paradigmLabel", "data_typeLabel", "analysis_strategy", research_paradigm=PARADIGM, data_type=DATA_TYPE)


@question(uid(61))
def question_and_method_type(t):
    df = with_methods(collected(t, df=with_question_type(t)), t)
    by = "question_type question_typeLabel method_type method_typeLabel"
    return counted_named(df, t, by, "question_type method_type", F.desc("paper_count"), "question_typeLabel", "method_typeLabel")
