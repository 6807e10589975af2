"""The 40 questions on language processing for requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators import graph as g
from tessella.questions.common import (
    YEAR, between_years, contributions, differs, follow, has, in_decade, joined, labelled, listed, named, question,
    top_with_papers,
)

# The class and the predicates of the template.
CLASS = "orkgc:C121001"
RE_TASK, NLP_TASK, TASK_TYPE, TASK_INPUT = "orkgp:P181002", "orkgp:P181003", "orkgp:P181004", "orkgp:P181005"
TASK_OUTPUT, OUTPUT_TYPE = "orkgp:P181006", "orkgp:P181007"
DATASET, PRODUCTION_TIME, SOURCE, SOURCE_TYPE = "orkgp:P181011", "orkgp:P181016", "orkgp:P181017", "orkgp:P181018"
SOURCE_COUNT, SOURCE_DOMAIN = "orkgp:P181019", "orkgp:P181020"
DATA_TYPE, DATA_FORMAT, LANGUAGE = "orkgp:P181022", "orkgp:P181023", "orkgp:P181025"
LICENSE, AVAILABILITY, LICENSE_TYPE = "orkgp:license", "orkgp:P181026", "orkgp:P181027"
LOCATION, RELEASE_LOCATION, LOCATION_TYPE, URL = "orkgp:P181028", "orkgp:P181029", "orkgp:P181030", "orkgp:P1003"
ANNOTATION, ANNOTATOR, ANNOTATOR_COUNT = "orkgp:P181031", "orkgp:P181032", "orkgp:P59120"
SCHEME, GUIDELINE, SHARED = "orkgp:P181036", "orkgp:P181038", "orkgp:P181039"
AGREEMENT, AGREEMENT_METRIC, CONFLICT, MEASURED = "orkgp:P181041", "orkgp:P181042", "orkgp:P181044", "orkgp:P181045"
APPROACH, APPROACH_TYPE, ALGORITHM = "orkgp:P181046", "orkgp:P5043", "orkgp:P58069"
REQUIREMENT, DEPENDENCY, RELEASE, RELEASE_FORMAT = "orkgp:P181047", "orkgp:P181048", "orkgp:release", "orkgp:P181049"
DOCUMENTATION = "orkgp:P41835"
EVALUATION, METRIC, PROCEDURE = "orkgp:HAS_EVALUATION", "orkgp:P110006", "orkgp:P181050"
BASELINE, BASELINE_TYPE, BASELINE_DETAIL = "orkgp:P181051", "orkgp:P181052", "orkgp:P181053"
NONE = "not reported"


def uid(n: int) -> str:
    return f"language/{n:02d}"


def reached(t: g.Triples, *hops: str, year: bool = False) -> DataFrame:
    """Papers of the class with the variables along a path of the contribution."""
    return follow(contributions(t, CLASS, year), t, "contribution", *hops)


def reported(df: DataFrame, t: g.Triples, *variables: str, **led: str) -> DataFrame:
    """Variables whose label says something."""
    return labelled(df, t, *variables, unless=NONE, **led)


def exactly(df: DataFrame, *columns: str) -> DataFrame:
    """Leave out the marker as written, where case is not normalised."""
    for c in columns:
        df = df.filter(F.col(c) != "Not reported")
    return df


def stated(t: g.Triples, p: str, var: str) -> DataFrame:
    """Subjects with a value of ``p`` whose label says something."""
    return reported(g.pattern(t, p, var, "__v"), t, __v=p).select(var)


@question(uid(1))
def re_tasks(t):
    return listed(named(reached(t, f"{RE_TASK} reTask"), t, "paper", "reTask"), "paper paperLabel reTask reTaskLabel", "paperLabel")


@question(uid(2))
def nlp_task_types(t):
    df = named(reached(t, f"{NLP_TASK} task", f"{TASK_TYPE} Nlp_TaskType"), t, "paper", "Nlp_TaskType")
    return listed(df, "paper paperLabel Nlp_TaskType Nlp_TaskTypeLabel")


@question(uid(3))
def nlp_task_inputs(t):
    df = named(reached(t, f"{NLP_TASK} Nlp_Task", f"{TASK_INPUT} Nlp_TaskInput"), t, "Nlp_Task", "Nlp_TaskInput")
    return listed(df.withColumnRenamed("Nlp_TaskInputLabel", "Nlp_InputLabel"), "Nlp_Task Nlp_TaskLabel Nlp_TaskInput Nlp_InputLabel")


def task_outputs(t: g.Triples, df: DataFrame) -> DataFrame:
    return follow(df, t, "nlpTask", f"{TASK_OUTPUT} nlpTaskOutput", f"{OUTPUT_TYPE} outputType")


@question(uid(4))
def outputs_per_task_type(t):
    df = g.star(reached(t, f"{NLP_TASK} nlpTask"), t, "nlpTask", {TASK_TYPE: "nlpTaskType"})
    columns = "nlpTaskType nlpTaskTypeLabel outputType outputTypeLabel"
    return listed(named(task_outputs(t, df), t, "nlpTaskType", "outputType"), columns, "nlpTaskTypeLabel", "outputTypeLabel")


@question(uid(5))
def datasets(t):
    return listed(named(reached(t, f"{DATASET} dataset"), t, "dataset"), "dataset datasetLabel", "datasetLabel")


@question(uid(6))
def natural_languages(t):
    df = reached(t, f"{DATASET} dataset", f"{DATA_TYPE} dataType", f"{LANGUAGE} naturalLanguage")
    return listed(named(df, t, "naturalLanguage"), "naturalLanguage naturalLanguageLabel", "naturalLanguage")


@question(uid(7))
def annotator_counts(t):
    df = named(reached(t, f"{ANNOTATION} process", f"{ANNOTATOR} annotator", f"{ANNOTATOR_COUNT} n"), t, "paper")
    df = df.withColumn("numberOfAnnotations", g.as_int(F.col("n")))
    return listed(df, "paper paperLabel numberOfAnnotations", F.desc("numberOfAnnotations"), "paperLabel")


GUIDELINES = (f"{ANNOTATION} annotationProcess", f"{SCHEME} annotationScheme", f"{GUIDELINE} guidelineAvailability")


@question(uid(8))
def guideline_availability(t):
    df = named(reached(t, *GUIDELINES), t, "guidelineAvailability")
    return listed(df, "guidelineAvailability guidelineAvailabilityLabel", "guidelineAvailability")


@question(uid(9))
def metrics_per_paper(t):
    df = g.optional(reached(t, f"{EVALUATION} evaluation"), g.pattern(t, METRIC, "evaluation", "metric"), "evaluation")
    return joined(named(df, t, "paper", "metric"), "paper paperLabel", "paperLabel", sep=", ", metrics="metricLabel")


@question(uid(10))
def baselines_per_paper(t):
    part = follow(g.pattern(t, EVALUATION, "contribution", "evaluation"), t, "evaluation", f"{BASELINE} baseline", f"{BASELINE_TYPE} type")
    part = named(part, t, type=BASELINE_TYPE).select("contribution", "typeLabel")
    df = named(g.optional(contributions(t, CLASS), part, "contribution"), t, "paper")
    return joined(df, "paper paperLabel", "paperLabel", sep=", ", baselineTypes="typeLabel")


def both_tasks(t: g.Triples) -> DataFrame:
    return g.star(contributions(t, CLASS), t, "contribution", {RE_TASK: "reTask", NLP_TASK: "nlpTask"})


@question(uid(11))
def frequent_task_combinations(t):
    df = task_outputs(t, g.star(both_tasks(t), t, "nlpTask", {TASK_TYPE: "nlpTaskType"}))
    by = "reTask nlpTaskType outputType"
    return top_with_papers(df, t, by, F.desc("paperCount"), "reTaskLabel", "nlpTaskTypeLabel", "outputTypeLabel", labels=by, reTask=RE_TASK, nlpTaskType=TASK_TYPE, outputType=OUTPUT_TYPE)


@question(uid(12))
def inputs_and_outputs_per_task(t):
    df = task_outputs(t, g.star(both_tasks(t), t, "nlpTask", {TASK_INPUT: "nlpTaskInput"}))
    df = named(df, t, "paper", "reTask", "nlpTaskInput", "outputType")
    by = ["reTask", "reTaskLabel", "nlpTaskInput", "nlpTaskInputLabel", "outputType", "outputTypeLabel"]
    once = df.select(*by, "paper", "paperLabel").distinct()
    # a paper may have several labels: count papers, not labels
    papers = F.array_join(F.array_sort(F.collect_set("paperLabel")), " | ").alias("papers")
    rows = once.groupBy(*by).agg(F.count_distinct("paper").alias("paperCount"), papers)
    return rows.orderBy("reTaskLabel", F.desc("paperCount"), "nlpTaskInputLabel", "outputTypeLabel")


@question(uid(13))
def dataset_terms(t):
    df = g.star(reached(t, f"{DATASET} dataset"), t, "dataset", {LICENSE: "license", LOCATION: "location"})
    df = g.star(df, t, "license", {AVAILABILITY: "publicAvailability", LICENSE_TYPE: "licenseType"})
    df = g.star(df, t, "location", {LOCATION_TYPE: "locationType", URL: "url"})
    df = named(df, t, "paper", "licenseType", "locationType", "publicAvailability")
    columns = "paper paperLabel licenseType licenseTypeLabel locationType locationTypeLabel publicAvailabilityLabel url"
    return listed(df, columns, "publicAvailabilityLabel", "paperLabel")


@question(uid(14))
def frequent_sources(t):
    df = g.star(reached(t, f"{DATASET} dataset", f"{SOURCE} source"), t, "source", {SOURCE_TYPE: "sourceType", SOURCE_DOMAIN: "sourceDomain"})
    by = "sourceType sourceDomain"
    return top_with_papers(df, t, by, F.desc("paperCount"), "sourceTypeLabel", "sourceDomainLabel", labels=by)


@question(uid(15))
def annotation_quality(t):
    df = g.star(reached(t, f"{ANNOTATION} process"), t, "process", {SCHEME: "scheme", AGREEMENT: "agreement"})
    df = g.star(df, t, "scheme", {GUIDELINE: "guideline"})
    df = g.star(df, t, "agreement", {MEASURED: "measured", AGREEMENT_METRIC: "metric", CONFLICT: "conflict"})
    return joined(
        named(df, t, "paper", guideline=GUIDELINE, metric=AGREEMENT_METRIC, conflict=CONFLICT), "paper paperLabel", "paperLabel",
        guidelineAvailabilities="guidelineLabel", measuredAgreements="measured", metrics="metricLabel", conflictResolutions="conflictLabel",
    )


@question(uid(16))
def several_baseline_types(t, more_than: int = 1):
    df = reached(t, f"{EVALUATION} evaluation", f"{BASELINE} baseline")
    df = named(g.star(df, t, "baseline", {BASELINE_TYPE: "type", BASELINE_DETAIL: "baselineDetail"}), t, "paper", "type")
    by = ["paper", "paperLabel", "baselineDetail"]
    labels = F.array_join(F.array_sort(F.collect_set("typeLabel")), " | ").alias("baselineTypes")
    rows = df.select(*by, "type", "typeLabel").distinct().groupBy(*by).agg(F.count_distinct("type").alias("baselineTypeCount"), labels)
    return rows.filter(F.col("baselineTypeCount") > more_than).orderBy("paperLabel")


@question(uid(17))
def frequent_algorithms(t):
    df = g.star(reached(t, f"{APPROACH} approach"), t, "approach", {APPROACH_TYPE: "approachType", ALGORITHM: "algorithm"})
    by = "approachType algorithm"
    return top_with_papers(df, t, by, F.desc("paperCount"), "approachTypeLabel", "algorithmLabel", labels=by)


@question(uid(18))
def releases(t):
    approaches = reached(t, f"{APPROACH} approach")
    released = follow(approaches, t, "approach", f"{RELEASE} release")

    def texts(df: DataFrame, start: str, p: str, name: str, labels: bool = True) -> DataFrame:
        rows = follow(df, t, start, f"{p} value")
        rows = named(rows, t, value=p) if labels else rows.withColumn("valueLabel", F.col("value"))
        return g.group_concat(rows, "paper", "valueLabel", name, " | ")

    df = listed(named(released, t, "paper"), "paper paperLabel")
    df = g.optional(df, texts(released, "release", RELEASE_FORMAT, "releaseFormats"), "paper")
    df = g.optional(df, texts(released, "release", RELEASE_LOCATION, "publicationTypes"), "paper")
    df = g.optional(df, texts(released, "release", URL, "urls", labels=False), "paper")
    return g.optional(df, texts(approaches, "approach", DOCUMENTATION, "documentationTypes"), "paper").orderBy("paperLabel")


@question(uid(19))
def metrics_and_procedures(t):
    df = g.star(reached(t, f"{EVALUATION} evaluation"), t, "evaluation", {METRIC: "metric", PROCEDURE: "procedure"})
    df = labelled(df.join(g.pattern(t, YEAR, "paper", "year"), ["paper"]), t, "metric", "procedure", "paper")
    once = df.select("year", "metricLabel", "procedureLabel", "paper", "paperLabel").distinct()
    papers = F.array_join(F.array_sort(F.collect_set("paperLabel")), " | ").alias("papers")
    rows = once.groupBy("year", F.col("metricLabel").alias("evaluation_metricLabel"), F.col("procedureLabel").alias("validation_procedureLabel"))
    return rows.agg(F.count_distinct("paper").alias("paperCount"), papers).orderBy("year", "evaluation_metricLabel", "validation_procedureLabel")


@question(uid(20))
def production_times(t):
    df = exactly(reached(t, f"{DATASET} dataset", f"{PRODUCTION_TIME} productionTime"), "productionTime")
    return listed(named(df, t, "paper"), "paper paperLabel productionTime", "paperLabel", "productionTime")


def leading(df: DataFrame, t: g.Triples, label: str) -> DataFrame:
    by = f"publicationDecade {label}"
    return top_with_papers(df, t, by, "publicationDecade", label, within="publicationDecade")


@question(uid(21))
def task_types_per_decade(t):
    df = reported(reached(t, f"{NLP_TASK} task", f"{TASK_TYPE} NLPTaskType", year=True), t, NLPTaskType=TASK_TYPE)
    return leading(in_decade(df, "publicationDecade"), t, "NLPTaskTypeLabel")


@question(uid(22))
def tasks_per_interval(t):
    df = reported(between_years(reached(t, f"{RE_TASK} RETask", year=True), 2006, 2025), t, "RETask")
    span = g.interval(g.as_int(F.col("year")), [(2006, 2015, "2006-2015"), (2016, 2025, "2016-2025")])
    return joined(named(df.withColumn("timeInterval", span), t, "paper"), "timeInterval RETaskLabel", "timeInterval", "RETaskLabel", papers="paperLabel")


def evaluated(t: g.Triples, p: str, var: str) -> DataFrame:
    df = between_years(reached(t, f"{EVALUATION} evaluation", f"{p} {var}", year=True), 2006, 2025)
    return in_decade(reported(df, t, var), "publicationDecade")


@question(uid(23))
def most_papers_per_metric(t):
    counts = g.count_per(evaluated(t, METRIC, "metric"), ["publicationDecade", "metricLabel"], "paper")
    return counts.groupBy("publicationDecade").agg(F.max("n").alias("maxCount")).orderBy("publicationDecade")


@question(uid(24))
def procedures_per_decade(t):
    return leading(evaluated(t, PROCEDURE, "validationProcedure"), t, "validationProcedureLabel")


@question(uid(25))
def languages_per_interval(t):
    df = reached(t, f"{DATASET} dataset", f"{DATA_TYPE} dataType", f"{LANGUAGE} naturalLanguage", year=True)
    df = between_years(df.filter(differs(F.col("naturalLanguage"), NONE)), 2006, 2025)
    spans = [(2006, 2010, "2006-2010"), (2011, 2015, "2011-2015"), (2016, 2020, "2016-2020"), (2021, 2025, "2021-2025")]
    df = named(df.withColumn("timeInterval", g.interval(g.as_int(F.col("year")), spans)), t, "paper")
    return joined(df, "timeInterval naturalLanguage", "timeInterval", "naturalLanguage", papers="paperLabel")


@question(uid(26))
def production_times_per_decade(t):
    df = reached(t, f"{DATASET} dataset", f"{PRODUCTION_TIME} dataProductionTime", year=True)
    df = between_years(df.filter(differs(F.col("dataProductionTime"), NONE)), 2006, 2025)
    df = named(in_decade(df, "publicationDecade"), t, "paper")
    return joined(df, "publicationDecade dataProductionTime", "publicationDecade", "dataProductionTime", papers="paperLabel")


@question(uid(27))
def domains_per_decade(t):
    df = reached(t, f"{DATASET} dataset", f"{SOURCE} source", f"{SOURCE_DOMAIN} datasourceDomain", year=True)
    df = reported(between_years(df, 2010, 2029), t, "datasourceDomain")
    span = g.interval(g.as_int(F.col("year")), [(2010, 2019, "2010s"), (2020, 2029, "2020s")])
    return leading(df.withColumn("publicationDecade", span), t, "datasourceDomainLabel")


@question(uid(28))
def any_metric_and_procedure(t):
    df = reached(t, f"{EVALUATION} evaluation").join(stated(t, METRIC, "evaluation"), ["evaluation"], "left_semi")
    return g.ask(df.join(stated(t, PROCEDURE, "evaluation"), ["evaluation"], "left_semi"))


@question(uid(29))
def any_guideline_without_material(t):
    df = reported(reached(t, *GUIDELINES), t, "guidelineAvailability")
    return g.ask(g.without(df, stated(t, SHARED, "annotationProcess"), "annotationProcess"))


@question(uid(30))
def any_bare_agreement(t):
    df = reported(reached(t, f"{ANNOTATION} process", f"{AGREEMENT} agreement"), t, agreement=AGREEMENT)
    df = g.without(df, stated(t, AGREEMENT_METRIC, "agreement"), "agreement")
    return g.ask(g.without(df, stated(t, CONFLICT, "agreement"), "agreement"))


@question(uid(31))
def language_and_format(t):
    """One row of two flags per data type instead of three branches."""
    df = reached(t, f"{DATASET} dataset", f"{DATA_TYPE} dataType")
    spoken = g.pattern(t, LANGUAGE, "dataType", "v").filter(differs(F.col("v"), NONE))
    df = g.exists_flag(g.exists_flag(df, spoken, "dataType", "spoken"), stated(t, DATA_FORMAT, "dataType"), "dataType", "formatted")
    a, b = F.col("spoken"), F.col("formatted")
    status = g.classify([(a & b, "both"), (a, "only natural language"), (b, "only data format")])
    df = named(df.withColumn("reportingStatus", status).filter("reportingStatus is not null"), t, "paper")
    return listed(df, "paper paperLabel reportingStatus", "reportingStatus", "paperLabel")


@question(uid(32))
def any_two_domains(t):
    df = reported(reached(t, f"{DATASET} dataset", f"{SOURCE} source", f"{SOURCE_DOMAIN} domain"), t, "domain")
    return g.ask(g.with_several(df, "source", "domain"))


@question(uid(33))
def released_without_license(t):
    df = reached(t, f"{APPROACH} approach", f"{RELEASE} release")
    either = g.union(stated(t, RELEASE_FORMAT, "release"), stated(t, RELEASE_LOCATION, "release"))
    df = g.without(df.join(either, ["release"], "left_semi"), stated(t, LICENSE_TYPE, "approach"), "approach")
    return listed(named(df, t, "paper"), "paper paperLabel", "paperLabel")


@question(uid(34))
def any_partial_baseline(t):
    df = reported(reached(t, f"{EVALUATION} evaluation", f"{BASELINE} baseline"), t, baseline=BASELINE)
    detailed = g.pattern(t, BASELINE_DETAIL, "baseline", "v").filter(differs(F.col("v"), NONE))
    return g.ask(g.lacking_any(df, [stated(t, BASELINE_TYPE, "baseline"), detailed], "baseline"))


@question(uid(35))
def any_dependency_and_requirement(t):
    def told(p: str) -> DataFrame:
        return exactly(labelled(g.pattern(t, p, "approach", "v"), t, "v"), "vLabel").select("approach")

    df = has(reached(t, f"{APPROACH} approach"), t, "paper", g.LABEL)
    return g.ask(df.join(told(DEPENDENCY), ["approach"], "left_semi").join(told(REQUIREMENT), ["approach"], "left_semi"))


def several_texts(df: DataFrame, by: list[str], value: str, name: str, sep: str) -> DataFrame:
    """Groups with at least two different values, and their text."""
    once = df.select(*by, value).distinct()
    rows = once.groupBy(*by).agg(F.count(value).alias("n"), F.array_join(F.array_sort(F.collect_list(value)), sep).alias(name))
    return rows.filter("n > 1").drop("n").orderBy("paperLabel")


@question(uid(36))
def several_source_types(t):
    df = g.star(reached(t, f"{DATASET} dataset", f"{SOURCE} source"), t, "source", {SOURCE_COUNT: "numberOfDatasources", SOURCE_TYPE: "type"})
    df = named(exactly(labelled(df, t, type=SOURCE_TYPE), "typeLabel", "numberOfDatasources"), t, "paper")
    return several_texts(df, ["paper", "paperLabel", "numberOfDatasources"], "typeLabel", "datasourceTypes", ", ")


@question(uid(37))
def url_without_location_type(t):
    df = exactly(reached(t, f"{DATASET} dataset", f"{LOCATION} location", f"{URL} datasetURL"), "datasetURL")
    typed = exactly(labelled(g.pattern(t, LOCATION_TYPE, "location", "v"), t, "v"), "vLabel")
    return listed(named(g.without(df, typed.select("location"), "location"), t, "paper"), "paper paperLabel datasetURL", "paperLabel")


@question(uid(38))
def algorithms_without_approach_type(t):
    df = exactly(labelled(reached(t, f"{APPROACH} approach", f"{ALGORITHM} algorithm"), t, "algorithm"), "algorithmLabel")
    typed = exactly(labelled(g.pattern(t, APPROACH_TYPE, "approach", "v"), t, "v"), "vLabel")
    df = named(g.without(df, typed.select("approach"), "approach"), t, "paper")
    return joined(df, "paper paperLabel", "paperLabel", sep="| ", algorithms="algorithmLabel")


@question(uid(39))
def several_requirements(t):
    df = exactly(labelled(reached(t, f"{APPROACH} approach", f"{REQUIREMENT} requirement"), t, "requirement"), "requirementLabel")
    return several_texts(named(df, t, "paper"), ["paper", "paperLabel"], "requirementLabel", "runningRequirements", "| ")


@question(uid(40))
def several_dependencies(t):
    df = exactly(labelled(reached(t, f"{APPROACH} approach", f"{DEPENDENCY} dependency"), t, "dependency"), "dependencyLabel")
    return several_texts(named(df, t, "paper"), ["paper", "paperLabel"], "dependencyLabel", "dependencies", "| ")
