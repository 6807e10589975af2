"""The 10 survey questions on language processing for requirements."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessella.operators import graph as g
from tessella.questions import language as n
from tessella.questions.common import YEAR, contributions, follow, labelled, listed, named, question

# Predicates only these questions use, and the marker of an empty answer.
DATA_ITEM, ABSTRACTION, RIGOR, DESCRIPTION = "orkgp:P181015", "orkgp:P181021", "orkgp:P181024", "orkgp:description"
ASSIGNMENT, EXPERTISE, IDENTITY, FATIGUE = "orkgp:P181033", "orkgp:P181034", "orkgp:P181035", "orkgp:P181040"
ESTABLISHED = "orkgp:P181037"
CLASSIFIED, EXTRACTED, TRANSLATED = "orkgp:P181008", "orkgp:P181009", "orkgp:P181010"
MISSING = "Not reported"


def uid(k: int) -> str:
    return f"language_survey/{k:02d}"


@question(uid(1))
def evaluation_metrics(t):
    df = n.reached(t, f"{n.EVALUATION} evaluation", f"{n.METRIC} evaluation_metric")
    return listed(named(df, t, "paper", "evaluation_metric"), "paper paperLabel evaluation_metricLabel", "paperLabel")


@question(uid(2))
def guidelines(t):
    df = n.reached(t, *n.GUIDELINES).join(g.pattern(t, YEAR, "paper", "year"), ["paper"])
    return listed(named(df, t, "paper", "guidelineAvailability"), "paper year paperLabel guidelineAvailabilityLabel", "paperLabel")


@question(uid(3))
def input_granularity(t):
    df = g.star(contributions(t, n.CLASS), t, "contribution", {n.RE_TASK: "RETask", n.NLP_TASK: "task"})
    df = named(follow(df, t, "task", f"{n.TASK_INPUT} NLPTaskInput"), t, "paper", "RETask", "NLPTaskInput")
    return listed(df, "contribution paper paperLabel RETaskLabel NLPTaskInputLabel", "contribution")


@question(uid(4))
def baseline_types(t):
    df = n.reached(t, f"{n.EVALUATION} evaluation", f"{n.BASELINE} baseline", f"{n.BASELINE_TYPE} baseline_type")
    return listed(named(df, t, "paper", "baseline_type"), "contribution paper paperLabel baseline_typeLabel", "contribution")


@question(uid(5))
def text_formats(t):
    df = n.reached(t, f"{n.DATASET} dataset", f"{n.DATA_TYPE} dataType", f"{n.DATA_FORMAT} NLPdataformat")
    return listed(named(df, t, "paper", "NLPdataformat"), "contribution paper paperLabel NLPdataformatLabel", "contribution")


@question(uid(6))
def reliability_metrics(t):
    df = n.reached(t, f"{n.ANNOTATION} process", f"{n.AGREEMENT} agreement", f"{n.AGREEMENT_METRIC} intercoderReliabilityMetric")
    return listed(named(df, t, "paper", "intercoderReliabilityMetric"), "contribution paper paperLabel intercoderReliabilityMetricLabel", "contribution")


@question(uid(7))
def datasets_per_task(t):
    df = g.star(contributions(t, n.CLASS), t, "contribution", {n.NLP_TASK: "task", n.DATASET: "NLPdataset"})
    kinds = labelled(g.pattern(t, n.TASK_TYPE, "task", "NLPTaskType"), t, "NLPTaskType")
    df = g.optional(df, kinds.select("task", "NLPTaskTypeLabel"), "task")
    df = g.star(
        df, t, "NLPdataset",
        {
            DATA_ITEM: "NLPdataItem", n.PRODUCTION_TIME: "dataProductionTime", n.SOURCE: "source", ABSTRACTION: "abstraction",
            n.DATA_TYPE: "dataType", n.LICENSE: "license", n.LOCATION: "location",
        },
    )
    df = g.star(df, t, "source", {n.SOURCE_TYPE: "sourceType", n.SOURCE_DOMAIN: "sourceDomain"})
    df = g.optional(df, g.pattern(t, n.SOURCE_COUNT, "source", "numberOfDatasources"), "source")
    # three labels that come together or not at all
    for var in ("sourceType", "sourceDomain", "abstraction"):
        df = g.label_of(df, t, var, f"{var}__")
    whole = F.col("sourceType__").isNotNull() & F.col("sourceDomain__").isNotNull() & F.col("abstraction__").isNotNull()
    shown = {"sourceType__": "NLPdatasourceTypeLabel", "sourceDomain__": "datasourceDomainLabel", "abstraction__": "NLPabstractionLevelLabel"}
    df = df.withColumns({out: F.when(whole, F.col(c)) for c, out in shown.items()})
    df = g.star(df, t, "dataType", {n.DATA_FORMAT: "NLPdataFormat", RIGOR: "rigorOfDataFormat", n.LANGUAGE: "naturalLanguage"})
    df = g.star(df, t, "license", {n.AVAILABILITY: "licensePubliclyAvailable", n.LICENSE_TYPE: "licenseType"})
    df = g.star(df, t, "location", {n.LOCATION_TYPE: "datasetLocationType"})
    df = g.optional(df, g.pattern(t, n.URL, "location", "datasetURL"), "location")
    df = named(df, t, "NLPdataFormat", "rigorOfDataFormat", "licensePubliclyAvailable", "licenseType", "datasetLocationType", "paper")
    columns = (
        "contribution paper paperLabel NLPTaskTypeLabel NLPdataItem dataProductionTime NLPdatasourceTypeLabel numberOfDatasources "
        "datasourceDomainLabel NLPdataFormatLabel rigorOfDataFormatLabel naturalLanguage licensePubliclyAvailableLabel licenseTypeLabel "
        "NLPdataset datasetLocationTypeLabel datasetURL NLPabstractionLevelLabel"
    )
    return listed(df, columns, "contribution", "NLPTaskTypeLabel")


@question(uid(8))
def task_pairs(t):
    df = g.star(contributions(t, n.CLASS), t, "contribution", {n.RE_TASK: "RETask", n.NLP_TASK: "task"})
    df = follow(df, t, "task", f"{n.TASK_TYPE} NLPTaskType")
    df = named(g.optional(df, g.pattern(t, DESCRIPTION, "NLPTaskType", "NLPTaskTypeDescription"), "NLPTaskType"), t, "paper", "RETask", "NLPTaskType")
    columns = "contribution paper paperLabel RETaskLabel NLPTaskTypeLabel NLPTaskTypeDescription"
    return listed(df, columns, "contribution", "paperLabel", "NLPTaskTypeLabel")


def missing(df: DataFrame, name: str, told: list[str], bound: list[str] = (), markers: dict[str, str] | None = None) -> DataFrame:
    """Per contribution the share of fields left empty, one value where several apply.

    ``told`` columns are empty when they hold the marker, ``bound`` columns when
    they are unbound.
    """
    empty = [F.when(F.col(c) == (markers or {}).get(c, MISSING), 1).otherwise(0) for c in told]
    empty += [F.when(F.col(c).isNull(), 1).otherwise(0) for c in bound]
    ratio = sum(empty[1:], empty[0]).cast("double") / len(empty) * 100
    return df.select("contribution", ratio.alias("r")).groupBy("contribution").agg(F.min("r").alias(name))


@question(uid(9))
def missing_per_section(t):
    a = g.star(
        n.reached(t, f"{n.ANNOTATION} process"), t, "process",
        {n.ANNOTATOR: "annotator", n.SCHEME: "scheme", n.SHARED: "shared", FATIGUE: "fatigue", n.AGREEMENT: "agreement"},
    )
    a = g.star(a, t, "annotator", {ASSIGNMENT: "assignment", EXPERTISE: "expertise", IDENTITY: "identity"})
    a = g.optional(a, g.pattern(t, n.ANNOTATOR_COUNT, "annotator", "count"), "annotator")
    a = g.star(a, t, "scheme", {ESTABLISHED: "established", n.GUIDELINE: "guideline"})
    a = g.star(a, t, "agreement", {n.AGREEMENT_METRIC: "metric", n.CONFLICT: "conflict", n.MEASURED: "measured"})
    fields = ["shared", "assignment", "expertise", "identity", "established", "guideline", "metric", "conflict"]
    annotation = missing(labelled(a, t, *fields), "ratio_annotation_missing", [f"{v}Label" for v in fields] + ["measured"], ["count"])

    d = g.star(
        n.reached(t, f"{n.DATASET} dataset"), t, "dataset",
        {
            DATA_ITEM: "item", n.PRODUCTION_TIME: "time", ABSTRACTION: "abstraction", n.SOURCE: "source", n.DATA_TYPE: "dataType",
            n.LICENSE: "license", n.LOCATION: "location",
        },
    )
    d = g.star(d, t, "source", {n.SOURCE_TYPE: "sourceType", n.SOURCE_DOMAIN: "domain"})
    d = g.optional(d, g.pattern(t, n.SOURCE_COUNT, "source", "count"), "source")
    d = g.star(d, t, "dataType", {n.DATA_FORMAT: "format", n.LANGUAGE: "language", RIGOR: "rigor"})
    d = g.star(d, t, "license", {n.AVAILABILITY: "available", n.LICENSE_TYPE: "licenseType"})
    d = g.star(d, t, "location", {n.LOCATION_TYPE: "locationType"})
    d = g.optional(d, g.pattern(t, n.URL, "location", "url"), "location")
    fields = ["abstraction", "sourceType", "domain", "format", "rigor", "available", "licenseType", "locationType"]
    dataset = missing(labelled(d, t, *fields), "ratio_missing_nlp_dataset", [f"{v}Label" for v in fields] + ["item", "time", "language"], ["count", "url"])

    k = g.star(n.reached(t, f"{n.NLP_TASK} task"), t, "task", {n.TASK_TYPE: "type", n.TASK_INPUT: "input", n.TASK_OUTPUT: "output"})
    k = g.star(k, t, "output", {n.OUTPUT_TYPE: "outputType", CLASSIFIED: "classified", EXTRACTED: "extracted", TRANSLATED: "translated"})
    fields = ["type", "input", "outputType", "translated"]
    task = missing(labelled(k, t, *fields), "ratio_missing_nlptask", [f"{v}Label" for v in fields] + ["classified", "extracted"])

    e = g.star(n.reached(t, f"{n.EVALUATION} evaluation"), t, "evaluation", {n.METRIC: "metric", n.PROCEDURE: "procedure", n.BASELINE: "baseline"})
    e = g.star(e, t, "baseline", {n.BASELINE_TYPE: "type", n.BASELINE_DETAIL: "detail"})
    evaluation = missing(labelled(e, t, "metric", "procedure", "type"), "ratio_missing_eval", ["metricLabel", "procedureLabel", "typeLabel", "detail"])

    p = g.star(
        n.reached(t, f"{n.APPROACH} approach"), t, "approach",
        {
            n.APPROACH_TYPE: "type", n.ALGORITHM: "algorithm", n.REQUIREMENT: "requirement", n.DOCUMENTATION: "documentation",
            n.DEPENDENCY: "dependency", n.LICENSE_TYPE: "licenseType", n.RELEASE: "release",
        },
    )
    p = g.star(p, t, "release", {n.RELEASE_LOCATION: "location", n.RELEASE_FORMAT: "format"})
    p = g.optional(p, g.pattern(t, n.URL, "release", "url"), "release")
    fields = ["type", "algorithm", "requirement", "documentation", "dependency", "licenseType", "location", "format"]
    # the question spells the marker of this one field differently
    approach = missing(labelled(p, t, *fields), "ratio_missing_approach", [f"{v}Label" for v in fields], ["url"], {"formatLabel": "No reported"})

    df = evaluation
    for part in (approach, task, dataset, annotation):
        df = df.join(part, ["contribution"])
    return df.orderBy("contribution")


@question(uid(10))
def annotators_per_task(t):
    df = g.star(contributions(t, n.CLASS), t, "contribution", {n.ANNOTATION: "process", n.NLP_TASK: "task"})
    df = follow(follow(df, t, "task", f"{n.TASK_TYPE} NLPTaskType"), t, "process", f"{n.ANNOTATOR} annotator")
    wanted = {n.ANNOTATOR_COUNT: "numberOfAnnotators", ASSIGNMENT: "annotatorAssignment", EXPERTISE: "levelOfExpertise", IDENTITY: "annotatorIdentity"}
    df = named(g.star(df, t, "annotator", wanted), t, "NLPTaskType", "paper", "annotatorAssignment", "levelOfExpertise", "annotatorIdentity")
    columns = "contribution paper paperLabel numberOfAnnotators NLPTaskTypeLabel annotatorAssignmentLabel levelOfExpertiseLabel annotatorIdentityLabel"
    return listed(df, columns, "paperLabel")
