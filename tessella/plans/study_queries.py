"""Notebook questions over the scholarly graph, checked against joins in SQL."""

from __future__ import annotations

from collections.abc import Callable

from tessella.plans.registry import query
from tessella.plans.study import Patterns, study_graph
from tessella.questions import QUESTIONS
from tessella.questions.empirical import CONFERENCE, VALIDITY

EMP = f"""paper P31 contribution; contribution a 'orkgc:C27001'; contribution P135046 venue; venue label '{CONFERENCE}'; """
NLP = "paper P31 contribution; contribution a 'orkgc:C121001'; "
DC = EMP + "contribution P56008 dc; dc label dcl; "
DA = EMP + "contribution P15124 da; da label dal; "
COLLECTED, ANALYSED = "dcl <> 'no collection'", "dal <> 'no analysis'"
YEAR = "paper P29 year; "
DECADE = "(floor(year::int / 10.0) * 10)::int || 's'"


def check(uid: str, name: str, body: Callable[[Patterns], str]) -> None:
    """Register one question with the SQL that ``body`` writes from patterns."""
    p = Patterns()
    run = QUESTIONS[uid]
    query(name, p.sql(body(p)))(lambda spark, sf: run(study_graph(spark, sf)))


def texts(column: str) -> str:
    return f"coalesce(string_agg(distinct {column}, ' | ' order by {column}), '')"


def told(column: str) -> str:
    return f"lower({column}) <> 'not reported'"


check(
    "empirical/01", "N01_venues_per_paper",
    lambda p: f"""select distinct paper, paperLabel, venue, venueLabel from
        {p.match("paper P31 contribution; contribution a 'orkgc:C27001'; contribution P135046 venue")} m {p.label("paper venue")}""",
)
check(
    "empirical/04", "N02_question_types_per_paper",
    lambda p: f"""select paper, paperLabel, {texts('typeLabel')} as questionTypes from
        {p.match(EMP + "contribution P37330 rq; rq P41928 type")} m {p.label("paper type")} group by 1, 2""",
)
check(
    "empirical/07", "N03_analysis_methods",
    lambda p: f"""select paper, paperLabel, {texts('methodLabel')} as dataAnalysisMethods from
        {p.match(DA + "da P1005 method", ANALYSED)} m {p.label("paper method")} where lower(methodLabel) <> 'no method' group by 1, 2""",
)
check(
    "empirical/13", "N04_several_urls",
    lambda p: f"""select paper, paperLabel, dataType, dataTypeLabel, count(distinct url) as urlCount, {texts('url')} as urls from
        {p.match(DC + "dc DATA data; data P7055 dataType; data url url; paper label paperLabel; dataType label dataTypeLabel", COLLECTED)}
        group by 1, 2, 3, 4 having count(distinct url) >= 2""",
)
check(
    "empirical/14", "N05_hypotheses_and_techniques",
    lambda p: f"""select paper, paperLabel, {texts('h')} as hypotheses, {texts('tl')} as statisticalTechniques from
        {p.match(DA + "da P56043 i; i P30001 h; i P35133 tech; tech label tl; paper label paperLabel", ANALYSED)} group by 1, 2""",
)
check(
    "empirical/16", "N06_unlinked_measures",
    lambda p: f"""select distinct paper, paperLabel from {p.match(EMP + "paper label paperLabel")} where exists (select 1 from
        {p.match("d P56048 s; s P57005 t; t P47000 a; t P57006 b; t P57007 c; t P44107 e; t P44108 f")})""",
)
check(
    "empirical/20", "N07_any_two_hypotheses",
    lambda p: f"""select exists (select paper, i from {p.match(DA + "da P56043 i; i P30001 h", ANALYSED)} group by paper, i having count(distinct h) >= 2) as answer""",
)
check(
    "empirical/21", "N08_untyped_questions",
    lambda p: f"""select distinct paper, paperLabel, rq as researchQuestion, questionWording from {p.match(EMP + "contribution P37330 rq; paper label paperLabel")} m
        left join {p.match("rq P44139 questionWording")} w using (rq) where not exists (select 1 from {p.match("rq P41928 ty; ty label tl")} n where n.rq = m.rq)""",
)
check(
    "empirical/24", "N09_untyped_hypotheses",
    lambda p: f"""select distinct paper, paperLabel, hypothesis, hypothesisStatement, hypothesisTypeLabel from
        {p.match(DA + "da P56043 i; i P30001 hypothesis; hypothesis P56046 hypothesisStatement; paper label paperLabel", ANALYSED)} m
        left join (select * from {p.match("hypothesis P41703 hypothesisType")} k {p.label("hypothesisType")}) using (hypothesis)
        where hypothesisType is null or hypothesisTypeLabel is null or lower(hypothesisTypeLabel) = 'no type'""",
)
check(
    "empirical/25", "N10_subquestion_counts",
    lambda p: f"""select paper, paperLabel, count(distinct sub) as subquestionCount from {p.match(EMP)} m
        left join {p.match("contribution P37330 rq; rq P57000 sub")} using (contribution) {p.label("paper")} group by 1, 2""",
)
check(
    "empirical/32", "N11_data_types_over_years",
    lambda p: f"""select paper, paperLabel, year, data_type, data_typeLabel from
        {p.match(DC + YEAR + "dc DATA data; data P7055 data_type", COLLECTED)} m {p.label("paper data_type")}""",
)
check(
    "empirical/33", "N12_algorithms_per_decade",
    lambda p: f"""select {DECADE} as decade, ml_algorithm, ml_algorithmLabel, count(distinct paper) as paper_count from
        {p.match(DA + YEAR + "da P57016 ml; ml P2001 ml_algorithm", ANALYSED)} m {p.label("ml_algorithm")} group by 1, 2, 3""",
)
check(
    "empirical/39", "N13_threats_per_interval",
    lambda p: f"""select case when year::int between 1993 and 1999 then '1993–1999' when year::int between 2000 and 2009 then '2000–2009'
        when year::int between 2010 and 2019 then '2010–2019' else '2020–2025' end as interval, count(distinct paper) as paper_count
        from {p.match(EMP + YEAR + "contribution P39099 th; th P145000 v", "year::int between 1993 and 2025")} group by 1""",
)
check(
    "empirical/40", "N14_questions_or_answers",
    lambda p: f"""select *, case when rq_paper_count > rqa_paper_count then 'research question' when rqa_paper_count > rq_paper_count then 'research question answer' else 'tie' end as more_reported
        from (select year, count(distinct paper) as rq_paper_count from {p.match(EMP + YEAR + "contribution P37330 x")} group by 1)
        join (select year, count(distinct paper) as rqa_paper_count from {p.match(EMP + YEAR + "contribution P57004 x")} group by 1) using (year)""",
)
check(
    "empirical/42", "N15_data_and_method_types",
    lambda p: f"""select data_type, data_typeLabel, method_type, method_typeLabel, count(distinct paper) as paper_count from
        {p.match(DC + "dc DATA data; dc P1005 me; data P7055 data_type; me P94003 method_type", COLLECTED)} m {p.label("data_type method_type")} group by 1, 2, 3, 4""",
)
check(
    "empirical/45", "N16_leading_paradigms",
    lambda p: f"""select * from (select {DECADE} as decade, data_type, data_typeLabel, research_paradigm, research_paradigmLabel, method_type, method_typeLabel, count(distinct paper) as paper_count from
        {p.match(DC + YEAR + "contribution P57003 research_paradigm; research_paradigm label research_paradigmLabel; dc DATA data; dc P1005 me; data P7055 data_type; "
                 "data_type label data_typeLabel; me P94003 method_type; method_type label method_typeLabel", COLLECTED + " and data_typeLabel in ('qualitative', 'quantitative')")}
        group by 1, 2, 3, 4, 5, 6, 7) qualify rank() over (partition by decade, data_type, data_typeLabel order by paper_count desc) = 1""",
)
check(
    "empirical/46", "N17_metrics_with_algorithms",
    lambda p: f"""select case when da in (select da from {p.match("da P56043 i")}) then 'with inferential statistics' else 'without inferential statistics' end as inferential_statistics_group,
        ml_algorithm, ml_algorithmLabel, metric_value, count(distinct paper) as paper_count from {p.match(DA + "da P57016 ml; ml P2001 ml_algorithm; ml P2006 metric", ANALYSED)} m
        join (select metric, 'recall' as metric_value from {p.match("metric P5073 v")} union all select metric, 'precision' from {p.match("metric P3004 v")}
            union all select metric, 'accuracy' from {p.match("metric P18048 v")} union all select metric, 'f-score' from {p.match("metric P59137 v")}) using (metric)
        {p.label("ml_algorithm")} group by 1, 2, 3, 4""",
)
check(
    "empirical/47", "N18_both_highlighted",
    lambda p: f"""select year, count(*) as papers_with_both_highlighted, sum(flag)::bigint as papers_with_both_highlighted_and_also_data_url_and_threats_mentioned from
        (select paper, year, max(case when contribution in (select contribution from
            {p.match("contribution P56008 dc; contribution P39099 th; dc label dcl; dc DATA data; data url u; th P145000 v", COLLECTED)}) then 1 else 0 end) as flag
        from {p.match(EMP + YEAR + "contribution P37330 rq; rq P55039 a; contribution P57004 rqa; rqa P55039 b")} group by 1, 2) group by 1""",
)
check(
    "empirical/49", "N19_analysis_cases",
    lambda p: f"""select decade, case when a = 1 and b = 1 then 'both' when a = 1 then 'inferential-statistics only' when b = 1 then 'machine-learning only' else 'neither' end as reporting_case,
        count(distinct paper) as paper_count from (select paper, {DECADE} as decade, max((da in (select da from {p.match("da P56043 i")}))::int) as a,
        max((da in (select da from {p.match("da P57016 i")}))::int) as b from {p.match(DA + YEAR, ANALYSED)} group by 1, 2) group by 1, 2""",
)
check(
    "empirical/50", "N20_validity_coverage",
    lambda p: "select *, case when validity_coverage_score = 0 then '0' when validity_coverage_score <= 2 then '1–2' when validity_coverage_score <= 4 then '3–4' else '5+' end as coverage_class from "
    f"(select paper, paperLabel, count(distinct category) as validity_coverage_score from {p.match(EMP)} m left join ("
    + " union all ".join(
        f"select contribution, '{name}' as category from {p.match(f'contribution P39099 th; th {pred.split(chr(58))[1]} v')}"
        for pred, name in [*VALIDITY.items(), ("orkgp:P145000", "mentioned")]
    )
    + f") using (contribution) {p.label('paper')} group by 1, 2)",
)
check(
    "empirical/51", "N21_subquestion_share",
    lambda p: f"""select year, count(*) as papers_with_research_question, sum(f)::bigint as papers_with_at_least_one_subquestion, (count(*) - sum(f))::bigint as papers_without_subquestion,
        100.0::double * sum(f)::double / count(*) as percentage_with_subquestion, 100.0::double * (count(*) - sum(f))::double / count(*) as percentage_without_subquestion from
        (select paper, year, max((rq in (select rq from {p.match("rq P57000 s")}))::int) as f from {p.match(EMP + YEAR + "contribution P37330 rq")} group by 1, 2) group by 1""",
)
check(
    "empirical/53", "N22_two_subquestions",
    lambda p: f"""select distinct paper, paperLabel from {p.match(EMP + "contribution P37330 rq; rq P41928 ty; rq P57000 s1; rq P57000 s2", "s1 <> s2")} m {p.label("paper")}""",
)
check(
    "empirical/58", "N23_subquestions_without_answer",
    lambda p: f"""select year, count(distinct paper) as paper_count from {p.match(EMP + YEAR + "contribution P37330 rq; rq P57000 s")}
        where contribution not in (select contribution from {p.match("contribution P57004 x")}) group by 1""",
)
check(
    "empirical/60", "N24_strategies_over_years",
    lambda p: f"""select year, research_paradigm, research_paradigmLabel, data_type, data_typeLabel, analysis_strategy, count(distinct paper) as paper_count from
        {p.match(DC + YEAR + "contribution P57003 research_paradigm; contribution P15124 da; dc DATA data; da label dal; data P7055 data_type", COLLECTED + " and " + ANALYSED)} m
        join (select da, 'inferential statistics' as analysis_strategy from {p.match("da P56043 x")} union all select da, 'descriptive statistic' from {p.match("da P56048 x")}
            union all select da, 'machine learning' from {p.match("da P57016 x")}) using (da) {p.label("research_paradigm data_type")} group by 1, 2, 3, 4, 5, 6""",
)
check(
    "language/10", "N25_baselines_per_paper",
    lambda p: f"""select paper, paperLabel, coalesce(string_agg(distinct tyLabel, ', ' order by tyLabel), '') as baselineTypes from {p.match(NLP)} m
        left join (select contribution, tyLabel from {p.match("contribution HAS_EVALUATION ev; ev P181051 b; b P181052 ty")} k {p.label("ty")}) using (contribution) {p.label("paper")} group by 1, 2""",
)
COMBINED = NLP + "contribution P181002 reTask; contribution P181003 nlpTask; nlpTask P181004 nlpTaskType; nlpTask P181006 output; output P181007 outputType"
check(
    "language/11", "N26_frequent_combinations",
    lambda p: f"""select reTask, reTaskLabel, nlpTaskType, nlpTaskTypeLabel, outputType, outputTypeLabel, paperCount, {texts('paperLabel')} as papers from
        (select reTask, nlpTaskType, outputType, count(distinct paper) as paperCount from {p.match(COMBINED)} group by 1, 2, 3 qualify paperCount = max(paperCount) over ()) top
        join {p.match(COMBINED)} m using (reTask, nlpTaskType, outputType) {p.label("paper reTask nlpTaskType outputType")} group by 1, 2, 3, 4, 5, 6, 7""",
)
check(
    "language/15", "N27_annotation_quality",
    lambda p: f"""select paper, paperLabel, {texts('gLabel')} as guidelineAvailabilities, {texts('measured')} as measuredAgreements, {texts('kLabel')} as metrics, {texts('cLabel')} as conflictResolutions from
        {p.match(NLP + "contribution P181031 ap; ap P181036 sc; ap P181041 ag; sc P181038 g; ag P181045 measured; ag P181042 k; ag P181044 c")} m {p.label("paper g k c")} group by 1, 2""",
)
check(
    "language/18", "N28_releases",
    lambda p: "select paper, paperLabel, releaseFormats, publicationTypes, urls, documentationTypes from (select distinct paper, paperLabel from "
    f"{p.match(NLP + 'contribution P181046 ap; ap release r')} m {p.label('paper')}) "
    + " ".join(
        f"left join (select paper, {texts(column)} as {name} from {p.match(NLP + 'contribution P181046 ap; ' + hop)} m {p.label('v')} group by 1) using (paper)"
        for name, hop, column in (
            ("releaseFormats", "ap release r; r P181049 v", "vLabel"), ("publicationTypes", "ap release r; r P181029 v", "vLabel"),
            ("urls", "ap release r; r P1003 v", "v"), ("documentationTypes", "ap P41835 v", "vLabel"),
        )
    ),
)
check(
    "language/21", "N29_task_types_per_decade",
    lambda p: (
        lambda m: f"""select publicationDecade, NLPTaskTypeLabel, paperCount, {texts('paperLabel')} as papers from
        (select publicationDecade, NLPTaskTypeLabel, count(distinct paper) as paperCount from {m} group by 1, 2 qualify rank() over (partition by publicationDecade order by paperCount desc) = 1) top
        join {m} m using (publicationDecade, NLPTaskTypeLabel) {p.label("paper")} group by 1, 2, 3"""
    )(f"""(select *, {DECADE} as publicationDecade from {p.match(NLP + YEAR + "contribution P181003 ta; ta P181004 ty; ty label NLPTaskTypeLabel", told('NLPTaskTypeLabel'))})"""),
)
check(
    "language/30", "N30_any_bare_agreement",
    lambda p: f"""select count(*) > 0 as answer from {p.match(NLP + "contribution P181031 ap; ap P181041 ag; ag label agl", told('agl'))} m
        where ag not in (select ag from {p.match("ag P181042 v; v label vl", told('vl'))}) and ag not in (select ag from {p.match("ag P181044 v; v label vl", told('vl'))})""",
)
LANGUAGE, FORMAT = "dt P181025 lang", "dt P181023 f; f label fl"
DATA_TYPES = NLP + "contribution P181011 ds; ds P181022 dt; "
check(
    "language/31", "N31_language_and_format",
    lambda p: f"""select distinct paper, paperLabel, reportingStatus from (
        select paper, 'both' as reportingStatus from {p.match(DATA_TYPES + LANGUAGE + "; " + FORMAT, told('lang') + " and " + told('fl'))}
        union all select paper, 'only natural language' from {p.match(DATA_TYPES + LANGUAGE, told('lang'))} where dt not in (select dt from {p.match(FORMAT, told('fl'))})
        union all select paper, 'only data format' from {p.match(DATA_TYPES + FORMAT, told('fl'))} where dt not in (select dt from {p.match(LANGUAGE, told('lang'))})) m {p.label("paper")}""",
)
check(
    "language/33", "N32_released_without_license",
    lambda p: f"""select distinct paper, paperLabel from {p.match(NLP + "contribution P181046 ap; ap release r")} m {p.label("paper")}
        where (r in (select r from {p.match("r P181049 v; v label vl", told('vl'))}) or r in (select r from {p.match("r P181029 v; v label vl", told('vl'))}))
        and ap not in (select ap from {p.match("ap P181027 v; v label vl", told('vl'))})""",
)
check(
    "language/34", "N33_any_partial_baseline",
    lambda p: f"""select count(*) > 0 as answer from {p.match(NLP + "contribution HAS_EVALUATION ev; ev P181051 b; b label bl", told('bl'))}
        where b not in (select b from {p.match("b P181052 v; v label vl", told('vl'))}) or b not in (select b from {p.match("b P181053 v", told('v'))})""",
)
check(
    "language/36", "N34_several_source_types",
    lambda p: f"""select paper, paperLabel, numberOfDatasources, string_agg(distinct tl, ', ' order by tl) as datasourceTypes from
        {p.match(NLP + "contribution P181011 ds; ds P181017 so; so P181019 numberOfDatasources; so P181018 ty; ty label tl", "tl <> 'Not reported' and numberOfDatasources <> 'Not reported'")} m
        {p.label("paper")} group by 1, 2, 3 having count(distinct tl) > 1""",
)
check(
    "empirical_trends/06", "N35_statistics_used",
    lambda p: f"""select paper, dal as da_label, test from {p.match(DA + YEAR, "dal = 'analysis'")} m
        left join (select da, test from {p.match("da P56043 i")} x left join {p.match("i P35133 te; te label test")} using (i)) using (da)""",
)
check(
    "empirical_trends/08", "N36_sampled_threats",
    lambda p: "select paper, year, "
    + ", ".join(f"min({n}) as {n}" for n in "external internal construct conclusion reliability generalizability content descriptive theoretical repeatability mentioned".split())
    + f" from {p.match(EMP + YEAR)} m left join {p.match('contribution P39099 th')} using (contribution) "
    + " ".join(
        f"left join (select th, min({n}) as {n} from {p.match(f'th {pred} {n}')} group by 1) using (th)"
        for pred, n in (
            ("P55034", "external"), ("P55035", "internal"), ("P55037", "construct"), ("P55036", "conclusion"), ("P59109", "reliability"),
            ("P60006", "generalizability"), ("P68005", "content"), ("P97000", "descriptive"), ("P97001", "theoretical"), ("P97002", "repeatability"), ("P145000", "mentioned"),
        )
    )
    + " group by 1, 2",
)
check(
    "empirical_trends/15", "N37_methods_per_paper",
    lambda p: f"""select paper, year, count(ml) as number_of_dc_methods from {p.match(DC + YEAR + "dc P1005 me; me P94003 mt; mt label ml", COLLECTED)} group by 1, 2""",
)
