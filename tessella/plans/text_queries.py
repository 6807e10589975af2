"""Extraction, validation and run queries over outputs derived from documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.functions import checks, extract
from tessella.functions.text import BLANK, LINE_BREAK, WHITESPACE, WS
from tessella.operators.runs import entry_id, gold_query, run_summary, score_run
from tessella.operators.validation import validate, validation_summary
from tessella.plans.outputs import OUTPUTS_SQL, model_outputs
from tessella.plans.registry import query, sql_text, table
from tessella.session import spread

# ------------------------------------------------------------ the chain in SQL

TRIM = "".join(f" || chr({ord(c)})" for c in WHITESPACE)[4:]


def strip(e: str) -> str:
    return f"trim({e}, {TRIM})"


def gsub(e: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({e}, {sql_text(pattern)}, {sql_text(to)}, 'g')"


def lines(e: str) -> str:
    return gsub(e, LINE_BREAK, "\n")


def x1(e: str) -> str:
    return gsub(e, r"(?is)<think>.*?</think>")


def x2(e: str) -> str:
    for label in (rf"##[{WS}]*Output", rf"SPARQL[{WS}]*Query[{WS}]*:?", rf"Output[{WS}]*:?"):
        e = gsub(e, rf"(?im)^{label}[{WS}]*$")
    return strip(e)


def x3(e: str) -> str:
    return strip(
        f"case when regexp_matches({e}, '(?is)```sparql.*?```') then regexp_extract({e}, '(?is)```sparql(.*?)```', 1) "
        f"when regexp_matches({e}, '(?s)```.*?```') then regexp_extract({e}, '(?s)```(.*?)```', 1) else {e} end"
    )


def x4(e: str) -> str:
    start = rf"(?ims)^[{BLANK}]*((?:PREFIX [{BLANK}]*[^{WS}]|SELECT|ASK|CONSTRUCT|DESCRIBE).*)"
    return strip(f"split_part(regexp_extract({lines(e)}, {sql_text(start)}, 1), '```', 1)")


def x5(e: str) -> str:
    """Line by line, as the rule is stated, where Spark rewrites the whole text."""
    kept = f"list_filter(string_split({lines(e)}, chr(10)), lambda l: not starts_with({strip('l')}, '#'))"
    tail = rf"[{BLANK}]+#.*$"
    cut = f"list_transform({kept}, lambda l: rtrim(regexp_replace(l, {sql_text(tail)}, ''), {TRIM}))"
    return strip(f"array_to_string({cut}, chr(10))")


def x6(e: str) -> str:
    head = rf"(?i)^[{BLANK}]*PREFIX[{BLANK}]+[\p{{L}}\p{{N}}_]+:[{BLANK}]*<[^>]+>[{BLANK}]*$"
    return strip(f"array_to_string(list_filter(string_split({lines(e)}, chr(10)), lambda l: not regexp_matches(l, {sql_text(head)})), chr(10))")


def x7(e: str) -> str:
    return strip(gsub(e, r"\n{3,}", "\n\n"))


def chain(source: str, key: str, raw: str) -> str:
    """CTEs ending in ``extracted(key, family, q)``."""
    return f"""x_a as (select {key} as key, family, {x2(x1(strip(raw)))} as t from {source}),
    x_b as (select key, family, {x3('t')} as t from x_a),
    x_c as (select key, family, {x4('t')} as t from x_b),
    x_d as (select key, family, {x6(x5('t'))} as t from x_c),
    extracted as (select key, family, {x7('t')} as q from x_d)"""


EXTRACTED = f"with {OUTPUTS_SQL}, {chain('outputs', 'doc_id', 'raw')}"


def extracted(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract_queries(model_outputs(spark, sf), F.col("raw"), "q").select(F.col("doc_id").alias("key"), "family", "q")


# ---------------------------------------------------------------- X0-X8 queries


@query(
    "X00_strip_echo",
    f"""select doc_id, {strip("case when starts_with(output, prompt) then substr(output, length(prompt) + 1) else output end")} as rest
        from (select doc_id, source || ': ' as prompt, case when doc_id % 3 = 0 then source || ': ' || text else ' ' || source || ': ' || text end as output from documents)""",
)
def x0_query(spark, sf):
    prompt = F.concat("source", F.lit(": "))
    output = F.when(F.col("doc_id") % 3 == 0, F.concat(prompt, "text")).otherwise(F.concat(F.lit(" "), prompt, "text"))
    return table(spark, sf, "documents").select("doc_id", extract.strip_echo(output, prompt).alias("rest"))


def step(name: str, sql_step, spark_step) -> None:
    """Register one step of the chain applied to the raw outputs."""

    @query(name, f"with {OUTPUTS_SQL} select doc_id, {sql_step('raw')} as text from outputs")
    def run(spark, sf):
        return model_outputs(spark, sf).select("doc_id", spark_step(F.col("raw")).alias("text"))


step("X01_drop_thinking", x1, extract.drop_thinking)
step("X02_drop_label_lines", x2, extract.drop_label_lines)
step("X03_code_block", x3, extract.code_block)
step("X04_query_region", x4, extract.query_region)
step("X05_drop_comments", x5, extract.drop_comments)
step("X06_drop_prefixes", x6, extract.drop_prefixes)
step("X07_squeeze_blank_lines", x7, extract.squeeze_blank_lines)


@query("X08_extract_queries", f"{EXTRACTED} select key, q from extracted")
def x8_query(spark, sf):
    return extracted(spark, sf).select("key", "q")


@query(
    "X08_extract_from_pages",
    f"""with page_rows as (select page_id, url as family, html || chr(10) || '<pre>' || chr(10) || 'SELECT ?x WHERE {{ ?x a <' || url || '> }}' || chr(10) || '</pre>' as raw from pages),
        {chain('page_rows', 'page_id', 'raw')} select key, family, q from extracted""",
)
def x8_pages(spark, sf):
    raw = F.concat("html", F.lit("\n<pre>\nSELECT ?x WHERE { ?x a <"), "url", F.lit("> }\n</pre>"))
    rows = spread(table(spark, sf, "pages")).select(F.col("page_id").alias("key"), F.col("url").alias("family"), raw.alias("raw"))
    return extract.extract_queries(rows, F.col("raw"), "q").select("key", "family", "q")


# --------------------------------------------------------------- V1-V12 queries


def depth(text: str, opening: str, closing: str) -> str:
    """Balanced in SQL: every prefix of the bracket text has depth >= 0, the whole 0."""
    b = gsub(text, rf"[^\{opening}\{closing}]")
    at = f"list_transform(range(1, length({b}) + 1), lambda i: 2 * length(replace(left({b}, i), '{closing}', '')) - i)"
    return f"(2 * length(replace({b}, '{closing}', '')) = length({b}) and coalesce(list_min({at}), 0) >= 0)"


HAS = f"length({strip('q')}) > 0"
START = f"regexp_matches(q, {sql_text(rf'(?i)^[{WS}]*(SELECT|ASK|CONSTRUCT|DESCRIBE)')})"
BALANCED = depth("q", "{", "}")
ENDINGS = ["?", "or", "and", "prefix", "select", "where", "{", "(", ",", ";"]
SUSPICIOUS = f"({HAS} and (" + " or ".join(f"ends_with(lower(rtrim(q, {TRIM})), {sql_text(e)})" for e in ENDINGS) + "))"
BARE = gsub(gsub("q", r"\\."), r'"[^"\n]*"|\'[^\'\n]*\'|<[^<>"{}|^`\s]*>')
GLUED = r"(?is)^(.*?\bSELECT)\?"
BEFORE = f"regexp_extract(q, {sql_text(GLUED)}, 1)"
GLUED_MESSAGE = (
    f"'Expected a blank, found ''?''  (at char ' || length({BEFORE}) || '), (line:' || (length({BEFORE}) - length(replace({BEFORE}, chr(10), '')) + 1)"
    f" || ', col:' || (length(regexp_extract({BEFORE}, '[^\\n]*$')) + 1) || ')'"
)
MESSAGE = f"""case when not ({HAS}) then 'Empty query' when regexp_matches(q, '(?i)\\bSELECT\\?') then {GLUED_MESSAGE}
    when not contains(bare, '{{') and not regexp_matches(q, {sql_text(rf'(?i)^[{WS}]*DESCRIBE')}) then 'Missing group'
    when not {depth('bare', '{', '}')} then 'Unbalanced braces' when not {depth('bare', '(', ')')} then 'Unbalanced parentheses'
    when regexp_matches(bare, '["'']') then 'Unclosed quote' end"""

CHECKED = f"""{EXTRACTED}, bared as (select *, {BARE} as bare from extracted),
checked as (select key, family, q, {HAS} as has, {START} as start, ({HAS} and (not {BALANCED} or {SUSPICIOUS})) as cut, {MESSAGE} as message from bared),
judged as (select *, message is null as parse_ok from checked)"""
HINT = f"""case when message is null then null when contains(lower(message), 'empty query') then {sql_text(checks.HINT_EMPTY)}
    when contains(message, 'found ''?''') then {sql_text(checks.HINT_SPACE)} else {sql_text(checks.HINT_DEFAULT)} end"""
STATUS = "case when not has then 'empty' when not start then 'invalid_start' when not parse_ok then 'syntax_error' when cut then 'needs_review' else 'looks_ok' end"
REASON = """case when not has then 'empty_query' when not start then 'invalid_query_start' when parse_ok then 'query_already_parseable'
    when cut then 'non_empty_query_with_valid_start_but_truncated' else 'non_empty_query_with_valid_start_but_syntax_error' end"""
CANDIDATE = "(has and start and not parse_ok)"


def number(label: str) -> str:
    return f"try_cast(nullif(regexp_extract(message, '{label}(\\d+)', 1), '') as int)"


def flag(name: str, sql: str, fn) -> None:
    """Register one check over the raw outputs, which hold every kind of text."""

    @query(name, f"with {OUTPUTS_SQL}, o as (select doc_id as key, raw as q from outputs) select key, {sql} as flag from o")
    def run(spark, sf):
        return model_outputs(spark, sf).select(F.col("doc_id").alias("key"), fn(F.col("raw")).alias("flag"))


flag("V01_has_query", HAS, checks.has_query)
flag("V02_valid_start", START, checks.valid_start)
flag("V03_balanced_braces", BALANCED, checks.balanced_braces)
flag("V04_ends_suspiciously", SUSPICIOUS, checks.ends_suspiciously)
flag(
    "V05_looks_truncated",
    f"({HAS} and (not {BALANCED} or {SUSPICIOUS}))",
    lambda q: checks.truncated(checks.has_query(q), checks.balanced_braces(q), checks.ends_suspiciously(q)),
)


def results(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted queries in the shape of a run."""
    rows = extracted(spark, sf)
    return rows.select(
        F.concat(F.lit("d-"), F.col("key").cast("string")).alias("benchmark_entry_id"),
        F.concat(F.lit("u-"), F.col("key").cast("string")).alias("uid"),
        F.col("key").alias("source_id"),
        F.lit("documents").alias("source_dataset"),
        "family",
        F.lit("?").alias("question"),
        F.col("q").alias("extracted_query"),
        F.lit("ASK {}").alias("gold_query"),
        F.concat(F.lit("run"), (F.col("key") % 2).cast("string")).alias("run"),
    )


@query("V06_lexical_check", f"{CHECKED} select key, parse_ok, message from judged")
def v6(spark, sf):
    rows = checks.with_lexical_issues(extracted(spark, sf), "q").withColumn("message", F.get("lexical_issues", F.lit(0)))
    return rows.select("key", F.col("message").isNull().alias("parse_ok"), "message")


@query("V07_error_position", f"{CHECKED} select key, {number('line:')} as line, {number('col:')} as col, {number('char ')} as at from judged")
def v7(spark, sf):
    rows = validate(results(spark, sf))
    return rows.select(F.col("source_id").alias("key"), F.col("parse_error_line").alias("line"), F.col("parse_error_column").alias("col"), F.col("parse_error_char").alias("at"))


@query("V08_error_hint", f"{CHECKED} select key, {HINT} as hint from judged")
def v8(spark, sf):
    return validate(results(spark, sf)).select(F.col("source_id").alias("key"), F.col("parse_error_hint").alias("hint"))


@query("V09_status", f"{CHECKED} select key, {STATUS} as status from judged")
def v9(spark, sf):
    return validate(results(spark, sf)).select(F.col("source_id").alias("key"), F.col("validation_status").alias("status"))


@query("V10_repair_candidate", f"{CHECKED} select key, {CANDIDATE} as candidate, {REASON} as reason from judged")
def v10(spark, sf):
    rows = validate(results(spark, sf))
    return rows.select(F.col("source_id").alias("key"), F.col("is_repair_candidate").alias("candidate"), F.col("repair_candidate_reason").alias("reason"))


@query(
    "V11_row_report",
    f"""{CHECKED} select 'd-' || key as benchmark_entry_id, 'u-' || key as uid, key as source_id, 'documents' as source_dataset, family, '?' as question,
        q as extracted_query, 'ASK {{}}' as gold_query, has as has_extracted_query, not has as is_empty_query, start as has_valid_query_start,
        cut as looks_truncated, parse_ok, message as parse_error_raw, {number('line:')} as parse_error_line, {number('col:')} as parse_error_column,
        {number('char ')} as parse_error_char, {HINT} as parse_error_hint, {CANDIDATE} as is_repair_candidate, {REASON} as repair_candidate_reason,
        {STATUS} as validation_status from judged""",
)
def v11(spark, sf):
    return validate(results(spark, sf).drop("run"))


@query(
    "V12_summary",
    f"""{CHECKED} select 'run' || (key % 2) as run, family, count(*) as total_items, count_if(has)::bigint as items_with_query, count_if(not has)::bigint as empty_query_items,
        count_if(start)::bigint as valid_query_start_items, count_if(cut)::bigint as truncated_items, count_if(parse_ok)::bigint as parse_ok_items,
        count_if(not parse_ok)::bigint as syntax_error_items, count_if({CANDIDATE})::bigint as repair_candidate_items,
        count_if(not {CANDIDATE})::bigint as non_repair_candidate_items from judged group by 1, 2""",
)
def v12(spark, sf):
    return validation_summary(validate(results(spark, sf)), "run", "family")


# ----------------------------------------------------------------- R1-R4 queries

ENTRIES_SQL = """entries as (select case when doc_id % 5 = 0 then '  ' when doc_id % 5 = 1 then null else 'u-' || doc_id end as uid,
    case when doc_id % 10 = 0 then doc_id end as source_id, doc_id + 1 as pos, case when doc_id % 11 = 0 then ' ' else source end as family,
    case when doc_id % 13 = 0 then '' else text end as question, case when doc_id % 4 = 0 then '' else ' ASK { ' || lang || ' } ' end as gold_query,
    case when doc_id % 4 = 0 and doc_id % 8 = 0 then 'SELECT ' || source end as sparql, doc_id from documents)"""
EID = f"case when length(coalesce({strip('uid')}, '')) > 0 then uid when source_id is not null then source_id::varchar else 'item-' || pos end"
GOLD = f"case when length({strip('gold_query')}) > 0 then {strip('gold_query')} when length({strip('sparql')}) > 0 then {strip('sparql')} else '' end"


def entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries with blank ids, families, questions and gold queries among them."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id")
    return d.select(
        F.when(k % 5 == 0, "  ").when(k % 5 != 1, F.concat(F.lit("u-"), k.cast("string"))).alias("uid"),
        F.when(k % 10 == 0, k).alias("source_id"),
        (k + 1).alias("pos"),
        F.when(k % 11 == 0, " ").otherwise(F.col("source")).alias("family"),
        F.when(k % 13 == 0, "").otherwise(F.col("text")).alias("question"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(" ASK { "), "lang", F.lit(" } "))).alias("gold_query"),
        F.when(k % 8 == 0, F.concat(F.lit("SELECT "), "source")).alias("sparql"),
        "doc_id",
    )


def run_entries(spark: SparkSession, sf: str) -> DataFrame:
    """The entries once for each of two runs; the second repeats every ninth under the id before it."""
    e = entries(spark, sf)
    repeated = (F.col("run") == "second") & (F.col("doc_id") % 9 == 1)
    runs = e.withColumn("run", F.explode(F.array(F.lit("first"), F.lit("second"))))
    return runs.withColumn("uid", F.when(repeated, F.concat(F.lit("u-"), (F.col("doc_id") - 1).cast("string"))).otherwise(F.col("uid")))


def recorded(spark: SparkSession, sf: str) -> DataFrame:
    """The recorded outputs of both runs; every 17th is missing."""
    ids = run_entries(spark, sf)
    ids = ids.select("doc_id", "run", "pos", entry_id(ids).alias("benchmark_entry_id"))
    made = model_outputs(spark, sf).filter(F.col("doc_id") % 17 != 0).join(ids, ["doc_id"])
    slower = F.when(F.col("run") == "second", 2).otherwise(1)
    return made.select("run", "pos", "benchmark_entry_id", F.col("raw").alias("raw_model_output"), ((F.col("doc_id") % 1000) / 64 * slower).alias("response_time_seconds"))


SCORED = f"""{EXTRACTED}, {ENTRIES_SQL}, both_runs as (select * replace (case when run = 'second' and doc_id % 9 = 1 then 'u-' || (doc_id - 1) else uid end as uid)
    from (select *, unnest(['first', 'second']) as run from entries)),
keyed as (select *, {EID} as eid, {GOLD} as gold from both_runs),
scored as (select k.*, (doc_id % 1000) / 64.0::double * case run when 'second' then 2 else 1 end as took, q, o.raw, case when length(trim(family, {TRIM})) = 0 then 'Entry ' || eid || ' has no valid ''family''.'
    when length(trim(question, {TRIM})) = 0 then 'Entry ' || eid || ' has no valid ''question''.'
    when doc_id % 17 = 0 then 'Entry ' || eid || ' has no model output.' end as error
    from (select k.*, x.q from keyed k join extracted x on x.key = k.doc_id) k join (select doc_id, raw from outputs) o using (doc_id))"""


@query("R01_entry_id", f"with {ENTRIES_SQL} select doc_id, {EID} as eid from entries")
def r1(spark, sf):
    e = entries(spark, sf)
    return e.select("doc_id", entry_id(e).alias("eid"))


@query("R02_gold_query", f"with {ENTRIES_SQL} select doc_id, {GOLD} as gold from entries")
def r2(spark, sf):
    e = entries(spark, sf)
    return e.select("doc_id", gold_query(e).alias("gold"))


@query(
    "R03_score_run",
    f"""{SCORED} select case when error is null then 'ok' else 'error' end as status, run, pos, eid as benchmark_entry_id, uid, source_id, null as source_dataset, family, question,
        gold as gold_query, case when error is null then {strip('raw')} end as raw_model_output, case when error is null then q end as extracted_query,
        case when error is null then round(took, 4) end as response_time_seconds, error from scored""",
)
def r3(spark, sf):
    return score_run(run_entries(spark, sf), recorded(spark, sf))


@query(
    "R04_run_summary",
    f"""{SCORED} select run, family, count(*) as total_items, count_if(error is null)::bigint as successful_items, count_if(error is not null)::bigint as failed_items,
        round(coalesce(sum(t), 0), 4) as total_runtime_seconds, round(avg(t), 4) as mean_response_seconds from
        (select *, case when error is null then round(took, 4) end as t from scored) group by run, family""",
)
def r4(spark, sf):
    return run_summary(score_run(run_entries(spark, sf), recorded(spark, sf)), "run", "family")
