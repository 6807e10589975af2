"""Source, canonicalisation, template, prompt and export queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessella.functions.text import BLANK, WS
from tessella.operators import canonical, export, prompts, templates
from tessella.operators import prompt_texts as texts
from tessella.operators.lookup import salted_join
from tessella.plans.outputs import CELLS_SQL, cells
from tessella.plans.registry import query, sql_text, table
from tessella.plans.shop import iri, money, shop_graph
from tessella.plans.text_queries import TRIM, extracted, gsub, lines, strip
from tessella.session import scratch_dir
from tessella.sources import readers, writers

# ------------------------------------------------------------ S1-S11: sources


@query(
    "S01_notebook_scan",
    f"with {CELLS_SQL} select 'conv-' || file as language, pos // 8 as notebook, (pos % 8)::int as pos, kind, value from cells",
)
def s1(spark, sf):
    """Notebooks of at most eight cells, packed one per line, written and scanned."""
    c = cells(spark, sf).withColumn("notebook", F.floor(F.col("pos") / 8))
    cell = F.struct("pos", F.col("kind"), F.concat(F.lit("conv-"), F.col("file").cast("string")).alias("language"), "value")
    packed = c.groupBy("file", "notebook").agg(F.to_json(F.array_sort(F.collect_list(cell))).alias("value"))
    out = scratch_dir(spark, "notebooks")
    packed.select(F.concat_ws("\t", F.col("notebook").cast("string"), "value").alias("value")).write.text(out)
    read = spark.read.text(out).select(
        F.substring_index("value", "\t", 1).alias("file"), F.substring_index("value", "\t", -1).alias("value")
    )
    return readers.notebook_cells(read).select("language", F.col("file").cast("bigint").alias("notebook"), "pos", "kind", "value")


CANONICAL_SQL = """select 'doc-' || doc_id as uid, source as source_dataset, doc_id::int as source_id, lang as family, text as question,
    'ASK { ?x ?y "' || lang || '" }' as gold_query, null as contribution_class from documents"""


def canonical_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the shape of canonical entries."""
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("uid"),
        F.col("source").alias("source_dataset"),
        F.col("doc_id").cast("int").alias("source_id"),
        F.col("lang").alias("family"),
        F.col("text").alias("question"),
        F.concat(F.lit('ASK { ?x ?y "'), "lang", F.lit('" }')).alias("gold_query"),
        F.lit(None).cast("string").alias("contribution_class"),
    )


@query("S02_canonical_json_scan", CANONICAL_SQL)
def s2(spark, sf):
    """JSON lists of at most 200 entries, one list per file."""
    rows = canonical_documents(spark, sf)
    lists = rows.groupBy(F.floor(F.col("source_id") / 200).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    out = scratch_dir(spark, "canonical")
    lists.write.partitionBy("part").text(out)
    return readers.read_canonical_json(spark, f"{out}/*")[0]


@query("S03_jsonl_scan", CANONICAL_SQL)
def s3(spark, sf):
    out = scratch_dir(spark, "lines")
    writers.write_jsonl(canonical_documents(spark, sf), out)
    return readers.read_jsonl(spark, out)[0]


@query(
    "S04_run_scan",
    """select 'model-' || (doc_id // 100) as run, (row_number() over (partition by doc_id // 100 order by doc_id))::int as pos, 'd-' || doc_id as benchmark_entry_id,
       lang as family, text as raw_model_output, doc_id / 8.0::double as response_time_seconds from documents""",
)
def s4(spark, sf):
    """Run payloads of at most 100 results, one JSON object per line."""
    d = table(spark, sf, "documents")
    result = F.struct(
        "doc_id",
        F.lit("ok").alias("status"),
        F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("benchmark_entry_id"),
        F.col("lang").alias("family"),
        F.col("text").alias("raw_model_output"),
        (F.col("doc_id") / 8).alias("response_time_seconds"),
    )
    payload = d.groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.array_sort(F.collect_list(result)).alias("results"))
    meta = F.struct(F.concat(F.lit("model-"), F.col("part").cast("string")).alias("model_name"))
    out = scratch_dir(spark, "runs")
    payload.select(meta.alias("run_metadata"), "results").write.json(out)
    rows, _ = readers.run_scan(spark.read.text(out).select(F.input_file_name().alias("file"), "value"))
    return rows.select("run", "pos", "benchmark_entry_id", "family", "raw_model_output", "response_time_seconds")


@query(
    "S05_config_scan",
    "select n_name as dataset, r_name as source_dataset, lower(n_name) as family, 'n' || n_nationkey as uid_prefix from nation join region on n_regionkey = r_regionkey",
)
def s5(spark, sf):
    """One registry object per region, keyed by nation."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.struct(
        F.col("r_name").alias("source_dataset"), F.lower("n_name").alias("family"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid_prefix")
    )
    configs = n.groupBy("r_name").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("n_name"), value)))).alias("value"))
    out = scratch_dir(spark, "registry")
    configs.select("value").write.text(out)
    return readers.registry_scan(spark.read.text(out).select(F.input_file_name().alias("file"), "value"))[0]


def spoiled(key: Column, value: Column, head: str, tail: str) -> Column:
    """Of four texts one is cut short and one wrapped, so that its top level is another."""
    return F.when(key % 4 == 1, F.expr("left(value, length(value) - 1)")).when(key % 4 == 2, F.concat(F.lit(head), value, F.lit(tail))).otherwise(value)


def outcome(scan: tuple[DataFrame, DataFrame]) -> DataFrame:
    """How many rows a scan accepted, and how many texts it refused for each reason."""
    rows, bad = scan
    refused = bad.groupBy("reason").agg(F.count("*").alias("n"))
    return rows.agg(F.count("*").alias("n")).select(F.lit("accepted").alias("reason"), "n").unionByName(refused)


def outcome_sql(accepted: str, refused: str, why: str) -> str:
    return f"select 'accepted' as reason, ({accepted}) as n union all select '{why}', ({refused})"


@query(
    "S01_notebook_refusals",
    f"with {CELLS_SQL} " + outcome_sql("select count(*) from cells where file % 4 in (0, 3)", "select count(distinct file) from cells where file % 4 in (1, 2)", readers.NOT_A_LIST),
)
def s1_refused(spark, sf):
    c = cells(spark, sf)
    cell = F.struct("pos", "kind", F.lit("x").alias("language"), "value")
    books = c.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(cell))).alias("value"))
    return outcome(readers.notebook_scan(books.select(F.col("file").cast("string").alias("file"), spoiled(F.col("file"), F.col("value"), '{"cells": ', "}").alias("value"))))


@query(
    "S02_canonical_refusals",
    outcome_sql("select count(*) from documents where (doc_id // 20) % 4 in (0, 3)", "select count(distinct doc_id // 20) from documents where (doc_id // 20) % 4 in (1, 2)", readers.NOT_A_LIST),
)
def s2_refused(spark, sf):
    rows = canonical_documents(spark, sf)
    part = F.floor(F.col("source_id") / 20).alias("part")
    lists = rows.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    return outcome(readers.canonical_scan(lists.select(F.col("part").cast("string").alias("file"), spoiled(F.col("part"), F.col("value"), '{"all": ', "}").alias("value"))))


@query(
    "S03_jsonl_refusals",
    outcome_sql("select count(*) from documents where doc_id % 4 in (0, 3)", "select count(*) from documents where doc_id % 4 in (1, 2)", readers.NOT_AN_OBJECT),
)
def s3_refused(spark, sf):
    rows = canonical_documents(spark, sf)
    lines_of = rows.select(F.col("uid").alias("file"), "source_id", F.to_json(F.struct(*rows.columns)).alias("value"))
    return outcome(readers.jsonl_scan(lines_of.select("file", spoiled(F.col("source_id"), F.col("value"), "[", "]").alias("value"))))


@query(
    "S04_run_refusals",
    """with p as (select doc_id // 20 as part, count(*) as n from documents group by 1)
       select 'accepted' as reason, sum(n)::bigint as n from p where part % 4 in (0, 3)
       union all select 'not a JSON list', count(*) from p where part % 4 = 1
       union all select 'no ''results'' list', count(*) from p where part % 4 = 2""",
)
def s4_refused(spark, sf):
    """Runs as objects and as plain lists, some cut short, some without results."""
    d = table(spark, sf, "documents").withColumn("part", F.floor(F.col("doc_id") / 20))
    result = F.struct(F.lit("ok").alias("status"), F.col("doc_id").cast("string").alias("benchmark_entry_id"), F.col("text").alias("raw_model_output"))
    runs = d.groupBy("part").agg(F.collect_list(result).alias("results"))
    whole = F.to_json(F.struct(F.struct(F.lit("m").alias("model_name")).alias("run_metadata"), "results"))
    k = F.col("part") % 4
    value = F.when(k == 0, whole).when(k == 1, F.substring_index(whole, "}", -1)).when(k == 2, F.lit('{"run_metadata": {}}')).otherwise(F.to_json("results"))
    return outcome(readers.run_scan(runs.select(F.col("part").cast("string").alias("file"), value.alias("value"))))


@query(
    "S05_config_refusals",
    outcome_sql("select count(*) from customer where c_custkey % 4 in (0, 3)", "select count(*) from customer where c_custkey % 4 in (1, 2)", readers.NOT_AN_OBJECT),
)
def s5_refused(spark, sf):
    value = F.struct(F.col("c_mktsegment").alias("source_dataset"), F.lit("f").alias("family"), F.lit("u").alias("uid_prefix"))
    configs = table(spark, sf, "customer").select("c_custkey", F.to_json(F.create_map(F.col("c_name"), value)).alias("value"))
    return outcome(readers.registry_scan(configs.select(F.col("c_custkey").cast("string").alias("file"), spoiled(F.col("c_custkey"), F.col("value"), "[", "]").alias("value"))))


@query(
    "S06_ntriples_scan",
    """select * from (select 'document/' || doc_id as s, 'text' as p, text as o, 'literal' as o_kind, null as dtype, lang from documents
       union all select 'customer/' || c_custkey, 'inNation', 'nation/' || c_nationkey, 'iri', null, null from customer
       union all select 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey, 'iri', null, null from supplier
       union all select 'customer/' || c_custkey, 'segment', c_mktsegment, 'literal', 'xsd:string', null from customer)""",
)
def s6(spark, sf):
    """Triples written as N-Triples lines and scanned again."""
    t = shop_graph(spark, sf).only(["text", "segment", "inNation"])
    body = F.col("o")
    for plain, escape in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(plain), F.lit(escape))
    suffix = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).otherwise(F.concat(F.lit("^^<"), "dtype", F.lit(">")))
    term = F.when(F.col("o_kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), body, F.lit('"'), suffix))
    out = scratch_dir(spark, "ntriples")
    t.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), term, F.lit(" .")).alias("value")).write.text(out)
    return readers.read_ntriples(spark, out)[0]


@query(
    "S07_melt",
    """select * from (select 'part/' || p_partkey as s, 'rdf:type' as p, 'Part' as o, 'iri' as o_kind, null as dtype from part
       union all select 'part/' || p_partkey, 'rdfs:label', p_name, 'literal', 'xsd:string' from part
       union all select 'part/' || p_partkey, 'brand', p_brand, 'literal', 'xsd:string' from part
       union all select 'part/' || p_partkey, 'kind', p_type, 'literal', 'xsd:string' from part
       union all select 'part/' || p_partkey, 'size', p_size::varchar, 'literal', 'xsd:integer' from part
       union all select 'part/' || p_partkey, 'price', p_retailprice::decimal(18,2)::varchar, 'literal', 'xsd:decimal' from part)""",
)
def s7(spark, sf):
    part = table(spark, sf, "part")
    literals = {"rdfs:label": F.col("p_name"), "brand": F.col("p_brand"), "kind": F.col("p_type"), "size": F.col("p_size"), "price": money("p_retailprice")}
    return readers.melt(part, iri("part", "p_partkey"), "Part", None, literals).all().drop("lang")


@query(
    "S07_melt_one_pass",
    "select 'document/' || doc_id as s, 'quality' as p, quality::varchar as o from labels union all select 'document/' || doc_id, 'toxic', toxic::varchar from labels",
)
def s7_once(spark, sf):
    return readers.melt_once(table(spark, sf, "labels"), iri("document", "doc_id"), {"quality": F.col("quality"), "toxic": F.col("toxic")})


@query(
    "S07_triple_store",
    "select 'part/' || p_partkey as s, p_brand as o from part",
)
def s7_store(spark, sf):
    """The whole graph written by predicate; the scan of one predicate reads one folder."""
    out = scratch_dir(spark, "triples")
    writers.write_triples(shop_graph(spark, sf).all(), out)
    return writers.read_triples(spark, out).filter(F.col("p") == "brand").select("s", "o")


@query("S08_jsonl_sink", "select key::bigint as key, value from (select doc_id as key, text as value from documents union all select conv_id, text from conversations)")
def s8(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    rows = rows.unionByName(table(spark, sf, "conversations").select(F.col("conv_id").alias("key"), F.col("text").alias("value")))
    out = scratch_dir(spark, "jsonl")
    writers.write_jsonl(rows, out)
    return spark.read.schema("key bigint, value string").json(out)


@query("S08_json_list_sink", CANONICAL_SQL)
def s8_lists(spark, sf):
    """Entries as JSON lists of 64, read back by the scan of lists."""
    out = scratch_dir(spark, "lists")
    writers.write_json_lists(canonical_documents(spark, sf), out, ["source_id"], 64)
    return readers.read_canonical_json(spark, f"{out}/*")[0]


SPLIT_SQL = """ranked as (select doc_id, source, row_number() over (order by md5('42:' || 'doc-' || doc_id)) as r, count(*) over () as n from documents),
    parts as (select *, case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'dev' else 'test' end as split from ranked)"""


@query("S09_split_sink", f"with {SPLIT_SQL} select 'doc-' || doc_id as uid, split from parts")
def s9(spark, sf):
    out = scratch_dir(spark, "splits")
    writers.write_splits(export.split_examples(canonical_documents(spark, sf)), out)
    return spark.read.schema("uid string, question string, split string").json(out).select("uid", "split")


@query("S09_no_split_sink", "select 'all' as split, count(*) as n from documents")
def s9_all(spark, sf):
    out = scratch_dir(spark, "all")
    writers.write_all(canonical_documents(spark, sf), out)
    return spark.read.schema("uid string, split string").json(out).groupBy("split").agg(F.count("uid").alias("n"))


@query(
    "S10_report_sink",
    f"with {SPLIT_SQL} select count(*) as total_examples, count_if(split = 'train')::bigint as train_examples, count_if(split = 'dev')::bigint as dev_examples, count_if(split = 'test')::bigint as test_examples from parts",
)
def s10(spark, sf):
    out = scratch_dir(spark, "report")
    writers.write_report(export.export_metadata(export.split_examples(canonical_documents(spark, sf))), out)
    schema = "total_examples bigint, train_examples bigint, dev_examples bigint, test_examples bigint"
    return spark.read.schema(schema).json(out)


# ----------------------------------------------- prompt versions from documents

PROMPT_FORMS = ["{{QUESTION}} | [Research Question] | {{QUESTION}}", "Ask: [Research Question]", "plain \n "]


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Every document is a version of its source's prompt."""
    d = table(spark, sf, "documents")
    k = F.col("doc_id") % 3
    form = F.when(k == 0, PROMPT_FORMS[0]).when(k == 1, PROMPT_FORMS[1]).otherwise(PROMPT_FORMS[2])
    return d.select(F.col("source").alias("base"), F.col("doc_id").alias("version"), F.concat("text", F.lit("\n"), form).alias("prompt_text"))


def family_profiles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Profiles of the sources seen, some disabled, some families left unmapped."""
    sources = table(spark, sf, "documents").select("source").distinct()
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    families = sources.filter(number % 5 != 4).select(F.col("source").alias("family"), F.concat(F.lit("p-"), "source").alias("profile"))
    profiles = sources.filter(number != 11).select(
        F.concat(F.lit("p-"), "source").alias("profile"),
        F.col("source").alias("family"),
        F.when(number == 10, F.lit("gone")).otherwise(F.col("source")).alias("output_base_name"),
        F.when(number % 5 == 3, False).when(number % 5 == 2, True).alias("enabled"),
    )
    return families, profiles


NUMBER = "try_cast(regexp_extract(source, '(\\d+)$', 1) as int)"
VERSIONS_SQL = f"""versions as (select source as base, doc_id as version, text || chr(10) || case doc_id % 3 when 0 then {sql_text(PROMPT_FORMS[0])}
    when 1 then {sql_text(PROMPT_FORMS[1])} else {sql_text(PROMPT_FORMS[2])} end as prompt_text from documents),
latest as (select base, max(version) as version, arg_max(prompt_text, version) as prompt_text from versions group by base),
families as (select source as family, 'p-' || source as profile from documents where {NUMBER} % 5 <> 4 group by source),
profiles as (select 'p-' || source as profile, case when {NUMBER} = 10 then 'gone' else source end as output_base_name,
    case when {NUMBER} % 5 = 3 then false when {NUMBER} % 5 = 2 then true end as enabled from documents where {NUMBER} <> 11 group by source),
prompt_table as (select f.family, f.profile, prompt_text as template_text, case when output_base_name is null then 'Profile ''' || f.profile || ''' does not exist in prompt_profiles.json.'
    when enabled = false then 'Profile ''' || f.profile || ''' is disabled.' when prompt_text is null then 'Rendered prompt file not found for family ''' || f.family || ''' (profile ''' || f.profile || ''')' end as profile_error
    from families f left join profiles p using (profile) left join latest on base = output_base_name)"""


@query("S11_latest_prompt_per_family", f"with {VERSIONS_SQL} select * from prompt_table")
def s11(spark, sf):
    families, profiles = family_profiles(spark, sf)
    return prompts.prompt_table(profiles, families, versions(spark, sf))


# ------------------------------------------------------- C1-C9: canonicalisation


@query("C01_pair_cells", f"with {CELLS_SQL} select * from pairs")
def c1(spark, sf):
    return canonical.pair_cells(cells(spark, sf))


BOTH = "(regexp_matches(value, '\\bEN:') and regexp_matches(value, '\\bDE:'))"
EN = f"regexp_extract(value, {sql_text(canonical.ENGLISH)}, 1)"
DE = f"regexp_extract(value, {sql_text(canonical.GERMAN)}, 1)"
ENGLISH_SQL = strip(f"case when {BOTH} and {EN} = '' then {DE} when {BOTH} then {EN} else {gsub('value', canonical.MARKER)} end")


@query("C02_english_text", f"with {CELLS_SQL} select file, pos, {ENGLISH_SQL} as text, {BOTH} and {EN} = '' as fallback from cells")
def c2(spark, sf):
    return cells(spark, sf).select("file", "pos", canonical.english(F.col("value")).alias("q")).select("file", "pos", "q.text", "q.fallback")


ORDINAL = rf"^[{WS}]*([0-9]+)\)[{WS}]*"


@query(
    "C03_ordinal",
    f"""with {CELLS_SQL}, numbered as (select file, pos, case when file % 3 = 0 then '99999999' || value else value end as value from cells)
        select file, pos, try_cast(nullif(regexp_extract(value, {sql_text(ORDINAL)}, 1), '') as int) as source_id, regexp_replace(value, {sql_text(ORDINAL)}, '') as rest from numbered""",
)
def c3(spark, sf):
    """Some ordinals fit no integer."""
    v = F.when(F.col("file") % 3 == 0, F.concat(F.lit("99999999"), "value")).otherwise(F.col("value"))
    return cells(spark, sf).select("file", "pos", canonical.ordinal(v).alias("source_id"), canonical.drop_ordinal(v).alias("rest"))


def after_prefixes(e: str) -> str:
    """In SQL: the lines from the first that is neither blank nor a PREFIX."""
    split = f"string_split({lines(e)}, chr(10))"
    keep = f"list_transform({split}, lambda l: not regexp_matches(l, {sql_text(rf'(?i)^[{BLANK}]*(PREFIX[{WS}]|$)')}) and not regexp_matches(l, {sql_text(rf'(?i)^[{BLANK}]*PREFIX$')}))"
    at = f"list_position({keep}, true)"
    return strip(f"case when {at} > 0 then array_to_string(list_slice({split}, {at}, len({split})), chr(10)) else '' end")


def no_comments(e: str) -> str:
    return f"array_to_string(list_filter(string_split({lines(e)}, chr(10)), lambda l: not starts_with({strip('l')}, '#')), chr(10))"


@query("C04_drop_leading_prefixes", f"with {CELLS_SQL} select file, pos, {after_prefixes('value')} as query from cells")
def c4(spark, sf):
    return cells(spark, sf).select("file", "pos", canonical.drop_leading_prefixes(F.col("value")).alias("query"))


@query("C05_drop_comment_lines", f"with {CELLS_SQL} select file, pos, rtrim({no_comments('value')}, chr(10)) as query from cells")
def c5(spark, sf):
    # a comment on the last line leaves the newline before it; ends are not part of the rule
    return cells(spark, sf).select("file", "pos", F.rtrim(canonical.drop_comment_lines(F.col("value")), F.lit("\n")).alias("query"))


@query("C06_uid", "select c_custkey, lower(c_mktsegment) || '-' || case when c_custkey < 10000 then lpad(c_custkey::varchar, 4, '0') else c_custkey::varchar end as uid from customer")
def c6(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", canonical.make_uid(F.lower("c_mktsegment"), F.col("c_custkey")).alias("uid"))


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """A registry with every dataset but one."""
    names = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("dataset")).distinct().filter("dataset != 'MACHINERY'")
    return names.select("dataset", F.concat(F.lit("set-"), "dataset").alias("source_dataset"), F.lower("dataset").alias("family"), F.lower("dataset").alias("uid_prefix"))


@query(
    "C07_attach_registry",
    """select c_custkey, c_mktsegment as dataset, case when c_mktsegment <> 'MACHINERY' then 'set-' || c_mktsegment end as source_dataset,
       case when c_mktsegment <> 'MACHINERY' then lower(c_mktsegment) end as family, case when c_mktsegment <> 'MACHINERY' then lower(c_mktsegment) end as uid_prefix from customer""",
)
def c7(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("dataset"))
    return canonical.attach_registry(rows, registry(spark, sf)).select("c_custkey", "dataset", "source_dataset", "family", "uid_prefix")


@query(
    "C07_salted_registry",
    """with rows as (select c_custkey, case when c_custkey % 10 > 0 then 'BUILDING' else c_mktsegment end as dataset from customer)
       select c_custkey, dataset, c_custkey % 3 as extra, case when dataset <> 'MACHINERY' then 'set-' || dataset end as source_dataset from rows""",
)
def c7_salted(spark, sf):
    """The join of a registry that may be large, with a key that nine rows of ten share and a map column."""
    dataset = F.when(F.col("c_custkey") % 10 > 0, "BUILDING").otherwise(F.col("c_mktsegment"))
    extra = F.create_map(F.lit("third"), F.col("c_custkey") % 3).alias("extra")
    rows = table(spark, sf, "customer").select("c_custkey", dataset.alias("dataset"), extra)
    found = salted_join(rows, registry(spark, sf), ["dataset"])
    return found.select("c_custkey", "dataset", F.col("extra")["third"].alias("extra"), "source_dataset")


@query(
    "C07_canonicalise",
    f"""with {CELLS_SQL}, q as (select *, regexp_replace(question_text, {sql_text(ORDINAL)}, '') as value, try_cast(nullif(regexp_extract(question_text, {sql_text(ORDINAL)}, 1), '') as int) as n,
        case when file % 2 = 0 then 'even' else 'odd' end as family from pairs)
        select family || '-' || lpad(coalesce(n, floor(pos / 2)::int + 1)::varchar, 4, '0') as uid, 'set-' || family as source_dataset, coalesce(n, floor(pos / 2)::int + 1) as source_id, family,
        {ENGLISH_SQL} as question, {after_prefixes(no_comments('query_text'))} as gold_query, {BOTH} and {EN} = '' as question_fallback, null as contribution_class from q""",
)
def c7_all(spark, sf):
    c = cells(spark, sf).withColumn("dataset", F.when(F.col("file") % 2 == 0, "even").otherwise("odd"))
    reg = c.select("dataset").distinct().select("dataset", F.concat(F.lit("set-"), "dataset").alias("source_dataset"), F.col("dataset").alias("family"), F.col("dataset").alias("uid_prefix"))
    return canonical.canonicalise(c, reg)


@query(
    "C08_merge",
    """select 'doc-' || doc_id as uid, text as question, lang as family from documents union all select 'item-' || item_id, text, null from benchmark""",
)
def c8(spark, sf):
    first = canonical_documents(spark, sf).select("uid", "question", "family")
    second = table(spark, sf, "benchmark").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("uid"), F.col("text").alias("question"))
    return canonical.merge(first, second)


FAULTY_SQL = """faulty as (select 'doc-' || (doc_id - doc_id % 7 // 6) as uid, case when doc_id % 10 = 0 then ' ' else lang end as family, text as question,
    case when doc_id % 9 = 0 then null else 'ASK {}' end as gold_query from documents)"""
FINDINGS_SQL = f"""{FAULTY_SQL}, findings as (select 'error' as severity, 'missing_family' as rule, uid, 1 as n from faulty where trim(family) = ''
    union all select 'error', 'missing_gold_query', uid, 1 from faulty where gold_query is null
    union all select 'error', 'missing_question', uid, 1 from faulty where length({strip('question')}) = 0
    union all select 'warning', 'duplicate_uid', uid, count(*) from faulty group by uid having count(*) > 1
    union all select 'warning', 'duplicate_question', min(uid), count(*) from faulty where length({strip('question')}) > 0 group by question having count(*) > 1)"""


def faulty(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as entries with missing fields and repeated uids; questions repeat by themselves."""
    k = F.col("doc_id")
    return table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), (k - F.floor((k % 7) / 6)).cast("string")).alias("uid"),
        F.when(k % 10 == 0, " ").otherwise(F.col("lang")).alias("family"),
        F.col("text").alias("question"),
        F.when(k % 9 != 0, "ASK {}").alias("gold_query"),
    )


@query("C09_findings", f"with {FINDINGS_SQL} select * from findings")
def c9(spark, sf):
    return canonical.canonical_findings(faulty(spark, sf))


@query(
    "C09_report",
    f"""with {FINDINGS_SQL} select (select count(*) from faulty) as total_entries, count_if(severity = 'error')::bigint as error_count,
        count_if(severity = 'warning')::bigint as warning_count, count_if(severity = 'error') = 0 as validation_passed from findings""",
)
def c9_report(spark, sf):
    return canonical.canonical_report(faulty(spark, sf))


# ----------------------------------------------------- P1-P7: templates, versions


# Lines that tie on these columns make the same template.
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")


def line_templates(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as templates: an order is a mapping, a line a template.

    Line numbers repeat within an order, so lines are numbered anew over all
    their columns; an order has few lines.  Each line offers three properties
    whose classes point at other lines, so that paths repeat, classes collide
    and nesting reaches the third level.
    """
    place = Window.partitionBy("mapping").orderBy(*LINE_ORDER)
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "mapping").select(
        "mapping", F.row_number().over(place).alias("tpos"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_returnflag").alias("flag"),
    )
    text = lambda e: e.cast("string")
    named = lambda head, e: F.concat(F.lit(head), text(e))
    ref = lambda i, label: F.struct(i.alias("id"), label.alias("label"))
    part, supp, none = F.col("part"), F.col("supp"), F.lit(None).cast("string")

    def prop(path, label, description, max_count, cls, class_label):
        return F.struct(
            label.alias("label"), description.alias("description"), max_count.cast("int").alias("max_count"),
            ref(path, F.concat(F.lit("path "), path)).alias("path"), ref(cls, class_label).alias("class"),
        )

    properties = F.array(
        prop(
            named("P", part % 5), named("label ", part), F.when(part % 2 == 0, "").otherwise(named("part ", part)),
            part % 3, named("C", part % 4), F.when(part % 3 != 0, named("class ", part % 4)),
        ),
        prop(named("P", supp % 5), F.when(supp % 2 == 0, ""), none, F.when(supp % 2 == 0, 1), F.when(supp % 3 != 0, named("C", supp % 4)), none),
        prop(F.when(F.col("flag") != "N", named("F", F.col("flag"))), F.col("flag"), F.lit("flag"), F.lit(1), none, none),
    )
    return rows.select(
        "mapping",
        "tpos",
        named("R", F.col("tpos")).alias("id"),
        named("line ", F.col("tpos")).alias("label"),
        ref(named("C", supp % 4), none).alias("target_class"),
        properties.alias("properties"),
    )


PROPERTIES_SQL = f"""lines as (select l_orderkey as mapping, row_number() over (partition by l_orderkey order by {', '.join(LINE_ORDER)})::int as tpos,
    l_partkey as part, l_suppkey as supp, l_returnflag as flag from lineitem),
props as (select mapping, tpos, 0 as ppos, 'P' || (part % 5) as path_id, 'label ' || part as label, case when part % 2 = 0 then '' else 'part ' || part end as description,
        (part % 3)::int as max_count, 'C' || (part % 4) as class_id, case when part % 3 <> 0 then 'class ' || (part % 4) end as class_label, 'C' || (supp % 4) as target from lines
    union all select mapping, tpos, 1, 'P' || (supp % 5), case when supp % 2 = 0 then '' end, null, case when supp % 2 = 0 then 1 end, case when supp % 3 <> 0 then 'C' || (supp % 4) end, null, 'C' || (supp % 4) from lines
    union all select mapping, tpos, 2, case when flag <> 'N' then 'F' || flag end, flag, 'flag', 1, null, null, 'C' || (supp % 4) from lines),
shown as (select *, coalesce(class_label, 'path ' || path_id) as slabel, case when max_count is null or max_count > 1 then 'one to many' else 'one to one' end as card,
    coalesce(nullif(description, ''), nullif(label, ''), 'path ' || path_id) as sdesc from props where path_id is not null),
in_t as (select *, first_value(ppos) over (partition by mapping, tpos, path_id order by ppos) as firstpos from shown
    qualify row_number() over (partition by mapping, tpos, path_id order by ppos desc) = 1),
classes as (select mapping, target, tpos from props qualify row_number() over (partition by mapping, target order by tpos desc) = 1),
top as (select *, first_value(tpos) over w as t, first_value(firstpos) over w as p1, row_number() over (partition by mapping, path_id order by tpos desc, ppos desc) as rn from in_t
    window w as (partition by mapping, path_id order by tpos, firstpos)),
l1 as (select top.* exclude (target), c.tpos as sub from top left join classes c on c.mapping = top.mapping and c.target = top.class_id where rn = 1),
l2 as (select l1.mapping, l1.path_id as path1, l1.t, l1.p1, x.path_id as path2, x.firstpos as p2, x.slabel, x.card, x.sdesc, x.class_label, x.class_id, c.tpos as sub
    from l1 join in_t x on x.mapping = l1.mapping and x.tpos = l1.sub left join classes c on c.mapping = x.mapping and c.target = x.class_id),
l3 as (select l2.mapping, path1, path2, t, p1, p2, x.path_id as path3, x.firstpos as p3, x.slabel, x.card, x.sdesc, x.class_label from l2 join in_t x on x.mapping = l2.mapping and x.tpos = l2.sub),
mapped as (select mapping, 1 as level, path_id as path1, null as path2, null as path3, slabel as label, card as cardinality, sdesc as description, 'path ' || path_id as predicate_label, class_label,
        case when sub is not null then class_id end as class_id, 'R' || sub as subtemplate_id, 'line ' || sub as subtemplate_label, t, p1, -1 as p2, -1 as p3 from l1
    union all select mapping, 2, path1, path2, null, slabel, card, sdesc, 'path ' || path2, class_label, case when sub is not null then class_id end, 'R' || sub, 'line ' || sub, t, p1, p2, -1 from l2
    union all select mapping, 3, path1, path2, path3, slabel, card, sdesc, 'path ' || path3, class_label, null, null, null, t, p1, p2, p3 from l3)"""


@query("P01_template_mapping", f"with {PROPERTIES_SQL} select * exclude (t, p1, p2, p3), t || '.' || p1 || '.' || p2 || '.' || p3 as place from mapped")
def p1(spark, sf):
    rows = templates.template_mapping(line_templates(spark, sf))
    place = F.concat_ws(".", *[F.col(f"pos.{c}").cast("string") for c in ("t", "p1", "p2", "p3")])
    return rows.withColumn("place", place).drop("pos")


@query("P02_cardinality", "select p_partkey, case when p_size % 3 = 0 or p_size % 3 > 1 then 'one to many' else 'one to one' end as cardinality from part")
def p2(spark, sf):
    size = F.col("p_size") % 3
    return table(spark, sf, "part").select("p_partkey", templates.cardinality(F.when(size != 0, size)).alias("cardinality"))


@query(
    "P03_fallback_texts",
    """select p_partkey, coalesce(case when p_size % 3 = 0 then '' when p_size % 3 = 1 then p_type end, p_name) as label,
       case when p_size % 5 > 1 then p_brand when p_size % 2 = 1 then p_type else p_name end as description from part""",
)
def p3(spark, sf):
    k = F.col("p_size")
    cls = F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("p_type"))
    described = F.when(k % 5 > 1, F.col("p_brand")).when(k % 5 == 1, "")
    own = F.when(k % 2 == 1, F.col("p_type")).otherwise("")
    return table(spark, sf, "part").select(
        "p_partkey",
        templates.shown_label(cls, F.col("p_name")).alias("label"),
        templates.shown_description(described, own, F.col("p_name")).alias("description"),
    )


def rendered(usage: str) -> str:
    """Mapping rows with their schema and outline lines, in SQL."""
    return f"""{usage}, lined as (select *, coalesce(path3, path2, path1) as own,
        case level when 1 then '?variable orkgp:' || path1 || ' ?target' when 2 then '?contribution orkgp:' || path1 || ' ?subtemplate . ?subtemplate orkgp:' || path2 || ' ?subtarget'
        else '?contribution orkgp:' || path1 || ' ?subtemplate . ?subtemplate orkgp:' || path2 || ' ?nestedtemplate . ?nestedtemplate orkgp:' || path3 || ' ?nestedtarget' end as use,
        row_number() over (partition by mapping order by t, p1, p2, p3) as place from mapped),
    drawn as (select *, '| ' || case level when 1 then '' when 2 then '└─ ' else '&nbsp;&nbsp;&nbsp;&nbsp;└─ ' end || label || ' | `orkgp:' || own || '` | '
            || case cardinality when 'one to many' then 'Predicate (multiple)' else 'Predicate' end || ' | ' || description || '. Usage: `' || use || '` |' || chr(10) as row_line,
        case when level = 1 and place > 1 then chr(10) else '' end || case level when 1 then '' when 2 then '  └─ ' else '    └─ ' end || '**' || label || '** (`orkgp:' || own || '`)' || chr(10) as out_line from lined),
    sections as (select mapping, {sql_text(texts.SCHEMA_HEAD)} || string_agg(row_line, '' order by place) as schema_section,
        {sql_text(texts.OUTLINE_HEAD)} || string_agg(out_line, '' order by place) || chr(10) || {sql_text(texts.OUTLINE_FOOT)} as hierarchy_section from drawn group by mapping)"""


@query("P04_schema_section", f"with {rendered(PROPERTIES_SQL)} select mapping, schema_section from sections")
def p4(spark, sf):
    return templates.schema_section(templates.template_mapping(line_templates(spark, sf)))


@query("P05_hierarchy_section", f"with {rendered(PROPERTIES_SQL)} select mapping, hierarchy_section from sections")
def p5(spark, sf):
    return templates.hierarchy_section(templates.template_mapping(line_templates(spark, sf), columns=templates.OUTLINED))


@query(
    "P04_P05_section_segments",
    f"""with {rendered(PROPERTIES_SQL)}, told as (select mapping, place - 1 as r, 'schema' as section, case when place = 1 then {sql_text(texts.SCHEMA_HEAD)} else '' end || row_line as line from drawn
      union all select mapping, place - 1, 'hierarchy', case when place = 1 then {sql_text(texts.OUTLINE_HEAD)} else '' end || out_line ||
        case when place = max(place) over (partition by mapping) then chr(10) || {sql_text(texts.OUTLINE_FOOT)} else '' end from drawn),
    made as (select mapping, section, (r // 8)::bigint as segment, string_agg(line, '' order by r) as text from told group by mapping, section, r // 8)
    select mapping, section, segment, coalesce(sum(length(text)) over (partition by mapping, section order by segment rows between unbounded preceding and 1 preceding), 0)::bigint as offset, text from made""",
)
def p4_segments(spark, sf):
    """Both sections in segments of eight rows."""
    return templates.section_segments(templates.template_mapping(line_templates(spark, sf)), 8)


GUIDANCE_SQL = "guidance as (select * from (values " + ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in texts.GUIDANCE) + ") as g(template_id, glabel, a, b, c, d, e))"


def filled(text: str) -> str:
    return f"replace(replace(replace({sql_text(text)}, '<<LABEL>>', name), '<<TEMPLATE>>', template_id), '<<CLASS>>', cls)"


@query(
    "P06_prompt_text",
    f"""with {rendered(PROPERTIES_SQL)}, {GUIDANCE_SQL},
        profiled as (select mapping, case mapping % 3 when 0 then 'R186491' when 1 then 'R1544125' else 'R1' end as template_id, case when mapping % 2 = 0 then 'Order ' || mapping end as label,
            case when mapping % 5 = 0 then 'C9' else '' end as target from sections),
        known as (select s.*, p.template_id, g.glabel, a, b, c, d, e, coalesce(nullif(label, ''), glabel, p.template_id) as name, coalesce(nullif(target, ''), 'C27001') as cls
            from sections s join profiled p using (mapping) left join guidance g on g.template_id = p.template_id)
        select mapping, template_id, {filled(texts.BASE)} || schema_section || hierarchy_section ||
            case when glabel is not null then {sql_text(texts.GUIDANCE_HEAD)} || a || case when b <> '' then chr(10) || chr(10) || b else '' end || chr(10) || chr(10) || c || chr(10) || chr(10) || d || chr(10) || chr(10) || e else '' end
            || {filled(texts.RULES)} as prompt_text from known""",
)
def p6(spark, sf):
    rows = templates.template_mapping(line_templates(spark, sf))
    m = F.col("mapping")
    profiles = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("mapping")).distinct().select(
        "mapping",
        F.when(m % 3 == 0, "R186491").when(m % 3 == 1, "R1544125").otherwise("R1").alias("template_id"),
        F.when(m % 2 == 0, F.concat(F.lit("Order "), m.cast("string"))).alias("template_label"),
        F.when(m % 5 == 0, "C9").otherwise("").alias("target_class_id"),
    )
    return templates.assemble_prompts(rows, profiles, spark.createDataFrame(texts.GUIDANCE, texts.GUIDANCE_SCHEMA))


@query(
    "P07_next_version",
    """select p_brand as base, (coalesce(max(case when p_size % 4 < 2 then case when p_partkey % 7 = 0 then 99999999999 else p_size end end), 0) + 1)::decimal(38,0) as next_version from part group by p_brand""",
)
def p7(spark, sf):
    part = table(spark, sf, "part")
    end = F.when(F.col("p_size") % 4 == 0, ".json").when(F.col("p_size") % 4 == 1, ".txt").otherwise("_latest.md")
    number = F.when(F.col("p_partkey") % 7 == 0, "99999999999").otherwise(F.col("p_size").cast("string"))  # some need more than 32 bits
    names = part.select(F.concat("p_brand", F.lit("_v"), number, end).alias("name"))
    return templates.next_versions(part.select(F.col("p_brand").alias("base")), names)


@query("P07_latest_version", f"with {VERSIONS_SQL} select base, version, prompt_text from latest")
def p7_latest(spark, sf):
    return templates.latest_prompts(versions(spark, sf))


# ------------------------------------------------------------- P8-P11: prompts


@query("P08_resolve_profile", f"select doc_id, source as family, case when {NUMBER} % 5 <> 4 then 'p-' || source end as profile from documents")
def p8(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("family"))
    return prompts.resolve_profiles(rows, family_profiles(spark, sf)[0]).select("doc_id", "family", "profile")


@query("P08_unknown_families", f"select source as family, count(*) as entries from documents where {NUMBER} % 5 = 4 group by source")
def p8_unknown(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.col("source").alias("family"))
    return prompts.unknown_families(rows, family_profiles(spark, sf)[0])


@query("P09_enabled_profiles", f"with {VERSIONS_SQL} select profile, output_base_name from profiles where enabled is distinct from false")
def p9(spark, sf):
    return prompts.enabled_profiles(family_profiles(spark, sf)[1]).select("profile", "output_base_name")


def injected(prompt: str, question: str) -> str:
    asked = strip(question)
    return f"""case when contains({prompt}, '{{{{QUESTION}}}}') then replace({prompt}, '{{{{QUESTION}}}}', {asked})
        when contains({prompt}, '[Research Question]') then replace({prompt}, '[Research Question]', {asked})
        else rtrim({prompt}, {TRIM}) || chr(10) || chr(10) || '## Input' || chr(10) || '**Research Question:** ' || {asked} || chr(10) end"""


@query("P10_inject_question", f"with {VERSIONS_SQL} select version, {injected('prompt_text', chr(39) + '  Which ' + chr(39) + ' || base || chr(10)')} as prompt from versions")
def p10(spark, sf):
    question = F.concat(F.lit("  Which "), "base", F.lit("\n"))
    return versions(spark, sf).select("version", prompts.inject_question(F.col("prompt_text"), question).alias("prompt"))


@query(
    "P11_build_prompts",
    f"""with {VERSIONS_SQL}, e as (select doc_id, case when doc_id % 50 = 0 then '' else source end as family, case when doc_id % 40 = 1 then ' ' else ' ' || text end as question from documents),
        j as (select e.*, t.family as known, template_text, profile_error from e left join prompt_table t on t.family = e.family),
        r as (select *, case when family = '' then 'Entry is missing a valid ''family'' field.' when trim(question) = '' then 'Entry is missing a valid ''question'' field.'
            when known is null then 'No prompt profile mapping found for family ''' || family || '''.' else profile_error end as prompt_error from j)
        select doc_id, family, question, prompt_error, case when prompt_error is null then {injected('template_text', 'question')} end as prompt from r""",
)
def p11(spark, sf):
    families, profiles = family_profiles(spark, sf)
    k = F.col("doc_id")
    entries = table(spark, sf, "documents").select(
        "doc_id",
        F.when(k % 50 == 0, "").otherwise(F.col("source")).alias("family"),
        F.when(k % 40 == 1, " ").otherwise(F.concat(F.lit(" "), "text")).alias("question"),
    )
    built = prompts.build_prompts(entries, prompts.prompt_table(profiles, families, versions(spark, sf)))
    return built.select("doc_id", "family", "question", "prompt_error", "prompt")


# --------------------------------------------------------------- E1-E7: export


@query(
    "E01_violations",
    f"""with {FAULTY_SQL}, p as (select *, case when trim(family) = '' then 'family' when length({strip('question')}) = 0 then 'question' when gold_query is null then 'gold_query' end as bad,
        try_cast(split_part(uid, '-', 2) as bigint) as pos from faulty) select uid, pos, 'Entry ' || pos || ' has no valid ''' || bad || '''.' as violation from p where bad is not null""",
)
def e1(spark, sf):
    rows = faulty(spark, sf).withColumn("pos", F.substring_index("uid", "-", -1).cast("bigint"))
    return export.violations(rows).select("uid", "pos", "violation")


def prompted(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical rows of the conversations with a prompt of their own."""
    pairs = canonical.pair_cells(cells(spark, sf))
    uid = F.concat_ws("-", F.lit("c"), F.col("file").cast("string"), F.col("pos").cast("string"))
    return pairs.select(
        uid.alias("uid"),
        F.when(F.col("file") % 2 == 0, F.concat(F.lit("b-"), uid)).alias("benchmark_entry_id"),
        F.col("file").alias("source_id"),
        F.lit("conversations").alias("source_dataset"),
        F.lit("chat").alias("family"),
        F.col("question_text").alias("question"),
        F.concat(F.lit("Q: "), "question_text").alias("prompt"),
        F.col("query_text").alias("gold_query"),
    )


EXAMPLES_SQL = f"""{CELLS_SQL}, ex as (select 'c-' || file || '-' || pos as uid, case when file % 2 = 0 then 'b-c-' || file || '-' || pos else 'c-' || file || '-' || pos end as benchmark_entry_id,
    file as source_id, 'conversations' as source_dataset, 'chat' as family, question_text as question, 'Q: ' || question_text as prompt, {strip('query_text')} as completion from pairs)"""


@query("E02_prompt_completion", f"with {EXAMPLES_SQL} select * from ex")
def e2(spark, sf):
    return export.build_examples(prompted(spark, sf))


@query(
    "E03_messages",
    f"""with {EXAMPLES_SQL} select uid, benchmark_entry_id, source_id, source_dataset, family, question, 0 as turn, 'user' as role, prompt as content from ex
        union all select uid, benchmark_entry_id, source_id, source_dataset, family, question, 1, 'assistant', completion from ex""",
)
def e3(spark, sf):
    rows = export.build_examples(prompted(spark, sf), "messages")
    return rows.select(*[c for c in rows.columns if c != "messages"], F.posexplode("messages").alias("turn", "m")).select(
        "uid", "benchmark_entry_id", "source_id", "source_dataset", "family", "question", "turn", "m.role", "m.content"
    )


@query("E04_exact_split", f"with {SPLIT_SQL} select 'doc-' || doc_id as uid, source, split from parts")
def e4(spark, sf):
    rows = canonical_documents(spark, sf).withColumn("source", F.col("source_dataset"))
    return export.split_examples(rows).select("uid", "source", "split")


@query(
    "E05_split_counts",
    f"""with {SPLIT_SQL} select count(*) as total_examples, count_if(split = 'train')::bigint as train_examples, count_if(split = 'dev')::bigint as dev_examples, count_if(split = 'test')::bigint as test_examples,
        'prompt_completion' as export_format, true as split_enabled, 42 as seed, 0.8::double as train_ratio, 0.1::double as dev_ratio, 0.1::double as test_ratio from parts""",
)
def e5(spark, sf):
    return export.export_metadata(export.split_examples(canonical_documents(spark, sf)))


def exportable(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as entries; a source is a family."""
    return canonical_documents(spark, sf).withColumn("family", F.col("source_dataset")).withColumn("pos", F.col("source_id"))


def every_profile(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A profile with a prompt for each family."""
    sources = table(spark, sf, "documents").select(F.col("source").alias("family")).distinct()
    families = sources.select("family", F.concat(F.lit("p-"), "family").alias("profile"))
    return families, families.select("profile", "family", F.col("family").alias("output_base_name"), F.lit(True).alias("enabled"))


def exported(spark: SparkSession, sf: str, export_format: str, split: bool) -> tuple[DataFrame, str]:
    families, profiles = every_profile(spark, sf)
    found, out = prompts.prompt_table(profiles, families, versions(spark, sf)), scratch_dir(spark, "export")
    return export.export_dataset(exportable(spark, sf), found, out, scratch_dir(spark, "examples"), export_format, split), out


EXPORT_SQL = f"""{VERSIONS_SQL}, chosen as (select doc_id, 'doc-' || doc_id as uid, {injected('prompt_text', 'text')} as prompt, 'ASK {{ ?x ?y "' || lang || '" }}' as completion
    from documents join latest on base = source),
numbered as (select *, row_number() over (order by md5('42:' || uid)) as r, count(*) over () as n from chosen),
exported as (select *, case when r <= floor(n * 0.8::double) then 'train' when r <= floor(n * 0.8::double) + floor(n * 0.1::double) then 'dev' else 'test' end as split from numbered)"""


@query("E08_export", f"with {EXPORT_SQL} select uid, prompt, completion, split from exported")
def e8(spark, sf):
    """Entries to files as one run, read back."""
    _, out = exported(spark, sf, "prompt_completion", True)
    return spark.read.schema("uid string, prompt string, completion string, split string").json(f"{out}/examples")


@query(
    "E08_export_messages",
    f"with {EXPORT_SQL} select uid, split, 0 as turn, 'user' as role, prompt as content from exported union all select uid, split, 1, 'assistant', completion from exported",
)
def e8_messages(spark, sf):
    _, out = exported(spark, sf, "messages", True)
    rows = spark.read.schema("uid string, messages array<struct<role: string, content: string>>, split string").json(f"{out}/examples")
    return rows.select("uid", "split", F.posexplode("messages").alias("turn", "m")).select("uid", "split", "turn", "m.role", "m.content")


@query(
    "E05_training_metadata",
    f"""with {SPLIT_SQL} select 'model-a' as model_id, 'exports/one' as dataset_dir, count_if(split = 'train')::bigint as train_examples,
        count_if(split = 'dev')::bigint as dev_examples, map {{'epochs': '3', 'rate': '0.0002', 'name': 'a'}} as training_config from parts""",
)
def e5_training(spark, sf):
    rows = export.split_examples(canonical_documents(spark, sf))
    return export.training_metadata(rows, "model-a", "exports/one", {"epochs": 3, "rate": 0.0002, "name": "a"})


@query(
    "S11_rendered_path",
    f"""with {VERSIONS_SQL}, r as (select source as family, 'made/' || source || '.txt' as path, max(text) as text from documents group by source)
    select family, case when {NUMBER.replace('source', 'family')} % 2 = 0 then r.text else latest.prompt_text end as template_text, null::varchar as profile_error
    from r join latest on base = family""",
)
def s11_rendered(spark, sf):
    """Families of even number name their prompt's path, which goes before the base name."""
    families, profiles = every_profile(spark, sf)
    even = F.regexp_extract("family", r"(\d+)$", 1).try_cast("int") % 2 == 0
    path = lambda c: F.concat(F.lit("made/"), c, F.lit(".txt"))
    profiles = profiles.withColumn("latest_rendered_path", F.when(even, path(F.col("family"))).otherwise(" "))
    rendered = table(spark, sf, "documents").groupBy(path(F.col("source")).alias("path")).agg(F.max("text").alias("prompt_text"))
    return prompts.prompt_table(profiles, families, versions(spark, sf), rendered).drop("profile")


@query(
    "E08_export_no_split",
    f"with {EXPORT_SQL} select count(*) as total_examples, count(*) as all_examples, 'prompt_completion' as export_format, false as split_enabled, 42 as seed, count(*) as written from exported",
)
def e8_all(spark, sf):
    """The metadata of a run without a split, with the number of rows it wrote."""
    _, out = exported(spark, sf, "prompt_completion", False)
    report = spark.read.json(f"{out}/metadata").withColumn("seed", F.col("seed").cast("int"))
    rows = spark.read.schema("uid string, split string").json(f"{out}/examples").filter("split = 'all'")
    written = rows.agg(F.count("uid").alias("total_examples"))
    return report.join(written.withColumn("written", F.col("total_examples")), "total_examples")


@query(
    "E08_export_metadata",
    f"""with {EXPORT_SQL} select count(*) as total_examples, count_if(split = 'train')::bigint as train_examples, count_if(split = 'dev')::bigint as dev_examples, count_if(split = 'test')::bigint as test_examples,
        'messages' as export_format, true as split_enabled, 42 as seed, 0.8::double as train_ratio, 0.1::double as dev_ratio, 0.1::double as test_ratio from exported""",
)
def e8_metadata(spark, sf):
    return exported(spark, sf, "messages", True)[0]


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Word lengths as token ids: the first two hundred and the rest of a text."""
    words = F.transform(F.split("text", " "), lambda w: F.length(w))
    rows = table(spark, sf, "documents").select("doc_id", words.alias("ids"), F.length("source").alias("cut"))
    return rows.select(
        "doc_id",
        F.slice("ids", F.lit(1), F.col("cut")).alias("prompt_ids"),
        F.slice("ids", F.col("cut") + 1, F.greatest(F.size("ids") - F.col("cut"), F.lit(0))).alias("completion_ids"),
    )


TOKENS_SQL = """w as (select doc_id, list_transform(string_split(text, ' '), lambda x: length(x)) as ids, length(source) as cut from documents),
t as (select doc_id, list_slice(list_append(ids, 2), 1, 512) as input_ids,
    list_slice(list_concat(list_transform(range(least(cut, len(ids))), lambda i: -100), list_slice(ids, cut + 1, len(ids)), [2]), 1, 512) as labels from w)"""


def joined(*names: str) -> list:
    return [F.array_join(F.col(n).cast("array<string>"), ",").alias(n) for n in names]


@query(
    "E06_token_examples",
    f"with {TOKENS_SQL} select doc_id, array_to_string(input_ids, ',') as input_ids, repeat('1,', len(input_ids) - 1) || '1' as attention_mask, array_to_string(labels, ',') as labels from t",
)
def e6(spark, sf):
    rows = token_rows(spark, sf).select("doc_id", *export.token_example("prompt_ids", "completion_ids", 2, 512))
    return rows.select("doc_id", *joined("input_ids", "attention_mask", "labels"))


@query(
    "E07_pad_batches",
    f"""with {TOKENS_SQL}, b as (select *, doc_id // 8 as batch, max(len(input_ids)) over (partition by doc_id // 8) - len(input_ids) as short from t)
        select doc_id, batch, array_to_string(list_concat(input_ids, list_transform(range(short), lambda i: 0)), ',') as input_ids,
        repeat('1,', len(input_ids) - 1) || '1' || repeat(',0', short) as attention_mask, array_to_string(list_concat(labels, list_transform(range(short), lambda i: -100)), ',') as labels from b""",
)
def e7(spark, sf):
    rows = token_rows(spark, sf).select("doc_id", F.floor(F.col("doc_id") / 8).alias("batch"), *export.token_example("prompt_ids", "completion_ids", 2, 512))
    return export.pad_batches(rows, "batch", 0).select("doc_id", "batch", *joined("input_ids", "attention_mask", "labels"))
