"""Extraction and checks on hand-written texts."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import checks, extract
from tessella.functions.text import WHITESPACE, strip
from tessella.operators.validation import REPORT_COLUMNS, validate, validation_summary

CASES = [
    ("  SELECT ?x WHERE { ?x ?y ?z }  ", "SELECT ?x WHERE { ?x ?y ?z }"),
    ("<THINK>SELECT wrong</think>ASK {}", "ASK {}"),
    ("prose\n```SPARQL\nASK { ?a ?b ?c }\n```\nmore", "ASK { ?a ?b ?c }"),
    ("```\nASK {}\n```\n```sparql\nASK { ?x ?y ?z }\n```", "ASK { ?x ?y ?z }"),
    ("```python\nprint()\n```", ""),
    ("```sparql\nSELECT ?x WHERE { ?x a ?c }", "SELECT ?x WHERE { ?x a ?c }"),
    ("I would write:\nselect ?x where {}\n```\ntail", "select ?x where {}"),
    ("nothing here", ""),
    ("We SELECT nothing", ""),
    ("", ""),
    ("ASK {\n  # gone\n  ?x a <http://a#b> . # cut\n  ?x ?y 'a#b' .\n}", "ASK {\n  ?x a <http://a#b> .\n  ?x ?y 'a#b' .\n}"),
    ("PREFIX a: <http://a>\nprefix : <http://b>\nPREFIX c: <http://c> ASK {}", "prefix : <http://b>\nPREFIX c: <http://c> ASK {}"),
    ("ASK {\n\n\n\n}", "ASK {\n\n}"),
    ("## Output\nSPARQL Query:\nASK {}", "ASK {}"),
    ("Output:\n\r\nASK {}\r\n}\x0b}", "ASK {}\n}\n}"),
    ("　ASK {} ", "ASK {}"),
    ("PREFIX", ""),
]


@pytest.fixture(scope="module")
def extracted(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)], "i int, raw string")
    return {r["i"]: r["extracted_query"] for r in extract.extract_queries(df, F.col("raw")).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_extraction(extracted, i):
    assert extracted[i] == CASES[i][1]


def test_extraction_is_idempotent_and_leaves_no_fence(spark, extracted):
    df = spark.createDataFrame([(q,) for q in extracted.values()], "raw string")
    again = extract.extract_queries(df, F.col("raw"))
    assert all(r["raw"] == r["extracted_query"] and "```" not in r["raw"] for r in again.collect())


def test_null_output_gives_empty_query(spark):
    df = spark.createDataFrame([(None,)], "raw string")
    assert extract.extract_queries(df, F.col("raw")).first()["extracted_query"] == ""


def test_white_space_is_that_of_python(spark):
    assert all(c.isspace() for c in WHITESPACE)
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}
    df = spark.createDataFrame([(WHITESPACE + "a b" + WHITESPACE,)], "t string")
    assert df.select(strip(F.col("t"))).first()[0] == "a b"


def test_long_texts_do_not_exhaust_the_stack(spark):
    texts = [" " * 200_000 + "x", "# c\n" * 50_000 + "ASK {}", "PREFIX a: <b>\n" * 20_000 + "ASK {}", '"' * 100_001, "{" * 50_000 + "}" * 50_000]
    df = extract.extract_queries(spark.createDataFrame([(t,) for t in texts], "raw string"), F.col("raw"), "extracted_query")
    assert [r[0] for r in df.select("extracted_query").collect()][:3] == ["", "ASK {}", "ASK {}"]
    raw = df.select(checks.balanced_braces(F.col("raw")).alias("b"), F.length(checks.bare(F.col("raw"))).alias("n")).collect()
    assert raw[4]["b"] and raw[3]["n"] == 1


def row(query, **more):
    return {c: None for c in REPORT_COLUMNS} | {"extracted_query": query, "family": "f", "run": "r"} | more


def test_report_cases(spark):
    queries = {
        "ASK { ?x ?y ?z }": "looks_ok",
        "": "empty",
        " \n": "empty",
        "WITH x": "invalid_start",
        "SELECT ?x WHERE { ?x": "syntax_error",
        "SELECTED { }": "looks_ok",
        "ASK { ?x ?y ?z } OR": "needs_review",
        "ASK {}}{": "syntax_error",
        "DESCRIBE <http://a>": "looks_ok",
        "ASK { ?x ?y 'it } ": "syntax_error",
    }
    schema = "extracted_query string, family string, run string, benchmark_entry_id string, uid string, source_id int, source_dataset string, question string, gold_query string"
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(row(q)[n] for n in names) for q in queries], schema)
    report = validate(df)
    assert report.columns[:21] == REPORT_COLUMNS
    assert {r["extracted_query"]: r["validation_status"] for r in report.collect()} == queries
    total = validation_summary(report, "run", "family").first()
    assert (total["total_items"], total["empty_query_items"], total["syntax_error_items"]) == (10, 2, 6)
    assert total["repair_candidate_items"] + total["non_repair_candidate_items"] == 10


def test_supplied_parse_error_overrides(spark):
    message = "Expected end of text, found '?'  (at char 8), (line:2, col:3)"
    schema = "extracted_query string, parser string, benchmark_entry_id string, uid string, source_id int, source_dataset string, family string, question string, gold_query string"
    df = spark.createDataFrame([("ASK { (", None) + (None,) * 7, ("ASK {}", message) + (None,) * 7, ("", None) + (None,) * 7], schema)
    a, b, c = validate(df, "parser").collect()
    assert a["parse_ok"] and a["validation_status"] == "needs_review"
    assert (b["parse_error_line"], b["parse_error_column"], b["parse_error_char"]) == (2, 3, 8)
    assert b["parse_error_hint"] == checks.HINT_SPACE and b["is_repair_candidate"]
    assert c["parse_error_raw"] == "Empty query" and c["parse_error_hint"] == checks.HINT_EMPTY


def test_every_order_line_is_a_template(spark):
    from tessella.plans.dataset_queries import line_templates

    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    made = line_templates(spark, "/root/testdata/sf0.001")
    assert made.count() == lines == made.select("mapping", "tpos").distinct().count()


def test_numbers_that_fit_no_integer_are_null(spark):
    from pyspark.sql import functions as F

    from tessella.functions.checks import error_position
    from tessella.operators.canonical import ordinal
    from tessella.operators.templates import name_version

    row = spark.sql("select '99999999999) x' as a, 'b_v99999999999.json' as b, 'at line:99999999999' as c").select(
        ordinal(F.col("a")).alias("a"), name_version(F.col("b"))["version"].alias("b"), error_position(F.col("c"), "line:").alias("c")
    ).first()
    assert (row.a, row.b, row.c) == (None, 99999999999, None)  # versions are kept beyond 32 bits
    assert spark.sql(f"select 'b_v{'9' * 39}.json' as b").select(name_version(F.col("b"))["version"]).first()[0] is None
