"""Scans: notebooks, canonical rows, runs, configuration, triples."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField

from tessella.sources import json_lists

CELL_SCHEMA = "array<struct<kind: int, language: string, value: string>>"
CANONICAL_SCHEMA = (
    "uid string, source_dataset string, source_id int, family string, question string, "
    "gold_query string, contribution_class string"
)
RESULT_SCHEMA = (
    "status string, benchmark_entry_id string, uid string, source_id int, source_dataset string, family string, "
    "question string, gold_query string, raw_model_output string, extracted_query string, "
    "response_time_seconds double, error string"
)
RUN_SCHEMA = (
    "run_metadata struct<model_name: string, benchmark_path: string, started_at_utc: string, finished_at_utc: string, "
    f"total_items: int, successful_items: int, failed_items: int, total_runtime_seconds: double>, results array<struct<{RESULT_SCHEMA.replace(' string', ': string').replace(' int', ': int').replace(' double', ': double')}>>"
)
REGISTRY_SCHEMA = "map<string, struct<source_dataset: string, family: string, uid_prefix: string>>"
PROFILES_SCHEMA = (
    "version string, default_query_language string, default_prefix_profile string, "
    "profiles map<string, struct<family: string, template_id: string, template_label: string, target_class_id: string, "
    "contribution_class: string, query_language: string, prefix_profile: string, output_base_name: string, "
    "latest_rendered_path: string, prompt_generator_source: string, enabled: boolean>>, family_to_profile map<string, string>"
)
_REF = "struct<id: string, label: string>"
TEMPLATES_SCHEMA = (
    f"array<struct<id: string, label: string, description: string, target_class: {_REF}, properties: array<struct<"
    f"id: string, label: string, description: string, order: int, min_count: int, max_count: int, path: {_REF}, "
    f"class: {_REF}, datatype: {_REF}>>>>"
)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """Each file below ``path`` as one row ``file, value``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")


Scan = tuple[DataFrame, DataFrame]  # the accepted rows, and ``file, reason`` of what was refused


def _refused(df: DataFrame, reason: Column) -> DataFrame:
    """``file, reason`` of the rows that have a reason."""
    return df.select("file", reason.alias("reason")).filter("reason is not null")


def _items(texts: DataFrame, json: Column, schema: str, *keep: Column) -> tuple[DataFrame, DataFrame]:
    """Texts with ``raw``, the items of the JSON list in ``json`` (null where it isn't one), and one row per item.

    ``schema`` is an array of structs; an item that is no object is null.
    """
    lists = texts.withColumn("raw", F.when(F.json_array_length(json).isNotNull(), F.from_json(json, "array<string>")))
    each = lists.select("file", *keep, F.posexplode("raw").alias("pos", "raw"))
    item = F.from_json("raw", schema.removeprefix("array<").removesuffix(">"))
    return lists, each.withColumn("item", F.when(F.rlike("raw", F.lit(r"\A\s*\{")), item)).drop("raw")


# Why a text is refused.
NOT_A_LIST, NOT_AN_OBJECT, NO_RESULTS, ITEM = "not a JSON list", "not a JSON object", "no 'results' list", "item %d is not an object"


def _list_scan(texts: DataFrame, json: Column, schema: str, why: str | Column, *keep: Column) -> Scan:
    """One row ``file, pos, item`` per object of each list; other items and texts are refused."""
    lists, items = _items(texts, json, schema, *keep)
    bad = _refused(lists, F.when(F.col("raw").isNull(), why))
    bad = bad.unionByName(_refused(items, F.when(F.col("item").isNull(), F.format_string(ITEM, "pos"))))
    return items.filter("item is not null"), bad


def _objects(items: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """Items with ``item`` as a struct, and the refused ones; ``schema`` is an array of structs."""
    item = F.from_json("raw", schema.removeprefix("array<").removesuffix(">"))
    found = items.withColumn("item", F.when(F.rlike("raw", F.lit(r"\A\s*\{")), item)).drop("raw")
    return found.filter("item is not null"), _refused(found, F.when(F.col("item").isNull(), F.format_string(ITEM, "pos")))


def _read_lists(spark: SparkSession, path: str, schema: str, key: str | None = None, run: str | None = None) -> Scan:
    """One row ``file, pos, run, item`` per object of the files' lists, read by as many tasks as the files have splits."""
    lists = json_lists.scan(spark, path, key, run)
    items, bad = _objects(lists.items, schema)
    why = F.when((F.col("shape") == "{") & F.col("valid"), NO_RESULTS).otherwise(NOT_A_LIST)
    return items, bad.unionByName(_refused(lists.files, F.when(~F.col("good"), why)))


def notebook_scan(texts: DataFrame) -> Scan:
    """Notebook cells in order, ``file, pos, kind, language, value``, and the refused notebooks.

    ``texts`` holds one notebook per row ``file, value``: files read whole, or many
    small notebooks packed one per line, which splits and avoids small files.
    """
    items, bad = _list_scan(texts, F.col("value"), CELL_SCHEMA, NOT_A_LIST)
    return items.select("file", "pos", "item.kind", "item.language", "item.value"), bad


def notebook_cells(texts: DataFrame) -> DataFrame:
    """The cells of the accepted notebooks."""
    return notebook_scan(texts)[0]


def read_notebooks(spark: SparkSession, path: str) -> Scan:
    """The cells of every notebook file below ``path``, and the refused files; a large notebook is read by many tasks."""
    items, bad = _read_lists(spark, path, CELL_SCHEMA)
    return items.select("file", "pos", "item.kind", "item.language", "item.value"), bad


def _fields(schema: str) -> str:
    """A column list as an array of structs."""
    return f"array<struct<{', '.join(c.strip().replace(' ', ': ', 1) for c in schema.split(','))}>>"


def canonical_scan(texts: DataFrame) -> Scan:
    """The objects of one JSON list per text, and the refused texts and items."""
    items, bad = _list_scan(texts, F.col("value"), _fields(CANONICAL_SCHEMA), NOT_A_LIST)
    return items.select("item.*"), bad


def read_canonical_json(spark: SparkSession, path: str) -> Scan:
    """Files whose top level is one JSON list of canonical entries, of any size and however laid out."""
    items, bad = _read_lists(spark, path, _fields(CANONICAL_SCHEMA))
    return items.select("item.*"), bad


def jsonl_scan(lines: DataFrame, schema: str = CANONICAL_SCHEMA) -> Scan:
    """S3: one JSON object per line of ``file, value``; blank lines are skipped, others refused."""
    full = lines.filter(~F.rlike("value", F.lit(r"\A\s*\z")))
    options = {"columnNameOfCorruptRecord": "__broken"}
    object_ = F.rlike("value", F.lit(r"\A\s*\{"))
    rows = full.select("file", object_.alias("object"), F.from_json("value", f"{schema}, __broken string", options).alias("r"))
    good = F.col("object") & F.col("r.__broken").isNull() & F.col("r").isNotNull()
    return rows.filter(good).select("r.*").drop("__broken"), _refused(rows, F.when(~good, NOT_AN_OBJECT))


def read_jsonl(spark: SparkSession, path: str, schema: str = CANONICAL_SCHEMA) -> Scan:
    """S3: JSON lines, the form that splits."""
    return jsonl_scan(spark.read.text(path).select(F.input_file_name().alias("file"), "value"), schema)


def run_scan(texts: DataFrame) -> Scan:
    """One row per result of every run, with the run's model and position, and the refused texts.

    A run is an object with a ``results`` list, or a plain list of results.
    """
    plain = F.json_array_length("value").isNotNull()
    results = F.when(plain, F.col("value")).otherwise(F.get_json_object("value", "$.results"))
    run = F.when(~plain, F.get_json_object("value", "$.run_metadata.model_name")).alias("run")
    why = F.when(F.rlike("value", F.lit(r"\A\s*\{")) & F.get_json_object("value", "$").isNotNull(), NO_RESULTS).otherwise(NOT_A_LIST)
    items, bad = _list_scan(texts, results, _fields(RESULT_SCHEMA), why, run)
    return items.select("run", (F.col("pos") + 1).alias("pos"), "item.*"), bad


def read_runs(spark: SparkSession, path: str) -> Scan:
    """Run files of either shape, of any size; in an object, the list must end after an object or be empty."""
    items, bad = _read_lists(spark, path, _fields(RESULT_SCHEMA), "results", "$.run_metadata.model_name")
    return items.select("run", (F.col("pos") + 1).alias("pos"), "item.*"), bad


def _config(texts: DataFrame, schema: str) -> Scan:
    """``file, c``: one JSON object per text, and the refused texts."""
    parsed = texts.select("file", F.when(F.rlike("value", F.lit(r"\A\s*\{")), F.from_json("value", schema)).alias("c"))
    return parsed.filter("c is not null"), _refused(parsed, F.when(F.col("c").isNull(), NOT_AN_OBJECT))


def registry_scan(texts: DataFrame) -> Scan:
    """The dataset registry, one row per dataset key, and the refused texts."""
    config, bad = _config(texts, REGISTRY_SCHEMA)
    return config.select(F.explode("c").alias("dataset", "v")).select("dataset", "v.*"), bad


def profile_scan(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prompt profiles with defaults filled in, the family mapping, and the refused texts."""
    found, bad = _config(texts, f"struct<{PROFILES_SCHEMA}>")
    config = found.select("c.*")
    profiles = config.select("default_query_language", "default_prefix_profile", F.explode("profiles").alias("profile", "v")).select(
        "profile", "v.*", "default_query_language", "default_prefix_profile"
    )
    profiles = profiles.withColumns(
        {
            "query_language": F.coalesce("query_language", "default_query_language", F.lit("sparql")),
            "prefix_profile": F.coalesce("prefix_profile", "default_prefix_profile", F.lit("orkg_default")),
        }
    ).drop("default_query_language", "default_prefix_profile")
    return profiles, config.select(F.explode("family_to_profile").alias("family", "profile")), bad


def template_scan(texts: DataFrame, mapping: Column) -> Scan:
    """Template files, one row per template with its place in the list, and the refused texts."""
    items, bad = _list_scan(texts, F.col("value"), TEMPLATES_SCHEMA, NOT_A_LIST, mapping.alias("mapping"))
    return items.select("mapping", F.col("pos").alias("tpos"), "item.*"), bad


# -------------------------------------------------------------------- triples

# One N-Triples line; the object is an IRI, a blank node or a literal.
TRIPLE_LINE = (
    r'\A\s*(<[^<>"\s]*>|_:\S+)\s+(<[^<>"\s]*>)\s+(<[^<>"\s]*>|_:\S+|"(.*)"(?:@([a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|\^\^<([^<>"\s]*)>)?)\s*\.\s*\z'
)
SKIPPED_LINE = r"\A\s*(?:#.*)?\z"
TRIPLE_SCHEMA = "s string, p string, o string, o_kind string, dtype string, lang string"


def _term(c: Column) -> Column:
    return F.regexp_replace(c, r"\A<|>\z", "")


def _unescape(body: Column) -> Column:
    """Literal escapes are those of JSON strings, plus the escaped apostrophe."""
    as_json = F.concat(F.lit('["'), F.replace(body, F.lit("\\'"), F.lit("'")), F.lit('"]'))
    parsed = F.get(F.from_json(as_json, "array<string>", {"allowUnquotedControlChars": "true"}), F.lit(0))
    return F.when(F.contains(body, F.lit("\\")), F.coalesce(parsed, body)).otherwise(body)


def parse_triples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples from N-Triples lines in column ``value``, and the lines refused.

    A line is refused when it is not one triple, or its literal holds a quote
    that is not escaped.
    """
    at = lambda i: F.regexp_extract("value", TRIPLE_LINE, i)
    stray = F.contains(F.regexp_replace(at(4), r"\\.", ""), F.lit('"'))
    good = F.col("value").rlike(TRIPLE_LINE) & ~stray
    kept = lines.filter(~F.col("value").rlike(SKIPPED_LINE))
    obj = at(3)
    kind = F.when(F.startswith(obj, F.lit("<")), "iri").when(F.startswith(obj, F.lit("_:")), "bnode").otherwise("literal")
    triples = kept.filter(good).select(
        _term(at(1)).alias("s"),
        _term(at(2)).alias("p"),
        F.when(kind == "literal", _unescape(at(4))).otherwise(_term(obj)).alias("o"),
        kind.alias("o_kind"),
        F.nullif(at(6), F.lit("")).alias("dtype"),
        F.nullif(F.lower(at(5)), F.lit("")).alias("lang"),
    )
    return triples, kept.filter(~good).select("value")


# The namespaces the questions abbreviate.
NAMESPACES = {
    "orkgr:": "http://orkg.org/orkg/resource/",
    "orkgc:": "http://orkg.org/orkg/class/",
    "orkgp:": "http://orkg.org/orkg/predicate/",
    "rdfs:": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd:": "http://www.w3.org/2001/XMLSchema#",
    "rdf:": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
}


def abbreviate(triples: DataFrame, namespaces: Mapping[str, str] = NAMESPACES) -> DataFrame:
    """Write IRIs with their prefixes; do it once, before a store is written."""

    def short(c: Column) -> Column:
        pick = F.when(F.lit(False), c)
        for prefix, space in namespaces.items():
            rest = F.substring(c, F.lit(len(space) + 1), F.length(c))
            pick = pick.when(F.startswith(c, F.lit(space)), F.concat(F.lit(prefix), rest))
        return pick.otherwise(c)

    o = F.when(F.col("o_kind") == "iri", short(F.col("o"))).otherwise(F.col("o"))
    return triples.withColumns({"s": short(F.col("s")), "p": short(F.col("p")), "o": o, "dtype": short(F.col("dtype"))})


def read_ntriples(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Triples and refused lines of the text files below ``path``."""
    return parse_triples(spark.read.text(path))


class TripleTables:
    """Triples kept as one table per predicate, not yet put together.

    A pattern on a predicate opens that predicate's tables and nothing else, so
    plans stay as small as the question however many tables feed the graph.
    """

    def __init__(self, parts: Sequence[tuple[str, Callable[[], DataFrame]]]):
        self.parts = list(parts)

    def __add__(self, other: TripleTables) -> TripleTables:
        return TripleTables(self.parts + other.parts)

    def about(self, kind: str) -> TripleTables:
        """The tables that can hold triples of subjects of a kind, all of them where kinds aren't told apart.

        A predicate names its objects as a kind, and ``^predicate`` its subjects.
        """
        return self

    def only(self, predicates: Sequence[str]) -> DataFrame:
        """The triples of the given predicates."""
        wanted = [make() for p, make in self.parts if p in set(predicates)]
        wanted = wanted or [self.parts[0][1]().filter(F.lit(False))]
        return reduce(lambda a, b: a.unionByName(b), wanted)

    def all(self) -> DataFrame:
        """Every triple as one table, as for writing a store."""
        return reduce(lambda a, b: a.unionByName(b), [make() for _, make in self.parts])


def melt(
    source: DataFrame | Callable[[], DataFrame],
    subject: Column,
    cls: str | None = None,
    iris: Mapping[str, Column] | None = None,
    literals: Mapping[str, Column] | None = None,
    langs: Mapping[str, Column] | None = None,
) -> TripleTables:
    """A wide table as triples; null objects are left out.

    Each predicate is its own projection of the table, so a question reading
    one predicate scans only that predicate's columns.  ``source`` may be a
    function opening the table, called when a predicate is first asked for.
    """
    opened = (lambda: source) if isinstance(source, DataFrame) else cache(source)
    none = F.lit(None).cast("string")

    def rows(p: str, o: Column, kind: str, lang: Column | None = None) -> DataFrame:
        df = opened()
        typed = kind == "literal" and lang is None
        dtype = F.lit(_xsd(df.select(o.alias(p)).schema[p])) if typed else none
        return df.select(
            subject.cast("string").alias("s"),
            F.lit(p).alias("p"),
            o.cast("string").alias("o"),
            F.lit(kind).alias("o_kind"),
            dtype.alias("dtype"),
            (none if lang is None else lang).alias("lang"),
        ).filter(F.col("o").isNotNull())

    parts = [("rdf:type", partial(rows, "rdf:type", F.lit(cls), "iri"))] if cls else []
    parts += [(p, partial(rows, p, c, "iri")) for p, c in (iris or {}).items()]
    parts += [(p, partial(rows, p, c, "literal", (langs or {}).get(p))) for p, c in (literals or {}).items()]
    return TripleTables(parts)


def _xsd(field: StructField) -> str:
    """The XML Schema name of a column's type."""
    names = {"integer": "integer", "long": "integer", "decimal": "decimal", "double": "double", "float": "float", "date": "date", "boolean": "boolean"}
    return "xsd:" + names.get(field.dataType.typeName(), "string")


def melt_once(df: DataFrame, subject: Column, values: Mapping[str, Column]) -> DataFrame:
    """S7 for writing: every predicate in one pass over the table."""
    cells = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in values.items()])
    rows = df.select(subject.cast("string").alias("s"), F.explode(cells).alias("c"))
    return rows.select("s", "c.p", "c.o").filter(F.col("o").isNotNull())
