"""Model outputs, entries and cells that Spark derives from the given tables.

Each form wraps a document's whole text the way model output wraps a query:
reasoning blocks, fences, labels, prose, cut-off and malformed queries.  The
same table of forms yields the Spark column and the SQL text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessella.plans.registry import sql_text, table
from tessella.session import spread

# (before the text, after the text); form k is used for keys with key % len == k
FORMS = [
    (
        "<think>",
        "</think>\n## Output\n```SPARQL\n# find\nPREFIX a: <http://x.org/a#>\nprefix : <http://x.org/>\n"
        "SELECT ?s WHERE {\n  ?s a <http://x.org/c#D> . # tail\n\n\n\n  ?s a:p 'v' .\n}\n```\nDone.",
    ),
    ("Sure:\n```\nSELECT ?s ?o\nWHERE { ?s ?p ?o }\n```\n", ""),
    ("", "\n```text\nnothing\n```\n```sparql\nASK { ?a ?b ?c }\n```"),
    ("```sparql\nSELECT ?x WHERE { ?x ?y ?z }\n", ""),
    ("", "\nselect ?x where { ?x a ?c }"),
    ("", ""),
    ("", "\nSPARQL Query:\n  SELECT ?x WHERE { ?x ?p"),
    ("SPARQL Query:\n", "\r\nDESCRIBE <http://x.org/#me>\r\n# end"),
    ("Output:\nSELECT ?x WHERE {}}{ ", ""),
    ("  \n\t<think>", "</think>\n　"),
    ('CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p "', '" }'),
    ("", "\nSELECT?x WHERE { ?x ?p (1) } LIMIT 5;"),
    ("    PREFIX b: <http://y.org/b>\n\n ASK\n#", "\n{ ?x b:p '(' }\n\n\n\n  PREFIX c: <http://z.org>  \n  # gone\n}  \t"),
]


def _case(key: Column, options: list[Column]) -> Column:
    picks = list(enumerate(options))
    start = F.when(key % len(options) == 0, options[0])
    return reduce(lambda w, p: w.when(key % len(options) == p[0], p[1]), picks[1:], start)


def wrapped(key: Column, text: Column) -> Column:
    return _case(key, [F.concat(F.lit(a), text, F.lit(b)) for a, b in FORMS])


def wrapped_sql(key: str, text: str) -> str:
    arms = " ".join(f"when {k} then {sql_text(a)} || {text} || {sql_text(b)}" for k, (a, b) in enumerate(FORMS))
    return f"case {key} % {len(FORMS)} {arms} end"


def model_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, family, raw``: one recorded output per document."""
    return spread(table(spark, sf, "documents")).select("doc_id", F.col("source").alias("family"), wrapped(F.col("doc_id"), F.col("text")).alias("raw"))


OUTPUTS_SQL = f"outputs as (select doc_id, source as family, {wrapped_sql('doc_id', 'text')} as raw from documents)"

# ---------------------------------------------------------------- notebook cells

QUESTIONS = [
    ("%d) DE: Wie viele? \n\n   EN: ", "\n  "),
    ("%d) \n EN: ", "\n DE: Welche?\n"),
    ("%d) EN: \n\n DE: ", "\n"),
    ("%d) ", ""),
    ("EN: ", ""),
]
QUERY_HEAD = "\n PREFIX a: <http://x.org/a#>\n\n# note\nprefix b: <http://y.org/b>\nSELECT ?x # kept\nWHERE {\n  # gone\n  ?x a:p '"
QUERY_TAIL = "' .\n}\nPREFIX late: <http://z.org>\n"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as notebooks: user turns ask, assistant turns answer."""
    c = table(spark, sf, "conversations")
    number = F.format_string("%d", F.col("turn") + 1)
    asked = _case(F.col("conv_id"), [F.concat(F.replace(F.lit(a), F.lit("%d"), number), F.col("text"), F.lit(b)) for a, b in QUESTIONS])
    given = F.concat(F.lit(QUERY_HEAD), F.col("text"), F.lit(QUERY_TAIL))
    kind = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(0)
    return c.select(
        F.col("conv_id").alias("file"),
        F.col("turn").alias("pos"),
        kind.alias("kind"),
        F.when(kind == 1, asked).when(kind == 2, given).otherwise(F.col("text")).alias("value"),
    )


def _asked_sql() -> str:
    arms = []
    for k, (a, b) in enumerate(QUESTIONS):
        head = f"replace({sql_text(a)}, '%d', (turn + 1)::varchar)"
        arms.append(f"when {k} then {head} || text || {sql_text(b)}")
    return f"case conv_id % {len(QUESTIONS)} {' '.join(arms)} end"


CELLS_SQL = f"""cells as (select conv_id as file, turn as pos, case role when 'user' then 1 when 'assistant' then 2 else 0 end as kind,
    case role when 'user' then {_asked_sql()} when 'assistant' then {sql_text(QUERY_HEAD)} || text || {sql_text(QUERY_TAIL)} else text end as value from conversations),
pairs as (select a.file, a.pos, a.value as question_text, b.value as query_text from cells a join cells b on a.file = b.file and a.pos + 1 = b.pos where a.kind = 1 and b.kind = 2)"""
