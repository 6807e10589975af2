"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` are run in order; each works on all that the one before kept, written
as Parquet and read again.  All stages but the last return the columns of
``documents``.

Edge cases: every stage takes null, empty and very long texts, repeated rows, extra
columns and empty tables, as its operator says.  Rows without an id are told
apart by their text; of rows that repeat an id one stays at the latest when near
duplicates go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.llm import near_duplicates, packing, quality_classifier, quality_rules, suffix_dedup
from tessella.llm.queries import quality_model, vocabulary
from tessella.llm.registry import documents
from tessella.llm.shared import folder

POLICY = "v3"
BATCH = 1000  # rows of whole texts that go to a task's Python at once
NAMELESS = 1 << 61  # below the numbers that near_duplicates gives to classes without ids


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy for corpora keeps: short texts stay, as the classifier judges them too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
    return quality_rules.keep(docs, POLICY)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on the labelled rows of the whole table."""
    return quality_classifier.keep(docs, quality_model(spark, sf_dir, documents(spark, sf_dir)))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: that of the smallest id."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("text"), 4))
    rows = docs.select(number.alias("number"), F.struct("*").alias("row"), F.xxhash64("text").alias("version"), F.col("text"))
    found = near_duplicates.near_duplicates(rows.select(F.col("number").alias("doc_id"), "text"), size=5, percent=80)
    kept = found.filter("kept").select(F.col("doc_id").alias("number")).distinct()
    one = rows.groupBy("number").agg(F.min_by("row", "version").alias("row"))
    return one.join(kept, "number").select("row.*")


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that are repeated from earlier ones."""
    return suffix_dedup.without_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; the ids as their checksum."""
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("quality rules", rules), ("quality classifier", classifier), ("near duplicates", near), ("suffix dedup", suffixes), ("packing", packed)]

# A learned score, similarity joins and subword ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
