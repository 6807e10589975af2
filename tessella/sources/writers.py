"""Sinks: JSON lines, split folders, one-row reports, a triple store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.operators.ordered import ranked


def write_jsonl(df: DataFrame, path: str) -> None:
    """One UTF-8 JSON object per line; nulls are written, as in the source rows."""
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


LIST_ROWS = 10_000


def write_json_lists(df: DataFrame, path: str, order: Sequence[str], size: int = LIST_ROWS) -> None:
    """Files ``part=k/*.json`` of one JSON list each, with ``size`` rows in the order given; nulls are written.

    Rows are ranked across tasks and each list is put together by its own, so neither a
    task nor a file holds more than ``size`` rows.  A table without rows gives no files.
    """
    rows = ranked(df, [], list(order), "__rank")
    part = F.floor(F.col("__rank") / size).cast("long").alias("part")
    each = rows.select(part, F.struct("__rank", F.struct(*df.columns).alias("row")).alias("r"))
    lists = each.groupBy("part").agg(F.transform(F.array_sort(F.collect_list(F.struct("r.__rank", F.to_json("r.row", {"ignoreNullFields": "false"}).alias("json")))), lambda x: x["json"]).alias("rows"))
    text = F.concat(F.lit("[\n"), F.array_join("rows", ",\n"), F.lit("\n]"))
    lists.select("part", text.alias("value")).write.mode("errorifexists").partitionBy("part").text(path)


def write_splits(df: DataFrame, path: str, split: str = "split", compression: str = "none") -> None:
    """One folder per split, written by the tasks that hold the rows."""
    df.write.mode("errorifexists").partitionBy(split).option("ignoreNullFields", False).json(path, compression=compression)


def write_all(df: DataFrame, path: str, compression: str = "none") -> None:
    """S9 without a split: everything under ``split=all``."""
    write_splits(df.withColumn("split", F.lit("all")), path, compression=compression)


def write_report(row: DataFrame, path: str) -> None:
    """A one-row summary as a single JSON file."""
    row.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", False).json(path)


TRIPLE_SCHEMA = "s string, o string, o_kind string, dtype string, lang string, p string"


def write_triples(triples: DataFrame, path: str) -> None:
    """A store kept by predicate, so that a pattern reads its predicate only.

    Rows are rebalanced by predicate: a dominating one, such as the class or the
    label, is split by its measured size, and small ones stay in one file each.
    """
    triples.hint("rebalance", "p").write.mode("errorifexists").partitionBy("p").parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """The triple store; filters on ``p`` prune its folders."""
    return spark.read.schema(TRIPLE_SCHEMA).parquet(path).select("s", "p", "o", "o_kind", "dtype", "lang")
