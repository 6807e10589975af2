"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from tessella.llm import arrays


def folder(spark: SparkSession, label: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``.

    Without that setting only a local session may go on, with a folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tessella-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read again, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = folder(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(docs: DataFrame, find: Callable[[pa.Table], list[pa.Array]], fields: list[StructField]) -> tuple[DataFrame, list[str]]:
    """``docs`` with what ``find`` makes of each chunk of rows, and the new columns' names, which clash with none of its own.

    Every column goes through the task once; ``find`` gets a table whose ``text`` has its name.
    """
    prefix = "_"
    while any(f"{prefix}{f.name}" in docs.columns for f in fields):
        prefix += "_"
    names = [f"{prefix}{f.name}" for f in fields]
    plain = docs.toDF(*(c if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)))  # names with dots don't pass
    schema = StructType([*plain.schema, *(StructField(f"__{i}", f.dataType) for i, f in enumerate(fields))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in arrays.chunks(batches):
            columns = [*table.columns, *find(table)]
            yield from pa.Table.from_arrays(columns, schema.names).to_batches()

    return plain.mapInArrow(run, schema).toDF(*docs.columns, *names), names
