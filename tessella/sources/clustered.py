"""A triple store clustered by subject, for stars and hops that join where the rows lie.

Each predicate's triples are dealt into as many buckets by their subject, and
sorted by it in each.  Patterns of one subject variable then join bucket by
bucket without moving, a constant subject reads one bucket, and of that the row groups
that can hold it.  Subjects with more rows than an average bucket would make a task that
no machine shortens; they are kept apart, by predicate only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessella.session import scratch_dir
from tessella.sources.readers import TripleTables

TRIPLE = ["s", "o", "o_kind", "dtype", "lang", "p"]
ROW_GROUP = 8 << 20  # bytes; small enough for a subject's rows to be few of a bucket's


class ClusteredStore(TripleTables):
    """Triples as one table: bucketed by subject, or of heavy subjects alone."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name

    def only(self, predicates: Sequence[str]) -> DataFrame:
        """The triples of the given predicates; other folders aren't read."""
        wanted = [predicates] if isinstance(predicates, str) else list(predicates)
        return self.all().filter(F.col("p").isin(wanted))

    def all(self) -> DataFrame:
        return self.spark.table(self.name)


class SubjectStore(TripleTables):
    """Both kinds of subjects."""

    def __init__(self, light: ClusteredStore, heavy: ClusteredStore | None):
        self.light, self.heavy = light, heavy

    def halves(self) -> list[ClusteredStore]:
        return [self.light, self.heavy] if self.heavy else [self.light]

    def only(self, predicates: Sequence[str]) -> DataFrame:
        return self.each(lambda half: half.only(predicates))

    def all(self) -> DataFrame:
        return self.each(lambda half: half.all())

    def each(self, question: Callable[[ClusteredStore], DataFrame]) -> DataFrame:
        """A question about one subject at a time, such as a star, asked of light and heavy subjects by themselves."""
        first, *rest = (question(half) for half in self.halves())
        return first.unionByName(rest[0]) if rest else first


def heavy_subjects(triples: DataFrame, buckets: int) -> DataFrame:
    """``s`` of the subjects with more rows than an average bucket: fewer than ``buckets`` of them.

    A sketch of frequent items names all that can be, and a second count over those settles it.
    """
    sketch = triples.agg(F.call_function("approx_top_k", F.col("s"), F.lit(buckets), F.lit(max(1024, 8 * buckets))).alias("found"), F.count("*").alias("rows"))
    likely = sketch.select("rows", F.explode("found").alias("f")).select(F.col("f.item").alias("s"), (F.col("rows") / buckets).alias("most"))
    counted = triples.select("s").join(F.broadcast(likely), "s").groupBy("s", "most").agg(F.count("*").alias("n"))  # at most ``buckets`` rows
    return counted.filter("n > most").select("s")


def write_clustered(triples: DataFrame, name: str, buckets: int | None = None) -> SubjectStore:
    """Write ``triples`` as tables ``name`` and, if there are heavy subjects, ``name_heavy``."""
    spark = triples.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = triples.select(*TRIPLE)
    known = scratch_dir(spark, "heavy")
    heavy_subjects(rows, buckets).write.parquet(known)
    heavy = spark.read.schema("s string").parquet(known)
    # A bucket's rows of all predicates are dealt to one task, which writes one file of each.
    light = rows.join(F.broadcast(heavy), "s", "left_anti").select(*TRIPLE).repartition(buckets, "s")
    to = light.write.format("parquet").partitionBy("p").bucketBy(buckets, "s").sortBy("s", "o").option("parquet.block.size", ROW_GROUP)
    to.option("path", scratch_dir(spark, name)).saveAsTable(name)
    if not heavy.limit(1).count():
        return SubjectStore(ClusteredStore(spark, name), None)
    apart = rows.join(F.broadcast(heavy), "s", "left_semi").select(*TRIPLE).hint("rebalance", "p")
    apart.write.format("parquet").partitionBy("p").option("path", scratch_dir(spark, f"{name}-heavy")).saveAsTable(f"{name}_heavy")
    return SubjectStore(ClusteredStore(spark, name), ClusteredStore(spark, f"{name}_heavy"))
