"""One large JSON list read by many tasks.

A file is read in pieces that end at a closing brace, so the reader may split it
anywhere, pretty-printed or on one line.  What a piece does to the reading state,
whether it ends within a string and how deep it nests, is known for either state
it may begin in; running totals, first along the splits of a file and then along
the pieces of a split, give each piece the state it really begins in.  A run of
pieces ends where an object of the list closes.  Runs that lie in one split
stay there; those that cross a border meet by their number.  Every run is parsed by itself,
once its brackets show that the list goes on through all of it, so a file is
accepted if all of its runs and what is around the list are good JSON.

The text is read twice and moves once, by split; states and numbers move as a few
integers a piece.  What the passes find is kept in the shared scratch folder.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from tessella.session import written

BRACE = "}"
_SPLIT = ["file", "block"]
_BEFORE = (Window.unboundedPreceding, -1)


class Lists(NamedTuple):
    items: DataFrame  # file, pos from 0 on, raw, run: the raw JSON of every item of the accepted files
    files: DataFrame  # file, shape, good, valid: whether a file is a list or has one, and is JSON where it has none


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, block, id, value``: the text between closing braces, in the order of ``block, id``."""
    text = spark.read.option("lineSep", BRACE).text(path)
    return text.select(
        F.input_file_name().alias("file"), F.col("_metadata.file_size").alias("size"), F.input_file_block_start().alias("block"),
        F.monotonically_increasing_id().alias("id"), "value",
    )


def _parts(text: Column) -> Column:
    """Text between quotes; every other part is within a string."""
    return F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"')


def _outside(parts: Column, within: int) -> Column:
    return F.array_join(F.filter(parts, lambda x, i: (i + within) % 2 == 0), " ")


def _nesting(text: Column) -> Column:
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _if_within(state: Column, outside: str, within: str) -> Column:
    return F.when(state == 0, F.col(outside)).otherwise(F.col(within))


def _effects(rows: DataFrame) -> DataFrame:
    """What a piece and its brace do: whether they flip the state, and how they nest from either state."""
    rows = rows.withColumn("parts", _parts(F.col("value"))).withColumn("flips", (F.size("parts") - 1) % 2)
    nests = {f"d{s}": _nesting(_outside(F.col("parts"), s)) - F.when(F.col("flips") == s, 1).otherwise(0) for s in (0, 1)}
    return rows.withColumns(nests).drop("parts")


def _signs(rows: DataFrame, key: str | None) -> DataFrame:
    """Effects, and what tells where lists begin and end, in place of the text.

    ``k0`` or ``k1`` is the nesting at which the key's list begins in the piece, ``empty`` that it ends
    there and then, ``closes`` that a list ends before anything else.
    """
    light = ["file", "size", "block", "id", "flips", "d0", "d1", (F.octet_length("value") + 1).alias("bytes"), F.regexp_extract("value", r"\A\s*([\[{])", 1).alias("opens")]
    rows = _effects(rows)
    if key is None:
        return rows.select(*light)
    pattern = _key_pattern(key)
    found = F.contains("value", F.lit(key)) & F.rlike("value", F.lit(pattern))
    rows = rows.withColumn("head", _parts(F.when(found, F.regexp_extract("value", pattern, 1))))
    here = lambda s: F.col("head").isNotNull() & ((F.size("head") - 1 + s) % 2 == 0)
    nests = [F.when(here(s), _nesting(_outside(F.col("head"), s))).alias(f"k{s}") for s in (0, 1)]
    starts = lambda text: F.rlike(text, F.lit(r"\A\s*\]"))
    empty = F.when(found, starts(F.regexp_extract("value", pattern, 3))).otherwise(False)
    return rows.select(*light, *nests, empty.alias("empty"), starts(F.col("value")).alias("closes"))


def _key_pattern(key: str) -> str:
    return rf'(?s)\A(.*?)((?<!\\)"{key}"\s*:\s*\[)(.*)\z'


def _placed(rows: DataFrame) -> DataFrame:
    """Pieces with the state they begin in, from that of their split (``s, depth``)."""
    order = Window.partitionBy(*_SPLIT).orderBy("id")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(*_BEFORE)), F.lit(0))
    rows = rows.withColumn("state", (F.col("s") + before(F.col("flips"))) % 2)
    rows = rows.withColumn("step", _if_within(F.col("state"), "d0", "d1"))
    rows = rows.withColumn("from_depth", F.col("depth") + before(F.col("step")))
    return rows.withColumn("to_depth", F.col("from_depth") + F.col("step"))


def _splits(effects: DataFrame) -> DataFrame:
    """``file, block, s, depth``: the state at the start of every split."""
    order = Window.partitionBy(*_SPLIT).orderBy("id")
    state = F.coalesce(F.sum("flips").over(order.rowsBetween(*_BEFORE)), F.lit(0)) % 2
    rows = effects.withColumn("state", state)
    sums = rows.groupBy(*_SPLIT).agg(
        (F.sum("flips") % 2).alias("flips"), F.sum(_if_within(F.col("state"), "d0", "d1")).alias("d0"), F.sum(_if_within(F.col("state"), "d1", "d0")).alias("d1")
    )
    along = Window.partitionBy("file").orderBy("block").rowsBetween(*_BEFORE)
    sums = sums.withColumn("s", F.coalesce(F.sum("flips").over(along), F.lit(0)) % 2)
    return sums.select(*_SPLIT, "s", F.coalesce(F.sum(_if_within(F.col("s"), "d0", "d1")).over(along), F.lit(0)).alias("depth"))


def _at() -> Column:
    """A piece's place in its file."""
    return F.struct("block", "id")


def _files(placed: DataFrame, key: str | None) -> DataFrame:
    """``file, shape, braced, start, end``: what a file begins with, whether a brace ends it, and where the key's list begins and ends."""
    none = F.lit(None).cast("struct<block: bigint, id: bigint>")
    start = none
    if key is not None:
        start = F.min(F.when(F.col("from_depth") + _if_within(F.col("state"), "k0", "k1") == 1, _at()))
    found = placed.groupBy("file").agg(F.min_by("opens", _at()).alias("shape"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"), start.alias("start"))
    # A compressed file has another size; then neither is known.
    braced = F.when(F.col("bytes") == F.col("size"), True).when(F.col("bytes") == F.col("size") + 1, False)
    found = found.select("file", "shape", braced.alias("braced"), "start")
    if key is None:
        return found.withColumn("end", none)
    closing = F.col("closes") & (F.col("from_depth") == 2) & (F.col("state") == 0)
    ends = placed.filter(closing | F.col("empty")).select("file", _at().alias("at"), "empty", closing.alias("closing")).join(found.select("file", "start"), "file")
    ends = ends.filter((F.col("empty") & (F.col("at") == F.col("start"))) | (F.col("closing") & (F.col("at") > F.col("start"))))
    return found.join(ends.groupBy("file").agg(F.min("at").alias("end")), "file", "left")


def _zones(placed: DataFrame) -> DataFrame:
    """Pieces with their ``zone``, and whether they end an object of the list."""
    listed, at = F.col("shape") == "[", _at()
    outside_list = F.when(F.col("start").isNull() | (at < F.col("start")), "head").when(at >= F.col("end"), "tail").otherwise("body")
    rows = placed.withColumn("zone", F.when(listed, "body").otherwise(outside_list))
    level = F.when(listed, 1).otherwise(2)
    ends = (F.col("zone") == "body") & ((F.col("state") + F.col("flips")) % 2 == 0) & (F.col("to_depth") == level)
    return rows.withColumn("ends", ends.cast("int"))


def _runs(zoned: DataFrame, key: str | None) -> DataFrame:
    """``file, block, run, zone, text, ended``: pieces joined to runs as far as they lie in one split; ``run`` is counted along the file."""
    order = Window.partitionBy(*_SPLIT).orderBy("id")
    run = F.col("runs_before") + F.coalesce(F.sum("ends").over(order.rowsBetween(*_BEFORE)), F.lit(0))
    rows = zoned.withColumn("run", F.when(F.col("zone") == "body", run).otherwise(F.lit(-1)))
    if key is not None:
        at = lambda i: F.regexp_extract("value", _key_pattern(key), i)
        head = F.struct(F.lit("head").alias("zone"), F.lit(-1).cast("long").alias("run"), F.concat(at(1), at(2)).alias("value"))
        rest = F.struct("zone", F.col("run").cast("long").alias("run"), at(3).alias("value"))
        whole = F.struct("zone", F.col("run").cast("long").alias("run"), "value")
        parts = F.when(_at() == F.col("start"), F.array(head, rest)).otherwise(F.array(whole))
        rows = rows.select("file", "block", "id", "ends", "first_run", "shape", F.explode(parts).alias("p")).select("file", "block", "id", "ends", "first_run", "shape", "p.*")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "value"))), lambda p: p["value"]), BRACE)
    return rows.groupBy("file", "block", "run", "zone").agg(joined.alias("text"), F.max("ends").alias("ended"), F.max("first_run").alias("first_run"), F.max("shape").alias("shape"))


def _balanced(content: Column) -> Column:
    """Whether the brackets of a stretch of a list close what they open and nothing else."""
    brackets = F.split(F.regexp_replace(_outside(_parts(content), 0), r"[^\[\]{}]", ""), "")
    step = lambda c: F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def add(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + step(c)
        return F.struct(depth.alias("depth"), F.least(acc["low"], depth).alias("low"))

    end = F.aggregate(brackets, start, add)
    return (end["depth"] == 0) & (end["low"] == 0)


def _parsed(runs: DataFrame) -> DataFrame:
    """Runs that lie ``inside`` a split with ``raw`` for their text: their items, null where the run isn't a stretch of a list."""
    first, listed, ended = F.col("run") == 0, F.col("shape") == "[", F.col("ended") == 1
    lead = F.when(first & listed, r"\A\s*\[").when(first, r"\A").otherwise(r"\A\s*,")
    last = F.lit(r"\]\s*\z")
    led = F.regexp_like("text", lead)
    inner = F.when(led, F.regexp_replace("text", lead, F.lit("")))
    closed = ~first & F.rlike("text", F.lit(r"\A\s*\]\s*\z"))
    content = F.when(ended, F.concat(inner, F.lit(BRACE))).when(F.regexp_like(inner, last), F.regexp_replace(inner, last, F.lit("")))
    rows = runs.withColumn("content", F.when(F.col("inside"), content))
    json = F.concat(F.lit("["), F.col("content"), F.lit("]"))
    good = _balanced(F.col("content")) & F.json_array_length(json).isNotNull() & (first | (F.json_array_length(json) > 0))
    none = F.array().cast("array<string>")
    raw = F.when(F.col("inside"), F.when(closed, none).when(good, F.from_json(json, "array<string>")))
    return rows.withColumns({"raw": raw, "text": F.when(~F.col("inside"), F.col("text"))}).drop("content")


def _around(runs: DataFrame) -> DataFrame:
    """``file, head, tail``: the text before and after the list of an object, and all of a text that has none."""
    parts = runs.filter("zone <> 'body'").select("file", "block", "zone", "text")
    joined = lambda zone: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("zone") == zone, F.struct("block", "text")))), lambda p: p["text"]), BRACE)
    return parts.groupBy("file").agg(joined("head").alias("head"), joined("tail").alias("tail"))


def _split_states(spark: SparkSession, path: str, key: str | None) -> tuple[DataFrame, DataFrame]:
    """The first pass: every split's state with its file's shape and the runs before it, and the files."""
    signs = written(_signs(pieces(spark, path), key), "json-signs")
    starts = written(_splits(signs), "json-starts")
    files = written(_files(_placed(signs.join(starts, _SPLIT)), key), "json-files")
    marked = starts.join(files, "file")
    counts = _zones(_placed(signs.join(marked, _SPLIT))).groupBy(*_SPLIT).agg(F.sum("ends").alias("n_ends"))
    counts = counts.select(*_SPLIT, F.coalesce(F.sum("n_ends").over(_along()), F.lit(0)).alias("runs_before"))
    first = F.when(F.col("block") == 0, F.lit(0)).otherwise(F.col("runs_before") + 1)
    return written(marked.join(counts, _SPLIT).withColumn("first_run", first), "json-splits"), files


def _along() -> Window:
    return Window.partitionBy("file").orderBy("block").rowsBetween(*_BEFORE)


def scan(spark: SparkSession, path: str, key: str | None = None, run: str | None = None) -> Lists:
    """The items of the files' lists: of a top-level list, or of that under ``key`` in a top-level object.

    ``run`` is a JSON path into the object around the list, whose value goes with the items.
    An object's list must end after an object or be empty.
    """
    splits, files = _split_states(spark, path, key)
    joined = _runs(_zones(_placed(_effects(pieces(spark, path)).join(splits, _SPLIT))), key)
    inside = (F.col("ended") == 1) & (F.col("run") >= F.col("first_run")) & (F.col("zone") == "body")
    runs = written(_parsed(joined.withColumn("inside", inside)), "json-runs")
    whole = runs.filter("inside")
    halves = runs.filter("not inside and zone = 'body'").groupBy("file", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), BRACE).alias("text"),
        F.max("ended").alias("ended"), F.max("block").alias("block"), F.max("shape").alias("shape"),
    )
    crossing = _parsed(halves.withColumn("inside", F.lit(True)))

    fields = [*_SPLIT, "ended", F.size("raw").alias("n"), F.isnull("raw").cast("int").alias("bad")]
    told = whole.select(*fields, F.lit(0).alias("crossing")).unionByName(crossing.select(*fields, F.col("ended").alias("crossing")))
    some = F.when(F.col("bad") == 0, F.col("n"))
    told = told.groupBy(*_SPLIT).agg(
        F.sum(some).alias("n"), F.sum(F.when(F.col("crossing") == 1, some)).alias("n_crossing"), F.sum("bad").alias("bad"), F.sum(1 - F.col("ended")).alias("open")
    )
    counted = splits.select(*_SPLIT).join(told, _SPLIT, "left").withColumn("base", F.coalesce(F.sum("n").over(_along()), F.lit(0)))
    totals = counted.groupBy("file").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("open"), F.lit(0)).alias("open"))
    verdict = _verdict(files.join(totals, "file", "left"), runs, key, run)
    base = counted.select(*_SPLIT, "base", "n", F.coalesce("n_crossing", F.lit(0)).alias("n_crossing"))
    base = base.join(verdict.filter("good").select("file", F.col("run").alias("of_run")), "file")

    within = Window.partitionBy(*_SPLIT).orderBy("run").rowsBetween(*_BEFORE)
    earlier = F.coalesce(F.sum(F.size("raw")).over(within), F.lit(0))
    items = whole.withColumn("earlier", earlier).join(base, _SPLIT).select("file", "of_run", (F.col("base") + F.col("n_crossing") + F.col("earlier")).alias("from_pos"), "raw")
    # A run that crosses into a split comes before the split's own; a list's rest after its last object comes after them.
    after = F.when(F.col("ended") == 1, F.lit(0)).otherwise(F.col("n") - F.size("raw"))
    items = items.unionByName(crossing.join(base, _SPLIT).select("file", "of_run", (F.col("base") + after).alias("from_pos"), "raw"))
    items = items.select("file", F.col("of_run").alias("run"), "from_pos", F.posexplode("raw").alias("k", "raw"))
    return Lists(items.select("file", (F.col("from_pos") + F.col("k")).alias("pos"), "raw", "run"), verdict.select("file", "shape", "good", "valid"))


def _verdict(files: DataFrame, runs: DataFrame, key: str | None, run: str | None) -> DataFrame:
    """``file, shape, good, valid, run``: lists need all their runs and one end, objects also what is around their list."""
    sound = F.coalesce(F.col("bad") == 0, F.lit(False))
    listed = (F.col("shape") == "[") & sound & (F.col("open") == 1) & F.coalesce(~F.col("braced"), F.lit(True))
    if key is None:
        return files.select("file", "shape", listed.alias("good"), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("run"))
    around = _around(runs).join(files.select("file", "braced"), "file")
    text = F.concat("head", "tail", F.when(F.col("braced"), BRACE).otherwise(""))
    guess = F.when(F.col("braced").isNull() & F.get_json_object(text, "$").isNull(), F.concat(text, F.lit(BRACE))).otherwise(text)
    around = around.select("file", guess.alias("around"))
    empty = F.json_array_length(F.get_json_object("around", f"$.{key}")) == 0
    around = around.select("file", F.get_json_object("around", "$").isNotNull().alias("valid"), empty.alias("empty"), F.get_json_object("around", run or "$.none").alias("run"))
    whole = (F.col("shape") == "{") & F.isnotnull("start") & F.isnotnull("end") & F.col("valid") & F.col("empty") & sound & (F.col("open") == 0)
    return files.join(around, "file", "left").select("file", "shape", (listed | F.coalesce(whole, F.lit(False))).alias("good"), "valid", "run")
