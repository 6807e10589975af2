"""Fine-tuning export: checks, example shapes, exact seeded split, token rows."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import has_text, strip
from tessella.operators.prompts import build_prompts
from tessella.session import written
from tessella.sources import writers

REQUIRED = ("family", "question", "gold_query")
FORMATS = ("prompt_completion", "messages")
IGNORED_LABEL = -100
RATIO_TOLERANCE = 1e-9
PACKED = "gzip"  # every reader of JSON lines knows it
# Columns of an entry that its example shows or is made of.
EXPORTED = ("uid", "benchmark_entry_id", "source_id", "source_dataset", "family", "question", "gold_query")

# Width of one step of the rank search: 4 hex digits, so 65,536 counts at most.
STEP_DIGITS = 4
KEY_DIGITS = 32


# ---------------------------------------------------------------- E1: checks


def violations(entries: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per entry failing a required field, with the first message."""
    message = F.coalesce(
        *[F.when(~has_text(F.col(c)), F.format_string(f"Entry %d has no valid '{c}'.", F.col(pos))) for c in REQUIRED]
    )
    return entries.withColumn("violation", message).filter("violation is not null")


def valid_entries(entries: DataFrame) -> DataFrame:
    """The entries with every required field."""
    return entries.filter(reduce(and_, [has_text(F.col(c)) for c in REQUIRED]))


def require_valid(entries: DataFrame, pos: str = "pos") -> DataFrame:
    """E1, strict: fail naming the first bad entry, else return the entries."""
    bad = violations(entries, pos).orderBy(pos).select("violation").first()
    if bad:
        raise ValueError(bad[0])
    return entries


# ------------------------------------------------------- E2, E3: example rows


def build_examples(entries: DataFrame, export_format: str = "prompt_completion") -> DataFrame:
    """Training examples from entries that carry ``prompt``."""
    if export_format not in FORMATS:
        raise ValueError(f"Unsupported export format: {export_format}")
    answer = strip(F.col("gold_query"))
    eid = F.coalesce("benchmark_entry_id", "uid") if "benchmark_entry_id" in entries.columns else F.col("uid")
    common = ["uid", eid.alias("benchmark_entry_id"), "source_id", "source_dataset", "family", "question"]
    if export_format == "prompt_completion":
        return entries.select(*common, "prompt", answer.alias("completion"))

    def turn(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return entries.select(*common, F.array(turn("user", F.col("prompt")), turn("assistant", answer)).alias("messages"))


# ------------------------------------------------------- E4, E5: exact split


def check_ratios(train: float, dev: float, test: float) -> None:
    if abs(train + dev + test - 1.0) > RATIO_TOLERANCE:
        raise ValueError("train_ratio + dev_ratio + test_ratio must sum to 1.0")


def shuffle_key(key: Column, seed: int) -> Column:
    """The seeded order of the split: rows sort by this hash of their key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


@dataclass
class Search:
    """A 1-based rank, and the cell of the ordered hashes known to hold it: its prefix, the rows before it and in it."""

    rank: int
    prefix: str = ""
    before: int = 0
    size: int = 0

    def ends(self) -> bool:
        """Whether the rank is the cell's last row."""
        return self.before + self.size == self.rank


def _cell_counts(hashes: DataFrame, prefixes: list[str]) -> dict[str, list[tuple[str, int]]]:
    """Rows per next ``STEP_DIGITS`` hex digits below each of the prefixes, which are of one length, in order.

    At most ``16 ** STEP_DIGITS`` counts for each prefix come back, whatever the table size.
    """
    length = len(prefixes[0])
    head, cell = F.substring("h", 1, length).alias("head"), F.substring("h", length + 1, STEP_DIGITS).alias("cell")
    inside = hashes.filter(F.substring("h", 1, length).isin(prefixes)) if length else hashes
    found: dict[str, list[tuple[str, int]]] = {prefix: [] for prefix in prefixes}
    for r in inside.groupBy(head, cell).agg(F.count("*").alias("n")).collect():
        found[r["head"]].append((r["cell"], r["n"]))
    return {prefix: sorted(cells) for prefix, cells in found.items()}


def _search(hashes: DataFrame, searches: list[Search], digits: int, top: list[tuple[str, int]] | None = None) -> None:
    """Narrow all searches down to cells of ``digits`` hex digits of column ``h``, or until they end.

    One aggregate a step serves every search that goes on.  Each looks on inside one cell of its own; nothing is
    sorted or moved but the counts.
    """
    while going := [s for s in searches if len(s.prefix) < digits and not (s.size and s.ends())]:
        prefixes = sorted({s.prefix for s in going})
        cells = {"": top} if top is not None and prefixes == [""] else _cell_counts(hashes, prefixes)
        for s in going:
            for cell, n in cells[s.prefix]:
                if s.before + n >= s.rank:
                    s.prefix, s.size = s.prefix + cell, n
                    break
                s.before += n


def _content_hash(columns: list[str]) -> Column:
    return F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}).cast("binary"))


class Cut(NamedTuple):
    """Where one split ends: a key hash, then a content hash, then a copy number."""

    key: str
    content: str | None = None
    copies: int | None = None

    def covers(self, columns: list[str]) -> Column:
        """True for rows at or before the cut.  "g" sorts after every hex digit."""
        if self.content is None:
            return F.col("__h") < self.key + "g"
        content = _content_hash(columns)
        if self.copies is None:
            tied = content < self.content + "g"
        else:
            tied = (content < self.content) | ((content == self.content) & (F.col("__copy") <= self.copies))
        return (F.col("__h") < self.key) | ((F.col("__h") == self.key) & tied)


def _find_cuts(keyed: DataFrame, keys: DataFrame, columns: list[str], ranks: list[int], top: list[tuple[str, int]]) -> list[Cut | None]:
    """A cut for each rank, none for 0: all ranks are looked for at once, and those within one key then go on by content."""
    searches = [Search(rank) for rank in ranks if rank]
    _search(keys, searches, KEY_DIGITS, top)
    within = {id(s): Search(s.rank, s.prefix, s.before) for s in searches if not s.ends()}
    if within:
        tied = keyed.filter(F.col("__h").isin(sorted({s.prefix for s in within.values()})))
        contents = written(tied.select(F.concat("__h", _content_hash(columns)).alias("h")), "split-contents")
        _search(contents, list(within.values()), 2 * KEY_DIGITS)

    def cut(s: Search) -> Cut:
        if id(s) not in within:
            return Cut(s.prefix)
        c = within[id(s)]
        key, content = c.prefix[:KEY_DIGITS], c.prefix[KEY_DIGITS:]
        return Cut(key, content) if c.ends() else Cut(key, content, c.rank - c.before)

    cuts = iter([cut(s) for s in searches])
    return [next(cuts) if rank else None for rank in ranks]


def _number_copies(keyed: DataFrame, columns: list[str], groups: list[tuple[str, str]]) -> DataFrame:
    """Give every identical row of ``groups`` its own ``__copy`` number.

    Identical rows are counted, not moved, and written out again in chunks by
    many tasks, so a group of copies of any size is no one's burden.
    """
    chunk = 100_000
    content = _content_hash(columns)
    in_group = reduce(or_, [(F.col("__h") == h) & (content == c) for h, c in groups])
    counted = keyed.filter(in_group).groupBy(*columns, "__h").agg(F.count("*").alias("__n"))
    blocks = counted.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / chunk))))
    numbered = blocks.repartition("__h", "__b").withColumn(
        "__copy", F.explode(F.sequence(F.col("__b") * chunk + 1, F.least(F.col("__n"), (F.col("__b") + 1) * chunk)))
    )
    rest = keyed.filter(~in_group).withColumn("__copy", F.lit(0).cast("bigint"))
    return rest.unionByName(numbered.drop("__n", "__b"))


def split_examples(
    examples: DataFrame, key: str = "uid", ratios: tuple[float, float, float] = (0.8, 0.1, 0.1), seed: int = 42
) -> DataFrame:
    """Add ``split`` with exactly ``int(n*train)`` and ``int(n*dev)`` rows.

    Rows are ordered by the seeded hash of their key and cut at two ranks.  The
    hashes are written once, and the values at both cuts are found by the same counts over them, a few
    digits a time; then every row decides its own split in a map over the input:
    nothing is sorted or shuffled.  Rows sharing a key are told apart by their
    content; if a cut falls among identical rows, those alone are counted and dealt out.

    The result depends only on row contents, so a recomputed task agrees with
    the counts as long as the input plan is deterministic.
    """
    check_ratios(*ratios)
    columns = examples.columns
    keyed = examples.withColumn("__h", shuffle_key(F.col(key), seed))
    keys = written(keyed.select(F.col("__h").alias("h")), "split-keys")
    top = _cell_counts(keys, [""])[""]
    total = sum(n for _, n in top)
    train_end = int(total * ratios[0])
    dev_end = train_end + int(total * ratios[1])
    cuts = _find_cuts(keyed, keys, columns, [train_end, dev_end], top)

    shared = sorted({(c.key, c.content) for c in cuts if c and c.copies is not None})
    rows = _number_copies(keyed, columns, shared) if shared else keyed
    in_train, in_dev = [c.covers(columns) if c else F.lit(False) for c in cuts]
    split = F.when(in_train, "train").when(in_dev, "dev").otherwise("test")
    return rows.withColumn("split", split).drop("__h", "__copy")


def export_metadata(
    examples: DataFrame,
    export_format: str = "prompt_completion",
    seed: int = 42,
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
) -> DataFrame:
    """E5: one row with the counts and the settings.

    Examples with a ``split`` are counted per split, others as ``all_examples``.
    """
    split = "split" in examples.columns
    n = lambda name: F.count_if(F.col("split") == name)
    parts = [n(name).alias(f"{name}_examples") for name in ("train", "dev", "test")] if split else [F.count("*").alias("all_examples")]
    settings = {"export_format": F.lit(export_format), "split_enabled": F.lit(split), "seed": F.lit(seed)}
    if split:
        settings |= {f"{name}_ratio": F.lit(ratio) for name, ratio in zip(("train", "dev", "test"), ratios, strict=True)}
    return examples.agg(F.count("*").alias("total_examples"), *parts).withColumns(settings)


def training_metadata(examples: DataFrame, model_id: str, dataset_dir: str, config: Mapping[str, object]) -> DataFrame:
    """E5, the trainer's side: one row with the model, the folder, how many examples it trains and evaluates on, and its settings."""
    n = lambda name: F.count_if(F.col("split") == name).alias(f"{name}_examples")
    told = [F.lit(x) for k, v in config.items() for x in (k, v if isinstance(v, str) else json.dumps(v))]
    settings = F.create_map(*told) if told else F.create_map().cast("map<string,string>")
    counts = examples.agg(n("train"), n("dev"))
    return counts.select(F.lit(model_id).alias("model_id"), F.lit(dataset_dir).alias("dataset_dir"), "train_examples", "dev_examples", settings.alias("training_config"))


def export_dataset(
    entries: DataFrame,
    table: DataFrame,
    path: str,
    scratch: str,
    export_format: str = "prompt_completion",
    split: bool = True,
    seed: int = 42,
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1),
) -> DataFrame:
    """E1, P11, E2 or E3, E4, S9 and S10 as one run: entries to files below ``path``.

    ``table`` is the per-family prompt table.  The first bad entry or missing
    prompt fails the run, before anything is written below ``path``.  The entries
    are written to ``scratch`` once, so that the split's counts and its rows read
    the same input; prompts, which repeat their template and question, are made again
    wherever they are read.  The files of examples are packed for the same reason.
    Returns the metadata row.
    """
    # Read from files the table has a known size, so that a small one is broadcast and no entry moves.
    table = written(table, "prompt-table")
    bad = build_prompts(require_valid(entries), table).filter("prompt_error is not null").select("uid", "prompt_error").orderBy("uid").first()
    if bad:
        raise ValueError(f"{bad[0]}: {bad[1]}")
    entries.select(*(c for c in entries.columns if c in EXPORTED)).write.option("compression", "zstd").parquet(scratch)
    examples = build_examples(build_prompts(entries.sparkSession.read.parquet(scratch), table), export_format)
    if split:
        examples = split_examples(examples, ratios=ratios, seed=seed)
        writers.write_splits(examples, f"{path}/examples", compression=PACKED)
    else:
        writers.write_all(examples, f"{path}/examples", PACKED)
    report = export_metadata(examples, export_format, seed, ratios)
    writers.write_report(report, f"{path}/metadata")
    return report


# ------------------------------------------------------- E6, E7: token arrays


def token_example(prompt_ids: str, completion_ids: str, eos: int | None, max_length: int) -> list[Column]:
    """``input_ids, attention_mask, labels`` from given id arrays.

    The loss is learnt on the completion only, so prompt labels are ignored.
    """
    prompt, answer = F.col(prompt_ids), F.col(completion_ids)
    if eos is not None:
        answer = F.concat(answer, F.array(F.lit(eos)))
    ids = F.slice(F.concat(prompt, answer), 1, max_length)
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORED_LABEL), F.size(prompt)), answer), 1, max_length)
    return [ids.alias("input_ids"), F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"), labels.alias("labels")]


def pad_batches(tokens: DataFrame, batch: str, pad_id: int) -> DataFrame:
    """Pad every row to the longest row of its batch.

    The longest length is an aggregate joined back, so a batch key holding very
    many rows is reduced before it moves and its rows stay spread.
    """
    longest = tokens.groupBy(batch).agg(F.max(F.size("input_ids")).alias("__width"))
    joined = tokens.join(longest, [batch])
    short = F.col("__width") - F.size("input_ids")
    fill = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORED_LABEL}
    return joined.withColumns({c: F.concat(F.col(c), F.array_repeat(F.lit(v), short)) for c, v in fill.items()}).drop("__width")
