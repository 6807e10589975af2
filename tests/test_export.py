"""The exact split under repeated keys and rows, token rows, strict checks."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import export


def sizes(n, ratios=(0.8, 0.1, 0.1)):
    train = int(n * ratios[0])
    dev = int(n * ratios[1])
    return {k: v for k, v in {"train": train, "dev": dev, "test": n - train - dev}.items() if v}


def split_counts(df, **kw):
    return dict(Counter(r["split"] for r in export.split_examples(df, **kw).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 9, 10, 101, 1234])
def test_sizes_are_exact(spark, n):
    df = spark.range(n).select(F.col("id").cast("string").alias("uid"))
    assert split_counts(df) == sizes(n)


def test_order_is_that_of_the_seeded_hash(spark):
    df = spark.range(300).select(F.col("id").cast("string").alias("uid"))
    got = {r["uid"]: r["split"] for r in export.split_examples(df, seed=7).collect()}
    order = sorted(got, key=lambda u: hashlib.md5(f"7:{u}".encode()).hexdigest())
    assert [got[u] for u in order] == ["train"] * 240 + ["dev"] * 30 + ["test"] * 30


def test_split_is_a_partition_of_the_rows(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("uid"), (F.col("id") % 7).alias("x"))
    out = export.split_examples(df)
    assert out.count() == 500 and out.drop("split").exceptAll(df).count() == 0


def test_hot_key_with_different_rows(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("uid"), F.col("id").alias("x"))
    assert split_counts(df) == sizes(1000)


@pytest.mark.parametrize("ratios", [(0.8, 0.1, 0.1), (0.5, 0.25, 0.25), (1.0, 0.0, 0.0), (0.0, 0.5, 0.5)])
def test_identical_rows(spark, ratios):
    df = spark.range(777).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("uid"))
    assert split_counts(df, ratios=ratios) == sizes(777, ratios)
    same = spark.range(50).select(F.lit("one").alias("uid"))
    assert split_counts(same, ratios=ratios) == sizes(50, ratios)


def test_missing_keys_and_empty_input(spark):
    df = spark.range(20).select(F.lit(None).cast("string").alias("uid"), "id")
    assert split_counts(df) == sizes(20)
    assert split_counts(df.filter("id < 0")) == {}


def test_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError, match="must sum to 1.0"):
        export.split_examples(spark.range(1).withColumn("uid", F.lit("a")), ratios=(0.8, 0.1, 0.2))


def test_strict_check_names_the_first_bad_entry(spark):
    schema = "pos int, family string, question string, gold_query string"
    df = spark.createDataFrame([(1, "f", "q", "g"), (2, "f", " ", "g"), (3, None, None, None)], schema)
    with pytest.raises(ValueError, match="Entry 2 has no valid 'question'."):
        export.require_valid(df)
    assert [r["violation"] for r in export.violations(df).orderBy("pos").collect()][1] == "Entry 3 has no valid 'family'."
    assert export.valid_entries(df).count() == 1
    with pytest.raises(ValueError, match="Unsupported"):
        export.build_examples(df, "chat")


def test_tokens(spark):
    df = spark.createDataFrame([(0, [1, 2, 3], [4, 5]), (0, [1], []), (1, [7] * 9, [8])], "b int, p array<int>, c array<int>")
    rows = df.select("b", *export.token_example("p", "c", 2, 8))
    got = rows.collect()
    assert got[0]["input_ids"] == [1, 2, 3, 4, 5, 2] and got[0]["labels"] == [-100] * 3 + [4, 5, 2]
    assert got[2]["input_ids"] == [7] * 8 and got[2]["labels"] == [-100] * 8
    padded = export.pad_batches(rows, "b", 0).filter("b = 0").collect()
    short = min(padded, key=lambda r: sum(r["attention_mask"]))
    assert short["input_ids"] == [1, 2, 0, 0, 0, 0] and short["labels"] == [-100, 2, -100, -100, -100, -100]
    assert short["attention_mask"] == [1, 1, 0, 0, 0, 0]


def test_a_bad_entry_stops_the_export(spark, tmp_path):
    import pytest

    from tessella.operators import export

    table = spark.createDataFrame([("f", "p", "Ask [Research Question]", None), ("g", "p", None, "no prompt")], "family string, profile string, template_text string, profile_error string")
    make = lambda rows: spark.createDataFrame(rows, "uid string, source_id int, source_dataset string, family string, question string, gold_query string, pos int")
    good = ("u", 1, "d", "f", "why?", "ASK {}", 1)
    for bad, message in ((("v", 2, "d", "f", " ", "ASK {}", 2), "Entry 2"), (("v", 2, "d", "g", "x", "ASK {}", 2), "v: no prompt")):
        with pytest.raises(ValueError, match=message):
            export.export_dataset(make([good, bad]), table, str(tmp_path / "out"), str(tmp_path / "s"))
    assert not (tmp_path / "out").exists()
    report = export.export_dataset(make([good]), table, str(tmp_path / "out"), str(tmp_path / "t"), split=False).first()
    assert (report.total_examples, report.all_examples, report.split_enabled) == (1, 1, False)


def test_a_subject_with_two_values_stops_the_wide_star(spark):
    import pytest

    from tessella.operators import graph as g
    from tessella.sources.readers import melt

    rows = spark.createDataFrame([("s", "a"), ("s", "b")], "s string, o string")
    t = melt(rows, F.col("s"), literals={"p": F.col("o")})
    with pytest.raises(Exception, match="several values of p for s"):
        g.wide(t, "x", {"p": "v"}).collect()


def brute_split(hashes, contents, ratios):
    """Splits in order of key hash, content hash and nothing else."""
    order = sorted(range(len(hashes)), key=lambda i: (hashes[i], contents[i]))
    a = int(len(order) * ratios[0])
    b = a + int(len(order) * ratios[1])
    return Counter((hashes[i], contents[i], "train" if k < a else "dev" if k < b else "test") for k, i in enumerate(order))


@pytest.mark.parametrize("hot, same", [(0, 1), (9, 1), (9, 4), (5, 400)])
def test_both_cuts_match_brute_force(spark, hot, same):
    df = spark.range(600).select(
        F.when(F.col("id") % 10 < hot, "hot").otherwise((F.col("id") % 97).cast("string")).alias("uid"), F.floor(F.col("id") / same).alias("x")
    )
    ratios = (0.3, 0.45, 0.25)
    rows = export.split_examples(df, ratios=ratios).withColumn("h", export.shuffle_key(F.col("uid"), 42)).withColumn("c", export._content_hash(["uid", "x"])).collect()
    assert Counter((r.h, r.c, r.split) for r in rows) == brute_split([r.h for r in rows], [r.c for r in rows], ratios)


def test_all_cuts_share_their_counts(spark, monkeypatch):
    seen = []
    plain = export._cell_counts
    monkeypatch.setattr(export, "_cell_counts", lambda hashes, prefixes: seen.append(prefixes) or plain(hashes, prefixes))
    keys = spark.range(3000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("h")).cache()
    order = sorted(r.h for r in keys.collect())
    ranks = [1, 2, 700, 701, 1500, 2999, 3000]
    searches = [export.Search(rank) for rank in ranks]
    export._search(keys, searches, export.KEY_DIGITS)
    assert len(seen) <= export.KEY_DIGITS // export.STEP_DIGITS and seen[0] == [""]
    assert all(order[s.rank - 1].startswith(s.prefix) and s.ends() for s in searches)
    seen.clear()
    df = spark.range(3000).select(F.lit("one").alias("uid"), "id")
    assert split_counts(df) == sizes(3000)
    assert len(seen) <= 2 * export.KEY_DIGITS // export.STEP_DIGITS


def test_an_export_moves_no_entry_and_packs_its_scratch(spark, tmp_path, monkeypatch):
    """The prompt table comes from an aggregate over texts, whose size nobody knows before."""
    texts = spark.range(2000).selectExpr("'f' || id % 3 as family", "repeat('long template ', 50) || id as t", "id")
    table = texts.groupBy("family").agg(F.max_by("t", "id").alias("template_text")).withColumns({"profile": F.lit("p"), "profile_error": F.lit(None).cast("string")})
    table = table.select("family", "profile", F.concat("template_text", F.lit(" {question}")).alias("template_text"), "profile_error")
    entries = spark.range(300).selectExpr(
        "'u' || id as uid", "cast(id as int) as source_id", "'d' as source_dataset", "'f' || id % 3 as family", "'why ' || id as question", "'ASK {}' as gold_query", "cast(id as int) as pos"
    )
    plans, build = [], export.build_prompts

    def spied(*args):
        made = build(*args)
        plans.append(made._jdf.queryExecution().sparkPlan().toString())
        return made

    monkeypatch.setattr(export, "build_prompts", spied)
    report = export.export_dataset(entries, table, str(tmp_path / "out"), str(tmp_path / "s")).first()
    assert report.total_examples == 300
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
    assert all(f.name.endswith(".zstd.parquet") for f in (tmp_path / "s").glob("*.parquet"))


def folder_bytes(path):
    return sum(f.stat().st_size for f in path.rglob("*") if f.is_file())


@pytest.mark.parametrize("export_format", export.FORMATS)
def test_an_export_keeps_no_prompt_twice(spark, tmp_path, export_format):
    """Templates are many times longer than questions; what lies on disk must not grow with their product."""
    noise = "".join(hashlib.sha512(str(k).encode()).hexdigest() for k in range(100))
    table = spark.createDataFrame([("f", "p", f"{noise} [Research Question]", None)], "family string, profile string, template_text string, profile_error string")
    entries = spark.range(0, 600, 1, 2).selectExpr(
        "'u' || id as uid", "cast(id as int) as source_id", "'d' as source_dataset", "'f' as family", "'why ' || id as question", "'ASK {}' as gold_query", "cast(id as int) as pos", "uuid() as unused"
    )
    report = export.export_dataset(entries, table, str(tmp_path / "out"), str(tmp_path / "s"), export_format).first()
    assert (report.train_examples, report.dev_examples, report.test_examples) == (480, 60, 60)
    whole = 600 * len(noise)
    assert folder_bytes(tmp_path / "s") < whole / 50 and folder_bytes(tmp_path / "out") < whole * 0.8
    rows = spark.read.json(str(tmp_path / "out" / "examples"))
    prompt = F.col("prompt") if export_format == "prompt_completion" else F.col("messages")[0]["content"]
    got = {(r.uid, r.p) for r in rows.select("uid", prompt.alias("p")).collect()}
    assert got == {(f"u{k}", f"{noise} why {k}") for k in range(600)} and rows.count() == 600
