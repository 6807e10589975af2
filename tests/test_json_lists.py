"""JSON lists that are read by many tasks."""

import json

import pytest

from tessella.sources import json_lists, readers

BORDER = 1024

NASTY = [{"a": 'x}"],[{"'}, {"b": [{"c": '\\"'}, {"d": '\\\\"}'}]}, 7, "s}{", [{"e": 1}, []], {"f": "é}\n"}, None, {"g": {}}]
RESULTS = [{"s": '],"results": [}'}, {"m": [{"x": {}}]}, 3, {"e": '\\"}'}]


@pytest.fixture
def splits(spark):
    """Files are read in splits of BORDER bytes."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", BORDER)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def moved(text):
    """The text after so much white space that a split begins at each of its bytes in turn."""
    size = len(text.encode())
    return {f"{k}": " " * (BORDER - k) + text for k in range(size + 1)}


def told(lists):
    out = {r.file.split("/")[-1]: (r.good, []) for r in lists.files.collect()}
    for r in sorted(lists.items.collect(), key=lambda r: r.pos):
        assert r.pos == len(out[r.file.split("/")[-1]][1])
        out[r.file.split("/")[-1]][1].append(json.loads(r.raw) if r.raw and r.raw[0] in "[{" else r.raw)
    return out


def plain(items):
    return [x if x is None or isinstance(x, (dict, list)) else str(x) for x in items]


def put(folder, texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf8")
    return str(folder)


def test_split_borders_at_every_byte_of_a_nasty_list(spark, splits, tmp_path):
    texts = moved(json.dumps(NASTY, ensure_ascii=False))
    pretty = json.dumps(NASTY, indent=1)
    texts |= {f"pretty{k}": " " * (BORDER - k) + pretty + "\n" for k in range(0, len(pretty), 5)}
    got = told(json_lists.scan(spark, put(tmp_path / "lists", texts)))
    assert got == {name: (True, plain(NASTY)) for name in texts}


def test_split_borders_at_every_byte_of_a_run(spark, splits, tmp_path):
    run = {"run_metadata": {"model_name": "m", "o": {"results": [{"q": 1}]}}, "results": RESULTS, "z": {"y": {"x": {}}}}
    texts = moved(json.dumps(run))
    lists = json_lists.scan(spark, put(tmp_path / "runs", texts), "results", "$.run_metadata.model_name")
    assert told(lists) == {name: (True, plain(RESULTS)) for name in texts}
    assert {r.run for r in lists.items.select("run").distinct().collect()} == {"m"}


def test_what_is_refused(spark, tmp_path):
    good = {
        "empty": "[ ]", "strings": '["a","b"]', "rest": '[{"a":1},2,"]"]', "spaces": ' [ {"a":1} ] \n', "long": json.dumps([{"a": "x}" * 200_000}]),
        "nested": '[[[{"a":1}]]]', "same": "[" + ",".join(['{"a":1}'] * 500) + "]",
    }
    bad = {
        "object": '{"a":[{"b":1}]}', "brace": '[{"a":1}]}', "cut1": '[{"a":1},{"b":2}', "cut2": '[{"a":1},{"b":', "early": '[1],[{"a":1}]', "word": "hello",
        "deep": '[1]], [[{"a":1}]', "comma": '[{"a":1},]', "comma2": '[,{"a":1}]', "two": '[{"a":1} {"b":2}]', "token": '[{"a":1},{"b":x}]',
        "close": '[{"a":1}] ]', "after": '[{"a":1}] x', "space": " \n", "quote": '[{"a":1},{"b":"}]',
    }
    got = told(json_lists.scan(spark, put(tmp_path / "all", good | bad)))
    assert got == {n: (True, plain(json.loads(t))) for n, t in good.items()} | {n: (False, []) for n in bad}


def test_runs_that_are_refused(spark, tmp_path):
    good = {
        "list": json.dumps(RESULTS), "none": '{"results":[],"run_metadata":{"model_name":"m"}}', "none2": '{"x":{},"results" : [ ] }\n',
        "later": '{"x":[{"results":[{"a":1}]}],"results":[{"b":[{"c":1}]}, {}]}', "quoted": '{"x":"\\"results\\": [}","results":[{"b":1}]}',
    }
    bad = {
        "no": ('{"run_metadata":{}}', "no 'results' list"), "deeper": ('{"results":{"a":[{"results": [ {"b":1}]}]}}', "no 'results' list"),
        "cut": ('{"results":[{"a":1}]', "not a JSON list"), "cut2": ('{"results":[{"a":1}', "not a JSON list"), "token": ('{"results":[{"a":1}],"x":y}', "not a JSON list"),
    }
    path = put(tmp_path / "all", good | {n: t for n, (t, _) in bad.items()})
    got = told(json_lists.scan(spark, path, "results"))
    of = lambda v: v if isinstance(v, list) else v["results"]
    assert got == {n: (True, plain(of(json.loads(t)))) for n, t in good.items()} | {n: (False, []) for n in bad}
    refused = {r.file.split("/")[-1]: r.reason for r in readers.read_runs(spark, path)[1].collect()}
    assert refused == {n: why for n, (_, why) in bad.items()} | {"list": "item 2 is not an object"}


def test_one_large_list_is_read_by_many_tasks(spark, tmp_path):
    entries = [{"uid": f"u{i}", "source_id": i, "question": "q}" * 50} for i in range(6000)]
    path = put(tmp_path / "one", {"big.json": json.dumps(entries, indent=2)})
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        splits = json_lists.pieces(spark, path).select("block").distinct().count()
        rows, bad = readers.read_canonical_json(spark, path)
        assert splits > 10 and bad.count() == 0
        assert sorted((r.uid, r.source_id) for r in rows.collect()) == sorted((e["uid"], e["source_id"]) for e in entries)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


def test_a_compressed_file(spark, tmp_path):
    import gzip

    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.json.gz").write_bytes(gzip.compress(json.dumps(NASTY).encode()))
    (tmp_path / "z" / "b.json.gz").write_bytes(gzip.compress(json.dumps({"results": RESULTS}).encode()))
    got = told(json_lists.scan(spark, str(tmp_path / "z"), "results"))
    assert got == {"a.json.gz": (True, plain(NASTY)), "b.json.gz": (True, plain(RESULTS))}
