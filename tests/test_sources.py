"""Files on disk, templates and joins on small inputs."""

import json

from pyspark.sql import functions as F

from tessella.operators import canonical, graph as g, lookup, prompt_texts as texts, prompts, templates
from tessella.sources import readers, writers


def notebook(*cells):
    return json.dumps([{"kind": k, "language": "x", "value": v, "metadata": {}} for k, v in cells])


REGISTRY = {"a": {"source_dataset": "A", "family": "fam", "uid_prefix": "fam"}}


def test_notebook_to_canonical(spark, tmp_path):
    (tmp_path / "nb").mkdir()
    cells = [
        (1, "1) DE: Was?\n\n EN: What?"), (2, "PREFIX a: <b>\n# c\nSELECT ?x WHERE { ?x a orkgc:C1 }"),
        (1, "2) EN: \n\n DE: Wie?"), (2, "ASK {}\nPREFIX b: <c>"),
        (1, "Plain"), (2, "\n# only\nprefix x: <y>\n\n  DESCRIBE ?x"),
    ]
    (tmp_path / "nb" / "one.book").write_text(notebook(*cells))
    reg = tmp_path / "reg.json"
    reg.write_text(json.dumps(REGISTRY, indent=2))
    cells = readers.read_notebooks(spark, str(tmp_path / "nb"))[0].withColumn("dataset", F.lit("a"))
    rows = canonical.canonicalise(cells, readers.registry_scan(readers.whole_texts(spark, str(reg)))[0]).orderBy("source_id").collect()
    assert [(r["uid"], r["question"], r["question_fallback"]) for r in rows] == [
        ("fam-0001", "What?", False), ("fam-0002", "Wie?", True), ("fam-0003", "Plain", False),
    ]
    assert [r["gold_query"] for r in rows] == ["SELECT ?x WHERE { ?x a orkgc:C1 }", "ASK {}\nPREFIX b: <c>", "DESCRIBE ?x"]
    assert [r["contribution_class"] for r in rows] == ["orkgc:C1", None, None]


def test_run_shapes(spark, tmp_path):
    results = [{"status": "ok", "benchmark_entry_id": "a", "extracted_query": "ASK {}"}, {"status": "error", "error": "no"}]
    (tmp_path / "run.json").write_text(json.dumps({"run_metadata": {"model_name": "m"}, "results": results}, indent=1))
    (tmp_path / "list.json").write_text(json.dumps(results, indent=1))
    (tmp_path / "empty.json").write_text('{"run_metadata": {}}')
    (tmp_path / "cut.json").write_text(json.dumps(results)[:-3])
    (tmp_path / "odd.json").write_text(json.dumps([results[0], "text"]))
    rows, bad = readers.read_runs(spark, str(tmp_path))
    got = sorted((r["run"] or "", r["pos"], r["status"], r["error"] or "") for r in rows.collect())
    assert got == [("", 1, "ok", ""), ("", 1, "ok", ""), ("", 2, "error", "no"), ("m", 1, "ok", ""), ("m", 2, "error", "no")]
    assert sorted((r.file.split("/")[-1], r.reason) for r in bad.collect()) == [
        ("cut.json", "not a JSON list"), ("empty.json", "no 'results' list"), ("odd.json", "item 1 is not an object"),
    ]


def test_refused_entries(spark, tmp_path):
    entry = {"uid": "a-1", "source_id": 1, "question": "?"}
    (tmp_path / "ok.json").write_text(json.dumps([entry], indent=1))
    (tmp_path / "object.json").write_text(json.dumps(entry))
    rows, bad = readers.read_canonical_json(spark, str(tmp_path))
    assert [r.uid for r in rows.collect()] == ["a-1"]
    assert [(r.file.split("/")[-1], r.reason) for r in bad.collect()] == [("object.json", "not a JSON list")]
    (tmp_path / "l.jsonl").write_text(json.dumps(entry) + "\n\n" + json.dumps(entry)[:-4] + "\n[1]\n")
    rows, bad = readers.read_jsonl(spark, str(tmp_path / "l.jsonl"))
    assert [r.uid for r in rows.collect()] == ["a-1"] and bad.count() == 2


def test_profiles(spark, tmp_path):
    config = {
        "version": "3", "profiles": {"p": {"family": "f", "output_base_name": "b", "enabled": True}, "q": {"family": "g", "enabled": False}},
        "family_to_profile": {"f": "p", "g": "q"},
    }
    (tmp_path / "p.json").write_text(json.dumps(config, indent=1))
    profiles, families, _ = readers.profile_scan(readers.whole_texts(spark, str(tmp_path / "p.json")))
    assert {r["profile"]: r["query_language"] for r in profiles.collect()} == {"p": "sparql", "q": "sparql"}
    versions = spark.createDataFrame([("b", 1, "old"), ("b", 2, "Ask [Research Question]")], "base string, version int, prompt_text string")
    entries = spark.createDataFrame([("f", " why? "), ("g", "x"), ("h", "x"), (None, "x"), ("f", " ")], "family string, question string")
    built = prompts.build_prompts(entries, prompts.prompt_table(profiles, families, versions)).collect()
    assert {(r["family"], r["question"]): r["prompt"] or r["prompt_error"] for r in built} == {
        ("f", " why? "): "Ask why?",
        ("g", "x"): "Profile 'q' is disabled.",
        ("h", "x"): "No prompt profile mapping found for family 'h'.",
        (None, "x"): "Entry is missing a valid 'family' field.",
        ("f", " "): "Entry is missing a valid 'question' field.",
    }


def prop(path, label="", description=None, max_count=1, cls=None):
    p = {"id": "x", "label": label, "description": description, "max_count": max_count, "min_count": 0, "path": {"id": path, "label": f"path {path}"}}
    return p | ({"class": {"id": cls, "label": f"class {cls}"}} if cls else {})


def test_templates(spark, tmp_path):
    data = [
        {"id": "R1", "label": "one", "target_class": {"id": "C1", "label": "c"}, "properties": [
            prop("P1", "first", "", None, "C2"), prop("P2", "", "old"), prop("P2", "second", "", 2)]},
        {"id": "R2", "label": "two", "target_class": {"id": "C2", "label": "c"}, "properties": [prop("P3", "third", "deep", 1, "C3")]},
        {"id": "R3", "label": "three", "target_class": {"id": "C3", "label": "c"}, "properties": [prop("P4", "fourth", None, 1, "C1")]},
        {"id": "R4", "label": "none", "target_class": {"id": "C4", "label": "c"}},
    ]
    (tmp_path / "t.json").write_text(json.dumps(data, indent=1))
    rows = templates.template_mapping(readers.template_scan(readers.whole_texts(spark, str(tmp_path / "t.json")), F.lit("m"))[0])
    got = sorted((r["pos"], r["level"], r["path1"], r["path2"], r["path3"], r["label"], r["cardinality"], r["description"], r["subtemplate_id"]) for r in rows.collect())
    assert [g[1:] for g in got] == [
        (1, "P1", None, None, "class C2", "one to many", "first", "R2"),
        (2, "P1", "P3", None, "class C3", "one to one", "deep", "R3"),
        (3, "P1", "P3", "P4", "class C1", "one to one", "fourth", None),
        (1, "P2", None, None, "path P2", "one to many", "second", None),
        (1, "P3", None, None, "class C3", "one to one", "deep", "R3"),
        (2, "P3", "P4", None, "class C1", "one to one", "fourth", "R1"),
        (3, "P3", "P4", "P1", "class C2", "one to many", "first", None),
        (3, "P3", "P4", "P2", "path P2", "one to many", "second", None),
        (1, "P4", None, None, "class C1", "one to one", "fourth", "R1"),
        (2, "P4", "P1", None, "class C2", "one to many", "first", "R2"),
        (3, "P4", "P1", "P3", "class C3", "one to one", "deep", None),
        (2, "P4", "P2", None, "path P2", "one to many", "second", None),
    ]
    text = templates.hierarchy_section(rows).first()[1]
    assert text.startswith(texts.OUTLINE_HEAD + "**class C2** (`orkgp:P1`)\n  └─ **class C3** (`orkgp:P3`)\n    └─ **class C1** (`orkgp:P4`)\n\n**path P2**")
    profiles = spark.createDataFrame([("m", "R186491", None, None)], "mapping string, template_id string, template_label string, target_class_id string")
    guidance = spark.createDataFrame(texts.GUIDANCE, texts.GUIDANCE_SCHEMA)
    prompt = templates.assemble_prompts(rows, profiles, guidance).first()["prompt_text"]
    assert 'Template: "Empirical Research Practice" (ID: R186491).' in prompt and "orkgc:C27001" in prompt
    assert "\n\n\n\nExclude non-empirical" in prompt and "<<" not in prompt


def test_ntriples_files(spark, tmp_path):
    (tmp_path / "t.nt").write_text('# c\n<a> <b> "x\\"\\u00e9\\\\"@EN .\n\n_:n <b> <c> . \n<a> <b> "1"^^<xsd:int> .\n<a> b "no" .\n')
    good, bad = readers.read_ntriples(spark, str(tmp_path))
    assert {tuple(r)[2:] for r in good.collect()} == {('x"é\\', "literal", None, "en"), ("c", "iri", None, None), ("1", "literal", "xsd:int", None)}
    assert [r[0] for r in bad.collect()] == ['<a> b "no" .']


def test_store_prunes_to_one_predicate(spark, campus, tmp_path):
    writers.write_triples(campus, str(tmp_path / "store"))
    t = writers.read_triples(spark, str(tmp_path / "store"))
    df = g.pattern(t, "livesIn", "x", "city")
    assert df.count() == 13
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "ReadSchema: struct<s:string,o:string>" in plan


def test_salted_join_is_the_plain_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("k"), "id")
    right = spark.createDataFrame([("hot", 1), ("1", 2), ("1", 3), ("x", 4)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a, b = lookup.salted_join(left, right, ["k"], how), left.join(right, ["k"], how)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    same = spark.range(1000).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m"))
    assert lookup.salted_join(same, right, ["k"]).filter("v = 1 and m['a'] = 1").count() == 1000
    salted = same.withColumn("s", F.pmod(lookup._row_number(), F.lit(lookup.SALTS)))
    assert salted.select("s").distinct().count() == lookup.SALTS


def test_sinks_keep_text_as_it_is(spark, tmp_path):
    df = spark.createDataFrame([("ä\n\"ß", None)], "a string, b string")
    writers.write_jsonl(df, str(tmp_path / "j"))
    text = "".join(p.read_text(encoding="utf8") for p in (tmp_path / "j").glob("part-*"))
    assert json.loads(text) == {"a": 'ä\n"ß', "b": None} and "ä" in text


def test_unlinked_pattern_neither_multiplies_nor_drops(spark, campus):
    people = g.instances(campus, "Person", "x")
    assert g.if_any(people, g.pattern(campus, "gpa")).count() == 13
    assert g.if_any(people, g.pattern(campus, "nothing")).count() == 0


def test_ties_are_kept(spark):
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 2), ("a", "z", 1), ("b", "x", 1)], "k string, v string, n bigint")
    assert {tuple(r) for r in g.most_frequent(counts, within="k").select("k", "v").collect()} == {("a", "x"), ("a", "y"), ("b", "x")}
    assert g.most_frequent(counts).count() == 2


def test_a_rendered_path_goes_before_the_base_name(spark):
    profiles = spark.createDataFrame(
        [("p", "f", "b", "dir/x.txt", True), ("q", "g", None, "gone.txt", None), ("r", "h", "b", " ", True), ("s", "i", "b", "dir/x.txt", False)],
        "profile string, family string, output_base_name string, latest_rendered_path string, enabled boolean",
    )
    families = profiles.select("family", "profile")
    versions = spark.createDataFrame([("b", 1, "old"), ("b", 2, "new")], "base string, version int, prompt_text string")
    rendered = spark.createDataFrame([("dir/x.txt", "of the path")], "path string, prompt_text string")
    found = {r.family: r.profile_error or r.template_text for r in prompts.prompt_table(profiles, families, versions, rendered).collect()}
    assert found == {
        "f": "of the path", "g": "Rendered prompt file not found for family 'g' (profile 'q')", "h": "new", "i": "Profile 's' is disabled.",
    }
    assert prompts.prompt_table(profiles.drop("latest_rendered_path"), families, versions).filter("family = 'f'").first().template_text == "new"


def test_json_lists_hold_the_rows_in_order(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i % 3 else f'"{i}}}é\n') for i in range(23)], "k int, t string").repartition(5)
    writers.write_json_lists(df, str(tmp_path / "l"), ["k"], 10)
    files = sorted((tmp_path / "l").glob("part=*/*.txt"))
    lists = [json.loads(p.read_text(encoding="utf8")) for p in files]
    assert [len(x) for x in lists] == [10, 10, 3]
    assert [r for x in lists for r in x] == [{"k": i, "t": None if i % 3 else f'"{i}}}é\n'} for i in range(23)]
