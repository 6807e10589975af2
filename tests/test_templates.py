"""Template expansion by levels of rows, against nested loops."""

import random
import re

import pytest

from tessella.operators import templates
from tessella.sources.readers import TEMPLATES_SCHEMA

SCHEMA = "mapping string, tpos int, id string, label string, target_class struct<id: string, label: string>, properties " + re.search(r"properties: (array<.*>)>>$", TEMPLATES_SCHEMA)[1]


def prop(path, cls, n):
    cls = {"id": cls, "label": f"class {cls} {n}"} if cls else None
    path = None if path is None else {"id": path, "label": f"path {path}"}
    return {"id": f"i{n}", "label": f"l{n}" if n % 3 else "", "description": f"d{n}" if n % 2 else None, "order": n, "min_count": 0, "max_count": [None, 1, 2][n % 3], "path": path, "class": cls, "datatype": None}


def own(template):
    """The last property of each path, where the path first was."""
    out = {}
    props = [p for p in template[5] or [] if p["path"] and p["path"]["id"]]
    for place, p in enumerate(props):
        out[p["path"]["id"]] = (out.get(p["path"]["id"], (place,))[0], p)
    return out


def brute(rows):
    out = []
    for mapping in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == mapping), key=lambda r: r[1])
        by_class = {r[4]["id"]: r for r in mine if r[4] and r[4]["id"]}
        top = {}
        for r in mine:
            for path, (place, p) in own(r).items():
                top[path] = (top[path][0] if path in top else (r[1], place), p)
        target = lambda p: by_class.get(p["class"]["id"]) if p["class"] else None

        def row(level, paths, p, pos):
            t = target(p) if level < 3 else None
            out.append((mapping, level, *paths, p["class"]["label"] if p["class"] else p["path"]["label"], p["description"] or p["label"] or p["path"]["label"],
                        p["class"]["id"] if t else None, t[2] if t else None, t[3] if t else None, pos))

        for p1, (at, v) in top.items():
            row(1, (p1, None, None), v, (*at, -1, -1))
            for p2, (n2, w) in own(target(v)).items() if target(v) else ():
                row(2, (p1, p2, None), w, (*at, n2, -1))
                for p3, (n3, x) in own(target(w)).items() if target(w) else ():
                    row(3, (p1, p2, p3), x, (*at, n2, n3))
    return sorted(out, key=repr)


def told(spark, rows, **kw):
    names = ("mapping", "level", "path1", "path2", "path3", "label", "description", "class_id", "subtemplate_id", "subtemplate_label")
    found = templates.template_mapping(spark.createDataFrame(rows, SCHEMA), **kw).collect()
    return sorted(((*(r[n] for n in names), tuple(r["pos"])) for r in found), key=repr)


def made(seed, mappings, hot):
    random.seed(seed)
    rows, n = [], 0
    for m in range(mappings):
        for t in range(random.randrange(1, 6)):
            props = []
            for _ in range(random.randrange(7)):
                n += 1
                cls = random.choice(["A", "B", "C", None, "none", ""]) if random.random() > hot else "A"
                props.append(prop(random.choice([f"P{random.randrange(9)}", "", None]), cls, n))
            cls = random.choice([{"id": c, "label": "x"} for c in ("A", "B", "C", "")] + [None])
            rows.append((f"m{m}", t, f"R{m}.{t}", f"T{t}", cls, random.choice([props, props, None])))
    return rows


@pytest.mark.parametrize("most", [templates.MOST_ROWS, 2])
def test_expansion_matches_nested_loops(spark, most):
    rows = made(1, 8, 0.3)
    assert told(spark, rows, most=most) == brute(rows)


@pytest.mark.parametrize("held", [0, 60, templates.MOST_HELD])
def test_gathered_and_joined_mappings_are_alike(spark, held):
    rows = made(5, 12, 0.4) + [(None, *r[1:]) for r in made(6, 1, 0.0)]
    named = [r for r in rows if r[0]]
    unnamed = [(*r[:6], None, None, None, None, r[10]) for r in brute([("", *r[1:]) for r in rows if not r[0]]) if r[1] == 1]
    assert [r for r in told(spark, rows, held=held) if r[0]] == brute(named)
    assert len([r for r in told(spark, rows, held=held) if not r[0]]) == len(unnamed)


def test_small_mappings_move_once_and_nothing_is_written(spark):
    df = templates.template_mapping(spark.createDataFrame(made(1, 8, 0.3), SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert "properties-" not in plan and "linked-" not in plan and "top-properties-" not in plan


def test_a_property_finds_those_below_it_without_looking_through_the_mapping(spark):
    rows = spark.createDataFrame(made(1, 8, 0.3), SCHEMA)
    plan = templates.template_mapping(rows)._jdf.queryExecution().optimizedPlan().toString()
    expanded = [line for line in plan.splitlines() if "Generate explode(" in line and "transform(" in line]
    assert expanded and not any("filter(" in line for line in expanded)


@pytest.mark.parametrize("held", [0, 60, templates.MOST_HELD])
def test_only_wanted_columns_are_made(spark, held):
    rows = spark.createDataFrame(made(5, 12, 0.4), SCHEMA)
    whole = templates.template_mapping(rows, held=held).select("mapping", "level", *templates.OUTLINED, "pos")
    wanted = templates.template_mapping(rows, held=held, columns=templates.OUTLINED)
    assert wanted.columns == whole.columns
    assert sorted(map(tuple, wanted.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
    sections = templates.hierarchy_section(wanted).collect()
    assert sorted(sections) == sorted(templates.hierarchy_section(templates.template_mapping(rows, held=held)).collect())


def test_a_class_of_nine_tenths_of_the_rows(spark):
    rows = [("m", 0, "R0", "big", {"id": "A", "label": "a"}, [prop(f"P{i}", "A" if i % 10 else "B", i) for i in range(60)])]
    rows += [("m", 1, "R1", "small", {"id": "B", "label": "b"}, [prop("Q", "A", 1), prop("Q2", None, 2)])]
    rows += made(2, 2, 0.9)
    assert told(spark, rows, most=5) == brute(rows)


@pytest.mark.parametrize("held", [0, 7, templates.LINES])
@pytest.mark.parametrize("size", [1, 3, templates.LINES])
def test_segments_put_together_are_the_sections(spark, held, size):
    rows = templates.template_mapping(spark.createDataFrame(made(7, 6, 0.3) + [(None, *r[1:]) for r in made(8, 1, 0.0)], SCHEMA)).cache()
    found = {}
    for r in sorted(templates.section_segments(rows, size, held).collect(), key=lambda r: r.segment):
        text, n = found.get((r.mapping, r.section), ("", 0))
        assert (r.segment, r.offset) == (n, len(text))
        found[r.mapping, r.section] = text + r.text, n + 1
    for r in templates.sections(rows.filter("mapping is not null")).collect():
        assert found.pop((r.mapping, "schema"))[0] == r.schema_section
        assert found.pop((r.mapping, "hierarchy"))[0] == r.hierarchy_section
    assert not found


def test_segments_of_small_mappings_move_no_row(spark, monkeypatch):
    monkeypatch.setattr(templates, "ranked", None)
    rows = templates.template_mapping(spark.createDataFrame(made(1, 8, 0.3), SCHEMA))
    plan = templates.section_segments(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan and "Window" not in plan
