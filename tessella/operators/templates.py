"""Template hierarchies as flat mapping rows, and their rendered text.

A mapping is a set of templates rendered together, named by column ``mapping``.
A run renders any number of mappings at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tessella.operators import prompt_texts as texts
from tessella.operators.lookup import MOST_ROWS, lookup_join, split_join
from tessella.operators.ordered import LINES, ranked, segments
from tessella.session import written


def cardinality(max_count: Column) -> Column:
    """No upper bound, or one above 1, is many."""
    return F.when(max_count.isNull() | (max_count > 1), texts.MANY).otherwise(texts.ONE)


def shown_label(class_label: Column, path_label: Column) -> Column:
    """An empty class label is kept, only a missing one falls through."""
    return F.coalesce(class_label, path_label)


def shown_description(description: Column, label: Column, path_label: Column) -> Column:
    """Here an empty text falls through as well."""
    return F.coalesce(F.nullif(description, F.lit("")), F.nullif(label, F.lit("")), path_label)


# What a mapping row shows of its property, and of the template that its class stands for.
SHOWN = ("label", "cardinality", "description", "predicate_label", "class_label", "class_id", "target_id", "target_label", "target")


def _own_properties(templates: DataFrame) -> DataFrame:
    """One row ``mapping, tpos, path, place`` per template and path, with what is shown.

    The later property wins, in the place where the path first appeared.
    """
    props = F.filter("properties", lambda p: F.length(p["path"]["id"]) > 0)
    rows = templates.select("mapping", "tpos", F.posexplode_outer(props).alias("place", "p")).filter("p is not null")
    path, cls = F.col("p.path"), F.col("p.class")
    shown = F.struct(
        shown_label(cls["label"], path["label"]).alias("label"),
        cardinality(F.col("p.max_count")).alias("cardinality"),
        shown_description(F.col("p.description"), F.col("p.label"), path["label"]).alias("description"),
        path["label"].alias("predicate_label"),
        cls["label"].alias("class_label"),
        F.nullif(cls["id"], F.lit("")).alias("class_id"),
    )
    own = rows.groupBy("mapping", "tpos", path["id"].alias("path")).agg(F.max_by(shown, "place").alias("v"), F.min("place").alias("place"))
    return own.select("mapping", "tpos", "path", "place", "v.*")


def _linked(templates: DataFrame, most: int) -> DataFrame:
    """Properties with ``target``, the place of the last template of their class, and its id and label."""
    own = written(_own_properties(templates), "properties")
    targets = (
        templates.filter(F.length("target_class.id") > 0)
        .groupBy("mapping", F.col("target_class.id").alias("class_id"))
        .agg(F.max_by(F.struct(F.col("id").alias("target_id"), F.col("label").alias("target_label"), F.col("tpos").alias("target")), "tpos").alias("t"))
        .select("mapping", "class_id", "t.*")
    )
    classed = own.filter("class_id is not null")
    popularity = classed.groupBy("mapping", "class_id").agg(F.count("*").alias("n"))
    found = split_join(classed, targets, ["mapping", "class_id"], popularity, ["tpos", "path"], "left", most)
    none = own.filter("class_id is null").withColumns({c: F.lit(None).cast(t) for c, t in targets.dtypes if c not in ("mapping", "class_id")})
    return written(found.unionByName(none), "linked")


MOST_HELD = 100_000  # rows that a mapping may come to, at worst, to be made by one task


# Columns of a mapping row besides its mapping, level and place.
MAPPED = (
    "path1", "path2", "path3", "label", "cardinality", "description", "predicate_label", "class_label",
    "class_id", "subtemplate_id", "subtemplate_label",
)


def template_mapping(templates: DataFrame, most: int = MOST_ROWS, held: int = MOST_HELD, columns: Sequence[str] = MAPPED) -> DataFrame:
    """Property, subtemplate and nested rows of every mapping.

    ``templates`` has ``mapping, tpos, id, label, target_class, properties``,
    one row per template.  A property whose class is some template's target
    class carries that template's properties below it, two levels deep.  The
    later template wins for a class and the later property for a path, while a
    path keeps the place where it first appeared.

    A mapping that comes to no more than ``held`` rows is gathered and made where its templates meet: they move
    once and nothing is written.  Others go through joins; those of a null name do as well.
    ``columns`` names those of ``MAPPED`` that are wanted; others aren't made.

    There each property is linked to its class's template once.  Levels then are joins
    of rows: those of one level are known by their paths and the template they
    lead to, and meet that template's properties.  How many rows lead to each
    template is counted before, so a popular one's rows are split over many tasks.
    """
    # at most a row per property, one per property of a template below it, and one per property below that
    each = templates.select("mapping", F.greatest(F.size("properties"), F.lit(0)).cast("double").alias("n"))
    sizes = each.groupBy("mapping").agg(F.sum("n").alias("n"), F.max("n").alias("m"))
    large = sizes.filter(F.col("mapping").isNull() | (F.col("n") * (1 + F.col("m") + F.col("m") * F.col("m")) > held))
    large = written(large.select(F.col("mapping").alias("__large")), "large-mappings")
    wanted = [c for c in MAPPED if c in columns]
    held_rows = _gathered(templates.join(large, F.col("mapping") == F.col("__large"), "left_anti").filter("mapping is not null"), wanted)
    if not large.limit(1).count():
        return held_rows
    others = _by_levels(templates.join(large, F.col("mapping").eqNullSafe(F.col("__large")), "left_semi"), most)
    return held_rows.unionByName(others.select("mapping", "level", *wanted, "pos"))


def _gathered(templates: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``template_mapping`` of mappings that a task holds."""
    one = templates.groupBy("mapping").agg(F.collect_list(F.struct("tpos", "id", "label", "target_class", "properties")).alias("ts"))
    classes = F.filter("ts", lambda t: F.length(t["target_class"]["id"]) > 0)

    def target(cls: Column) -> Column:
        """The last template of a class."""
        of_class = F.filter("classes", lambda c: c["target_class"]["id"] == cls)
        return F.array_max(F.transform(of_class, lambda c: F.struct(c["tpos"].alias("target"), c["id"].alias("target_id"), c["label"].alias("target_label"))))

    def own(t: Column) -> Column:
        """The template's last property of each path, in the place where the path first was."""
        props = F.filter(t["properties"], lambda p: F.length(p["path"]["id"]) > 0)
        paths = F.transform(props, lambda p: p["path"]["id"])
        placed = F.transform(props, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
        last = F.filter(placed, lambda x: ~F.array_contains(F.slice(paths, x["i"] + 2, F.size(paths) + 1), x["p"]["path"]["id"]))

        def shown(x: Column) -> Column:
            p = x["p"]
            path, cls = p["path"], p["class"]
            texts_of = {
                "label": shown_label(cls["label"], path["label"]),
                "cardinality": cardinality(p["max_count"]),
                "description": shown_description(p["description"], p["label"], path["label"]),
                "predicate_label": path["label"],
                "class_label": cls["label"],
                "class_id": F.nullif(cls["id"], F.lit("")),
            }
            return F.struct(
                t["tpos"].alias("tpos"),
                (F.array_position(paths, path["id"]) - 1).cast("int").alias("place"),
                path["id"].alias("path"),
                *(c.alias(n) for n, c in texts_of.items() if n in wanted),
                target(F.nullif(cls["id"], F.lit(""))).alias("to"),
            )

        return F.coalesce(F.transform(last, shown), F.array())

    one = one.select("mapping", "ts", classes.alias("classes"))
    one = one.select("mapping", F.flatten(F.transform("ts", own)).alias("ps"), F.array_distinct(F.transform("ts", lambda t: t["tpos"])).alias("places"))
    # each place's properties are looked for once, and a property knows by number where those below it are;
    # the null before them is the row of the property above
    groups = F.transform("places", lambda place: F.concat(F.array(F.lit(None)), F.filter("ps", lambda c: c["tpos"] == place)))
    numbered = F.transform("ps", lambda p: p.withField("group", F.array_position("places", p["to"]["target"]) - 1))
    one = one.select("mapping", "places", numbered.alias("ps")).select("mapping", "ps", groups.alias("groups"))
    by_path = F.transform(F.array_distinct(F.transform("ps", lambda p: p["path"])), lambda path: F.filter("ps", lambda p: p["path"] == path))
    top = F.transform(
        "by_path",
        lambda of: F.struct(
            F.array_max(of).alias("v"),  # of the last template: tpos comes first
            F.array_min(F.transform(of, lambda p: F.struct(p["tpos"].alias("t"), p["place"].alias("p1")))).alias("at"),
        ),
    )
    # rows are made by compiled explosions; a lambda would be interpreted for each of them
    below = lambda p: F.explode_outer(F.get("groups", F.col(p)["group"].cast("int")))
    rows = one.select("mapping", "groups", by_path.alias("by_path")).select("mapping", "groups", F.explode(top).alias("x"))
    rows = rows.select("mapping", "groups", F.col("x.v").alias("v1"), F.col("x.at").alias("at"))
    rows = rows.select("*", below("v1").alias("v2")).select("*", below("v2").alias("v3"))

    level = F.when(F.col("v2").isNull(), 1).when(F.col("v3").isNull(), 2).otherwise(3)
    shown_of = lambda c: F.when(F.col("v2").isNull(), F.col("v1")[c]).when(F.col("v3").isNull(), F.col("v2")[c]).otherwise(F.col("v3")[c])
    to = F.when(F.col("v2").isNull(), F.col("v1")["to"]).when(F.col("v3").isNull(), F.col("v2")["to"])
    made = {f"path{i}": F.col(f"v{i}")["path"] for i in (1, 2, 3)}
    made |= {c: shown_of(c) for c in ("label", "cardinality", "description", "predicate_label", "class_label") if c in wanted}
    if "class_id" in wanted:
        made |= {"class_id": F.when(to.isNotNull(), shown_of("class_id"))}
    made |= {f"subtemplate_{c}": to[f"target_{c}"] for c in ("id", "label")}
    at = {"t": F.col("at.t"), "p1": F.col("at.p1"), "p2": F.coalesce(F.col("v2.place"), F.lit(-1)), "p3": F.coalesce(F.col("v3.place"), F.lit(-1))}
    return rows.select("mapping", level.alias("level"), *(made[c].alias(c) for c in wanted), F.struct(*(c.alias(n) for n, c in at.items())).alias("pos"))


def _by_levels(templates: DataFrame, most: int) -> DataFrame:
    """``template_mapping`` of mappings of any size."""
    linked = _linked(templates, most)
    top = linked.groupBy("mapping", F.col("path").alias("path1")).agg(
        F.max_by(F.struct(*SHOWN), "tpos").alias("v"), F.min(F.struct(F.col("tpos").alias("t"), F.col("place").alias("p1"))).alias("at")
    )
    top = written(top.select("mapping", "path1", "at.t", "at.p1", "v.*"), "top-properties")
    below = linked.select("mapping", F.col("tpos").alias("target"), F.col("path").alias("path_"), F.col("place").alias("place_"), *(F.col(c).alias(f"{c}_") for c in SHOWN))

    def children(rows: DataFrame, popularity: DataFrame, path: str, place: str) -> DataFrame:
        """The properties of the templates that ``rows`` lead to."""
        ids = rows.filter("target is not null").drop(*(c for c in SHOWN if c != "target"))
        found = split_join(ids, below, ["mapping", "target"], popularity, [c for c in ids.columns if c.startswith("path")], "inner", most)
        named = {"path_": path, "place_": place} | {f"{c}_": c for c in SHOWN}
        return found.drop("target").withColumnsRenamed(named)

    first = top.filter("target is not null").groupBy("mapping", "target").agg(F.count("*").alias("n"))
    step = below.filter("target_ is not null").groupBy("mapping", "target", "target_").agg(F.count("*").alias("k"))
    second = first.join(step, ["mapping", "target"]).groupBy("mapping", F.col("target_").alias("target")).agg(F.sum(F.col("n") * F.col("k")).alias("n"))
    subs = children(top, first, "path2", "p2")
    nested = children(subs, second, "path3", "p3")

    def rows(df: DataFrame, level: int) -> DataFrame:
        found = F.col("target").isNotNull() if level < 3 else F.lit(False)
        at = {"t": F.col("t"), "p1": F.col("p1"), "p2": F.col("p2") if level > 1 else F.lit(-1), "p3": F.col("p3") if level > 2 else F.lit(-1)}
        none = F.lit(None).cast("string")
        return df.select(
            "mapping",
            F.lit(level).alias("level"),
            "path1",
            (F.col("path2") if level > 1 else none).alias("path2"),
            (F.col("path3") if level > 2 else none).alias("path3"),
            "label", "cardinality", "description", "predicate_label", "class_label",
            F.when(found, F.col("class_id")).alias("class_id"),
            F.when(found, F.col("target_id")).alias("subtemplate_id"),
            F.when(found, F.col("target_label")).alias("subtemplate_label"),
            F.struct(*(c.alias(n) for n, c in at.items())).alias("pos"),
        )

    return rows(top, 1).unionByName(rows(subs, 2)).unionByName(rows(nested, 3))


def _formatted(text: str, *values: Column | str) -> Column:
    """``text`` with its ``%s`` filled in; unlike ``format_string`` compiled, and an unbound value is ``null`` as there."""
    parts = [F.lit(text.split("%s")[0])]
    for value, after in zip(values, text.split("%s")[1:], strict=True):
        parts += [F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("null")), F.lit(after)]
    return F.concat(*parts)


def schema_line() -> Column:
    """One table line per mapping row."""
    own = F.coalesce("path3", "path2", "path1")
    kind = F.when(F.col("cardinality") == texts.MANY, texts.PREDICATE_MANY).otherwise(texts.PREDICATE)
    usage = (
        F.when(F.col("level") == 1, _formatted(texts.USAGE[0], "path1"))
        .when(F.col("level") == 2, _formatted(texts.USAGE[1], "path1", "path2"))
        .otherwise(_formatted(texts.USAGE[2], "path1", "path2", "path3"))
    )
    indent = F.when(F.col("level") == 1, texts.ROW_INDENT[0]).when(F.col("level") == 2, texts.ROW_INDENT[1]).otherwise(texts.ROW_INDENT[2])
    return _formatted(texts.SCHEMA_ROW, indent, "label", own, kind, "description", usage)


def hierarchy_line() -> Column:
    """P5: one outline line per mapping row."""
    own = F.coalesce("path3", "path2", "path1")
    indent = F.when(F.col("level") == 1, texts.OUTLINE_INDENT[0]).when(F.col("level") == 2, texts.OUTLINE_INDENT[1]).otherwise(texts.OUTLINE_INDENT[2])
    return _formatted(texts.OUTLINE_ROW, indent, "label", own)


def sections(rows: DataFrame, wanted: Sequence[str] = ("schema_section", "hierarchy_section")) -> DataFrame:
    """Property table and outline of each mapping, parent before child.

    The wanted texts come from one grouping of the rows.  In the outline a blank line
    closes each top property.
    """
    made = {"schema_section": schema_line(), "hierarchy_section": hierarchy_line()}
    lines = rows.select("mapping", F.struct("pos", "level", *(made[w].alias(w) for w in wanted)).alias("line"))
    # lines are never null; sort_array has no lambda to interpret at each comparison, as array_sort does
    grouped = lines.groupBy("mapping").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    # a top line after the first is preceded by the blank line that ends the block before it
    gap = lambda r, i: F.when((r["level"] == 1) & (i > 0), F.lit("\n")).otherwise(F.lit(""))
    outline = F.array_join(F.transform("lines", lambda r, i: F.concat(gap(r, i), r["hierarchy_section"])), "")
    texts_of = {
        "schema_section": F.concat(F.lit(texts.SCHEMA_HEAD), F.array_join("lines.schema_section", "")),
        "hierarchy_section": F.concat(F.lit(texts.OUTLINE_HEAD), outline, F.lit("\n"), F.lit(texts.OUTLINE_FOOT)),
    }
    return grouped.select("mapping", *(texts_of[w].alias(w) for w in wanted))


def section_segments(rows: DataFrame, size: int = LINES, held: int = LINES) -> DataFrame:
    """P4, P5 for mappings of any length: ``mapping, section, segment, offset, text``.

    ``section`` is ``schema`` or ``hierarchy``. A section's heading goes with its first segment and its end with its
    last, so that the segments in order are the section.  Mappings of at most ``held`` rows, which are
    counted before, are cut where their rows meet; those of more are ranked across tasks and every segment of ``size``
    rows is rendered by its own.
    """
    rows = rows.filter("mapping is not null")
    counts = rows.groupBy("mapping").agg(F.count("*").alias("n"))
    long = written(counts.filter(F.col("n") > held).select(F.col("mapping").alias("__long")), "long-mappings")
    if not long.limit(1).count():
        return _short_segments(rows, size)
    of_long = F.col("mapping") == F.col("__long")
    return _short_segments(rows.join(long, of_long, "left_anti"), size).unionByName(_long_segments(rows.join(long, of_long, "left_semi"), size))


def _short_segments(rows: DataFrame, size: int) -> DataFrame:
    """``section_segments`` of mappings that a task holds."""
    outline = F.concat(F.when(F.col("level") == 1, "\n").otherwise(""), hierarchy_line())
    lines = rows.select("mapping", "pos", "level", schema_line().alias("schema"), outline.alias("outline"))
    line = F.struct("pos", "level", "schema", "outline", F.length("schema").cast("long").alias("ns"), F.length("outline").cast("long").alias("no"))
    one = lines.groupBy("mapping").agg(F.sort_array(F.collect_list(line)).alias("lines"))
    # no blank line before the first one
    first = F.when(F.col("lines")[0]["level"] == 1, 1).otherwise(0)
    head = lambda c, made: F.concat(F.array(made(F.col("lines")[0][c])), F.slice(F.col("lines")[c], 2, F.size("lines")))
    one = one.select(
        "mapping",
        F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / size).cast("int")).alias("ks"),
        F.col("lines.schema").alias("schema"),
        head("outline", lambda c: F.substring(c, first + 1, F.length(c))).alias("outline"),
        F.col("lines.ns").alias("ns"),
        head("no", lambda c: c - first).alias("no"),
    )
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    cut = lambda c, k: F.slice(c, k * size + 1, size)
    lengths = lambda c: F.transform("ks", lambda k: total(cut(F.col(c), k)))
    one = one.select("mapping", "ks", "schema", "outline", lengths("ns").alias("ns"), lengths("no").alias("no"))
    each = one.select("*", F.explode_outer("ks").alias("k"))

    def section(name: str, line: str, length: str, heading: str, end: str) -> Column:
        before = total(F.slice(length, F.lit(1), F.col("k"))) + F.when(F.col("k") > 0, len(heading)).otherwise(0)
        text = F.concat(
            F.when(F.col("k") == 0, heading).otherwise(""),
            F.array_join(cut(F.col(line), F.col("k")), ""),
            F.when(F.col("k") == F.size("ks") - 1, end).otherwise(""),
        )
        return F.struct(F.lit(name).alias("section"), before.alias("offset"), text.alias("text"))

    both = F.array(section("schema", "schema", "ns", texts.SCHEMA_HEAD, ""), section("hierarchy", "outline", "no", texts.OUTLINE_HEAD, "\n" + texts.OUTLINE_FOOT))
    found = each.select("mapping", F.col("k").cast("long").alias("segment"), F.explode(both).alias("s"))
    return found.select("mapping", "s.section", "segment", "s.offset", "s.text")


def _long_segments(rows: DataFrame, size: int) -> DataFrame:
    """``section_segments`` of mappings of any length."""
    ranked_rows = ranked(rows.withColumn("__order", F.struct("pos")), ["mapping"], ["__order"])
    sizes = ranked_rows.groupBy("mapping").agg(F.max("rank").alias("__last"))
    placed = ranked_rows.join(sizes, "mapping")
    first, last = F.col("rank") == 0, F.col("rank") == F.col("__last")
    gap = F.when((F.col("level") == 1) & ~first, "\n").otherwise("")
    schema = F.concat(F.when(first, texts.SCHEMA_HEAD).otherwise(""), schema_line())
    end = F.when(last, F.lit("\n" + texts.OUTLINE_FOOT)).otherwise("")
    outline = F.concat(F.when(first, texts.OUTLINE_HEAD).otherwise(""), gap, hierarchy_line(), end)
    both = F.array(F.struct(F.lit("schema").alias("section"), schema.alias("line")), F.struct(F.lit("hierarchy").alias("section"), outline.alias("line")))
    lines = placed.select("mapping", "rank", F.explode(both).alias("s")).select("mapping", "rank", "s.section", "s.line")
    return segments(lines, ["mapping", "section"], "rank", "line", size)


OUTLINED = ("path1", "path2", "path3", "label")  # columns of a mapping row that the outline shows


def schema_section(rows: DataFrame) -> DataFrame:
    """P4."""
    return sections(rows, ["schema_section"])


def hierarchy_section(rows: DataFrame) -> DataFrame:
    """P5."""
    return sections(rows, ["hierarchy_section"])


def assemble_prompts(rows: DataFrame, profiles: DataFrame, guidance: DataFrame) -> DataFrame:
    """The whole prompt text of every profile with a mapping.

    ``profiles`` has ``mapping, template_id, template_label, target_class_id``
    and ``guidance`` has ``template_id, guidance_label`` and the five optional
    parts.  A template without guidance leaves that section out.
    """
    known = lookup_join(profiles.join(sections(rows), "mapping"), guidance, ["template_id"])
    name = F.coalesce(F.nullif("template_label", F.lit("")), F.col("guidance_label"), F.col("template_id"))
    target = F.coalesce(F.nullif("target_class_id", F.lit("")), F.lit(texts.DEFAULT_CLASS))
    present = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    parts = [F.when(present("domain_knowledge"), F.col("domain_knowledge")).otherwise("")]
    parts += [F.when(present(c), F.concat(F.lit("\n\n"), F.col(c))).otherwise("") for c in texts.GUIDANCE_PARTS[1:]]
    guided = F.when(F.col("guidance_label").isNotNull(), F.concat(F.lit(texts.GUIDANCE_HEAD), *parts)).otherwise("")

    def fill(text: str) -> Column:
        c = F.replace(F.lit(text), F.lit("<<LABEL>>"), F.col("__name"))
        c = F.replace(c, F.lit("<<TEMPLATE>>"), F.col("template_id"))
        return F.replace(c, F.lit("<<CLASS>>"), F.col("__target"))

    return known.withColumns({"__name": name, "__target": target}).select(
        "mapping",
        "template_id",
        F.concat(fill(texts.BASE), F.col("schema_section"), F.col("hierarchy_section"), guided, fill(texts.RULES)).alias("prompt_text"),
    )


def name_version(name: Column) -> Column:
    """Struct of base and version parsed from ``<base>_v<N>.json|txt``."""
    return F.struct(
        F.regexp_extract(name, texts.VERSIONED_NAME, 1).alias("base"),
        F.nullif(F.regexp_extract(name, texts.VERSIONED_NAME, 2), F.lit("")).try_cast("decimal(38,0)").alias("version"),
    )


def next_versions(bases: DataFrame, names: DataFrame) -> DataFrame:
    """``base, next_version`` for every base, 1 when it has no file yet."""
    parsed = names.select(name_version(F.col("name")).alias("n")).filter("n.version is not null")
    seen = parsed.groupBy(F.col("n.base").alias("base")).agg(F.max("n.version").alias("top"))
    return bases.select("base").distinct().join(seen, "base", "left").select(
        "base", (F.coalesce("top", F.lit(0)).cast("decimal(38,0)") + 1).cast("decimal(38,0)").alias("next_version")
    )


def latest_prompts(prompts: DataFrame) -> DataFrame:
    """The row of the highest version per base name."""
    kept = [c for c in prompts.columns if c != "base"]
    newest = prompts.groupBy("base").agg(F.max_by(F.struct(*kept), "version").alias("r"))
    return newest.select("base", "r.*")
