"""From a family to the final prompt of each entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import has_text, rstrip, strip
from tessella.operators.lookup import lookup_join
from tessella.operators.templates import latest_prompts

# Placeholders and the section appended when there is none.
PLACEHOLDERS = ("{{QUESTION}}", "[Research Question]")
INPUT_SECTION = "\n\n## Input\n**Research Question:** %s\n"


def resolve_profiles(entries: DataFrame, family_to_profile: DataFrame) -> DataFrame:
    """Add ``profile``; it stays null for a family nobody mapped."""
    return lookup_join(entries, family_to_profile.select("family", "profile"), ["family"])


def unknown_families(entries: DataFrame, family_to_profile: DataFrame) -> DataFrame:
    """Each unmapped family with its number of entries."""
    return entries.groupBy("family").agg(F.count("*").alias("entries")).join(family_to_profile, "family", "left_anti")


def enabled_profiles(profiles: DataFrame) -> DataFrame:
    """Only an explicit false disables a profile."""
    return profiles.filter(F.coalesce("enabled", F.lit(True)))


def inject_question(prompt: Column, question: Column) -> Column:
    """P10: fill the first kind of placeholder present, else append a section."""
    asked = strip(question)
    filled = F.when(F.contains(prompt, F.lit(PLACEHOLDERS[0])), F.replace(prompt, F.lit(PLACEHOLDERS[0]), asked))
    filled = filled.when(F.contains(prompt, F.lit(PLACEHOLDERS[1])), F.replace(prompt, F.lit(PLACEHOLDERS[1]), asked))
    return filled.otherwise(F.concat(rstrip(prompt), F.format_string(INPUT_SECTION, asked)))


def prompt_table(profiles: DataFrame, family_to_profile: DataFrame, prompts: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    """The latest prompt text per family, with the reason when there is none.

    A profile that names a ``latest_rendered_path`` gets the text of that path in
    ``rendered`` (``path, prompt_text``), whatever its base name; any other the
    latest version of its base name in ``prompts``.
    """
    if "latest_rendered_path" not in profiles.columns:
        profiles = profiles.withColumn("latest_rendered_path", F.lit(None).cast("string"))
    direct = has_text(F.col("latest_rendered_path"))
    profiles = profiles.withColumn("rendered_path", F.when(direct, F.col("latest_rendered_path")))
    known = family_to_profile.join(profiles.drop("family").withColumn("known", F.lit(True)), "profile", "left")
    latest = latest_prompts(prompts).select(F.col("base").alias("output_base_name"), F.col("prompt_text").alias("of_base"))
    found = known.join(latest, "output_base_name", "left")
    if rendered is None:
        found = found.withColumn("of_path", F.lit(None).cast("string"))
    else:
        one = rendered.groupBy(F.col("path").alias("rendered_path")).agg(F.min("prompt_text").alias("of_path"))
        found = found.join(one, "rendered_path", "left")
    text = F.when(F.col("rendered_path").isNotNull(), F.col("of_path")).otherwise(F.col("of_base"))
    return found.withColumn("prompt_text", text).select(
        "family",
        "profile",
        F.col("prompt_text").alias("template_text"),
        F.when(F.col("known").isNull(), F.format_string("Profile '%s' does not exist in prompt_profiles.json.", "profile"))
        .when(~F.coalesce("enabled", F.lit(True)), F.format_string("Profile '%s' is disabled.", "profile"))
        .when(F.col("rendered_path").isNull() & ~has_text(F.col("output_base_name")), F.format_string("Profile '%s' must define a non-empty 'output_base_name'", "profile"))
        .when(~has_text(F.col("prompt_text")), F.format_string("Rendered prompt file not found for family '%s' (profile '%s')", "family", "profile"))
        .alias("profile_error"),
    )


def build_prompts(entries: DataFrame, table: DataFrame) -> DataFrame:
    """Add ``prompt`` and ``prompt_error`` to every entry.

    ``table`` is the per-family prompt table.  Few families share all entries,
    so the table goes through the measured lookup join rather than a shuffle of
    the entries by family.
    """
    joined = lookup_join(entries, table.withColumn("known", F.lit(True)), ["family"])
    error = (
        F.when(~has_text(F.col("family")), "Entry is missing a valid 'family' field.")
        .when(~has_text(F.col("question")), "Entry is missing a valid 'question' field.")
        .when(F.col("known").isNull(), F.format_string("No prompt profile mapping found for family '%s'.", "family"))
        .otherwise(F.col("profile_error"))
    )
    return (
        joined.withColumn("prompt_error", error)
        .withColumn("prompt", F.when(F.col("prompt_error").isNull(), inject_question(F.col("template_text"), F.col("question"))))
        .drop("known", "profile", "template_text", "profile_error")
    )
