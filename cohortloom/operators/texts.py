"""Text records: claims that reports must not make, GEO characteristics, module lists, free fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def banned_phrases(text: Column, phrases: list[str]) -> Column:
    """The phrases that a text holds, ignoring case and runs of white space."""
    flat = F.lower(F.regexp_replace(text, r"\s+", " "))
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(flat, F.lower(p)))


def characteristics(lines: DataFrame, n: int) -> DataFrame:
    """(key, pos, value) of cells 'key: value' in (line_no, pos, cell): keys with exactly one value for each of n samples.

    The first colon splits, keys are lower-cased.
    """
    pairs = lines.where(F.contains("cell", F.lit(":"))).select("line_no", "pos", F.lower(F.trim(F.substring_index("cell", ":", 1))).alias("key"), F.trim(F.expr("substring(cell, instr(cell, ':') + 1)")).alias("value"))
    good = pairs.groupBy("key").agg(F.count("*").alias("c"), F.count_distinct("pos").alias("k")).where((F.col("c") == n) & (F.col("k") == n)).select("key")
    return pairs.join(good, "key", "left_semi").select("key", "pos", "value")


def modules_from_gmt(lines: DataFrame) -> DataFrame:
    """(module, gene) of tab-separated name, description, genes; lines of under three fields are skipped, repeats within a module count once."""
    f = F.split("value", "\t")
    return lines.where(F.size(f) >= 3).select(F.get(f, F.lit(0)).alias("module"), F.explode(F.slice(f, 3, F.greatest(F.size(f), F.lit(3)))).alias("gene")).where(F.trim("gene") != "").distinct()


def strip_version(gene: Column) -> Column:
    return F.substring_index(gene, ".", 1)


#: What a published value must not hold: sample accessions, home folders, mail addresses (fixed values).
PROHIBITED_VALUES = r"GSM[0-9]{3,}|/home/[^/ ]+|/Users/[^/ ]+|[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+"


def prohibited_value(text: Column) -> Column:
    """Whether a value holds what must not be published."""
    return text.rlike(PROHIBITED_VALUES)


#: Conditions of sample names and their labels (fixed values).
CONDITIONS = {"con": "unexposed", "control": "unexposed", "e-cigs": "vape", "ecig": "vape", "ecigs": "vape"}


def sample_of_file(path: Column) -> Column:
    """(sample, condition, label) of a file name GSM<n>_<condition>_...; an unknown condition has no label."""
    name = F.element_at(F.split(path, "/"), -1)
    sample, condition = F.regexp_extract(name, r"^(GSM\d+)_([^_]+)_", 1), F.regexp_extract(name, r"^(GSM\d+)_([^_]+)_", 2)
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv]), F.lower(condition))
    return F.struct(F.nullif(sample, F.lit("")).alias("sample"), F.nullif(condition, F.lit("")).alias("condition"), label.alias("label"))
