"""Filters of papers, paragraphs, records and tables as boolean columns, and their dimensions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import col

MATERIAL_LABELS = ("POLYMER", "MONOMER", "POLYMER_FAMILY", "ORGANIC", "INORGANIC")
POLYMER_LABELS = MATERIAL_LABELS[:3]


def mentions(word: str, *texts) -> Column:
    """Any of the texts holds the word, whatever its case; nulls hold nothing."""
    found = F.lit(False)
    for t in texts:
        found = found | F.contains(F.lower(F.coalesce(col(t), F.lit(""))), F.lit(word))
    return found


def has_keyword(text, keywords: list[str]) -> Column:
    """A keyword is in the text or in its lower case; keywords themselves keep their case."""
    c = col(text)
    found = F.lit(False)
    for k in keywords:
        found = found | c.contains(k) | F.lower(c).contains(k)
    return found


def keyword_hits(paragraphs: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """(all paragraph columns, property, hits): every property whose keywords a paragraph holds, in one pass.

    keywords: (property, keyword), a list that people write, so small; it is held as one array
    and looked up row by row, without a join.
    """
    listed = F.broadcast(keywords.groupBy().agg(F.collect_list(F.struct("property", "keyword")).alias("__k")))
    c = F.col(text)
    hit = F.filter("__k", lambda k: c.contains(k["keyword"]) | F.lower(c).contains(k["keyword"]))
    rows = paragraphs.join(listed).withColumn("__hit", hit).drop("__k")
    one = F.explode(F.array_distinct(F.transform("__hit", lambda k: k["property"])))
    return rows.select("*", one.alias("property")).withColumn("hits", F.size(F.filter("__hit", lambda k: k["property"] == F.col("property")))).drop("__hit")


def tagged_record(labels, polymer_only: bool = False) -> Column:
    """Labels name a property, a value and a material."""
    kinds = POLYMER_LABELS if polymer_only else MATERIAL_LABELS
    return F.array_contains(labels, "PROP_VALUE") & F.array_contains(labels, "PROP_NAME") & F.arrays_overlap(labels, F.array(*map(F.lit, kinds)))


def known_name(name, other_names) -> Column:
    """The name, whatever its case, is one of the property's names."""
    return F.coalesce(F.array_contains(F.transform(other_names, F.lower), F.lower(col(name))), F.lit(False))


def out_of_range(value, lower, upper) -> Column:
    """Not between the limits; a null limit is no limit, a null value is out of any range."""
    v = col(value)
    low, high = F.coalesce(col(lower), F.lit(float("-inf"))), F.coalesce(col(upper), F.lit(float("inf")))
    return ~F.coalesce(v.between(low, high), F.lit(False))


def bad_unit(unit, units) -> Column:
    """Not one of the property's units; no unit is right where the property has none."""
    u = F.lower(F.coalesce(col(unit), F.lit("")))
    allowed = F.coalesce(units, F.array().cast("array<string>"))
    return ~((u == "") & (F.size(allowed) == 0)) & ~F.array_contains(F.transform(allowed, F.lower), u)


def is_class(material_class, name: str = "polymer") -> Column:
    """The class by name, whatever its case."""
    return F.coalesce(F.lower(col(material_class)) == name.lower(), F.lit(False))


def looks_like_table(text, gaps: int = 3, width: int = 20) -> Column:
    """At least ``gaps`` stretches under ``width`` characters between neighbouring pairs of numbers."""
    parts = F.split(col(text), r"\s?\d+\s+\d+[%\s]?", -1)
    inner = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.size(F.filter(inner, lambda g: F.length(g) < width)) >= gaps


def valid_paragraph(text) -> Column:
    """A full stop, over 10 characters, over 5 words."""
    c = col(text)
    return c.contains(".") & (F.length(c) > 10) & (F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")) > 5)


def is_reference(text) -> Column:
    return col(text).rlike("http|doi")


def document_errors(title, abstract, paragraphs) -> Column:
    """What a parsed document lacks."""
    lacks = [F.when(F.coalesce(F.trim(col(c)), F.lit("")) == "", F.lit(f"no {c}")) for c in (title, abstract)]
    return F.array_compact(F.array(*lacks, F.when(F.coalesce(F.size(paragraphs), F.lit(0)) <= 0, F.lit("no paragraphs"))))


def unparsed_error(value, error) -> Column:
    return F.col(value).like("%+/-%") & (F.col(error) == 0)


def stray_unit(unit) -> Column:
    return col(unit) == "}"


def unclassed(material_class) -> Column:
    return col(material_class) == ""


def not_section(section, name: str) -> Column:
    """Any other section, or none."""
    return ~col(section).eqNullSafe(F.lit(name))


def matches_pattern(name, pattern) -> Column:
    """``pattern`` taken as a LIKE pattern, with its wildcards."""
    return F.like(col(name), col(pattern))


def enough_records(records, least: int) -> Column:
    return F.size(records) >= least


def chosen(frame: DataFrame, **allowed) -> DataFrame:
    """Rows whose columns are among the allowed values."""
    for name, values in allowed.items():
        frame = frame.where(F.col(name).isin(list(values)))
    return frame


def property_filters(spark: SparkSession, properties: list[str]) -> DataFrame:
    """The dimension of filter names: keyword filter, tag filter and property."""
    short = lambda p: re.sub(r"\W+", "-", p.lower()).strip("-")
    return spark.createDataFrame([(f"property_{short(p)}", f"ner_{short(p)}", p) for p in properties], "filter string, ner_filter string, name string")


def checked_choice(name: str, allowed: list[str]) -> str:
    if name not in allowed:
        raise ValueError(f"{name!r} is none of {sorted(allowed)}")
    return name
