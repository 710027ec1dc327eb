"""Flags on extracted records, their scores, and the records without errors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import predicates as P

# fixed values: names of flags; the first four are errors where records are scored by default
ERRORS = {"unit": "invalid_property_unit", "prop": "invalid_property_name", "tabl": "is_table", "rang": "out_of_range"}
POLYMER, VALID_NAME = "is_polymer", "valid_property_name"


def _signed(name: str, sign: int) -> Column:
    return F.sum(F.when(F.col("filter_name") == name, sign).otherwise(0)).cast("long")


def scores(flags: DataFrame) -> DataFrame:
    """(prop_id, unit, prop, tabl, rang, poly, error, score): a row for each flagged record."""
    sums = flags.groupBy(F.col("table_row").alias("prop_id")).agg(*[_signed(f, -1).alias(c) for c, f in ERRORS.items()], _signed(POLYMER, 1).alias("poly"))
    return sums.withColumns({"error": F.col("unit") + F.col("prop") + F.col("tabl") + F.col("rang"), "score": F.col("poly")})


#: So many ids, and their scores, at most are sent to all executors: some MB.
FEW = 300_000


def selected_scores(flags: DataFrame, properties: DataFrame, method_id: int, filter_on: str) -> DataFrame:
    """The same per (filter_on, record) of one method and property, where a valid name counts for the record and is no error.

    The method's ids are counted first, ``FEW`` at most; where they are few, flags, and the
    records that these scores are joined with, are filtered where they are read and not shuffled.
    """
    ids = properties.where(F.col("method_id") == method_id).select(F.col("id").alias("table_row")).distinct()
    few = ids.limit(FEW + 1).count() <= FEW
    held = F.broadcast if few else lambda df: df
    own = flags.where(F.col("filter_on") == filter_on).join(held(ids), "table_row", "left_semi")
    sums = own.groupBy("filter_on", F.col("table_row").alias("prop_id")).agg(
        *[_signed(f, -1).alias(c) for c, f in ERRORS.items() if c != "prop"], _signed(POLYMER, 1).alias("poly"), _signed(VALID_NAME, 1).alias("prop")
    )
    return held(sums.withColumns({"error": F.col("unit") + F.col("tabl") + F.col("rang"), "score": F.col("poly")}))


def star(properties: DataFrame, materials: DataFrame, texts: DataFrame) -> DataFrame:
    """properties with their material and paragraph."""
    m = materials.select(F.col("id").alias("material_id"), F.col("entity_name").alias("material"), "material_class", "para_id")
    t = texts.select(F.col("id").alias("para_id"), "doi", "text")
    return properties.join(m, "material_id").join(t, "para_id")


def scored(properties: DataFrame, materials: DataFrame, texts: DataFrame, found: DataFrame, method: str, name: str, flagged_only: bool = False) -> DataFrame:
    """Records with error and score: unflagged ones have 0 and 0, or go if ``flagged_only``, before their material and text are looked up."""
    own, found = properties.withColumnRenamed("id", "prop_id"), found.select("prop_id", "error", "score")
    joined = star(own.join(found, "prop_id"), materials, texts) if flagged_only else star(own, materials, texts).join(found, "prop_id", "left")
    return joined.select(
        "doi", F.lit(method).alias("method"), "material", F.lit(name).alias("property"), F.col("numeric_value").alias("value"), "unit", "prop_id",
        F.coalesce("error", F.lit(0)).alias("error"), F.coalesce("score", F.lit(0)).alias("score"),
    )


def new_valid(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """Records without errors that are not in ``existing`` yet, as rows of extracted_data."""
    valid = rows.where(F.col("error") == 0).join(existing.select(F.col("property_id").alias("prop_id")), "prop_id", "left_anti")
    return valid.select(F.col("prop_id").alias("property_id"), "method", "material", "property", "value", "unit", "doi", F.col("score").cast("int").alias("confidence"))


@dataclass(frozen=True)
class Validator:
    """A flag: which records get it. ``selected``: only records already flagged with a valid name are looked at."""

    flag: str
    check: Callable[[], Column]
    selected: bool = False

    def flagged(self, records: DataFrame, filter_on: str, flags: DataFrame | None = None, table: str = "extracted_properties") -> DataFrame:
        """Rows of filtered_data for the records that fail (or pass) the check and don't have the flag yet."""
        rows = records
        if self.selected and flags is not None:
            rows = rows.join(flags.where((F.col("filter_name") == VALID_NAME) & (F.col("filter_on") == filter_on)).select(F.col("table_row").alias("id")), "id", "left_semi")
        if flags is not None:
            rows = rows.join(flags.where((F.col("filter_name") == self.flag) & (F.col("filter_on") == filter_on)).select(F.col("table_row").alias("id")), "id", "left_anti")
        return rows.where(self.check()).select(F.lit(table).alias("table_name"), F.col("id").alias("table_row"), F.lit(filter_on).alias("filter_on"), F.lit(self.flag).alias("filter_name"))


#: Checks over records joined with their property's metadata: entity_name, numeric_value, unit, material_class, text, other_names, units, lower_limit, upper_limit.
NAME = Validator("invalid_property_name", lambda: ~P.known_name("entity_name", F.col("other_names")))
NAME_SELECTOR = Validator(VALID_NAME, lambda: P.known_name("entity_name", F.col("other_names")))
RANGE = Validator("out_of_range", lambda: P.out_of_range("numeric_value", "lower_limit", "upper_limit"))
UNIT = Validator("invalid_property_unit", lambda: P.bad_unit("unit", F.col("units")))
IS_POLYMER = Validator(POLYMER, lambda: P.is_class("material_class"))
TABLE = Validator("is_table", lambda: P.looks_like_table("text"))
SELECTED_RANGE, SELECTED_UNIT, SELECTED_POLYMER, SELECTED_TABLE = (Validator(v.flag, v.check, True) for v in (RANGE, UNIT, IS_POLYMER, TABLE))
VALIDATORS = (NAME, RANGE, UNIT, IS_POLYMER, TABLE)
SELECTED_VALIDATORS = (NAME_SELECTOR, SELECTED_RANGE, SELECTED_UNIT, SELECTED_POLYMER, SELECTED_TABLE)


def all_flags(records: DataFrame, filter_on: str, validators: tuple[Validator, ...] = VALIDATORS, table: str = "extracted_properties") -> DataFrame:
    """Rows of filtered_data by all validators in one pass over the records."""
    selected = any(v.selected for v in validators)
    named = P.known_name("entity_name", F.col("other_names"))
    kept = F.array_compact(F.array(*[F.when(F.coalesce(v.check(), F.lit(False)) & (named if selected else F.lit(True)), F.lit(v.flag)) for v in validators]))
    return records.select(F.lit(table).alias("table_name"), F.col("id").alias("table_row"), F.lit(filter_on).alias("filter_on"), F.explode(kept).alias("filter_name"))


def with_metadata(records: DataFrame, metadata: DataFrame, name: str) -> DataFrame:
    """Records beside the limits, units and names of one property."""
    dim = metadata.where(F.col("name") == name).select("other_names", "units", "lower_limit", "upper_limit")
    return records.crossJoin(F.broadcast(dim.limit(1)))
