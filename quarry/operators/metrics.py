"""Precision, recall and F1 of extracted records against curated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.numbers import precision_recall
from quarry.functions.text import materials_match, name_matches, values_match

PARTS = ("material", "value", "property")


def _sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with what any right row of the same paragraph matches: the material, the value, both in one row."""
    a = left.select(F.monotonically_increasing_id().alias("__row"), key, *[F.col(c).alias(f"e_{c}") for c in ("material", "material_coreferents", "property_value")])
    b = right.select(F.col(key), *[F.col(c).alias(f"o_{c}") for c in ("material", "material_coreferents", "property_value")])
    same_material = materials_match("e_material", "o_material", F.col("e_material_coreferents"), F.col("o_material_coreferents"))
    same_value = values_match("e_property_value", "o_property_value")
    hit = lambda c: F.coalesce(F.bool_or(F.coalesce(c, F.lit(False))), F.lit(False))
    return a.join(b, key, "left").groupBy("__row").agg(hit(same_material).alias("material"), hit(same_value).alias("value"), hit(same_material & same_value).alias("property"))


def _count(c: str | Column) -> Column:
    return F.count_if(F.col(c) if isinstance(c, str) else c)


def confusion(extracted: DataFrame, curated: DataFrame, names: list[str], key: str = "para_id") -> DataFrame:
    """(part, tp, fp, fn) for material, value, and both: tp and fp over extracted rows, fn over curated rows.

    Both tables: key, material, material_coreferents, property_name, property_value. Only
    rows of the named property count, and extracted rows of paragraphs that are curated.
    """
    listed = F.array(*map(F.lit, names))
    wanted = curated.where(name_matches("property_name", listed))
    found = extracted.where(name_matches("property_name", listed)).join(curated.select(key), key, "left_semi")
    e, c = _sided(found, wanted, key), _sided(wanted, found, key)
    tpfp = e.agg(*[_count(p).cast("long").alias(f"tp_{p}") for p in PARTS], *[_count(~F.col(p)).cast("long").alias(f"fp_{p}") for p in PARTS])
    fn = c.agg(*[_count(~F.col(p)).cast("long").alias(f"fn_{p}") for p in PARTS])
    one = tpfp.crossJoin(fn)
    return one.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"tp_{p}").alias("tp"), F.col(f"fp_{p}").alias("fp"), F.col(f"fn_{p}").alias("fn")) for p in PARTS])).alias("r")).select("r.*")


def metrics(extracted: DataFrame, curated: DataFrame, names: list[str], key: str = "para_id") -> DataFrame:
    """``confusion`` with precision, recall and f1."""
    return confusion(extracted, curated, names, key).withColumns(precision_recall("tp", "fp", "fn"))


def counters(extracted: DataFrame, curated: DataFrame, names: list[str], key: str = "para_id") -> DataFrame:
    """One row of 26 counters.

    tp, fp and fn of materials, values and both; curated paragraphs and rows; extracted rows of
    these; of either side the rows of the property, and how many of them the other side matches
    or not, by material, value and both.
    """
    listed = F.array(*map(F.lit, names))
    relevant = extracted.join(curated.select(key), key, "left_semi")
    found, wanted = relevant.where(name_matches("property_name", listed)), curated.where(name_matches("property_name", listed))
    short = {"material": "mat", "value": "val", "property": "prop"}

    def side(own: DataFrame, other: DataFrame, name: str) -> DataFrame:
        counts = [_count(F.col(p) if hit else ~F.col(p)).cast("long").alias(f"{short[p]}_{'' if hit else 'not_'}matched_iter_{name}") for p in PARTS for hit in (True, False)]
        return _sided(own, other, key).agg(F.count(F.lit(1)).alias(f"prop_{name}_rows"), *counts)

    totals = curated.agg(F.count_distinct(key).alias("para_from_curated"), F.count(F.lit(1)).alias("total_curated_rows"))
    one = side(found, wanted, "extracted").crossJoin(side(wanted, found, "curated")).crossJoin(totals).crossJoin(relevant.agg(F.count(F.lit(1)).alias("relevant_extracted_rows")))
    rates = [F.col(f"{short[p]}_{c}").alias(f"{k}_{short[p]}") for p in PARTS for k, c in (("tp", "matched_iter_extracted"), ("fp", "not_matched_iter_extracted"), ("fn", "not_matched_iter_curated"))]
    return one.select("*", *rates)


#: Price of a thousand tokens, and how much more a request with one shot costs.
PRICE, ONE_SHOT = 0.0015, 3.5


def token_costs(rows: DataFrame, tokens: Column, price: float = PRICE) -> DataFrame:
    """``rows`` with ``tokens`` and what they cost; the count of a tokenizer is passed in."""
    n = tokens.cast("long")
    return rows.withColumns({"tokens": n, "cost": n / F.lit(1000.0) * F.lit(price)})


def token_total(rows: DataFrame, tokens: Column, price: float = PRICE, one_shot: float = ONE_SHOT) -> DataFrame:
    """One row: all tokens, their cost, and the cost with one shot in every request."""
    total = F.coalesce(F.sum(tokens.cast("long")), F.lit(0))
    cost = total / F.lit(1000.0) * F.lit(price)
    return rows.agg(F.count(F.lit(1)).alias("requests"), total.alias("tokens"), cost.alias("cost"), (cost * F.lit(one_shot)).alias("one_shot_cost"))


def by_document(extracted: DataFrame, truth: DataFrame, key: str = "doi") -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of (document, material, property, value) rows, each matched at most once."""
    cols = [key, "material", "property", "value"]
    count = lambda df, name: df.groupBy(*cols).agg(F.count(F.lit(1)).alias(name))
    both = count(extracted, "e").join(count(truth, "t"), cols, "full_outer")
    e, t = F.coalesce("e", F.lit(0)), F.coalesce("t", F.lit(0))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sums = both.agg(total(F.least(e, t)).alias("tp"), total(e - F.least(e, t)).alias("fp"), total(t - F.least(e, t)).alias("fn"))
    return sums.withColumns(precision_recall("tp", "fp", "fn"))
