"""Ordered operators over the tokens, sentences and rows of one paragraph or partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import join_tokens
from quarry.operators.predicates import MATERIAL_LABELS


def islands(rows: DataFrame, part: list[str], order: str, label: str) -> DataFrame:
    """rows with ``island``: numbers, from 1, the runs of equal labels."""
    w = Window.partitionBy(*part).orderBy(order)
    new = F.coalesce((~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    return rows.withColumn("__new", F.when(first, 1).otherwise(new)).withColumn("island", F.sum("__new").over(w)).drop("__new")


def grouped_tokens(tokens: DataFrame, part: list[str], order: str = "pos") -> DataFrame:
    """(part, text, label, token_start, token_end): runs of one label joined; unlabelled tokens (``O``) stay single."""
    w = Window.partitionBy(*part).orderBy(order)
    same = F.col("label").eqNullSafe(F.lag("label").over(w)) & (F.col("label") != "O")
    marked = tokens.withColumn("__g", F.sum(F.when(same, 0).otherwise(1)).over(w))
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return marked.groupBy(*part, "__g").agg(
        join_tokens(F.array_join(parts, " ")).alias("text"), F.first("label").alias("label"), F.min(order).alias("token_start"), F.max(order).alias("token_end")
    ).drop("__g")


def with_sentence(tokens: DataFrame, part: list[str], order: str = "pos", text: str = "text") -> DataFrame:
    """tokens with ``sentence`` from 0: a token that is, or ends in, a full stop is its sentence's last."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return tokens.withColumn("sentence", F.coalesce(F.sum(F.col(text).endswith(".").cast("int")).over(w), F.lit(0)))


def nearest_before(rows: DataFrame, part: list[str], order: str, value: Column, name: str) -> DataFrame:
    """rows with the last non-null ``value`` of an earlier row."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def nearest_around(rows: DataFrame, part: list[str], order: str, value: Column, name: str, left_first: bool = True, compat: bool = False) -> DataFrame:
    """rows with the nearest non-null ``value`` of another row, by position; ties go left (or right).

    ``compat``: a partition's first row is never taken from the left.
    """
    base = Window.partitionBy(*part).orderBy(order)
    before, after = base.rowsBetween(Window.unboundedPreceding, -1), base.rowsBetween(1, Window.unboundedFollowing)
    left_value = F.when(F.row_number().over(base) > 1, value) if compat else value
    rows = rows.withColumns({"__l": left_value, "__r": value})
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("p"), F.col(c).alias("v")))
    rows = rows.withColumns({"__left": F.last(at("__l"), ignorenulls=True).over(before), "__right": F.first(at("__r"), ignorenulls=True).over(after)})
    dl, dr = F.col(order) - F.col("__left.p"), F.col("__right.p") - F.col(order)
    left = F.col("__right").isNull() | ((dl <= dr) if left_first else (dl < dr))
    return rows.withColumn(name, F.when(F.col("__left").isNotNull() & left, F.col("__left.v")).otherwise(F.col("__right.v"))).drop("__l", "__r", "__left", "__right")


def property_values(tokens: DataFrame, part: list[str], order: str = "pos") -> DataFrame:
    """(part, property, value, material): each value with the nearest property before it, and the material nearest to that.

    ``part`` names the sentence.
    """
    material = F.when(F.col("label").isin(*MATERIAL_LABELS), F.col("text"))
    near = nearest_around(tokens, part, order, material, "material", compat=True)
    named = F.when(F.col("label") == "PROP_NAME", F.struct(F.col("text").alias("property"), "material"))
    rows = nearest_before(near, part, order, named, "__named").where((F.col("label") == "PROP_VALUE") & F.col("__named").isNotNull())
    return rows.select(*part, order, F.col("__named.property").alias("property"), F.col("text").alias("value"), F.col("__named.material").alias("material"))


def material_amounts(tokens: DataFrame, part: list[str], order: str = "pos") -> DataFrame:
    """(part, entity_name, material_amount): each amount with the nearest material, the right one first."""
    material = F.when(F.col("label").isin(*MATERIAL_LABELS), F.col("text"))
    near = nearest_around(tokens, part, order, material, "entity_name", left_first=False).where((F.col("label") == "MATERIAL_AMOUNT") & F.col("entity_name").isNotNull())
    return near.select(*part, order, "entity_name", F.col("text").alias("material_amount"))


def respectively(sentences: DataFrame, names: str = "names", values: str = "values") -> DataFrame:
    """sentences with ``pairs``: names and values, both in order, paired from the right."""
    n = F.least(F.size(names), F.size(values)).cast("int")
    tail = lambda a: F.slice(a, F.size(a) - n + 1, n)
    pairs = F.transform(F.arrays_zip(tail(F.col(names)).alias("n"), tail(F.col(values)).alias("v")), lambda p: F.struct(p["n"].alias("name"), p["v"].alias("value")))
    return sentences.withColumn("pairs", F.when(n > 0, pairs).otherwise(F.array().cast("array<struct<name:string,value:string>>")))


def unit_from_next(pairs: DataFrame, part: list[str], order: str, name: str = "property", unit: str = "unit") -> DataFrame:
    """An empty unit becomes that of the next pair of the same name."""
    w = Window.partitionBy(*part).orderBy(order)
    take = (F.col(unit) == "") & (F.lead(name).over(w) == F.col(name)) & (F.lead(unit).over(w) != "")
    return pairs.withColumn("__u", F.when(take, F.lead(unit).over(w)).otherwise(F.col(unit))).drop(unit).withColumnRenamed("__u", unit)


def with_context(sentences: DataFrame, part: list[str], order: str, text: str, wanted: Column, width: int = 1) -> DataFrame:
    """The wanted sentences with ``context``: the sentences up to ``width`` before and after, joined."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(-width, width)
    return sentences.withColumn("context", F.array_join(F.collect_list(text).over(w), " ")).where(wanted)


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def first_rows(rows: DataFrame, n: int, order: list[str], **criteria) -> DataFrame:
    """The first n rows by criteria, in a stated order."""
    for k, v in criteria.items():
        rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
    return rows.orderBy(*order).limit(n)


def sample_by_hash(rows: DataFrame, n: int, key: str, seed: int = 0, pool: int | None = None) -> DataFrame:
    """n rows in an order that depends on key and seed only; the same in every run. ``pool``: the first so many of them are drawn from."""
    order = F.xxhash64(F.lit(seed), F.col(key))
    drawn = rows if pool is None else rows.orderBy(order, key).limit(pool)
    return drawn.orderBy(order, key).limit(n)


def evaluation_sample(texts: DataFrame, curated: DataFrame, n: int = 1000, least: int = 10, seed: int = 0) -> DataFrame:
    """doi of n papers with at least ``least`` paragraphs: all curated ones, the rest drawn by hash."""
    sized = texts.groupBy("doi").agg(F.count("text").alias("paragraphs")).where(F.col("paragraphs") >= least)
    own = sized.join(curated.select("doi"), "doi", "left_semi")
    rest = sized.join(curated.select("doi"), "doi", "left_anti")
    both = own.select("doi", F.lit(0).alias("__o"), F.lit(0).cast("long").alias("__h")).union(rest.select("doi", F.lit(1), F.xxhash64(F.lit(seed), "doi")))
    return both.orderBy("__o", "__h", "doi").limit(n).select("doi")
