"""Joins by what they are for: lookups, what is not done yet, containment, fuzzy names, dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import arrow


def pending(candidates: DataFrame, done: DataFrame, key: str, last: int | None = None, limit: int | None = None, done_key: str | None = None) -> DataFrame:
    """Candidates over the cursor, the first ``limit`` by key, without those done: the limit is taken first."""
    rows = candidates if last is None else candidates.where(F.col(key) > last)
    rows = rows if limit is None else rows.orderBy(key).limit(limit)
    return rows.join(done.select(F.col(done_key or key).alias(key)), key, "left_anti")


def not_in(rows: DataFrame, listed: DataFrame, key: str, listed_key: str) -> DataFrame:
    """NOT IN: a null in the list rejects every row, a null key is rejected unless the list is empty."""
    left, right = "__rows", "__listed"
    spark = rows.sparkSession
    rows.createOrReplaceTempView(left)
    listed.select(F.col(f"`{listed_key}`").alias("k")).createOrReplaceTempView(right)
    out = spark.sql(f"SELECT * FROM {left} WHERE `{key}` NOT IN (SELECT k FROM {right})")
    return out


def siblings(paragraphs: DataFrame, chosen: DataFrame) -> DataFrame:
    """All paragraphs of the papers that the chosen paragraphs (id) belong to."""
    papers = paragraphs.join(chosen.select("id"), "id", "left_semi").select("pid")
    return paragraphs.join(papers, "pid", "left_semi")


def of_filtered_papers(paragraphs: DataFrame, filtered: DataFrame, filter_name: str | None = None) -> DataFrame:
    """Paragraphs of filtered papers, each once however many filters name the paper."""
    own = filtered if filter_name is None else filtered.where(F.col("filter_name") == filter_name)
    return paragraphs.join(own.select("doi"), "doi", "left_semi")


def uncontained(rows: Column, pos: str, text: str, named: Column | bool = True) -> Column:
    """An array of structs in order, without repeated texts and parts of earlier ones; where not ``named``, only repeats go.

    ``rows`` must be a column that is already computed, as each element refers to it.
    """
    named = F.lit(named) if isinstance(named, bool) else named

    def holds(e: Column, r: Column) -> Column:
        inside = named & (e[pos] < r[pos]) & (F.length(e[text]) >= F.length(r[text])) & F.contains(e[text], r[text])
        return e[text].eqNullSafe(r[text]) | F.coalesce(inside, F.lit(False))

    return F.filter(rows, lambda r, i: ~F.exists(F.slice(rows, F.lit(1), i), lambda e: holds(e, r)))


def without_contained(paragraphs: DataFrame, doc: str, pos: str, text: str) -> DataFrame:
    """Paragraphs that no earlier paragraph of their document holds as a part.

    A document's paragraphs are brought together as one row and compared there, so no pairs of
    rows are made and the text is shuffled once. Rows without a document only lose their repeats.
    """

    def order(x: Column, y: Column) -> Column:
        a, b = x[pos], y[pos]
        return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)

    whole = F.struct(*[F.col(f"`{c}`") for c in paragraphs.columns])
    groups = paragraphs.groupBy(F.col(doc).alias("__doc"), F.when(F.col(doc).isNull(), F.col(text)).alias("__alone")).agg(F.collect_list(whole).alias("__rows"))
    groups = groups.select("__doc", F.explode(F.array(F.array_sort("__rows", order))).alias("__rows"))
    return groups.select(F.explode(uncontained(F.col("__rows"), pos, text, F.col("__doc").isNotNull())).alias("__r")).select("__r.*")


def ratio(a: str, b: str) -> float:
    """Similarity in percent: twice the longest common subsequence over both lengths."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


@arrow("double")
def similarity(a: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for x, y in a:
        yield pd.Series([ratio(p, q) if p is not None and q is not None else 0.0 for p, q in zip(x, y, strict=True)], dtype="float64")


def fuzzy_matches(names: DataFrame, known: DataFrame, name: str, known_name: str, cutoff: float = 96.0, best: int = 1) -> DataFrame:
    """names with ``match``, ``match_score`` and ``match_rank``: the ``best`` known names that reach the cutoff.

    Blocked on length and edit bound: strings of lengths n, m that reach c percent differ by at
    most (n + m)(100 - c) / 100 edits by insertion and deletion, so each name meets only known
    names whose length is that near, cut into as many parts as edits allow plus one: some part
    of the known name is then in the name unchanged, at most that many places off.
    """
    share = (100.0 - cutoff) / 100.0
    own, other = F.length(name), F.length("__k")
    parts = F.floor(2 * other * share / (1 - share)) + 1
    size = F.floor(other / parts).cast("int")
    start = lambda i: (i.cast("int") * size + 1).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), (parts - 1).cast("int")), lambda i: F.when(i < parts - 1, F.substring(F.col("__k"), start(i), size)).otherwise(F.substring(F.col("__k"), start(i), other)))
    dim = known.select(F.col(known_name).alias("__k")).where(F.length("__k") > 0).distinct()
    dim = dim.select("__k", F.explode(F.array_distinct(pieces)).alias("__part"))
    spread = F.ceil(own * share / (1 - share) * 2).cast("int") + 1
    lengths = F.sequence(F.greatest(F.lit(1), own - spread), own + spread)
    part_count = lambda m: (F.floor(2 * m * share / (1 - share)) + 1).cast("int")
    each = lambda m: F.floor(m / part_count(m)).cast("int")
    sizes = F.array_distinct(F.concat(F.transform(lengths, each), F.transform(lengths, lambda m: m - (part_count(m) - 1) * each(m))))
    grams = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), own), lambda i: F.substring(F.col(name), i.cast("int"), s.cast("int")))))
    uniq = names.select(name).where(own > 0).distinct()
    met = uniq.select(name, F.explode(F.array_distinct(grams)).alias("__part")).join(dim, "__part").select(name, "__k").distinct()
    close = met.where(F.abs(own - other) <= (own + other) * share).where(F.levenshtein(F.col(name), F.col("__k")) <= (own + other) * share)
    placed = close.withColumn("match_score", similarity(F.col(name), F.col("__k"))).where(F.col("match_score") >= cutoff)
    w = Window.partitionBy(name).orderBy(F.desc("match_score"), "__k")
    top = placed.withColumn("match_rank", F.row_number().over(w)).where(F.col("match_rank") <= best)
    return names.join(top.select(name, F.col("__k").alias("match"), "match_score", "match_rank"), name, "left")


def edit_distance_pairs(rows: DataFrame, block: list[str], key: str, name: str, most: int) -> DataFrame:
    """(a, b, edits): pairs of keys, a < b, of one block whose names are at most that many edits apart.

    Edits are counted once for each two different names of a block, then rows are had by their
    names. So the work grows with different names squared, and with the pairs that are returned.
    """
    own = [F.col(f"`{c}`").alias(f"__g{i}") for i, c in enumerate(block)]
    blocks = [f"__g{i}" for i in range(len(block))]
    members = rows.select(*own, F.col(key).alias("__id"), F.col(name).alias("__name")).hint("merge")  # too many to broadcast, however small their file
    names = members.select(*blocks, "__name").distinct()
    met = names.withColumnRenamed("__name", "__x").join(names.withColumnRenamed("__name", "__y"), blocks).where("__x <= __y")
    near = met.withColumn("edits", F.levenshtein("__x", "__y", most)).where("edits >= 0")
    # both ways round, as either name may have the smaller key
    ways = F.when(F.col("__x") == F.col("__y"), F.array(F.struct("__x", "__y"))).otherwise(F.array(F.struct("__x", "__y"), F.struct(F.col("__y").alias("__x"), F.col("__x").alias("__y"))))
    near = near.select(*blocks, "edits", F.explode(ways).alias("__w")).select(*blocks, "edits", "__w.*")
    left = near.join(members.select(*blocks, F.col("__id").alias("a"), F.col("__name").alias("__x")), [*blocks, "__x"])
    return left.join(members.select(*blocks, F.col("__id").alias("b"), F.col("__name").alias("__y")), [*blocks, "__y"]).where("a < b").select("a", "b", "edits")


def case_variants(term) -> Column:
    """A term as it is, with its first letter in either case, and in lower and upper case."""
    head, tail = F.substring(term, 1, 1), F.substring(term, F.lit(2), F.length(term))
    return F.array_distinct(F.array(term, F.concat(F.upper(head), tail), F.concat(F.lower(head), tail), F.lower(term), F.upper(term)))


def normalised(materials: DataFrame, dictionary: DataFrame, key: str, coreferents: str = "coreferents") -> DataFrame:
    """materials with ``normalized_material_name``: the first entry, in the dictionary's order, that lists a variant of any coreferent.

    dictionary: (ord, name, coreferents). Entries that list the same variant are one before they
    are met, as only the first can be chosen, so a material meets at most one row a variant.
    """
    entries = dictionary.select("ord", "name", F.explode("coreferents").alias("__v"))
    entries = entries.groupBy("__v").agg(F.min_by("name", "ord").alias("name"), F.min("ord").alias("ord"))
    asked = materials.select(key, F.explode(F.array_distinct(F.flatten(F.transform(coreferents, case_variants)))).alias("__v"))
    best = asked.hint("merge").join(entries, "__v").groupBy(key).agg(F.min_by("name", "ord").alias("normalized_material_name"))
    return materials.drop("normalized_material_name").join(best.hint("merge"), key, "left")  # neither is broadcast: as many rows as materials, however small their file


def polymers_of(materials: DataFrame, polymers: DataFrame, key: str, as_pattern: bool = False) -> DataFrame:
    """materials with the class and normal name that their own name, else a coreferent in order, has among polymers.

    composite and blend come first, by name. ``as_pattern`` takes names as LIKE patterns.
    """
    names = materials.select(key, F.posexplode(F.concat(F.array("entity_name"), F.coalesce("coreferents", F.array().cast("array<string>")))).alias("__at", "__name"))
    dim = polymers.select(F.col("name").alias("__known"), "norm_name", "is_polymer")
    on = F.like(F.col("__known"), F.col("__name")) if as_pattern else F.col("__known") == F.col("__name")
    hit = names.join(F.broadcast(dim) if as_pattern else dim, on)
    best = hit.groupBy(key).agg(F.min_by(F.struct("norm_name", "is_polymer"), F.struct("__at", "__known")).alias("__p"))
    low = F.lower("entity_name")
    kind = F.when(low.contains("composite"), "COMPOSITE").when(low.contains("blend"), "BLEND").when(F.col("__p.is_polymer"), "POLYMER").otherwise(F.col("material_class"))
    known = ~low.contains("composite") & ~low.contains("blend") & F.col("__p").isNotNull()
    name = F.when(known, F.col("__p.norm_name")).otherwise(F.col("normalized_material_name"))
    return materials.join(best, key, "left").withColumns({"material_class": kind, "normalized_material_name": name}).drop("__p")


def paragraphs_of_data(data: DataFrame, properties: DataFrame, materials: DataFrame, method: str, name: str, below: int = 1) -> DataFrame:
    """Paragraphs, each once, of a method's data on a property whose confidence lies below a bound."""
    chosen = data.where((F.col("method") == method) & (F.col("property") == name) & (F.col("confidence") < below)).select("property_id")
    linked = properties.select(F.col("id").alias("property_id"), "material_id").join(chosen, "property_id", "left_semi")
    return materials.select(F.col("id").alias("material_id"), "para_id").join(linked, "material_id", "left_semi").select("para_id").distinct()


def extracted_rows(properties: DataFrame, materials: DataFrame, method_id: int) -> DataFrame:
    """(para_id, material, material_coreferents, property_name, property_value) of a method, as metrics read them."""
    own = materials.select(F.col("id").alias("material_id"), "para_id", F.col("entity_name").alias("material"), F.col("coreferents").alias("material_coreferents"))
    found = properties.where(F.col("method_id") == method_id).select("material_id", F.col("entity_name").alias("property_name"), F.col("value").alias("property_value"))
    return found.join(own, "material_id").drop("material_id")


def plot_points(data: DataFrame, properties: DataFrame, names: list[str], point: int = 0) -> DataFrame:
    """Data of some properties that are still among the extracted ones, marked as a point of a plot."""
    kept = data.where(F.col("property").isin(names)).join(properties.select(F.col("id").alias("property_id")), "property_id", "left_semi")
    return kept.select(F.lit(point).alias("point"), "method", "material", "property", "value", "unit")
