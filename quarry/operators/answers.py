"""Records from a language model's answers: asked, unpacked, and their materials and values parsed.

Materials are parsed once for each different string, however many records name it, and joined
back; values are parsed and converted row by row in built-in functions. Only the call of the
model runs in Python.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import model_output as Y
from quarry.functions.numbers import COMMON_UNITS, parsed_properties
from quarry.functions.text import polymer_type
from quarry.operators.extraction import ROLES, Client, asked
from quarry.operators.joins import fuzzy_matches

#: Least likeness, in percent, of a material's string and a known name.
CUTOFF = 96.0


def coreferents(names: DataFrame, crossrefs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """(material, coreferents): all names and other names of the cross-references that a material is like."""
    both = crossrefs.select(F.explode(F.array("name", "othername")).alias("known"), F.array("name", "othername").alias("pair"))
    near = fuzzy_matches(names, both.select("known"), "material", "known", cutoff, best=1 << 30).where("match IS NOT NULL")
    found = near.join(both, near["match"] == both["known"]).groupBy("material").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("pair")))).alias("coreferents"))
    return names.join(found, "material", "left").withColumn("coreferents", F.coalesce("coreferents", F.array().cast("array<string>")))


def parsed_materials(rows: DataFrame, polymers: DataFrame, crossrefs: DataFrame, solvents: list[str], categories: tuple[str, ...] = ROLES, cutoff: float = CUTOFF) -> DataFrame:
    """``rows`` (material, ...) with entity_name, material_class, polymer_type, normalized_material_name, role and coreferents.

    A material that is like a known polymer (name, normalized_name) takes its name; one that says
    poly, or a coreferent of which does, is a polymer too; solvents are known by their lower-cased
    names; the role is the first category that is part of the name.
    """
    names = rows.select("material").where("material IS NOT NULL").distinct()
    like = fuzzy_matches(coreferents(names, crossrefs, cutoff), polymers.select("name"), "material", "name", cutoff)
    like = like.join(polymers.groupBy(F.col("name").alias("match")).agg(F.min("normalized_name").alias("norm")), "match", "left")
    low = F.lower("material")
    says_poly = low.contains("poly")
    is_polymer = F.col("match").isNotNull() | says_poly | F.exists("coreferents", lambda x: x.contains("poly"))
    kind = F.when(is_polymer, "POLYMER").when(low.isin([s.lower() for s in solvents]), "SOLVENT").otherwise("")
    role = F.coalesce(*[F.when(low.contains(c), F.lit(c)) for c in categories], F.lit(""))
    made = like.select(
        "material",
        F.coalesce("match", "material").alias("entity_name"),
        kind.alias("material_class"),
        F.when(F.col("match").isNotNull() | says_poly, polymer_type(low)).otherwise("").alias("polymer_type"),
        F.coalesce("norm", F.lit("")).alias("normalized_material_name"),
        role.alias("role"),
        "coreferents",
    )
    return rows.join(made, "material")


def answered_records(
    paragraphs: DataFrame,
    client: Client,
    polymers: DataFrame,
    crossrefs: DataFrame,
    instruction: str,
    shots: Column | None = None,
    key: str = "para_id",
    text: str = "text",
    units: tuple[str, ...] = COMMON_UNITS,
    solvents: list[str] | None = None,
    retries: int = 1,
) -> DataFrame:
    """Every record that a model's answer holds on a paragraph, with its material and value parsed.

    Records are kept on the executors' disks until ``spark.catalog.clearCache()``, so that each
    paragraph is asked once. Paragraphs whose call failed or whose answer is no record give none; records without a
    material, a property or a number are dropped. shots: array<struct<text:string, records:string>>.
    """
    none = F.array().cast("array<struct<text:string,records:string>>")
    requests = paragraphs.select(key, Y.few_shot_messages(none if shots is None else shots, text, instruction).alias("messages"))
    # a small file of paragraphs is few tasks, however long the answers take
    tasks = int(paragraphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers = Y.unpacked(asked(requests.repartition(tasks), client, key, retries).where("status = 'done'")).select(key, "response")
    # names are collected first and joined back: without this, the model would be asked and values be read once more for them
    found = parsed_properties(Y.extracted(answers), "value", units).persist(StorageLevel.DISK_ONLY)
    stated = F.when(F.col("condition") != "", F.col("condition")).otherwise(F.col("condition_str"))
    return parsed_materials(found, polymers, crossrefs, solvents or []).select(
        key, "entity_name", "material_class", "polymer_type", "normalized_material_name", "role", "coreferents",
        "property", "value", "numeric_value", "numeric_error", "unit", "value_average", stated.alias("condition"),
    )
