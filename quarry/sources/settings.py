"""Settings by section, from a JSON file, with overrides; and the registry of extraction methods."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Run:
    directory: str = "runs"
    log_level: int = 1
    seed: int = 0


@dataclass(frozen=True)
class Extraction:
    """How records are asked for; secrets are read from the environment, never kept here."""

    model: str = ""
    temperature: float = 0.0
    shots: int = 1
    shot_kind: str = "random"
    retries: int = 1
    delay: float = 2.0
    fuzzy_cutoff: float = 96.0


@dataclass(frozen=True)
class Paths:
    tables: str = "tables"
    property_metadata: str = ""
    normalization: str = ""
    names: str = ""


@dataclass(frozen=True)
class Settings:
    run: Run = field(default_factory=Run)
    extraction: Extraction = field(default_factory=Extraction)
    paths: Paths = field(default_factory=Paths)

    @classmethod
    def of(cls, values: dict) -> Settings:
        """Sections and keys that are unknown are refused."""
        out = cls()
        for name, section in values.items():
            own = getattr(out, name, None)
            if own is None:
                raise ValueError(f"no section {name!r}")
            unknown = set(section) - {f.name for f in fields(own)}
            if unknown:
                raise ValueError(f"no settings {sorted(unknown)} in {name!r}")
            out = replace(out, **{name: replace(own, **section)})
        return out

    def with_overrides(self, overrides: dict[str, str]) -> Settings:
        """``section.key`` to a string, read as the setting's own type."""
        values = asdict(self)
        for path, text in overrides.items():
            section, key = path.split(".", 1)
            values[section][key] = type(values[section][key])(text)
        return Settings.of(values)

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2)


def load(spark: SparkSession, path: str) -> Settings:
    return Settings.of(json.loads(spark.read.option("wholetext", True).text(path).first().value))


def save(spark: SparkSession, settings: Settings, path: str) -> None:
    spark.createDataFrame([(json.dumps(asdict(settings)),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def methods_with(methods: DataFrame, name: str, **info) -> DataFrame:
    """methods with one added or changed; info values are kept as strings."""
    spark = methods.sparkSession
    top = {k: str(v) for k, v in info.items() if k in ("dataset", "model", "api", "para_subset")}
    rest = {k: str(v) for k, v in info.items() if k not in top}
    new = spark.createDataFrame([(name, top.get("dataset"), top.get("model"), top.get("api"), top.get("para_subset"), rest)], "name string, dataset string, model string, api string, para_subset string, extraction_info map<string,string>")
    old = methods.where(F.col("name") == name).select(*[F.col(c).alias(f"__{c}") for c in new.columns])
    merged = new.join(old, new["name"] == old["__name"], "left").select(
        "name", *[F.coalesce(c, f"__{c}").alias(c) for c in ("dataset", "model", "api", "para_subset")],
        F.map_concat(F.map_filter(F.coalesce("__extraction_info", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("extraction_info", k)), "extraction_info").alias("extraction_info"),
    )
    return methods.where(F.col("name") != name).select(*new.columns).unionByName(merged)


def info_values(methods: DataFrame) -> DataFrame:
    """(name, key, whole, real, text): each setting of each method, by its narrowest kind."""
    from quarry.functions.text import coerce_cell

    rows = methods.select("name", F.explode("extraction_info").alias("key", "value"))
    return rows.select("name", "key", coerce_cell("value").alias("v")).select("name", "key", "v.*")
