"""Reading driver tables, literal rows, and the registration of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Registry:
    """Queries by name, with their SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def register(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return register


def values_sql(rows: list[tuple], names: list[str], types: list[str]) -> str:
    """Rows as SQL, for queries over literals whose results are known."""

    def one(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).upper()
        if isinstance(v, (int, float)):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(map(one, v)) + "]"
        return "'" + str(v).replace("'", "''") + "'"

    cast = ", ".join(f"CAST({n} AS {t}) AS {n}" for n, t in zip(names, types, strict=True))
    body = ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {body}) AS v({', '.join(names)})"


def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as extracted properties."""
    return read(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("material_id"), F.col("l_suppkey").alias("method_id"), F.col("l_linestatus").alias("entity_name"),
        F.col("l_extendedprice").alias("numeric_value"), F.col("l_discount").alias("numeric_error"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("quantity"),
    )


PROPERTIES = """properties AS (
  SELECT l_orderkey * 1000000000 + l_partkey * 10000 + l_suppkey * 10 + l_linenumber AS id, l_partkey AS material_id, l_suppkey AS method_id, l_linestatus AS entity_name,
    l_extendedprice AS numeric_value, l_discount AS numeric_error, l_returnflag AS unit, l_quantity AS quantity
  FROM lineitem)"""


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as extracted materials; documents are their paragraphs."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("entity_name"), F.col("p_type").alias("material_class"), F.col("p_partkey").alias("para_id"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as paragraphs of papers."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doi"), F.col("source").alias("pid"), "text")
