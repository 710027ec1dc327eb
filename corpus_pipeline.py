"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that the one before has kept, and
returns the columns of ``documents`` (the last one: packed pieces). Between stages the
rows are written to the shared folder and read again, so a lost executor costs a stage's
tasks and no more. Nulls, empty texts, ties and repeated rows are treated as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, language, mixing, packing, pii
from quarry.llm.common import table, written


def _measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """``n_chars`` follows the text where a stage has changed it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else docs


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: what no learned language recognises goes."""
    return language.recognised(docs, language.fit(docs.where(~language.held_out())))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup, confirmed and made complete by Jaccard similarity of five-word shingles: one document of each group stays."""
    return jaccard.one_of_each(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """PII: every span is replaced by its kind."""
    return _measured(pii.redact(docs), docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to target weights: a row for each time a document is served."""
    return _measured(mixing.mix(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces with their sequences and offsets."""
    return packing.pack(packing.pieces_of(docs.select("doc_id", "text")))


STAGES = [("language", identify), ("near_duplicates", deduplicate), ("pii", mask), ("mixing", mix), ("packing", pack)]

#: SQL expresses neither the learned model nor the packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
