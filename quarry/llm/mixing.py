"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Every source is a queue of its documents in an order shuffled by a keyed digest, repeated
once if its target asks for it. A document's virtual finish time is the source's tokens
up to its end divided by the source's target. Targets sum to the total budget, so the
budget is used up at virtual time 1: the mix is the range-sorted documents up to there,
and of the document that each queue is serving then, the words served so far.

Targets are found by water filling in one pass: sources sorted by cap over weight, those
whose cap lies under the level of the rest are full, the others share by weight.

Positions need no window over a whole source: digests are dealt into 4096 buckets per
source, bucket totals are summed map-side, and only the running sum within a bucket sorts
documents; a source with a third of all rows is spread over 4096 groups.

A null source is a source of its own, last in order. Null and empty texts have size 0 and
take nothing. Repeated rows share a digest and are served one after the other. Extra
columns never matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import columns_but, discard, quoted, table, written

WEIGHTS, BUDGET, REPEATS, SEED = (3, 1, 2), 1.5, 2, "17"
#: Sources whose cuts are broadcast; more are joined by source with each cut at PLACES places.
MAX_SOURCES, PLACES = 50_000, 32
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def digest_of(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(doc_id).cast("string"), F.md5(F.col(text))))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) with each source's target; a row per source, so small."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(w) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * repeats)
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    up_to, all_ = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns(
        {
            "left": F.lit(budget) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(up_to), F.lit(0)),
            "rest": F.sum("weight").over(by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    full = F.col("cap") * F.col("rest") <= F.col("weight") * F.col("left")
    level = F.max(F.when(~full, F.col("left") / F.col("rest"))).over(all_)  # that of the first one not full; later ones lie lower
    target = F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * level)
    return rows.select("source", "source_size", target.alias("target"))


def served(slim: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(source, size, digest, ...) with source_size, target, taken and finish, the virtual time of the first service."""
    rows = slim.select(F.struct(*quoted(slim.columns)).alias("row"), "source", "size", "digest", F.substring("digest", 1, 3).alias("bucket"))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("size"))
    goals = targets(totals.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, repeats)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select("source", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    goals = shifts.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    goals = goals.withColumnRenamed("bucket", "b")
    own = Window.partitionBy("source", "bucket").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    start = F.col("own") + F.col("shift")
    words = F.floor(F.col("target") + 0.5)
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), words - start - F.col("source_size") * k)) for k in range(repeats)), F.lit(0))
    return rows.select(
        *(F.col("row").getField(c).alias(c) for c in columns_but(slim, ["source_size", "target", "taken", "finish"])),
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.when(F.col("target") > 0, (start + F.col("size")) / F.col("target")).alias("finish"),
    )


def slim_of(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """What positions depend on, as a written table: texts are read once."""
    return written(docs.select(doc_id, F.col(source).alias("source"), size_of(text).alias("size"), digest_of(doc_id, text).alias("digest")), "sized")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS, max_sources: int = MAX_SOURCES) -> DataFrame:
    """The mixed documents: a row per service, with the columns of ``docs``.

    Texts are neither shuffled nor joined by document: all that a document's share depends
    on is its digest's place beside its source's last served digest, one row per source.
    The text served in part keeps its first words, single-spaced; identical rows that are
    last served share what is left evenly.
    """
    slim = slim_of(docs, text, source, doc_id)
    taken = written(served(slim, weights, budget, repeats).select("source", "size", "digest", "taken"), "served")
    discard(slim)
    some = taken.where(F.col("size") > 0)
    whole = F.floor(F.col("taken") / F.col("size"))
    # documents up to `edge` are served `high` times, later ones `low` times, the one at `cut` in part
    by_times = some.groupBy("source", whole.alias("whole")).agg(
        F.max("digest").alias("edge"),
        F.max(F.ceil(F.col("taken") / F.col("size"))).alias("times"),
        F.max(F.when(F.col("taken") % F.col("size") > 0, F.col("digest"))).alias("cut"),
    )
    high, low = F.max("times"), F.min("whole")
    edge = F.when((F.max("whole") == high) & (low < high), F.max_by("edge", "whole"))
    cuts = by_times.groupBy(F.col("source").alias("s")).agg(low.alias("low"), high.alias("high"), edge.alias("edge"), F.max("cut").alias("cut"))
    at_cut = some.join(cuts.select("s", "cut"), F.col("source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("cut")))
    shares = at_cut.groupBy(F.col("s").alias("s2")).agg(F.floor(F.sum("taken") / F.count(F.lit(1))).alias("share"))
    cuts = written(cuts.join(shares, F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2"), "cuts")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col(source).alias("source"), digest_of(doc_id, text).alias("digest"), size_of(text).alias("size"))
    same = F.col("source").eqNullSafe(F.col("s"))
    if cuts.count() <= max_sources:
        rows = rows.join(F.broadcast(cuts), same)
    else:
        placed = cuts.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1))))
        rows = rows.join(placed, same & (F.pmod(F.xxhash64("digest"), F.lit(PLACES)) == F.col("p")))
    size = F.col("size")
    total = F.when(F.col("digest") == F.col("cut"), F.col("share")).when(F.col("digest") <= F.col("edge"), F.col("high") * size).otherwise(F.col("low") * size)
    rows = rows.where(size > 0).withColumn("total", total).where("total > 0")
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / size) - 1))).withColumn("words", F.least(size, F.col("total") - F.col("k") * size))
    own = F.col("row").getField(text)
    lead = F.array_join(F.slice(F.filter(F.split(own, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col("words").cast("int")), " ")
    new = F.when(F.col("words") < size, lead).otherwise(own)
    return rows.select(*[(new if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = served(slim_of(docs)).orderBy("finish", "digest")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "finish", "source", "digest")


ORACLES = {
    "op6_mixing": f"""
WITH slim AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws(':', '{SEED}', CAST(doc_id AS VARCHAR), md5(text))) AS digest
  FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM slim GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2 AS cap,
    CAST([3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS weight
  FROM sums),
fills AS (
  SELECT *, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
    CAST(sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest
  FROM weighed),
levels AS (SELECT *, cap * rest <= weight * remaining AS is_full FROM fills),
goals AS (
  SELECT source, source_size,
    CASE WHEN is_full THEN cap::DOUBLE ELSE weight * max(CASE WHEN NOT is_full THEN remaining / rest END) OVER () END AS target
  FROM levels),
placed AS (
  SELECT s.*, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS words,
    CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM slim s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  greatest(0, least(size, words - start)) + greatest(0, least(size, words - start - source_size)) AS taken,
  CASE WHEN target > 0 THEN (start + size) / target END AS finish, source, digest
FROM placed
"""
}
QUERIES = {"op6_mixing": op6_mixing}
