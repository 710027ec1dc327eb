"""Reproducible shuffle and shards by a Feistel permutation of global row numbers.

Rows get gapless numbers in a total order of their digest; a keyed four-round Feistel
network over the next power of four, walked along its cycles until it falls below the
row count, permutes them. The permuted number p gives shard ``p mod shards`` and slot
``p div shards``: row counts differ by one at most, and both are computable from the
number alone, as is the way back.

Numbering needs no global sort: equal rows are counted first (map-side), digests are
dealt into buckets, as many as the distinct rows ask for, a bucket's total shifts the next
bucket's numbers, and equal rows take a range of numbers that is expanded last, spread over
all tasks.

Null values and texts are values like any other. Equal rows are rows of their own with
neighbouring numbers. Columns named like the new ones are replaced; no other name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import columns_but, long_field, quoted, table, written

SHARDS, SEED = 16, 20_240_917
#: Buckets at least, and distinct rows a bucket has at most on average.
BUCKETS, PER_BUCKET = 4096, 100_000
#: Equal rows are expanded in stretches of this many numbers.
STRETCH = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def _half_bits(n: int) -> int:
    return max(1, ((max(1, n) - 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at ``numbers``."""
    bits = _half_bits(n)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = _keys(seed)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> shift, out[todo] & mask
            for k in keys[::-1] if back else keys:
                if back:
                    left, right = right ^ (_mix(left + k) & mask), left
                else:
                    left, right = right, left ^ (_mix(right + k) & mask)
            out[todo] = (left << shift) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def place_of(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of a row number."""
    p = int(permute(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def number_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number at a shard and slot."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def numbered(rows: DataFrame, buckets: int = BUCKETS, per_bucket: int = PER_BUCKET) -> tuple[DataFrame, int]:
    """``rows`` with gapless ``row_number`` from 0, and how many there are.

    The order is that of the rows' digest bucket, then of their columns, so it is a function
    of the rows alone; equal rows take neighbouring numbers. All columns must be orderable.
    """
    whole = F.struct(*quoted(columns_but(rows, ["row_number"]))).alias("row")
    same = written(rows.select(whole).groupBy("row").agg(F.count(F.lit(1)).alias("n")), "equal-rows")
    different, n = same.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    same = same.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(max(buckets, -(-different // per_bucket)))))
    totals = same.groupBy("bucket").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = same.withColumn("own", own).join(totals.select("bucket", before.alias("shift")), "bucket")
    stretches = F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(STRETCH))).alias("from")
    parts = starts.select("row", (F.col("own") + F.col("shift")).alias("first"), "n", stretches)
    last = F.least(F.col("from") + STRETCH, F.col("n")) - 1
    return parts.select("row.*", F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + last)).alias("row_number")), n


def shard(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` with row_number, shard and slot; an empty table gives an empty one."""
    found, n = numbered(rows.select(*quoted(columns_but(rows, ["row_number", "shard", "slot"]))))
    names = [*found.columns, "shard", "slot"]
    schema = T.StructType([*found.schema.fields, T.StructField("shard", T.IntegerType()), long_field("slot")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = permute(b.column(b.num_columns - 1).to_numpy(), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=names)

    return found.mapInArrow(run, schema)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    return shard(slim).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {"op2_sharding": op2_sharding}
ORACLES: dict[str, str] = {}
