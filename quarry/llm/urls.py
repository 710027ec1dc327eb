"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Listed entries are canonical ``host + path prefix`` keys. A URL can only be hit by a key
made of as many last labels of its host and as many first characters of its path as some
listed key has, so it is asked for those few keys only. The Bloom filter, one block of
eight 64-bit words a key, drops nearly all of them; a page with no key left gets the default
verdict where it is read. Only the pages with possible hits move: their keys are joined exactly
with the listed ones, and of the entries that fit the longest wins.

The list is broadcast if its keys measure ``MAX_LISTED_BYTES`` or less. A longer one is first
cut to the keys that pages ask for (distinct, so that no key is hot), and then joined with each
key at ``SALTS_A_KEY`` places, over which the pages of a frequent key are dealt.

The filter's bits grow with the list (``BITS`` a key) up to ``MAX_FILTER_BYTES``; beyond
that it is fuller and passes more false hits, which the join removes, so results are the
same. It is built block by block in Spark.

Null URLs and those without ``://`` have an empty host and path and are hit by nothing.
Repeated rows are judged row by row. A key listed both ways is blocked. Columns of any name survive,
but for those named like the new ones, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import columns_but, quoted, table

BITS, BLOCK_BITS, MAX_FILTER_BYTES = 16, 512, 32 << 20
MAX_LISTED_BYTES, SALTS_A_KEY = 16 << 20, 16
SALTS = (0x47B6137B, 0x44974D91, 0x08824AD5, 0x22B7B3C3, 0x705495C7, 0x2DF1424B, 0x1EFCA961, 0x5C6BFB31)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts_of(url: str = "url") -> tuple:
    """The canonical host and path of a URL column."""
    text = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)\A.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    return host.alias("host"), F.regexp_extract(text, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1).alias("path")


class BlockedBloom:
    """Eight 64-bit words a block; a key sets one bit in each word of its block."""

    def __init__(self, words: np.ndarray):
        self.words = words  # (blocks, 8) unsigned

    @classmethod
    def build(cls, keys: DataFrame, column: str) -> BlockedBloom:
        n = keys.count()
        blocks = max(1, min(-(-n * BITS // BLOCK_BITS), MAX_FILTER_BYTES * 8 // BLOCK_BITS))
        h = F.xxhash64(column)
        low = h.bitwiseAND(F.lit(0x7FFFFFFF))
        block = (F.shiftrightunsigned(h, 31) % blocks).alias("block")
        bits = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.shiftright(low * F.lit(s), 25).bitwiseAND(F.lit(63))).cast("int"))).alias(f"w{i}") for i, s in enumerate(SALTS)]
        found = keys.groupBy(block).agg(*bits).toArrow()
        words = np.zeros((blocks, 8), np.uint64)
        at = found.column("block").to_numpy()
        for i in range(8):
            words[at, i] = found.column(f"w{i}").to_numpy().view(np.uint64)
        return cls(words)

    def may_hold(self, key: str) -> bool:
        h = xxhash.xxh64_intdigest(key.encode(), 42)
        low, words = h & 0x7FFFFFFF, self.words[(h >> 31) % len(self.words)]
        return all(int(words[i]) >> ((low * s >> 25) & 63) & 1 for i, s in enumerate(SALTS))


def judge(pages: DataFrame, listed: DataFrame, url: str = "url", default: str = "allow", max_bytes: int = MAX_LISTED_BYTES) -> DataFrame:
    """``pages`` with host, path, rule (the longest listed key that fits, or null) and verdict.

    listed: host, path (empty or from its first slash) and verdict. An empty table or list
    gives no hits.
    """
    keys = (
        listed.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "host", "path", "verdict")
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"), F.max(F.size(F.split("host", "[.]"))).alias("labels"), F.max(F.length(F.coalesce("path", F.lit("")))).alias("chars"))
    )
    shapes = sorted((r.labels, r.chars) for r in keys.select("labels", "chars").distinct().collect())
    bloom = BlockedBloom.build(keys.select("rule"), "rule")
    own = columns_but(pages, ["host", "path", "rule", "verdict"])
    rows = pages.select(F.struct(F.lit(0).alias("_"), *quoted(own)).alias("row"), *parts_of(url))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = []
            for host, path in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                parts = host.rsplit(".", shapes[-1][0]) if shapes else []
                asked = {".".join(parts[-n:]) + path[:c] for n, c in shapes if n <= len(parts) and c <= len(path)} if host else ()
                hits.append([k for k in sorted(asked) if bloom.may_hold(k)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.string()))], names=["row", "host", "path", "hits"])

    asked = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("hits", T.ArrayType(T.StringType()))]))
    before = [F.col("row").getField(c).alias(c) for c in own]
    clear = asked.where(F.size("hits") == 0).select(*before, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    every = asked.where(F.size("hits") > 0).withColumn("n", F.monotonically_increasing_id()).withColumn("rule", F.explode("hits"))
    size = keys.agg(F.coalesce(F.sum(F.octet_length("rule") + 64), F.lit(0))).first()[0]
    keys = keys.select("rule", "verdict")
    if size <= max_bytes:
        joined = every.join(F.broadcast(keys), "rule", "left")
    else:
        places = F.explode(F.sequence(F.lit(0), F.lit(SALTS_A_KEY - 1))).alias("place")
        met = keys.join(every.select("rule").distinct(), "rule").select("rule", "verdict", places)
        joined = every.withColumn("place", F.pmod(F.xxhash64("n"), F.lit(SALTS_A_KEY)).cast("int")).join(met, ["rule", "place"], "left")
    best = F.max(F.when(F.col("verdict").isNotNull(), F.struct(F.length("rule").alias("n"), "rule", "verdict"))).alias("best")
    found = joined.groupBy("n").agg(*(F.first(c).alias(c) for c in ("row", "host", "path")), best)
    return clear.union(found.select(*before, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")))


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), listed).drop("url")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
ORACLES = {
    "op5_urls": f"""
WITH rules(verdict, host, path) AS (VALUES {_VALUES}),
cut AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
fit AS (
  SELECT c.*, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY c.n ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
  FROM cut c LEFT JOIN rules r
    ON (c.host = r.host OR suffix(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit WHERE place = 1
"""
}
QUERIES = {"op5_urls": op5_urls}
