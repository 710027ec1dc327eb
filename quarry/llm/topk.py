"""Exact top-k by inner product: exhaustive term-at-a-time accumulation.

Vectors are rows of sparse postings by term (dimension). A block of candidate rows is
stored term by term; a block of query rows takes its terms one at a time and scatters
(query weight x posting weight) into dense score arrays, one slot per candidate. Of each
query's scores a partition selection keeps the block's best k, and a window merges the
blocks. No score is skipped, and ties go to the smaller id, inside a block and between.

Queries and candidates meet block by block: a block is one row, as long as ``block`` rows
of vectors, so what is paired are blocks, by an equi-join on both blocks' numbers, and
the memory a task needs is fixed by the two block sizes.

Weights are floor(scale * x) in double. Vectors null or with a null or non-finite
component take no part. A term missing at one side (vectors of other lengths) adds zero.
A score outside 64 bits is clamped to them. Repeated (id, vector) rows count once, as
candidates and as queries; rows of one id with different vectors are candidates of their own,
and of a query id with several vectors the best of all its (vec_id, score) pairs are kept, each
once. A query never meets rows of its own id. Ties go to the smaller id. Empty tables give empty
results; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import table, written

K, EVERY, SCALE = 10, 100, 1024
BLOCK, QUERY_BLOCK = 8192, 4096


def usable(vector: str) -> Column:
    """Vectors that are not null and hold only finite numbers."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad


def _packed(rows: DataFrame, number: str, blocks: int) -> DataFrame:
    """(id, vector) rows as one row of numpy bytes per block."""

    def pack(found: pa.Table) -> pa.Table:
        ids = found.column("id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        lists = found.column("vector").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())[order]
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), (lists.offsets.to_numpy() - lists.offsets[0].as_py())[:-1][order]
        width = int(lengths.max(initial=0))
        dense = np.zeros((len(ids), width))
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            dense[at, :n] = flat[starts[at][:, None] + np.arange(n)]
        return pa.table({number: pa.array([found.column(number)[0].as_py()], pa.int32()), "ids": [ids[order].astype("<i8").tobytes()], "width": pa.array([width], pa.int32()), "values": [dense.astype("<f8").tobytes()]})

    placed = rows.withColumn(number, F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"))
    return placed.groupBy(number).applyInArrow(pack, f"{number} int, ids binary, width int, values binary")


def _clamped(x) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def accumulate(queries: np.ndarray, candidates: np.ndarray, scale: float = SCALE) -> Iterator[np.ndarray]:
    """Each query's dense scores over the candidates, as int64."""
    q, c = np.floor(queries * scale), np.floor(candidates * scale)
    terms = min(q.shape[1], c.shape[1])
    top = float(np.abs(q).max(initial=0)), float(np.abs(c).max(initial=0))
    wide = top[0] * top[1] * max(1, terms) >= 2.0**62 or max(top) >= 2.0**62
    if wide:
        big = [[(int(x), int(i)) for i, x in enumerate(c[:, t]) if x] for t in range(terms)]
        for row in q:
            scores = [0] * len(c)
            for t in range(terms):
                for w, i in big[t] if row[t] else ():
                    scores[i] += int(row[t]) * w
            yield np.array([_clamped(s) for s in scores], np.int64)
        return
    q, c = q.astype(np.int64), c.astype(np.int64)
    postings = []
    for t in range(terms):
        at = np.flatnonzero(c[:, t])
        postings.append((slice(None) if len(at) == len(c) else at, c[at, t]))
    for row in q:
        scores = np.zeros(len(c), np.int64)
        for t in np.flatnonzero(row[:terms]):
            at, weights = postings[t]
            scores[at] += row[t] * weights
        yield scores


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores; of equal ones the first. ``scores`` is in id order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = scores[np.argpartition(-scores, k - 1)[:k]].min()
    above = np.flatnonzero(scores > least)
    return np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])


def search(candidates: DataFrame, queries: DataFrame, k: int = K, scale: float = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates of another id.

    candidates, queries: (id long, vector array<double>), of which unusable rows take no part.
    """
    c, q = (x.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where(usable("vector") & F.col("id").isNotNull()).distinct() for x in (candidates, queries))
    c, q = written(c, "candidates"), written(q, "queries")
    n, m = c.count(), q.count()
    nb, mb = max(1, -(-n // block)), max(1, -(-m // query_block))
    left = _packed(c, "cb", nb).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(mb - 1))))
    right = _packed(q, "qb", mb).select("qb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("cb"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("values").alias("q_values"))
    pairs = left.join(right.hint("shuffle_hash"), ["cb", "qb"]).select("ids", "width", "values", "q_ids", "q_width", "q_values")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, width, values, q_ids, q_width, q_values in zip(*(col.to_pylist() for col in b.columns), strict=True):
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                dense = np.frombuffer(values, "<f8").reshape(len(ids), width)
                asked = np.frombuffer(q_values, "<f8").reshape(len(q_ids), q_width)
                out: tuple[list, list, list] = ([], [], [])
                for who, scores in zip(q_ids, accumulate(asked, dense, scale), strict=True):
                    own = np.searchsorted(ids, [who, who + 1]) if who < (1 << 63) - 1 else [np.searchsorted(ids, who), len(ids)]
                    rest = np.concatenate([np.arange(own[0]), np.arange(own[1], len(ids))]) if own[1] > own[0] else None
                    at = best_of(scores if rest is None else scores[rest], k)
                    at = at if rest is None else rest[at]
                    out[0].append(np.full(len(at), who))
                    out[1].append(ids[at])
                    out[2].append(scores[at])
                cols = [np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in out]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, rows.where(F.col("id") % EVERY == 0))


ORACLES = {
    "op10_topk": """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT DISTINCT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 10
"""
}
QUERIES = {"op10_topk": op10_topk}
