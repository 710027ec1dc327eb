"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Every table has ``hashes`` Gaussian (2-stable) projections, each cut into cells of one
width; a vector's cells name its bucket. A query visits buckets in the order in which
they are likely to hold its neighbours: by the sum, over the projections, of the squared
distance from the query to the bucket's cell. It visits ``probes`` buckets a table, and
goes on until they hold ``least`` vectors. Where ``probes`` is not given it is fitted: for
``ASKED`` vectors, drawn by a hash of their ids, the true neighbours among all candidates are
found by an exact scan, and as many buckets are visited as catch ``RECALL`` of these. All candidates of all tables are scored
exactly, and the best are merged.

Inner products become distances by one more coordinate, sqrt(M^2 - |x|^2) for candidates
and 0 for queries, M being the longest norm, to which queries are stretched. Projections are centred and scaled over all
vectors, and cells beyond ``-3..2`` count as the outermost, so a table has at most
``6 ** hashes`` buckets: the map of buckets that goes to every task is bounded whatever
the data, and no other state is.

Buckets are dealt into blocks of even size, neighbouring buckets together; a bucket
larger than a block is split over several, all of which its visitors meet, so nothing
is dropped. Candidates of a block are held by a task (``max_block`` at most) while the
queries of the block stream by.

Vectors null, zero, empty, or with a null or non-finite component take no part, nor do
null ids. Shorter vectors count as padded with zeros. A query never meets rows of its
own id; equal (id, score) pairs count once, and repeated (id, vector) rows are dropped
before vectors are counted and dealt. Scores are sums in component order, in
double precision; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import table, written
from quarry.llm.topk import usable

K, EVERY = 20, 20
TABLES, HASHES, WIDTH, LEAST, SEED = 2, 4, 1.5, 2000, 7
#: Vectors asked to fit the number of probes, and the share of their neighbours to be met.
ASKED, RECALL = 128, 0.95
BLOCKS, MAX_BLOCK = 16, 32_768
LOW, HIGH = -3, 2


@dataclass
class Hashes:
    """Projections of vectors to cells; fitted means and scales, a shift for each projection."""

    tables: int
    hashes: int
    width: float
    longest: float
    axes: np.ndarray
    shift: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def raw(self, dense: np.ndarray, query: bool) -> np.ndarray:
        square = np.einsum("ij,ij->i", dense, dense)
        if query:
            return (dense / np.sqrt(square)[:, None]) @ self.axes[:-1]
        last = np.sqrt(np.maximum(0.0, self.longest**2 - square))
        return (dense @ self.axes[:-1] + last[:, None] * self.axes[-1]) / self.longest

    def place(self, dense: np.ndarray, query: bool = False) -> np.ndarray:
        """Positions in units of cells, a row for each vector."""
        return (self.raw(dense, query) - self.mean) / (self.scale * self.width) + self.shift

    def codes(self, dense: np.ndarray) -> np.ndarray:
        """Bucket numbers, a column for each table."""
        cells = np.clip(np.floor(self.place(dense)), LOW, HIGH).astype(np.int64) - LOW
        side = HIGH - LOW + 1
        return cells.reshape(len(dense), self.tables, self.hashes) @ (side ** np.arange(self.hashes - 1, -1, -1))


def cells_of(codes: np.ndarray, hashes: int) -> np.ndarray:
    side = HIGH - LOW + 1
    return codes[:, None] // side ** np.arange(hashes - 1, -1, -1) % side + LOW


def success(place: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Squared distances of queries (rows) to buckets (columns): the smaller, the likelier a hit."""
    low = np.where(cells == LOW, -np.inf, cells)
    high = np.where(cells == HIGH, np.inf, cells + 1)
    away = np.zeros((len(place), len(cells)))
    for j in range(cells.shape[1]):
        p = place[:, j : j + 1]
        away += np.maximum(0, np.maximum(low[:, j] - p, p - high[:, j])) ** 2
    return away


def visits(place: np.ndarray, cells: np.ndarray, sizes: np.ndarray, probes: int, least: int) -> np.ndarray:
    """Which buckets each query visits: the first by success estimate, until both bounds are met."""
    away = success(place, cells)
    order = np.argsort(away, axis=1, kind="stable")
    held = np.cumsum(sizes[order], axis=1)
    wanted = (np.arange(len(cells)) < probes) | (held - sizes[order] < least)
    out = np.zeros(away.shape, bool)
    np.put_along_axis(out, order, wanted, axis=1)
    return out


def dense_of(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of numbers as rows of doubles, padded with zeros."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(lengths), dim))
    starts = offsets[:-1] - offsets[0]
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[at, :n] = flat[starts[at][:, None] + np.arange(n)]
    return out


def blocks_of(counts: list[tuple[int, int, int]], blocks: int, max_block: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(table, bucket, how many) to (table, bucket) -> (first block, over how many it is split)."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    now, room = -1, 0
    last = None
    total = sum(c for _, _, c in counts) / max(1, len({t for t, _, _ in counts}))
    target = max(1, min(max_block, int(-(-total // blocks))))
    for t, bucket, many in sorted(counts):
        if many > target:
            split = -(-many // target)
            out[t, bucket] = (now + 1, split)
            now, room = now + split, 0
        else:
            if many > room or t != last:
                now, room = now + 1, target
            out[t, bucket] = (now, 1)
            room -= many
        last = t
    return out


def fit(rows: DataFrame, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, seed: int = SEED) -> Hashes | None:
    """Hashes for usable (id, vector) rows: sums over all of them; None if there are none."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    longest, dim = rows.agg(F.max(norm), F.max(F.size("vector"))).first()
    if not longest:
        return None
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(dim + 1, tables * hashes))
    n = tables * hashes
    made = Hashes(tables, hashes, width, longest, axes, rng.uniform(0, 1, n), np.zeros(n), np.ones(n))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, square, many = np.zeros(n), np.zeros(n), 0
        for b in batches:
            p = made.raw(dense_of(b.column(0), dim), False)
            total, square, many = total + p.sum(0), square + (p * p).sum(0), many + len(p)
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(total), pa.array(square), pa.array([many] * n, pa.int64())], names=["j", "s", "q", "n"])

    found = rows.select("vector").mapInArrow(sums, "j int, s double, q double, n long").groupBy("j").agg(F.sum("s"), F.sum("q"), F.sum("n")).orderBy("j").collect()
    mean = np.array([r[1] / r[3] for r in found])
    spread = np.sqrt(np.maximum(0, np.array([r[2] / r[3] for r in found]) - mean**2))
    made.mean, made.scale = mean, np.where(spread > 0, spread, 1.0)
    return made


def exact(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products, summed in component order whatever the number of candidates."""
    total = np.zeros(len(candidates))
    for t in range(len(query)):
        total += query[t] * candidates[:, t]
    return total


def fit_probes(candidates: DataFrame, made: Hashes, known: list[np.ndarray], k: int = K, asked: int = ASKED, recall: float = RECALL) -> int:
    """Buckets a table that must be visited to meet ``recall`` of the neighbours of ``asked`` vectors.

    candidates: (id, vector); known: the bucket numbers of each table. Every task keeps its best k
    for each vector asked, and the driver sees the k best of these alone.
    """
    dim, kind = len(made.axes) - 1, candidates.schema["id"].dataType.simpleString()
    some = candidates.orderBy(F.xxhash64("id"), "id").limit(asked).collect()
    ids = np.array([r.id for r in some])
    vectors = np.array([[*map(float, r.vector), *[0.0] * (dim - len(r.vector))] for r in some])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            dense, own = dense_of(b.column(1), dim), b.column(0).to_numpy()
            scores = vectors @ dense.T
            scores[ids[:, None] == own] = -np.inf
            at = np.argpartition(-scores, min(k, len(own)) - 1, axis=1)[:, :k]
            codes = made.codes(dense)[at.ravel()]
            cols = [np.repeat(np.arange(len(ids)), at.shape[1]), own[at.ravel()], np.take_along_axis(scores, at, 1).ravel()]
            yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(list(codes), pa.list_(pa.int64()))], names=["q", "id", "score", "codes"])

    found = candidates.select("id", "vector").mapInArrow(scan, f"q long, id {kind}, score double, codes array<long>").where(F.col("score") > float("-inf"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    met = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "codes").collect()
    place, needed = made.place(vectors, True), np.full(len(met), np.iinfo(np.int64).max)
    for t, codes in enumerate(known):
        away = success(place[:, t * made.hashes : (t + 1) * made.hashes], cells_of(codes, made.hashes))
        rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
        at = np.searchsorted(codes, [r.codes[t] for r in met])
        needed = np.minimum(needed, rank[[r.q for r in met], at] + 1)
    return int(np.quantile(needed, recall, method="higher")) if len(met) else 1


def _met(dim: int, k: int):
    """(block, side, id, buckets, vector), candidates (side 0) before queries, to each query's best of each block."""

    def answer(held, batch) -> pa.RecordBatch:
        ids, bucket, dense = held
        asked, lists, vectors = batch.column(2).to_numpy(), batch.column(3), dense_of(batch.column(4), dim)
        number = np.unique(bucket)
        of = np.searchsorted(number, bucket)
        who, which = np.repeat(np.arange(len(asked)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
        at = np.minimum(np.searchsorted(number, which), len(number) - 1)
        visited = np.zeros((len(asked), len(number)), bool)
        there = number[at] == which
        visited[who[there], at[there]] = True
        out: tuple[list, list, list] = ([], [], [])
        for i in range(0, len(asked), 256):
            scores = vectors[i : i + 256] @ dense.T
            scores[~visited[i : i + 256][:, of] | (asked[i : i + 256, None] == ids)] = -np.inf
            for j, row in enumerate(scores):
                many = k
                while True:  # equal (id, score) pairs count once: more rows are taken until k pairs differ
                    cut = -np.inf if len(row) <= many else row[np.argpartition(-row, many - 1)[:many]].min()
                    near = np.flatnonzero((row >= cut - 1e-9 * (1 + abs(cut)) if np.isfinite(cut) else row > -np.inf) & (row > -np.inf))
                    value = exact(vectors[i + j], dense[near])
                    best = np.lexsort((ids[near], -value))
                    fresh = np.concatenate([[True], (np.diff(ids[near][best]) != 0) | (np.diff(value[best]) != 0)])[: len(best)]
                    best = best[fresh][:k]
                    if len(best) == k or not np.isfinite(cut):
                        break
                    many *= 4
                if not len(best):
                    continue
                out[0].append(np.full(len(best), asked[i + j]))
                out[1].append(ids[near][best])
                out[2].append(value[best])
        cols = [np.concatenate([*x, np.zeros(0, kind)]).astype(kind) for x, kind in zip(out, (np.int64, np.int64, np.float64), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, held = None, [], None
        for b in batches:
            key = b.column(0).to_numpy().astype(np.int64) * 2 + b.column(1).to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if key[lo] // 2 != block:
                    block, parts, held = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    parts.append((part.column(2).to_numpy(), part.column(3).flatten().to_numpy(), dense_of(part.column(4), dim)))
                    continue
                if held is None and parts:
                    held, parts = tuple(np.concatenate(x) for x in zip(*parts, strict=True)), []
                if held is not None:
                    yield answer(held, part)

    return run


def search(
    candidates: DataFrame,
    queries: DataFrame,
    k: int = K,
    tables: int = TABLES,
    hashes: int = HASHES,
    width: float = WIDTH,
    probes: int | None = None,
    least: int = LEAST,
    blocks: int = BLOCKS,
    max_block: int = MAX_BLOCK,
    seed: int = SEED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates found for each query.

    candidates, queries: (id, vector array of numbers); other columns don't matter. Empty
    tables give empty results.
    """
    zero = F.forall("vector", lambda x: x == 0)
    c, q = (x.select(F.col("id").cast("long").alias("id"), "vector").where(usable("vector") & F.col("id").isNotNull() & ~zero) for x in (candidates, queries))
    spark = c.sparkSession
    c = written(c.dropDuplicates(["id", "vector"]), "candidates")
    made = fit(c, tables, hashes, width, seed)
    if made is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = len(made.axes) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = made.codes(dense_of(b.column(0), dim))
            for t in range(tables):
                code, many = np.unique(codes[:, t], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(code), pa.int32()), pa.array(code), pa.array(many)], names=["t", "code", "n"])

    counts = [tuple(r) for r in c.select("vector").mapInArrow(count, "t int, code long, n long").groupBy("t", "code").agg(F.sum("n")).collect()]
    blocks_by = blocks_of(counts, blocks, max_block)
    lists = []
    for t in range(tables):
        own = sorted((code, n) for x, code, n in counts if x == t)
        codes = np.array([x for x, _ in own], np.int64)
        lists.append((codes, cells_of(codes, hashes), np.array([n for _, n in own]), np.array([blocks_by[t, x] for x, _ in own]).reshape(-1, 2)))
    if probes is None:
        probes = fit_probes(c, made, [known for known, _, _, _ in lists], k)
    schema = f"block int, side int, id long, buckets array<int>, vector {c.schema['vector'].dataType.simpleString()}"
    wide = 6**hashes

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            codes = made.codes(dense_of(b.column(1), dim))
            for t, (known, _, _, spots) in enumerate(lists):
                first, split = spots[np.searchsorted(known, codes[:, t])].T
                block = first + (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % split
                one = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1), pa.int32()), pa.array(t * wide + codes[:, t], pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(np.zeros(len(ids), np.int32)), b.column(0), one, b.column(1)], names=["block", "side", "id", "buckets", "vector"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 512):
                b = big.slice(i, 512)
                place = made.place(dense_of(b.column(1), dim), True)
                for t, (known, cells, sizes, spots) in enumerate(lists):
                    seen = visits(place[:, t * hashes : (t + 1) * hashes], cells, sizes, probes, least)
                    first, split = spots.T
                    rows, block, buckets = [], [], []
                    for n in np.unique(first):
                        own = np.flatnonzero(first == n)
                        asked = seen[:, own]
                        for r in np.flatnonzero(asked.any(axis=1)):
                            found = (t * wide + known[own[asked[r]]]).tolist()
                            for s in range(split[own[0]]):
                                rows.append(r)
                                block.append(n + s)
                                buckets.append(found)
                    at = b.take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block, pa.int32()), pa.array([1] * len(rows), pa.int32()), at.column(0), pa.array(buckets, pa.list_(pa.int32())), at.column(1)], names=["block", "side", "id", "buckets", "vector"]
                    )

    many = max((b + n for b, n in blocks_by.values()), default=1)
    both = c.mapInArrow(index, schema).union(q.select("id", F.col("vector").cast(c.schema["vector"].dataType).alias("vector")).mapInArrow(probe, schema))
    dealt = both.repartition(many, "block").sortWithinPartitions("block", "side")
    found = dealt.mapInArrow(_met(dim, k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    placed = found.withColumn("rank", F.dense_rank().over(w)).where(F.col("rank") <= k)
    return placed.groupBy("query_id", "rank").agg(F.first("vec_id").alias("vec_id"), F.first("score").alias("score"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, rows.where(F.col("id") % EVERY == 0))


QUERIES = {"op7_neighbours": op7_neighbours}
ORACLES: dict[str, str] = {}
