"""Near duplicates by SimHash and covering locality-sensitive hashing.

A text's fingerprint has a bit set where over half of its shingles' hashes have it set.
Documents of one fingerprint are one class, whatever their number; links are sought
between classes only.

Two fingerprints within the radius r are found by 2^(r+1)-1 bit masks: every bit position
gets a vector of r+1 bits, and mask v keeps the positions whose vector has an odd inner
product with v, for every v but zero. The vectors of at most r differing positions lie
in a proper subspace, so some v is orthogonal to all of them: its mask leaves out every
differing position, and the pair collides in table v. No pair within the radius is missed.

Each table's keys are dealt out and sorted, and runs of one key are streamed through a
task. In a run the distances are exact, and only a spanning star of each connected part
is emitted. A run longer than ``run_cap`` is not held by one task: its members are cut into
blocks, and every pair of blocks is compared by a task of its own, so that the answer stays
exact. Components of all links are then found by star contraction.

Null and empty texts have fingerprint zero and are linked like any other. A null doc_id
takes part; a component's id is the smallest doc_id that is not null. Equal fingerprints and
repeated rows are of one component. Columns of any name survive, but for the text and those named
like the new ones. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import columns_but, long_field, quoted, table, with_text_columns, written
from quarry.llm.components import components

RADIUS, SHINGLE, RUN_CAP = 4, 4, 4096


def fingerprint(raw: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of UTF-8 bytes: A-Z lower-cased, words split at white space."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(joined))
    n = len(words) - width + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for i in range(0, n, 16_384):
        m = min(n, i + 16_384)
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[i:m], ends[i + width - 1 : m + width - 1], strict=True)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1)-1 masks of 64 bits, of which one leaves out any ``radius`` bits chosen."""
    size = 1 << (radius + 1)
    vectors = [1 + (i * 11 + i // (size - 1) * 7) % (size - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _stars(values: np.ndarray, radius: int, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning star (least, other) of each connected part of ``values`` (with ``others``)."""
    pool = values if others is None else np.concatenate([values, others])
    left = np.ones(len(pool), bool)
    out = []
    for seed in range(len(pool)):
        if not left[seed]:
            continue
        left[seed] = False
        part, front = [seed], [seed]
        while front:
            rest = np.flatnonzero(left)
            if not len(rest):
                break
            near = rest[np.bitwise_count(pool[rest] ^ pool[front.pop()]) <= radius]
            left[near] = False
            part.extend(near.tolist())
            front.extend(near.tolist())
        if len(part) > 1:
            ids = pool[part].view(np.int64)
            least = int(ids.min())
            out.extend((least, int(x)) for x in np.unique(ids) if x != least)
    return out


def _runs(radius: int, cap: int):
    """Batches sorted by (mask, key) to links (kind 0: a, b) and members of long runs (kind 1: mask, key, member)."""

    def emit(links, long_):
        cols = [[0] * len(links) + [1] * len(long_), [0] * len(links) + [x[0] for x in long_]]
        cols += [[x[0] for x in links] + [x[1] for x in long_], [x[1] for x in links] + [x[2] for x in long_]]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], names=["kind", "mask", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held, long_run = None, np.zeros(0, np.uint64), False
        links: list[tuple[int, int]] = []
        long_: list[tuple[int, int, int]] = []
        for b in batches:
            if not b.num_rows:
                continue
            mask, key, value = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy()
            cuts = np.flatnonzero((np.diff(mask) != 0) | (np.diff(key) != 0)) + 1
            bounds = np.concatenate([[0], cuts, [len(key)]])
            size = np.diff(bounds)
            two = np.flatnonzero(size == 2)
            two = two[(two > 0) & (two < len(size) - 1)]
            x, y = value[bounds[two]], value[bounds[two] + 1]
            near = np.bitwise_count((x ^ y).view(np.uint64)) <= radius
            links.extend(zip(np.minimum(x, y)[near].tolist(), np.maximum(x, y)[near].tolist(), strict=True))
            picked = set(np.flatnonzero(size > 2).tolist()) | {0, len(size) - 1}
            for i in sorted(picked):
                lo, hi = bounds[i], bounds[i + 1]
                now = (int(mask[lo]), int(key[lo]))
                fresh = value[lo:hi].view(np.uint64)
                if now != held_key:
                    if not long_run and len(held) > 1:
                        links.extend(_stars(held, radius))
                    held_key, held, long_run = now, np.zeros(0, np.uint64), False
                if long_run:
                    long_.extend((*now, int(v)) for v in fresh.view(np.int64))
                elif len(held) + len(fresh) > cap:
                    long_.extend((*now, int(v)) for v in np.concatenate([held, fresh]).view(np.int64))
                    held, long_run = held[:0], True
                else:
                    held = np.concatenate([held, fresh])
                if i < len(size) - 1 and not long_run:
                    if len(held) > 1:
                        links.extend(_stars(held, radius))
                    held = held[:0]
            if len(links) + len(long_) > 50_000:
                yield emit(links, long_)
                links, long_ = [], []
        if not long_run and len(held) > 1:
            links.extend(_stars(held, radius))
        yield emit(links, long_)

    return run


def _block_links(radius: int):
    """One pair of blocks of a long run: members come as (side, value)."""

    def run(found: pa.Table) -> pa.Table:
        side, value = found.column("side").to_numpy(), found.column("b").to_numpy()
        stars = _stars(value[side == 0].view(np.uint64), radius, value[side == 1].view(np.uint64))
        return pa.table({"a": pa.array([x[0] for x in stars], pa.int64()), "b": pa.array([x[1] for x in stars], pa.int64())})

    return run


def links_between(classes: DataFrame, radius: int = RADIUS, run_cap: int = RUN_CAP) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``fp`` within the radius.

    classes: distinct ``fp`` (long). A link joins members of one component; every pair
    within the radius is joined by a path of links.
    """
    tables = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks(radius))]))
    keys = classes.select(tables.alias("t"), "fp").select("t.mask", "t.key", "fp")
    dealt = keys.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
    found = written(dealt.mapInArrow(_runs(radius, run_cap), "kind int, mask int, a long, b long"), "runs")
    near = found.where("kind = 0").select("a", "b")
    members = found.where("kind = 1").select("mask", F.col("a").alias("key"), "b")
    sizes = members.groupBy("mask", "key").agg(F.ceil(F.count(F.lit(1)) / (run_cap // 2)).alias("n"))
    own = members.join(sizes, ["mask", "key"]).withColumn("own", F.pmod(F.xxhash64("b"), F.col("n")))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("o")
    pairs = own.select("mask", "key", "b", "own", other).select(
        "mask", "key", "b", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side")
    )
    return near.union(pairs.groupBy("mask", "key", "i", "j").applyInArrow(_block_links(radius), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, text: str = "text", doc_id: str = "doc_id", run_cap: int = RUN_CAP) -> DataFrame:
    """``docs`` without its text, with ``fp`` (long), ``root`` (a component's least fp) and ``component_id``."""

    def maker():
        return lambda texts: [[_signed(fingerprint(t, width)) for t in texts]]

    prints = with_text_columns(docs, [long_field("fp")], maker, text)
    kept = written(prints.select(*quoted(columns_but(prints, [text, "root", "component_id"]))), "fingerprints")
    classes = kept.groupBy("fp").agg(F.min(doc_id).alias("__least"))
    roots = components(links_between(classes.select("fp"), radius, run_cap)).withColumnRenamed("node", "fp")
    of = written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "classes")
    least = of.groupBy("root").agg(F.min("__least").alias("component_id"))
    return kept.join(of.join(least, "root").select("fp", "root", "component_id"), "fp").select(*[f"`{c}`" for c in kept.columns], "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS, width: int = SHINGLE, text: str = "text", doc_id: str = "doc_id", run_cap: int = RUN_CAP) -> DataFrame:
    """One row of each component, as it was: that of the least doc_id (nulls last), then the least text hash.

    Exactly repeated rows are one component, so one stays. Texts are moved once, to meet the
    short list of the rows that stay.
    """
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    found = near_duplicates(rows.select("id", "hash", "text"), radius, width, "text", "id", run_cap)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("first")
    stay = found.groupBy("root").agg(first).select(F.col("first.id").alias("i"), F.col("first.hash").alias("h"))
    met = rows.drop("text").join(stay, F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    place = F.row_number().over(Window.partitionBy("i", "h").orderBy(F.lit(0)))
    return met.withColumn("place", place).where("place = 1").select("row.*")


def hex_of(column: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex_of().alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash": op8_simhash}
ORACLES: dict[str, str] = {}
