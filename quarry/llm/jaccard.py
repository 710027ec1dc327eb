"""Near duplicates by the Jaccard similarity of their shingles: an exact set-similarity join.

A text is the set of its five-word shingles (64-bit hashes). Texts of one set are one class,
whatever their number; classes of similarity ``SIMILARITY`` or more are linked, and components
of links are groups.

Candidates come from a prefix filter: shingles are put in one order for all texts, and two sets
of n and m shingles can only be similar if their first n - ceil(0.8 n) + 1 and m - ceil(0.8 m) + 1
share one. Any order is right; shingles that a sample finds often come last, so that common
lines make few candidates. Size and position filters drop what cannot reach the similarity.

The first pairs are those of SimHash: classes of one fingerprint, and a star of each set of
fingerprints that ``simhash``'s covering hashing joins. It misses most pairs near the
similarity, so the prefix filter follows it and is complete.

A run of up to ``run_cap`` classes with one shingle gives all its pairs. A longer run first
gives the pairs of neighbours by size. SimHash's pairs and one of these for each class are
confirmed first; of the rest, only pairs of different components are compared: those of short
runs at once, those of long runs block by block, so that no pair is left out and none is
compared whose answer is known.

A pair is first held against parity bitmaps, whose differing bits are never more than the
differing shingles, and then confirmed by the sets themselves, row by row in the JVM, so
that a task holds two sets at a time however long the texts are. Two blocks of a long run give
no pairs, whose number would be the square of a group's: bitmaps leave the members that may
have a link, and these members' sets then give a spanning set of their links. Blocks are
bounded by members and by shingles.

Null and empty texts are one class, of no shingle. A null doc_id takes part. Repeated rows
are of one class. Columns of any name survive; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.common import discard, quoted, written
from quarry.llm.components import components

SIMILARITY, SHINGLE, RUN_CAP, BLOCK = 0.8, 5, 64, 1024
SAMPLE, OFTEN, LISTED = 32, 3, 100_000
#: Classes whose hashes are broadcast to fetch their texts; more are joined by hash.
MAX_ASKED = 1_000_000
#: Shingles that a block of a long run holds for each of its ``block`` members, on average.
MEMBER = 512
#: Bits of the bitmap that a member of a long run carries.
SKETCH = 256


def shingles(raw: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of UTF-8 bytes' shingles: A-Z lower-cased, words split at white space."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts = [0, *(e + 1 for e in ends)]
    ends.append(len(joined))
    last = min(width, len(words)) - 1
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[last:], strict=False)), np.uint64))


def prefix_size(n: int, similarity: float = SIMILARITY) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def most_apart(total, similarity: float = SIMILARITY):
    """How many shingles may differ between similar sets of ``total`` shingles together."""
    return np.floor(total * (1 - similarity) / (1 + similarity) + 1e-9)


def parities(found: np.ndarray) -> bytes:
    """A bitmap of two bits or more for each shingle: whether an odd number of shingles fall on a bit."""
    size = 1 << max(6, (2 * len(found) - 1).bit_length())
    bits = np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def sketch(found: np.ndarray) -> bytes:
    """Such a bitmap of ``SKETCH`` bits, whatever the set."""
    return np.packbits((np.bincount((found & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).astype(np.uint8)).tobytes()


def least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the shingles that differ, from two bitmaps; the larger one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _binary(column: pa.Array) -> list:
    return column.cast(pa.binary()).to_pylist()


def common_shingles(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """Shingles that a sample of distinct texts holds often; they only set the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in _binary(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(raw, width).view(np.int64))], names=["key"])

    sample = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(F.col(text).alias("text")).distinct()
    often = sample.mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= OFTEN)
    rows = often.orderBy(F.desc("count"), "key").limit(LISTED).select("key").collect()
    return np.sort(np.array([r.key for r in rows], np.int64).view(np.uint64))


def prints(docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """(id, hash, text) rows to (id, hash, cls, n, prefix, bits, sketch, fp); ``fp`` is SimHash's fingerprint."""
    common = common_shingles(docs, "text", width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                b = big.slice(i, 1000)
                cls, sizes, prefixes, bits, sketches, fps = [], [], [], [], [], []
                for raw in _binary(b.column(2)):
                    found = shingles(raw, width)
                    at = np.minimum(np.searchsorted(common, found), max(0, len(common) - 1))
                    late = common[at] == found if len(common) else np.zeros(len(found), bool)
                    ordered = np.concatenate([found[~late], found[late]])
                    cls.append(xxhash.xxh64_intdigest(found.tobytes(), 42) - (1 << 63))
                    sizes.append(len(found))
                    prefixes.append(ordered[: prefix_size(len(found), similarity) if len(found) else 0].view(np.int64))
                    bits.append(parities(found))
                    sketches.append(sketch(found))
                    fps.append(simhash.fingerprint(raw, width))
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cls, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(bits, pa.binary()), pa.array(sketches, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "hash", "cls", "n", "prefix", "bits", "sketch", "fp"])

    kind = docs.schema["id"].dataType.simpleString()
    return written(docs.select("id", "hash", "text").mapInArrow(run, f"id {kind}, hash long, cls long, n int, prefix array<long>, bits binary, sketch binary, fp long"), "prints")


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that SimHash holds near, as a table: of one fingerprint, or of linked ones by their least classes."""
    heads = written(classes.groupBy("fp").agg(F.min("cls").alias("head")), "heads")
    near = written(simhash.links_between(heads.select("fp")).distinct(), "near-prints")
    x, y = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}")) for c in "ab")
    linked = near.join(x, "a").join(y, "b").select("ha", "hb")
    pairs = linked.union(classes.join(heads, "fp").where("cls != head").select("head", "cls"))
    made = written(pairs.select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct(), "by-fingerprint")
    discard(heads, near)
    return made


def _may_reach(n, i, m, j, similarity: float):
    """Size and position filters: sets of n and m shingles that share their i-th and j-th."""
    need = np.ceil((n + m) * similarity / (1 + similarity) - 1e-9)
    # the shared shingle need not be the first one: those before may be shared as well
    return (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9) & (np.minimum(i, j) + 1 + np.minimum(n - i - 1, m - j - 1) >= need)


def _stacked(parts: list, columns: int) -> list[np.ndarray]:
    """Tuples of columns of longs, one under another."""
    return [np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * columns, *parts, strict=True)]


def _runs(cap: int, similarity: float):
    """(key, n, cls, pos) sorted by (key, n, cls) to pairs (kind 0: a, b) and members of long runs (kind 1)."""

    def emit(pairs, members):
        a, b = _stacked(pairs, 2)
        key, n, cls, pos = _stacked(members, 4)
        kind = np.repeat([0, 1], [len(a), len(key)])
        none = np.zeros(len(a), np.int64)
        cols = [kind, *(np.concatenate(x) for x in ((a, cls), (b, key), (none, n), (none, pos)))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["kind", "a", "b", "n", "pos"])

    def done(run, pairs, members):
        key, n, cls, pos = run
        one = np.concatenate([[True], cls[1:] != cls[:-1]])
        key, n, cls, pos = key[one], n[one], cls[one], pos[one]
        if len(cls) < 2:
            return
        if len(cls) <= cap:
            i, j = np.triu_indices(len(cls), 1)
        else:
            members.append((key, n, cls, pos))
            i = np.arange(len(cls) - 1)
            j = i + 1
        ok = _may_reach(n[i], pos[i], n[j], pos[j], similarity)
        x, y = cls[i[ok]], cls[j[ok]]
        pairs.append((np.minimum(x, y), np.maximum(x, y)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        pairs: list = []
        members: list = []
        for b in batches:
            if not b.num_rows:
                continue
            cols = [c.to_numpy().astype(np.int64) for c in b.columns]
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            if held and held[0][0][0] != cols[0][0]:
                done([np.concatenate(x) for x in zip(*held, strict=True)], pairs, members)
                held = []
            bounds = [0, *cuts.tolist(), len(cols[0])]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                part = [c[lo:hi] for c in cols]
                if hi == len(cols[0]):
                    held.append(part)
                elif lo == 0 and held:
                    done([np.concatenate(x) for x in zip(*held, part, strict=True)], pairs, members)
                    held = []
                elif hi - lo > 1:
                    done(part, pairs, members)
            yield emit(pairs, members)
            pairs, members = [], []
        if held:
            done([np.concatenate(x) for x in zip(*held, strict=True)], pairs, members)
        yield emit(pairs, members)

    return run


def _block_members(similarity: float):
    """Some minor members (side 0) of a long run with a block of its members: those that may be similar to one of another component."""

    def run(found: pa.Table) -> pa.Table:
        side, minor, cls, n, pos, root = (found.column(c).to_numpy() for c in ("side", "minor", "cls", "n", "pos", "root"))
        bits = np.frombuffer(b"".join(_binary(found.column("sketch").combine_chunks())), np.uint64).reshape(len(side), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        met = np.zeros(len(side), bool)
        for i in left:
            ok = right[(root[right] != root[i]) & ((minor[right] == 0) | (cls[right] > cls[i]))]
            ok = ok[_may_reach(n[i], pos[i], n[ok], pos[ok], similarity)]
            ok = ok[np.bitwise_count(bits[ok] ^ bits[i]).sum(axis=1) <= most_apart(n[i] + n[ok], similarity)]
            met[ok] = True
            met[i] = len(ok) > 0
        return found.select(["key", "i", "j", "side", "cls", "root"]).filter(pa.array(met))

    return run


def _block_links(similarity: float):
    """Members of both sides with their sets: links between the sides, as many as join what similar pairs join."""

    def run(found: pa.Table) -> pa.Table:
        side, cls, group = (found.column(c).to_numpy() for c in ("side", "cls", "root"))
        group = group.copy()
        sets = found.column("found").combine_chunks()
        ends = sets.offsets.to_numpy() - sets.offsets[0].as_py()
        known, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        size = np.diff(ends)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        others = np.concatenate([code[:0], *(code[ends[j] : ends[j + 1]] for j in right)])
        starts = np.cumsum(size[right]) - size[right]
        out: list = []
        for i in left:
            if (group[right] == group[i]).all():
                continue
            mine = np.zeros(len(known), np.int8)
            mine[code[ends[i] : ends[i + 1]]] = 1
            both = np.add.reduceat(mine[others], starts, dtype=np.int64)
            for j in right[both >= (size[i] + size[right] - both) * similarity - 1e-9]:
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    out.append((min(cls[i], cls[j]), max(cls[i], cls[j])))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _near(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) of classes whose bitmaps allow that they are similar, as a table."""

    def by_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 1000):
                b = big.slice(i, 1000)
                most = most_apart(b.column(2).to_numpy() + b.column(3).to_numpy(), similarity)
                ok = [least_apart(x, y) <= m for x, y, m in zip(_binary(b.column(4)), _binary(b.column(5)), most, strict=True)]
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return written(pairs.distinct().join(x, "a").join(y, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(by_bits, "a long, b long"), "pairs")


def _sets(asked: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The sets (cls, found) of the classes asked for, as a table."""

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 500):
                b = big.slice(i, 500)
                found = [shingles(raw, width).view(np.int64) for raw in _binary(b.column(1))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], names=["cls", "found"])

    which = written(classes.select("cls", "hash").join(asked.distinct(), "cls"), "asked")
    rows = docs.select("hash", "text").join(F.broadcast(which) if which.count() <= MAX_ASKED else which, "hash")
    made = written(rows.groupBy("cls").agg(F.first("text").alias("text")).mapInArrow(sets_of, "cls long, found array<long>"), "sets")
    discard(which)
    return made


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float, width: int) -> DataFrame:
    """Those of the pairs (a, b) of classes whose sets are similar, as a table."""
    sets = _sets(pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))), docs, classes, width)
    s, t = (sets.select(F.col("cls").alias(c), F.col("found").alias(f"s{c}")) for c in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    all_ = F.size("sa") + F.size("sb")
    made = written(pairs.join(s, "a").join(t, "b").where(both >= (all_ - both) * similarity - 1e-9).select("a", "b"), "confirmed")
    discard(sets)
    return made


def _between_blocks(placed: DataFrame, docs: DataFrame, classes: DataFrame, similarity: float, width: int, block: int) -> DataFrame:
    """Links (a, b) of members (key, cls, n, pos, root) of long runs that join what similar pairs of different roots join, as a table."""
    by_root = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("held"))
    top = F.max(F.struct("many", "root", "held")).alias("top")
    sizes = by_root.groupBy("key").agg(top, F.sum("many").alias("all"), F.sum("held").alias("held")).where("all > top.many")
    blocks = lambda many, held: F.ceil(F.greatest(many / block, held / (block * MEMBER)))
    sizes = sizes.select(
        "key", F.col("top.root").alias("main"), blocks(F.col("all"), F.col("held")).alias("blocks"), blocks(F.col("all") - F.col("top.many"), F.col("held") - F.col("top.held")).alias("minors")
    )
    sizes = written(sizes, "sizes")
    own = placed.join(sizes, "key").join(classes.select("cls", "sketch"), "cls").select(
        "key", "cls", "n", "pos", "root", "sketch", "blocks", "minors", (F.col("root") != F.col("main")).cast("int").alias("minor"), F.xxhash64("cls").alias("h")
    )
    own = written(own, "own")
    upto = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), F.col(many) - 1))
    left = own.where("minor = 1").withColumns({"i": F.pmod("h", "minors"), "side": F.lit(0)}).withColumn("j", upto("blocks"))
    right = own.withColumns({"j": F.pmod("h", "blocks"), "side": F.lit(1)}).withColumn("i", upto("minors"))
    met = left.unionByName(right).groupBy("key", "i", "j").applyInArrow(_block_members(similarity), "key long, i long, j long, side int, cls long, root long")
    met = written(met, "met")
    sets = _sets(met.select("cls"), docs, classes, width)
    made = written(met.join(sets, "cls").groupBy("key", "i", "j").applyInArrow(_block_links(similarity), "a long, b long").distinct(), "between")
    discard(met, sets, sizes, own)
    return made


def links(docs: DataFrame, kept: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, run_cap: int = RUN_CAP, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of classes whose components are those of all similar pairs."""
    same = [F.first(c).alias(c) for c in ("n", "bits", "sketch")]
    classes = written(kept.groupBy("cls").agg(F.min("hash").alias("hash"), F.min("fp").alias("fp"), *same), "classes")
    prints_near = by_fingerprint(classes.select("cls", "fp"))
    keys = kept.select(F.posexplode("prefix").alias("pos", "key"), "n", "cls").select("key", "n", "cls", "pos")
    dealt = keys.repartition("key").sortWithinPartitions("key", "n", "cls")
    found = written(dealt.mapInArrow(_runs(run_cap, similarity), "kind long, a long, b long, n long, pos long"), "runs")
    near = _near(found.where("kind = 0").select("a", "b").union(prints_near), classes, similarity)
    ahead = near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").union(near.join(prints_near, ["a", "b"], "left_semi"))
    asked = written(ahead.distinct(), "ahead")
    first = _confirmed(asked, docs, classes, similarity, width)
    roots = components(first).withColumnRenamed("node", "cls")
    x, y = (roots.select(F.col("cls").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
    open_ = near.join(asked, ["a", "b"], "left_anti").join(x, "a", "left").join(y, "b", "left")
    rest = written(open_.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "rest")
    made = first if rest.isEmpty() else first.union(_confirmed(rest, docs, classes, similarity, width))

    members = found.where("kind = 1").select(F.col("b").alias("key"), F.col("a").alias("cls"), "n", "pos")
    roots = roots if made is first else components(made).withColumnRenamed("node", "cls")
    placed = written(members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "members")
    made = made if placed.isEmpty() else made.union(_between_blocks(placed, docs, classes, similarity, width, block))
    discard(found, near, prints_near, asked, placed, rest, classes)
    return made


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, width: int = SHINGLE, text: str = "text", doc_id: str = "doc_id", run_cap: int = RUN_CAP, block: int = BLOCK) -> DataFrame:
    """One row of each group, as it was: that of the least doc_id (nulls last), then the least text hash."""
    slim = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    kept = prints(slim, similarity, width)
    roots = components(links(slim, kept, similarity, width, run_cap, block)).withColumnRenamed("node", "cls")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least")
    classes = kept.groupBy("cls").agg(least).join(roots, "cls", "left")
    stay = classes.groupBy(F.coalesce("root", "cls")).agg(F.min("least").alias("least")).select("least.*")
    rows = docs.select(F.struct(*quoted(docs.columns)).alias("row"), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"))
    met = rows.join(stay.select(F.col("id").alias("i"), F.col("hash").alias("h")), F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h")))
    place = F.row_number().over(Window.partitionBy("i", "h").orderBy(F.lit(0)))
    return met.withColumn("place", place).where("place = 1").select("row.*")
