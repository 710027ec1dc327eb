"""Token sequences packed by bulk-synchronous best fit.

Documents become runs of token ids, each closed by ``eos``; only those over the capacity
are cut, the first piece taking what is left over. The pieces are then packed in rounds:
documents and gaps are range-sorted, a successor sweep gives every document the smallest
gap that holds it, documents that want the same gap are served by rank, gaps are updated,
and documents without a gap open sequences, longest first.

Both sides of a sweep are sorted by a whole number that is at most the capacity, so the
sorted order is held run by run: (length, first rank, how many) and (gap, first sequence,
how many). A round is one Spark job over these runs, read from and written to the shared
folder. They are dealt by ranges of size; in every range a task sweeps documents, longest
first, to the smallest gap that holds them, and of a run of documents that want one run of
gaps the lowest ranks get the first gaps. What found no gap in its range meets the gaps left
in the ranges above it at the next levels of the same job, four ranges together, until all
are one. Gaps that a round makes wait for the next round. The driver sees three totals of a
round: documents left, their smallest length and the largest gap; it opens sequences when
nothing fits any more.

A sweep reads at most ``capacity`` lengths, independent of the corpus. Counting the runs,
ranking every piece within its run and turning (length, rank) into (sequence, offset) are
done in stretches of ranks, so that a length that very many pieces share fills no task.

Null texts are empty; an empty text is one piece, the closing id. Repeated rows and pieces
of one length are pieces of their own. Columns of any name survive but for the text and those
named like the new ones. An empty table gives an empty one.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import columns_but, discard, long_field, quoted, table, written

CAPACITY, EOS = 1024, 2
#: Ranges of sizes at the first level of a sweep, and how many of them meet at the next.
RANGES, TOGETHER = 16, 4
#: Ranks of a length that are joined with their steps together.
STRETCH = 1 << 18
#: Words whose ids a task remembers.
CACHE = 400_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder(dict):
    """Texts to ids, the same as the tokenizer file gives, from a memory of words.

    A byte-level BPE splits before a single space, so the ids of a text are those of its
    first word and of each further word with its space. A text with two white space
    characters around a space breaks that rule and is encoded whole; a text that holds
    a special token is left to the tokenizer file's own library.
    """

    def __init__(self, path: str, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        with open(ranks or re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            table_of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ordinary = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_of, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes | None:
        v = None if not word or word[0].isspace() else np.array(self.ordinary(" " + word), "<u4").tobytes()
        if len(self) < CACHE and len(word) <= 64:
            self[word] = v
        return v

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.special and "<" in text and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        parts = list(map(self.__getitem__, rest))
        if None in parts:
            return np.array(self.ordinary(text), "<u4").tobytes()
        return b"".join([np.array(self.ordinary(first), "<u4").tobytes(), *parts])


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, eos: int = EOS, path: str | None = None, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The other columns of ``docs`` with piece, start, length, ids_crc32 (and ids, if asked), a row per piece."""
    path = path or tokenizer_path()
    fields = [T.StructField("piece", T.IntegerType()), long_field("start"), long_field("length"), long_field("ids_crc32")]
    fields += [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids
    keep = columns_but(docs, [text, *(f.name for f in fields)])
    schema = T.StructType([docs.schema[c] for c in keep] + fields)
    names, n = schema.names, len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = Encoder(path).encode, np.array([eos], "<u4").tobytes()
        for b in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, t in enumerate(b.column(n).to_pylist()):
                got = (encode(t) if t else b"") + end
                total = len(got) // 4
                cut, k = 0, 0
                while cut < total:
                    till = cut + ((total - cut - 1) % capacity + 1 if k == 0 else capacity)
                    at.append(row)
                    piece.append(k)
                    start.append(cut)
                    length.append(till - cut)
                    crc.append(zlib.crc32(got[4 * cut : 4 * till]))
                    if with_ids:
                        ids.append(np.frombuffer(got[4 * cut : 4 * till], "<u4").astype("int64"))
                    cut, k = till, k + 1
            own = b.select(list(range(n))).take(pa.array(at, pa.int64())) if n else None
            made = [pa.array(piece, pa.int32()), *(pa.array(v, pa.int64()) for v in (start, length, crc)), *[pa.array(ids, pa.list_(pa.int64()))] * with_ids]
            yield pa.RecordBatch.from_arrays([*(own.columns if n else []), *made], names=names)

    return docs.select(*quoted(keep), F.col(text).alias("__text")).mapInArrow(run, schema)


def sweep(docs: list[list[int]], gaps: dict[int, list[tuple[int, int]]], capacity: int) -> tuple[list[tuple], list[tuple]]:
    """Each run of documents, longest first, goes to the smallest gaps that hold it.

    docs: [length, first rank, how many]; gaps: size to (first sequence, how many); both are
    changed to what is left. Equal documents that fit a gap together are placed together.
    Gives (length, rank, many, per sequence, sequence, offset) and the gaps made, as
    (size, first sequence, how many), that wait for the next round.
    """
    steps, made = [], []
    sizes = sorted(gaps)
    for run in docs:
        length = run[0]
        at = bisect_left(sizes, length)
        while run[2] and at < len(sizes):
            gap = sizes[at]
            while run[2] and gaps[gap]:
                first, many = gaps[gap].pop()
                each = min(gap // length, run[2])
                used = min(many, run[2] // each)
                steps.append((length, run[1], used * each, each, first, capacity - gap))
                run[1] += used * each
                run[2] -= used * each
                if used < many:
                    gaps[gap].append((first + used, many - used))
                if gap > each * length:
                    made.append((gap - each * length, first, used))
            if not gaps[gap]:
                del gaps[gap]
                sizes.pop(at)
    return steps, made


#: Rows of a round: documents left, gaps left, steps, gaps made.
DOCS, GAPS, STEPS, MADE = range(4)
_STATE = ("size", "first", "many", "each", "sequence", "place")
_SCHEMA = ", ".join(["kind int", *(f"{c} long" for c in _STATE)])


def _sweep_range(capacity: int):
    """The sweep of one range: its rows of a round to what is left and made of them."""

    def run(found: pa.Table) -> pa.Table:
        rows = sorted(zip(*(found.column(c).to_pylist() for c in ("kind", *_STATE)), strict=True))
        docs = [list(r[1:4]) for r in reversed(rows) if r[0] == DOCS]
        gaps: dict[int, list[tuple[int, int]]] = {}
        for r in rows:
            if r[0] == GAPS:
                gaps.setdefault(r[1], []).append((r[2], r[3]))
        steps, made = sweep(docs, gaps, capacity)
        out = [r for r in rows if r[0] in (STEPS, MADE)] + [(STEPS, *x) for x in steps] + [(MADE, *x, 0, 0, 0) for x in made]
        out += [(DOCS, *d, 0, 0, 0) for d in docs if d[2]] + [(GAPS, size, *x, 0, 0, 0) for size, left in gaps.items() for x in left]
        columns = list(zip(*out, strict=True))
        return pa.table([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["kind", *_STATE])

    return run


def best_fit(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Steps (length, first, many, each, sequence, place) that place all pieces, from (length, n)."""
    spark = counts.sparkSession
    zeros = [F.lit(0).cast("long").alias(c) for c in _STATE[3:]]
    kind = lambda k: F.lit(k).alias("kind")
    # pieces of over half a sequence open one each: a row a length, so this window is small
    alone = counts.where(2 * F.col("length") > capacity)
    before = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    alone = alone.withColumn("opens", F.coalesce(F.sum("n").over(before), F.lit(0)))
    none = F.lit(0).cast("long")
    start = (
        counts.where(2 * F.col("length") <= capacity)
        .select(kind(DOCS), F.col("length").alias("size"), none.alias("first"), F.col("n").alias("many"), *zeros)
        .union(alone.select(kind(STEPS), "length", none, "n", F.lit(1).cast("long"), "opens", none))
        .union(alone.where(F.col("length") < capacity).select(kind(GAPS), capacity - F.col("length"), "opens", "n", *zeros))
    )
    rounds = [written(start, "round")]
    opened = rounds[0].where(F.col("kind") == STEPS).agg(F.coalesce(F.sum("many"), F.lit(0))).first()[0]
    while True:
        now = rounds[-1].where(F.col("kind") != STEPS)
        is_doc = F.col("kind") == DOCS
        total, least, widest = now.agg(
            F.coalesce(F.sum(F.when(is_doc, F.col("size") * F.col("many"))), F.lit(0)), F.min(F.when(is_doc, F.col("size"))), F.coalesce(F.max(F.when(~is_doc, F.col("size"))), F.lit(0))
        ).first()
        if not total:
            break
        now = now.withColumn("kind", F.when(F.col("kind") == MADE, F.lit(GAPS)).otherwise(F.col("kind")))
        if widest < least:
            fresh = -(-total // capacity)
            now = now.union(spark.range(1).select(kind(GAPS), F.lit(capacity).cast("long"), F.lit(opened).cast("long"), F.lit(fresh).cast("long"), *zeros))
            opened += fresh
        ranges = RANGES
        while True:
            place = F.floor((F.col("size") - 1) * ranges / capacity).cast("int")
            now = now.withColumn("range", place).repartition(ranges, "range").groupBy("range").applyInArrow(_sweep_range(capacity), _SCHEMA)
            if ranges == 1:
                break
            ranges = max(1, ranges // TOGETHER)
        rounds.append(written(now, "round"))
    steps = rounds[0].where(F.col("kind") == STEPS)
    for r in rounds[1:]:
        steps = steps.union(r.where(F.col("kind") == STEPS))
    made = written(steps.select(F.col("size").alias("length"), *_STATE[1:]).coalesce(8), "steps")
    discard(*rounds)
    return made


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` from 1 to capacity) with ``sequence_id`` and ``offset``."""
    own = columns_but(pieces, ["sequence_id", "offset"])
    kept = written(pieces.select(F.struct(*quoted(own)).alias("row"), F.col("length").cast("long").alias("length")), "pieces")
    rows = kept.select("row", "length", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    by_file = written(rows.groupBy("length", "file").agg(F.count(F.lit(1)).alias("n")), "counts")
    before = Window.partitionBy("length").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_file.select("length", "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    steps = best_fit(by_file.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    place = Window.partitionBy("length", "file").orderBy("at")
    ranked = rows.withColumn("own", F.row_number().over(place) - 1).join(offsets, ["length", "file"]).select("row", "length", (F.col("own") + F.col("before")).alias("rank"))
    ranked = ranked.withColumn("stretch", F.floor(F.col("rank") / STRETCH))
    stretches = F.sequence(F.floor(F.col("first") / STRETCH), F.floor((F.col("first") + F.col("many") - 1) / STRETCH))
    found = ranked.join(steps.withColumn("stretch", F.explode(stretches)), ["length", "stretch"])
    at = F.col("rank") - F.col("first")
    return found.where((at >= 0) & (at < F.col("many"))).select(
        *(F.col("row").getField(c).alias(c) for c in own),
        (F.col("sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("place") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(table(spark, sf_dir, "documents").select("doc_id", "text")))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
