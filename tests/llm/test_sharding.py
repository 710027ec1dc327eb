import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import sharding


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 63, 64, 65, 1000, 4097])
def test_permutation_and_back(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p) == list(range(n))
    assert (sharding.permute(p, n, back=True) == np.arange(n)).all()
    assert n < 100 or (p != np.arange(n)).mean() > 0.9
    for k in range(0, n, max(1, n // 7)):
        assert sharding.number_at(*sharding.place_of(k, n), n) == k


def check(rows, shards=16):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    sizes = [len(slots[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = sharding.op2_sharding(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    check(rows)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        assert (r.shard, r.slot) == sharding.place_of(r.row_number, len(rows))
    again = sharding.shard(spark.createDataFrame([(r.doc_id, r.size, r.text_crc32) for r in rows], "doc_id long, size long, text_crc32 long").repartition(5)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in again} == {(r.doc_id, r.shard, r.slot) for r in rows}


def test_numbers_equal_brute_force(spark):
    rows = [(i % 300 if i % 11 else None, "t" * (i % 7), i % 3) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, __n string, bucket int")
    for buckets, per_bucket in ((4096, 100_000), (5, 100_000), (1, 40)):
        found, n = sharding.numbered(df, buckets, per_bucket)
        got = [tuple(r) for r in found.collect()]
        used = max(buckets, -(-len(set(rows)) // per_bucket))
        hashed = df.select("*", F.pmod(F.xxhash64("a", "__n", "bucket"), F.lit(used))).collect()
        least = lambda r: (r[3], r[0] is not None, r[0] or 0, r[1], r[2])
        assert n == len(rows) and sorted(x[3] for x in got) == list(range(n))
        assert [x[:3] for x in sorted(got, key=lambda x: x[3])] == [tuple(r)[:3] for r in sorted(hashed, key=least)]


def test_edges(spark):
    rows = [(None, 1, None), (1, 2, "a"), (2, 3, "b" * 1_000_000)] + [(7, 5, "same")] * 10_000
    docs = spark.createDataFrame(rows, "doc_id long, slot int, x string")
    got = sharding.shard(docs, 3).collect()
    assert Counter((r.doc_id, r.x) for r in got) == Counter((a, x) for a, _, x in rows)
    assert sorted(r.row_number for r in got) == list(range(len(rows)))
    check(got, 3)
    assert sharding.shard(docs.limit(0)).count() == 0
