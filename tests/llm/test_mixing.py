import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
from pyspark.sql import functions as F
from sql_check import same_rows

from quarry.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def goals(sizes):
    """Targets by sharing and resharing, source by source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        if not full:
            out |= {s: weight[s] * level for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_sql(spark):
    sf = "/root/testdata/sf0.01"
    same_rows(spark, mixing.op6_mixing, mixing.ORACLES["op6_mixing"], sf)
    texts = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(mixing.op6_mixing(spark, sf).collect(), texts)


def check(rows, texts):
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in texts)
    sums, taken = Counter(), Counter()
    for _, t, s in texts:
        sums[s] += size(t)
    want = goals(sums)
    for r in rows:
        assert r.source_size == sums[r.source]
        assert abs(r.target - want[r.source]) <= 1e-9 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sums)
    return taken


def test_edges_and_mix(spark):
    texts = [(1, None, "a"), (2, "", "a"), (3, "x " * 300_000, "b"), (4, "p q\tr\nß s", "a"), (None, "n n", None), (5, "w w w", "c"), (5, "w w w", "c"), (6, "é é", "\U0001f600"), (7, "u v", "�")]
    texts += [(i, "big " * (i % 50), "b") for i in range(100, 400)] + [(i, "k " * (i % 7 + 1), "a") for i in range(400, 700)]
    docs = spark.createDataFrame([(a, t, s, 0, "z") for a, t, s in texts], "doc_id long, text string, source string, size int, target string")
    slim = mixing.slim_of(docs)
    rows = mixing.served(slim).collect()
    taken = check(rows, texts)
    again = mixing.served(mixing.slim_of(docs.repartition(7))).collect()
    key = lambda rs: sorted((r.digest, r.taken) for r in rs)
    assert key(rows) == key(again)
    clashing = docs.withColumns({"__size": F.col("doc_id") * 2, "s": F.lit("s"), "row": F.lit("r"), "digest": F.lit(5), "K": F.lit(1)})
    for many in (mixing.MAX_SOURCES, 0):
        mixed = mixing.mix(clashing, max_sources=many)
        assert mixed.columns == clashing.columns
        got = defaultdict(int)
        for r in mixed.collect():
            got[r.source] += len(WORD.findall(r.text))
            assert (r["__size"], r.s, r.row, r.digest, r.K) == (r.doc_id and r.doc_id * 2, "s", "r", 5, 1)
        assert all(abs(got[s] - taken[s]) <= 2 for s in taken)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.served(mixing.slim_of(docs.limit(0))).count() == 0
    assert mixing.mix(docs.where("doc_id <= 2")).count() == 0


def test_only_native_nodes(spark):
    plan = mixing.op6_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
