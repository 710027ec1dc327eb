import math
import sys
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
from sql_check import same_rows

from quarry.llm import topk


def brute(rows, every, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_sql(spark):
    same_rows(spark, topk.op10_topk, topk.ORACLES["op10_topk"], "/root/testdata/sf0.01")


def test_repeated_rows_count_once(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=5)]) for i in range(60)]
    df = spark.createDataFrame(rows + rows[:20] * 15 + [(20, [9.0] * 5)], "id long, vector array<double>")
    got = topk.search(df, df.where("id in (0, 10, 20)"), block=16, query_block=4).collect()
    want = brute(rows + [(20, [9.0] * 5)], 10, 10)
    assert sorted(tuple(r) for r in got if r.query_id in (0, 10)) == [w for w in want if w[0] in (0, 10)]
    asked, best = [rows[20][1], [9.0] * 5], set()
    for v in asked:
        best |= {(-sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(v, w)), i) for i, w in rows if i != 20}
    assert sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == 20) == [(k + 1, i, -s) for k, (s, i) in enumerate(sorted(best)[:10])]


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(200)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # ties
    rows += [(300, None), (305, [1.0, None, 1.0]), (310, [float("nan")] * 6), (315, [float("inf")] * 6), (320, []), (325, [1.0, 2.0]), (330, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<double>, score string")
    for block, query_block in ((8192, 256), (16, 4)):
        got = topk.search(df, df.where("id % 5 = 0"), block=block, query_block=query_block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect())) == brute(rows, 5, 10)
    few = df.where("id < 3")
    assert few.count() == 3 and topk.search(few, few.where("id = 0")).count() == 2
    assert topk.search(df.limit(0), df.limit(0)).count() == 0
    huge = [(0, [1e300, -1e300]), (1, [1e300, 1.0]), (2, [1.0, 1e300])]
    big = spark.createDataFrame(huge, "id long, vector array<double>")
    assert sorted(map(tuple, topk.search(big, big).collect())) == brute(huge, 1, 10)
