import functools
import math

import numpy as np
import pytest

from quarry.llm import ann


def dot(a, b):
    return functools.reduce(lambda t, p: t + p[0] * p[1], zip(a, b), 0.0)


def brute(rows, every, k):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            out[q] = sorted({(-dot(a, b), i) for i, b in good if i != q})[:k]
    return out


def recall(got, want):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, best in want.items():
        mine = sorted(found.get(q, []))
        assert [m[0] for m in mine] == list(range(1, len(best) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
    assert set(found) <= set(want)
    return hits / max(1, sum(map(len, want.values())))


def test_recall_and_scores_on_the_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float64)
    want = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        want[int(ids[q])] = [(-s[i], int(ids[i])) for i in np.lexsort((ids, -s))[:20]]
    got = ann.op7_neighbours(spark, sf).collect()
    assert recall(got, want) >= 0.9
    at = {int(i): v for i, v in zip(ids, x, strict=True)}
    assert all(r.score == dot(at[r.query_id].tolist(), at[r.vec_id].tolist()) for r in got[::37])


def test_recall_with_many_buckets_and_norms(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6000, 24)) * rng.uniform(0.3, 2, size=(6000, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = ann.search(df, df.where("id % 100 = 0"), k=10, probes=200, least=500).collect()
    assert recall(got, brute(rows, 100, 10)) >= 0.9


@pytest.mark.parametrize("dim, even", [(24, False), (64, False), (64, True)])
def test_default_recall_beyond_the_least(spark, dim, even):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, dim))
    x = x / np.linalg.norm(x, axis=1)[:, None] if even else x * rng.uniform(0.3, 2, size=(len(x), 1))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, vector array<double>")
    got = ann.search(df, df.where("id % 200 = 0")).collect()
    want = {}
    for q in range(0, len(x), 200):
        s = x @ x[q]
        s[q] = -np.inf
        want[q] = [(-s[i], int(i)) for i in np.argsort(-s)[:20]]
    assert recall(got, want) >= 0.9


def test_edges(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(150)]
    rows += [(200 + i, [0.5] * 6) for i in range(80)]  # ties, one bucket
    rows += [(300, None), (305, [1.0, None, 1.0]), (310, [float("nan")] * 6), (315, [float("inf")] * 6), (320, []), (325, [1.0, 2.0]), (330, [0.0] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "id long, vector array<double>, rank string")
    want = brute(rows, 5, 20)
    for blocks, max_block in ((16, 32_768), (16, 5)):
        got = ann.search(df, df.where("id % 5 = 0"), blocks=blocks, max_block=max_block)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        mine = {}
        for r in got.collect():
            mine.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert {q: sorted(m) for q, m in mine.items()} == {q: [(float(s), i) for s, i in m] for q, m in want.items()}
    few = df.where("id < 3")
    assert ann.search(few, few.where("id = 0")).count() == 2
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df, df.limit(0)).count() == 0
    assert ann.search(df.where("id = 330"), df.where("id = 330")).count() == 0


def test_visits_follow_the_success_estimate():
    cells = np.array([[0], [1], [-1], [2]])
    seen = ann.visits(np.array([[0.9]]), cells, np.array([5, 5, 5, 5]), 2, 0)
    assert seen.tolist() == [[True, True, False, False]]
    assert ann.visits(np.array([[0.9]]), cells, np.array([5, 5, 5, 5]), 1, 11).sum() == 3


def test_blocks_cover_every_bucket():
    counts = [(0, 0, 3), (0, 1, 50), (0, 5, 2), (1, 2, 7)]
    found = ann.blocks_of(counts, 4, 10)
    assert found == {(0, 0): (0, 1), (0, 1): (1, 7), (0, 5): (8, 1), (1, 2): (9, 1)}


def test_repeated_rows_take_no_places(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    first = sorted(rows, key=lambda r: -dot(rows[0][1], r[1]))[:5]
    rows += [r for r in first for _ in range(60)]
    rows += [(500, [2.0 * x for x in rows[0][1]] + [float(i)]) for i in range(40)]  # one id and score for queries of 6 numbers
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = ann.search(df, df.where("id in (0, 20, 40)")).collect()
    for q in (0, 20, 40):
        mine = sorted((-r.score, r.vec_id) for r in got if r.query_id == q)
        assert mine == sorted({(-dot(dict(rows[:120])[q], v), i) for i, v in rows if i != q})[:20]
