import random

import pytest

from quarry.llm import components


def brute_roots(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root if find(x) != x}


def graphs():
    rng = random.Random(2)
    ids = rng.sample(range(-(10**9), -(10**6)), 40)
    mixed = list(zip(ids, ids[1:], strict=False)) + [(i, i + 1) for i in range(20)] + [(100 + i, 100 + (i + 1) % 15) for i in range(15)]
    mixed += [(299, i) for i in range(200, 230)] + [(7, 7), (400, 400), (None, 3), (4, None), (3, 2), (2, 3)]
    mixed += [(rng.randrange(500, 560), rng.randrange(500, 560)) for _ in range(40)]
    return {"none": [], "stars": [(i, i % 3) for i in range(3, 30)], "chains, ring, hub, loops, nulls, repeats": mixed}


@pytest.mark.parametrize("name", graphs())
def test_roots_by_plans_of_two_scans(spark, monkeypatch, name):
    """A plan of many scans and stages takes the driver's memory, however few the links."""
    scans, plain = [], components.written

    def counted(df, kind):
        scans.append(df._jdf.queryExecution().optimizedPlan().collectLeaves().size())
        return plain(df, kind)

    monkeypatch.setattr(components, "written", counted)
    pairs = graphs()[name]
    got = [tuple(r) for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute_roots(pairs)
    assert max(scans) <= 2
