import itertools
import random
import re

import numpy as np
import xxhash

from quarry.llm import components, simhash


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> doc_id to component."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    arr = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 4):
            root[find(fps[i + 1 + j])] = find(f)
    least = {}
    for d, f in rows:
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return [(d, least.get(find(f))) for d, f in rows]


def test_masks_cover_every_choice_of_bits():
    found = simhash.masks(4)
    assert len(found) == 31 and len(set(found)) == 31
    assert all(8 <= m.bit_count() for m in found)
    rng = random.Random(1)
    for _ in range(20_000):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(m & bits == 0 for m in found)
    for a, b in itertools.combinations(range(64), 2):
        assert any(m & (1 << a | 1 << b) == 0 for m in found)


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for e in links for x in e if x is not None}
    for _ in range(400):
        for a, b in links:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}


def test_links_of_planted_groups_with_and_without_long_runs(spark):
    rng = random.Random(3)
    fps = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.choice([0, 1, 3, 40])):
            x = base
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << b
            fps.add(x)
    rows = [(i, f) for i, f in enumerate(sorted(fps, key=lambda f: f % 1009))]
    want = brute_components(rows)
    df = spark.createDataFrame([(simhash._signed(f),) for _, f in rows], "fp long")
    for cap in (4096, 8):
        links = simhash.links_between(df, run_cap=cap)
        root = {r.node: r.root for r in components.components(links).collect()}
        groups = {}
        for d, f in rows:
            groups.setdefault(root.get(simhash._signed(f), simhash._signed(f)), []).append(d)
        got = {d: min(g) for g in groups.values() for d in g}
        assert got == dict(want)


def test_fingerprints_and_edges(spark):
    texts = [None, "", " \n", "One", "one two three four", "ONE two\tthree\x0bfour", "É é a b c d", "a b c d e " * 60_000, "x\x85y z w v u", "x\xa0y"]
    texts += [f"w{i} w{i + 1} w{i % 3} q r s t {i}" for i in range(30)]
    for t in texts:
        assert simhash.fingerprint(t.encode() if t is not None else None) == brute_print(t)
    rows = [(i if i % 7 else None, t, "f") for i, t in enumerate(texts)] + [(3, "One", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs).collect()
    key = lambda x: sorted(x, key=repr)
    assert key((r.doc_id, r.component_id) for r in got) == key(brute_components([(d, brute_print(t)) for d, t, _ in rows]))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = simhash.op8_simhash(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    assert {(r.doc_id, r.fingerprint) for r in rows} == {(d, f"{f:016x}") for d, f in prints.items()}
    assert {(r.doc_id, r.component_id) for r in rows} == set(brute_components(list(prints.items())))
    assert len({r.component_id for r in rows}) < 950


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(i, t, i * 2, i * 3) for i, t in enumerate(["one two", "ONE two", "three four", "three four", None, ""])] + [(2, "three four", 4, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash long, id long")
    got = {tuple(r) for r in simhash.one_of_each(docs).collect()}
    assert got == {(0, "one two", 0, 0), (2, "three four", 4, 6), (4, None, 8, 12)}
