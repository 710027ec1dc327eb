import random
import re

import corpus_pipeline
import pytest

from pyspark.sql import functions as F

from quarry.llm import jaccard, simhash


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_pairs(texts):
    """Pairs of different sets of similarity 0.8 or more."""
    sets = list({brute_set(t) for t in texts})
    out = []
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if a and b and min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and len(a & b) * 5 >= len(a | b) * 4:
                out.append((a, b))
    return out


def brute_stay(rows):
    root = {brute_set(t): brute_set(t) for _, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_pairs([t for _, t in rows]):
        root[find(a)] = find(b)
    least = {}
    for d, t in rows:
        g = find(brute_set(t))
        least[g] = min(d, least.get(g, d))
    return sorted(least.values())


def test_stage_joins_every_similar_pair_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert len(brute_pairs([t for _, t in rows])) >= 5
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.deduplicate(spark, docs, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in kept) == brute_stay(rows)
    at = dict(rows)
    assert all(r.text == at[r.doc_id] for r in kept)


@pytest.mark.parametrize("cap, block", [(64, 1024), (4, 7)])
def test_planted_groups_with_and_without_long_runs(spark, cap, block):
    rng = random.Random(5)
    texts = ["", None, "one", "One", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([8, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            t = list(base)
            for _ in range(rng.randrange(4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(4000)}"
            texts.append(" ".join(t))
    line = [f"c{i}" for i in range(12)]
    texts += [" ".join([f"y{rng.randrange(9000)}" for _ in range(6)] + line) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = jaccard.one_of_each(docs, run_cap=cap, block=block)
    assert sorted(r.doc_id for r in kept.collect()) == brute_stay(rows)


def test_clashing_names_null_ids_and_empty_tables(spark):
    rows = [(i, t, 7, "r", i) for i, t in enumerate(["a b c d e f", "A b c d e f", None, "", "x y"])] + [(None, "x y", 7, "r", 4), (0, "a b c d e f", 7, "r", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __hash int, row string, id long")
    got = {tuple(r) for r in jaccard.one_of_each(docs).collect()}
    assert got == {rows[0], rows[2], rows[4]}
    assert jaccard.one_of_each(docs.limit(0)).count() == 0


def test_groups_of_many_near_copies_with_a_line_of_all(spark):
    rng = random.Random(9)
    line = [f"c{i}" for i in range(40)]
    texts = []
    for size in (90, 3, 1, 1):
        base = [f"w{rng.randrange(9000)}" for _ in range(60)]
        for _ in range(size):
            t = base + line
            for _ in range(rng.randrange(5)):
                t[rng.randrange(60)] = f"x{rng.randrange(9000)}"
            texts.append(" ".join(t))
    rows = list(enumerate(texts))
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), run_cap=8, block=16)
    assert sorted(r.doc_id for r in kept.collect()) == brute_stay(rows)


def edited(rng, base, edits):
    t = list(base)
    for at in rng.sample(range(4, len(t) - 4), edits):
        t[at] = f"x{rng.randrange(10**6)}"
    return " ".join(t)


def test_simhash_proposes_pairs_that_the_stage_confirms(spark, monkeypatch):
    rng = random.Random(3)
    texts = ["", "one", "a b c d e", "a b c a b c a b c a b c"]
    for _ in range(20):
        base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        texts += [" ".join(base), edited(rng, base, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    slim = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), "text")
    rows = jaccard.prints(slim, jaccard.SIMILARITY, jaccard.SHINGLE).collect()
    assert all(r.fp == simhash._signed(simhash.fingerprint(texts[r.id].encode(), jaccard.SHINGLE)) for r in rows)
    fp = {r.cls: r.fp % 2**64 for r in rows}
    near = {(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= simhash.RADIUS}
    assert len(near) >= 5
    asked, plain = [], simhash.links_between
    monkeypatch.setattr(simhash, "links_between", lambda *a, **k: asked.append(1) or plain(*a, **k))
    kept = spark.createDataFrame([(r.cls, r.fp) for r in rows], "cls long, fp long")
    assert {tuple(r) for r in jaccard.by_fingerprint(kept).collect()} == near
    assert sorted(r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, "").collect()) == brute_stay(list(enumerate(texts)))
    assert len(asked) == 2


@pytest.mark.parametrize("edits, with_base", [(4, False), (4, True), (2, False)])
def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch, edits, with_base):
    """Copies too far apart, or joined by one text alone, or all near."""
    rng = random.Random(edits)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [edited(rng, base, edits) for _ in range(200)] + [" ".join(base)] * with_base
    made, plain = [], jaccard.written

    def counted(df, name):
        out = plain(df, name)
        if out.columns == ["a", "b"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", counted)
    rows = list(enumerate(texts))
    kept = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), run_cap=4, block=64)
    assert sorted(r.doc_id for r in kept.collect()) == brute_stay(rows)
    assert max(made) <= 10 * len(rows)
