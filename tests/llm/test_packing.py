import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import packing

ENCODER = packing.Encoder(packing.tokenizer_path())
WHOLE = Tokenizer.from_file(packing.tokenizer_path())


@settings(max_examples=1500, deadline=None)
@given(st.one_of(st.text(alphabet="ab1 \n\t.'s é<", max_size=40), st.text(max_size=40)))
def test_ids_equal_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == WHOLE.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text():
    for t in ("a <|endoftext|> b", "<|endoftext|>"):
        assert np.frombuffer(ENCODER.encode(t), "<u4").tolist() == WHOLE.encode(t, add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Sequences that best fit opens, longest first, one document at a time."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - n)
    return len(gaps)


def by_rounds(counts, capacity):
    """Sweeps of whole rounds, all sizes together, as steps and a number of sequences."""
    docs = [[n, 0, c] for n, c in sorted(counts.items(), reverse=True) if c]
    gaps, steps, opened = {}, [], 0
    while docs:
        if max(gaps, default=0) < docs[-1][0]:
            alone = sum(d[2] for d in docs if 2 * d[0] > capacity)
            fresh = alone or -(-sum(d[0] * d[2] for d in docs) // capacity)
            gaps.setdefault(capacity, []).append((opened, fresh))
            opened += fresh
            some, docs = [d for d in docs if not alone or 2 * d[0] > capacity], [d for d in docs if alone and 2 * d[0] <= capacity]
        else:
            some, docs = docs, []
        more, made = packing.sweep(some, gaps, capacity)
        steps += more
        for size, first, many in made:
            gaps.setdefault(size, []).append((first, many))
        docs = sorted([d for d in some if d[2]] + docs, reverse=True)
    return steps, max((p[4] + -(-p[2] // p[3]) for p in steps), default=0)


def check_plan(steps, used, lengths, capacity):
    counts = Counter(lengths)
    filled, seen = defaultdict(list), Counter()
    for n, rank, many, each, sequence, place in steps:
        for i in range(many):
            filled[sequence + i // each].append((place + i % each * n, n))
            seen[n, rank + i] += 1
    assert seen == {(n, i): 1 for n, c in counts.items() for i in range(c)}
    for parts in filled.values():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at <= capacity
    assert used is None or len(filled) == used
    assert len(filled) <= 1.1 * one_by_one(lengths, capacity) + 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_is_a_packing_near_the_bound(lengths):
    check_plan(*by_rounds(Counter(lengths), 64), lengths, 64)


@pytest.mark.parametrize("capacity, seed", [(64, 1), (64, 2), (1024, 3), (100_000, 4)])
def test_distributed_plan_is_a_packing_near_the_bound(spark, capacity, seed):
    rng = np.random.default_rng(seed)
    lengths = [*np.minimum((rng.pareto(0.7, 800) * capacity / 50 + 1).astype(int), capacity).tolist(), *[capacity] * 300, *[1] * 300, *[capacity // 3] * 100]
    counts = spark.createDataFrame(list(Counter(lengths).items()), "length long, n long")
    steps = packing.best_fit(counts, capacity)
    check_plan([(r.length, r["first"], r.many, r.each, r.sequence, r.place) for r in steps.collect()], None, lengths, capacity)


def check(rows, texts, capacity):
    parts, spots = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        spots[r.sequence_id].append((r.offset, r.length))
    for doc, t in texts.items():
        ids = [*WHOLE.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for k, r in enumerate(sorted(parts[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.length == capacity or k == 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for found in spots.values():
        at = 0
        for start, n in sorted(found):
            assert start == at
            at += n
        assert at <= capacity
    return len(spots)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = packing.op4_packing(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    n = check(rows, texts, 1024)
    assert n <= 1.02 * -(-sum(r.length for r in rows) // 1024) + 1


def test_long_texts_and_long_words(spark):
    texts = {1: "x" * 300_000, 2: "a é " * 100_000, 3: " " * 50_000, 4: "q"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(packing.pack(packing.pieces_of(docs)).collect(), texts, 1024)
    check(packing.pack(packing.pieces_of(docs, 100_000), 100_000).collect(), texts, 100_000)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "a b " * 4000, 9), (None, "x", 9)], "doc_id long, text string, length int")
    rows = packing.pack(packing.pieces_of(docs)).collect()
    check(rows, {1: None, 2: "", 3: "a b " * 4000, None: "x"}, 1024)
    twice = docs.where("doc_id = 2").union(docs.where("doc_id = 2"))
    assert len({(r.sequence_id, r.offset) for r in packing.pack(packing.pieces_of(twice)).collect()}) == 2
    assert packing.pack(packing.pieces_of(docs.limit(0))).count() == 0
    clashing = packing.pieces_of(docs).withColumns({"__file": F.lit("f"), "row": F.lit("r"), "first": F.col("length") + 1, "OFFSET": F.lit(5), "kind": F.lit(6)})
    for r in packing.pack(clashing).collect():
        assert (r["__file"], r.row, r.first, r.kind, r.offset >= 0) == ("f", "r", r.length + 1, 6, True)
    ids = packing.pieces_of(docs, with_ids=True).where("doc_id is null").first().ids
    assert ids[-1] == 2
