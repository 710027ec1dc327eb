import math
import unicodedata
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import language


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = language.op3_language(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_backoff_goes_to_shorter_ngrams():
    model = language.Model([("aa", 0, "xyz", 5), ("bb", 0, "uvw", 5), ("aa", 4, "^xyz", 5), ("aa", 2, "xy", 5), ("bb", 1, "u", 5), ("bb", 1, "w", 5), ("aa", 1, "x", 5)])
    s = language.Scorer(model)
    assert s.predict("xyz")[0] == "aa" and s.predict("uvw")[0] == "bb"
    assert s.predict("xyzzz")[0] == "aa"
    assert s.predict("qxy")[0] == "aa"
    assert s.predict("quq")[0] == "bb"


def test_edges(spark):
    rows = [(1, None, "aa", 0), (2, "", "aa", 0), (3, "12 3²", "aa", 0), (None, "xyz xyz", "aa", 0), (5, "xyz " * 200_000, None, 0), (6, "uvw uvw", "bb", 0), (6, "uvw uvw", "bb", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert got == {1: "und", 2: "und", 3: "und", None: "aa", 5: "aa", 6: "bb"}
    none = language.fit(docs.limit(0))
    assert language.predict(docs.limit(0), none).count() == 0
    assert {r.lang_pred for r in language.predict(docs, none).collect()} == {"und"}
    bounded = language.fit(docs.where("doc_id is not null"), max_docs=2)
    assert set(bounded.langs) <= {"aa", "bb"}
    clashing = docs.withColumnsRenamed({"score": "lang_pred_"}).withColumns({"Steps": F.lit("s"), "lang_pred": F.lit("old"), "h": F.lit(1)})
    found = language.predict(clashing, model)
    assert set(found.columns) == {"doc_id", "text", "lang", "lang_pred_", "Steps", "h", "lang_pred", "score"}
    assert {r.lang_pred for r in found.collect()} == {"und", "aa", "bb"} and {r.Steps for r in found.collect()} == {"s"}
    kept = language.recognised(clashing, model)
    assert kept.columns == clashing.columns and {(r.doc_id, r.lang_pred) for r in kept.collect()} == {(None, "old"), (5, "old"), (6, "old")}


def brute_words(text):
    letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower())
    return letters.split()


class Plain:
    """A scorer without any memory, matrix or batch."""

    def __init__(self, texts):
        self.langs = sorted({k for _, k in texts})
        self.counts = {(k, n): Counter() for k in self.langs for n in (0, *language.NGRAMS)}
        for t, k in texts:
            for w in brute_words(t):
                for n in (0, *language.NGRAMS):
                    self.counts[k, n].update(language.grams_of(w, n) if n else [w])
        self.known = {n: set().union(*(self.counts[k, n] for k in self.langs)) for n in (0, *language.NGRAMS)}
        self.total = {key: sum(c.values()) + 0.5 * len(self.known[key[1]]) for key, c in self.counts.items()}
        self.cached = {}

    def log(self, k, n, key):
        return math.log((self.counts[k, n][key] + 0.5) / self.total[k, n])

    def word(self, w):
        if w not in self.cached:
            self.cached[w] = [0.0] * len(self.langs)
            for n in (0, *language.NGRAMS):
                found = [g for g in (language.grams_of(w, n) if n else [w]) if g in self.known[n]]
                if found:
                    self.cached[w] = [sum(self.log(k, n, g) for g in found) / len(found) for k in self.langs]
                    break
        return self.cached[w]

    def predict(self, text):
        words = brute_words(text)
        if not words:
            return "und", 0.0
        sums = [math.fsum(self.word(w)[i] for w in words) for i in range(len(self.langs))]
        best = max(range(len(sums)), key=lambda i: (sums[i], -i))
        return self.langs[best], 1 / sum(math.exp(max(-700, x - sums[best])) for x in sums)


@pytest.mark.parametrize("chunk, cache", [(language.CHUNK, language.CACHE), (20_000, 50)])
def test_whole_table_equals_a_plain_scorer(spark, monkeypatch, chunk, cache):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.collect()
    learned = {(r.text, r.lang) for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    plain = Plain(sorted(learned))
    monkeypatch.setattr(language, "CHUNK", chunk)
    monkeypatch.setattr(language, "CACHE", cache)
    model = language.fit(docs.where(~language.held_out()))
    assert all(len(model.index[n]) == len(plain.known[n]) for n in language.NGRAMS) and len(model.words) == len(plain.known[0])
    for r, (lang, score, _) in zip(rows, language.Scorer(model).judged([r.text for r in rows]), strict=True):
        want = plain.predict(r.text)
        assert lang == want[0] and abs(score - want[1]) < 1e-3
    if chunk == language.CHUNK:
        return
    got = {r.doc_id: r.lang_pred for r in language.op3_language(spark, sf).collect()}
    assert got == {r.doc_id: plain.predict(r.text)[0] for r in rows}


def test_the_sample_is_bounded_and_loses_no_language(spark):
    rows = [("same text", "aa")] * 500 + [(f"other {i}", "bb") for i in range(500)] + [("few", "cc")] + [(None, "dd"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    got = Counter(r.lang for r in language.sampled(docs, 90).collect())
    assert got == {"aa": 1, "bb": 30, "cc": 1}
    assert language.sampled(docs, 2).count() == 2
    assert language.fit(docs, max_docs=90).langs == ["aa", "bb", "cc"]


def test_noise_and_foreign_scripts_are_not_recognised(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where(~language.held_out()))
    more = spark.createDataFrame([(t,) for t in ("jkq xzv wqrt plmk zzxq", "Привет мир", "12 34", "w" * 500_000, "the and of with that")], "text string")
    assert [r.text for r in language.recognised(more, model).collect()] == ["the and of with that"]
    assert language.recognised(docs, model).count() == docs.where("text rlike '[a-zA-Z]'").count()
