import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from test_jaccard import brute_stay
from tokenizers import Tokenizer

from quarry.llm import language, mixing, packing, pii, simhash

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names_and_columns(stages):
    assert [s[0] for s in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mixing", "packing"]
    assert all(df.schema == stages[0].schema for df in stages[:-1])


def test_language_rejects_only_what_no_language_recognises(stages):
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[:2])
    assert after.items() <= before.items()
    gone = [before[d] for d in before.keys() - after.keys()]
    model = language.Scorer(language.fit(stages[0].where(~language.held_out())))
    assert all(lang == "und" or steps > language.MAX_STEPS for lang, _, steps in model.judged(gone))
    assert len(gone) <= 0.02 * len(before)


def test_one_document_of_each_group_stays(stages):
    """The rule of stages on word shingles: five words, similarity 0.8 or more."""
    before, after = ({r.doc_id: r.text for r in df.collect()} for df in stages[1:3])
    assert after == {d: before[d] for d in brute_stay(list(before.items()))}


def test_spans_are_masked(stages):
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[2:4])
    assert before.keys() == after.keys()
    for d, r in before.items():
        assert after[d].text == pii.masked(r.text, pii.find_spans(r.text))
        assert after[d].n_chars == len(after[d].text)
    assert not any(s[0] < 4 for r in after.values() for s in pii.find_spans(r.text))


def test_mix_meets_the_targets(stages):
    before, after = (df.collect() for df in stages[3:5])
    n = lambda t: len(re.findall(mixing.WORD, t))
    sizes, taken, times = Counter(), Counter(), Counter()
    for r in before:
        sizes[r.source] += n(r.text)
    for r in after:
        taken[r.source] += n(r.text)
        times[r.doc_id] += 1
    text = {r.doc_id: r.text for r in before}
    whole = [r for r in after if r.text == text[r.doc_id]]
    assert len(after) - len(whole) <= len(sizes)
    assert max(times.values()) <= mixing.REPEATS
    assert abs(sum(taken.values()) - mixing.BUDGET * sum(sizes.values())) <= len(sizes)
    assert all(taken[s] <= mixing.REPEATS * sizes[s] for s in sizes)


def test_pieces_hold_the_mixed_texts(stages):
    whole = Tokenizer.from_file(packing.tokenizer_path())
    texts = defaultdict(list)
    for r in stages[4].collect():
        texts[r.doc_id].append(len(whole.encode(r.text, add_special_tokens=False).ids) + 1)
    tokens, spots = Counter(), defaultdict(list)
    for r in stages[5].collect():
        tokens[r.doc_id] += r.length
        spots[r.sequence_id].append((r.offset, r.length))
    assert tokens == {d: sum(n) for d, n in texts.items()}
    for found in spots.values():
        ends = np.cumsum([n for _, n in sorted(found)])
        assert [a for a, _ in sorted(found)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(spots) <= 1.02 * -(-sum(tokens.values()) // 1024) + 1


def test_edges(spark):
    rows = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two three four five six", "en", None, 1), (3, "one two three four five six", "en", None, 1)]
    rows += [(None, "one two three four five six", None, "a", 1), (5, "sieben acht neun zehn elf me@x.org", "de", "b", 1), (6, "12 34", None, "b", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.one_of_each(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 5, 6]
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert {r.doc_id for r in now.collect()} <= {3, 5}
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
