import functools
import random
import re

from quarry.llm import license_scan as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@functools.cache
def naming(template, label, templates, threshold):
    """Tokens that tell a template from those of other labels which hold enough of its tokens to meet the threshold."""
    t = set(template.split())
    rivals = [set(o.split()) for o, other in templates if other != label and len(t & set(o.split())) >= threshold * len(t) - 1e-9]
    return {w for o in rivals for w in t - o}


def brute(text, templates=ls.TEMPLATES, threshold=ls.THRESHOLD, size=ls.BLOCK):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places, labels, score = [], set(), 0.0
    for p, label in ls.PHRASES:
        p = p.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += [(i, label) for i in at]
    vocabulary = {w for t, _ in templates for w in t.split()}
    blocks = [words[i : i + size] for i in range(0, max(1, len(words) - size + size // 2), size // 2)]
    blocks = [b for b in blocks if vocabulary.intersection(b)]
    for template, label in templates:
        inside = list(zip(template.split(), template.split()[1:]))
        named, t = naming(template, label, templates, threshold), set(template.split())
        for b in blocks:
            share = len(t & set(b)) / len(t)
            beside = set(zip(b, b[1:])) & set(inside)
            if share >= threshold - 1e-9 and all(any(w in pair for pair in beside) for w in named):
                labels.add(label)
                score = max(score, share)
    base = {x for _, x in places}
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else score


def row(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score


def test_random_texts_equal_brute_force(spark):
    rng = random.Random(4)
    pool = [w for t, _ in (*ls.TEMPLATES, *ls.PHRASES) for w in t.split()] + ["é", "Ünder", "x"] * 60
    texts = [None, "", " ..", "MIT  License", "mit_license mit-license MITlicense", "mit license " * 500, "mit\nlicense\tmit license"]
    for _ in range(300):
        t = [rng.choice(pool) for _ in range(rng.choice([5, 40, 150, 400]))]
        for _ in range(rng.randrange(4)):
            p = rng.choice([*ls.TEMPLATES, *ls.PHRASES])[0].split()
            if rng.random() < 0.5 and len(p) > 3:
                p.pop(rng.randrange(len(p)))
            i = rng.randrange(len(t) + 1)
            t[i:i] = p
        texts.append(" ".join(t))
    texts.append("y " * 400_000 + "General Public-License")
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(0, None, "s")], "doc_id long, text string, score string")
    got = ls.scan(docs).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert row(r) == brute(texts[r.doc_id]), texts[r.doc_id]
    assert ls.scan(docs.limit(0)).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = ls.op9_licenses(spark, sf).collect()
    assert {(r.doc_id, *row(r)) for r in rows} == {(d, *brute(t)) for d, t in texts.items()}
    assert sum(r.n_base > 0 for r in rows) > 5 and all(r.doc_id is not None for r in rows)


def test_notices_carry_their_own_labels(spark):
    notices = {
        "x Licensed under the Apache License, see y": "apache",
        "Arbeit mit Freude. Licensed under the Apache License": "apache",
        "licensed under the mit license": "mit",
        "licensed under the mit": "mit",
        "licensed under mit license": "mit",
        "licensed under the bsd license": "bsd",
        "licensed under the foo license": "",
        "the GNU General Public License": "gpl",
        "gnu lesser public license": "lgpl",
        "licensed under cc by 4 0": "cc-by",
    }
    docs = spark.createDataFrame(list(notices.items()), "text string, want string")
    for r in ls.scan(docs).collect():
        assert r.labels == r.want, r.text
        assert {m.label for m in r.matches} <= {r.want}


def test_templates_longer_than_a_block(spark):
    rng = random.Random(2)
    long = " ".join(f"t{i}" for i in range(300))
    templates = (*ls.TEMPLATES, (long, "own"))
    part = long.split()
    some = [w for w in part if rng.random() < 0.9]
    texts = ["y " * 777 + long + " z" * 500, " ".join(some), " ".join(part[:200]), "y " * 5000 + " ".join(some) + " y" * 5000, "licensed under the mit license"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, __text string")
    got = {r.doc_id: row(r) for r in ls.scan(docs, templates=templates).collect()}
    assert got == {i: brute(t, templates, size=600) for i, t in enumerate(texts)}
    assert [got[i][5] for i in range(5)] == ["own", "own", "", "own", "mit"]
