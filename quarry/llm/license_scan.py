"""License scans by an exact set-similarity join of text blocks with templates.

Blocks are windows of ``BLOCK`` words, or of twice the longest template where that is more,
each starting half a block after the last, so that any passage as long as a template or
phrase lies whole in some block. A block
matches a template if at least ``threshold`` of the template's distinct tokens are in it,
and among them those that name its license: where a template of another label alone would
meet the threshold, the tokens that it doesn't have must all be there, each beside a word
that it stands beside in the template (``mit`` is a German word, too).

Tokens are ordered by how many documents of the whole table hold them, rarest first. A
template of m tokens that must share n of them is found by its first m - n + 1 tokens in
that order (prefix filter), is passed over where the text holds fewer than n of its tokens
(length filter), and given up once the tokens left cannot reach n (positional filter). So
no block that meets the threshold is missed, and hardly a word is looked at twice.

The base phrases are templates with threshold 1: every place of a phrase lies in a block
that holds all of its words, and in the found blocks the words' order is checked.

Templates are a parameter of a few rows; texts never leave their partition. Null and
empty texts have no words. ``score`` is the largest share of a template found in a block.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import long_field, string_field, table, with_text_columns

BLOCK, THRESHOLD = 96, 0.8
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("all rights reserved no part of this work may be reproduced without permission", "proprietary"),
)
#: A-Z to a-z; ASCII but letters and digits to spaces; bytes over 127 as they are.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if i > 127 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(_FOLD).split() if raw else []


class Templates:
    """Templates with their tokens in global order, and the prefix tokens that find them."""

    def __init__(self, phrases, templates, frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.block = max([BLOCK, *(2 * len(words_of(t.encode())) for t, _ in (*phrases, *templates))])
        self.items = []
        for rows, share, base in ((phrases, 1.0, True), (templates, threshold, False)):
            for text, label in rows:
                words = words_of(text.encode())
                tokens = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
                if tokens:
                    need = max(1, math.ceil(share * len(tokens) - 1e-9))
                    self.items.append((words, label, tokens, need, base))
        self.naming = [self._naming(*item) for item in self.items]
        self.by_token: dict[bytes, list[int]] = {}
        for i, (_, _, tokens, need, _) in enumerate(self.items):
            for w in tokens[: len(tokens) - need + 1]:
                self.by_token.setdefault(w, []).append(i)
        self.vocabulary = {w for item in self.items for w in item[2]}

    def _naming(self, words: list[bytes], label: str, tokens: list[bytes], need: int, base: bool) -> list[tuple[bytes, set[tuple[bytes, bytes]]]]:
        """Tokens by which a template differs from those of other labels that would meet its threshold, and the pairs of words they are in."""
        others = [set(x[2]) for x in self.items if not base and x[1] != label and not x[4]]
        named = {w for x in others if len(x.intersection(tokens)) >= need for w in tokens if w not in x}
        pairs = list(zip(words, words[1:], strict=False))
        return [(w, {p for p in pairs if w in p}) for w in sorted(named)]

    def scan(self, words: list[bytes]) -> tuple[dict[int, list[int]], dict[int, float]]:
        """Places of each base phrase, and each template's largest share in a block that meets its threshold."""
        by_token, block, stride = self.by_token, self.block, self.block // 2
        hits = [i for i, w in enumerate(words) if w in by_token]
        places: dict[int, set[int]] = {}
        shares: dict[int, float] = {}
        if not hits:
            return {}, shares
        last = max(0, -(-(len(words) - block) // stride))
        asked: dict[int, set[int]] = {}
        for i in hits:
            for t in by_token[words[i]]:
                for b in range(max(0, -(-(i - block + 1) // stride)), min(last, i // stride) + 1):
                    asked.setdefault(b, set()).add(t)
        for b, found in asked.items():
            part = words[b * stride : b * stride + block]
            have = self.vocabulary.intersection(part)
            for t in found:
                phrase, _, tokens, need, base = self.items[t]
                if len(have) < need or not all(w in have and any(p in pairs for p in zip(part, part[1:], strict=False)) for w, pairs in self.naming[t]):
                    continue
                shared, left = 0, len(tokens)
                for w in tokens:
                    if shared + left < need:
                        break
                    shared += w in have
                    left -= 1
                if shared + left < need or shared < need:
                    continue
                shares[t] = max(shares.get(t, 0.0), shared / len(tokens))
                if base:
                    n, first = len(phrase), phrase[0]
                    at = -1
                    for _ in range(part.count(first)):
                        at = part.index(first, at + 1)
                        if part[at : at + n] == phrase:
                            places.setdefault(t, set()).add(b * stride + at)
        return {t: sorted(p) for t, p in places.items()}, shares


def frequencies(docs: DataFrame, tokens: set[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents of the whole table each of the templates' tokens occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                seen.update(tokens.intersection(words_of(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.token): r.n for r in rows}


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``matches``.

    matches: (template, label, share) of every template that meets the threshold in some
    block that has its naming tokens. Equal shares all count; repeated rows are scanned row by
    row; columns of ``docs`` named like the new ones are replaced. An empty table gives an empty one.
    """
    vocabulary = {w for t, _ in (*phrases, *templates) for w in words_of(t.encode())}
    frequency = frequencies(docs, vocabulary, text)
    match = T.StructType([string_field("template"), string_field("label"), T.StructField("share", T.DoubleType())])
    fields = [*(long_field(n) for n in ("n_words", "n_base", "first_word", "last_word")), string_field("base_labels"), string_field("labels"), T.StructField("score", T.DoubleType()), T.StructField("matches", T.ArrayType(match))]

    def maker():
        found = Templates(phrases, templates, frequency, threshold)
        items = found.items

        def run(texts):
            rows = []
            for raw in texts:
                words = words_of(raw)
                places, shares = found.scan(words)
                at = [p for v in places.values() for p in v]
                base = {items[t][1] for t in places}
                more = {t: s for t, s in shares.items() if not items[t][4] or t in places}
                labels = base | {items[t][1] for t in more}
                listed = [{"template": b" ".join(items[t][0]).decode(), "label": items[t][1], "share": s} for t, s in sorted(more.items())]
                rows.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), max(more.values(), default=0.0), listed))
            return [list(c) for c in zip(*rows, strict=True)]

        return run

    return with_text_columns(docs, fields, maker, text)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "matches")


QUERIES = {"op9_licenses": op9_licenses}
ORACLES: dict[str, str] = {}
