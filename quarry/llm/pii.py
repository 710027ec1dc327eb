"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, URL schemes, ``+digit``,
``digit.digit``, digit pairs and identifier cues. From each anchor a deterministic
local parser walks to the boundaries of the item and validates it. A text is read once,
and every parser is linear in the run of characters it walks over.

Kinds, in the order in which spans are listed:

* ``email``, ``ip``, ``card``, ``phone``: the base kinds, with the results of a leftmost
  non-overlapping scan by their patterns; matches that fail validation are consumed.
* ``address``: a URL with user information, ``scheme://user[:password]@host...``.
* ``account``: a value after a cue such as ``account no:``, ``token =``, ``password:``:
  6 or more characters with a digit among them, to the closing quote or white space.
* ``iban``: a country code and number after the cue ``IBAN`` that passes mod 97.

Null and empty texts have no spans. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.llm.common import long_field, string_field, table, with_text_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "account", "iban")
CUES = ("account", "acct", "token", "password", "passwd", "secret", "api key", "api_key", "apikey", "passport", "ssn", "user id", "userid")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = frozenset("0123456789")
_SCHEME = _LOCAL - frozenset("_%")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"://[^\s/?#@<>\"']+@[^\s<>\"']+")
_VALUE = re.compile(r"(?:[ \t]+(?:no\.?|number|id|nr\.?))?[ \t]*[:=#][ \t]*([\"']?)([A-Za-z0-9][A-Za-z0-9_./+-]{5,})\1")
_IBAN = re.compile(r"[ \t]*[:=#]?[ \t]*([A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    keys = ahocorasick.Automaton()
    keys.add_word("@", (0, 1))
    keys.add_word("://", (4, 3))
    for a in "0123456789":
        keys.add_word(f"+{a}", (3, 2))
        for b in "0123456789":
            keys.add_word(f"{a}.{b}", (1, 3))
            keys.add_word(a + b, (2, 2))
            keys.add_word(f"{a} {b}", (2, 3))
            keys.add_word(f"{a}-{b}", (2, 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            keys.add_word(form, (5, len(form)))
    for form in ("IBAN", "iban", "Iban"):
        keys.add_word(form, (6, len(form)))
    keys.make_automaton()
    return keys


_KEYS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    moved = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of every item, sorted."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    mail_end = ip_end = chain_end = url_end = value_end = 0
    for last, (kind, width) in _KEYS.iter(text):
        start = last - width + 1
        if kind == 2:
            if start < chain_end:
                continue
            m = _CHAIN.match(text, start)
            chain_end = m.end()
            if chain_end - start >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, start, chain_end))
        elif kind == 0:
            left = start
            while left > mail_end and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _DOMAIN.match(text, start + 1)):
                mail_end = m.end()
                found.append((0, left, mail_end))
        elif kind == 1:
            if start < ip_end:
                continue
            left = start
            while left > ip_end and text[left - 1] in _DIGIT:
                left -= 1
            m = _QUAD.match(text, left)
            if m:
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
                    found.append((1, left, m.end()))
                ip_end = m.end()
            else:
                ip_end = _DOTTED.match(text, left).end()
        elif kind == 3:
            m = _PHONE.match(text, start)
            if m and 8 <= sum(c in _DIGIT for c in m.group()) <= 15:
                found.append((3, start, m.end()))
        elif kind == 4:
            left = start
            while left > url_end and text[left - 1] in _SCHEME:
                left -= 1
            m = _URL.match(text, start)
            if left < start and m:
                url_end = m.end()
                found.append((4, left, url_end))
        elif start >= value_end and (start == 0 or not text[start - 1].isalnum()):
            m = (_VALUE if kind == 5 else _IBAN).match(text, last + 1)
            if m and kind == 5 and any(c in _DIGIT for c in m.group(2)):
                value_end = m.end(2)
                found.append((5, m.start(2), value_end))
            elif m and kind == 6 and _iban_ok(m.group(1).replace(" ", "")):
                value_end = m.end(1)
                found.append((6, m.start(1), value_end))
    found.sort()
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """Each run of overlapping spans becomes the bracketed kind of its first span."""
    if not spans:
        return text
    out, at, end, name = [], 0, -1, ""
    for k, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a < end:
            end = max(end, b)
            continue
        if end >= 0:
            out.append(f"[{name}]")
            at = end
        out.append(text[at:a])
        end, name = b, KINDS[k].upper()
    return "".join([*out, f"[{name}]", text[end:]])


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii_spans``: array of (kind, start, end), empty where there are none.

    Ties and repeated rows are treated row by row; an extra column of that name is replaced.
    """
    span = T.StructType([string_field("kind"), long_field("start"), long_field("end")])

    def maker():
        return lambda texts: [[[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in find_spans(t)] for t in texts]]

    return with_text_columns(docs, [T.StructField("pii_spans", T.ArrayType(span))], maker, text, binary=False)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of its text masked; null stays null, columns stay as they are."""
    order = docs.columns

    def maker():
        return lambda texts: [[masked(t, find_spans(t)) for t in texts]]

    field = T.StructField(text, T.StringType())
    return with_text_columns(docs, [field], maker, text, binary=False).select(*[f"`{c}`" for c in order])


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of the base kinds, the hash of their spans, and all spans as text."""
    fields = [*(long_field(f"n_{k}") for k in BASE), string_field("base_sha256"), string_field("spans")]

    def maker():
        def run(texts):
            rows = []
            for t in texts:
                spans = find_spans(t)
                base = [s for s in spans if s[0] < 4]
                count = [0] * 4
                for s in base:
                    count[s[0]] += 1
                rows.append((*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            return [list(c) for c in zip(*rows, strict=True)]

        return run

    return with_text_columns(docs, fields, maker, text, binary=False)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(docs).drop("text")


QUERIES = {"op1_pii": op1_pii}
ORACLES: dict[str, str] = {}
