"""Records from tagged paragraphs, and from a language model's answers, behind replaceable interfaces.

A paragraph's tags are an array of (text, label). Grouping, coreference, properties, amounts
and linking are one Arrow function per paragraph with plain, ordered passes; all else is
relational. Models are passed in: a tagger, an embedder and an answering client each have a
deterministic stand-in here.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import combinations
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quarry.functions.numbers import bare_value, once
from quarry.functions.text import COPOLYMER_MARKS, TOKEN_GAPS, abbreviation_pairs
from quarry.operators.predicates import MATERIAL_LABELS, tagged_record

# fixed values: cues of a material's role, of mixtures, and solvents that are no materials of their own
ROLES = (
    "composite", "additive", "plasticiz", "quaterni", "crosslink", "cross-link", "graft", "doping", "doped", "dopant", "hydrogel", "oligomer",
    "star", "filler", "initia", "catalys", "inhib", "oxidiz", "solven", "ligan",
)
SHORT = 4
NEAR = 2
DIELECTRIC = ("dielectric loss", "dielectric constant", "relative permittivity")

SPANS = "array<struct<text:string,label:string>>"
MATERIAL = "struct<entity_name:string,material_class:string,role:string,polymer_type:string,normalized_material_name:string,coreferents:array<string>,components:array<string>>"
PROPERTY = (
    "struct<entity_name:string,value:string,coreferents:array<string>,material_name:string,material_amount_entity:string,material_amount:string,"
    "temperature_condition:string,frequency_condition:string,entity_start:int,value_start:int>"
)
AMOUNT = "struct<entity_name:string,material_amount:string>"
RESULT = f"struct<materials:array<{MATERIAL}>,monomers:array<{MATERIAL}>,families:array<{MATERIAL}>,properties:array<{PROPERTY}>,amounts:array<{AMOUNT}>>"


class Tagger(Protocol):
    def tag(self, text: str) -> list[tuple[str, str]]: ...


@dataclass(frozen=True)
class LexiconTagger:
    """Tokens labelled by word lists; a number with what follows it is a value."""

    words: dict[str, tuple[str, ...]]

    def tag(self, text: str) -> list[tuple[str, str]]:
        by = {w.lower(): label for label, ws in self.words.items() for w in ws}
        out: list[tuple[str, str]] = []
        for t in re.findall(r"\d+(?:\.\d+)?|[^\W\d_]+(?:[-'][^\W\d_]+)*|°|\S", text):
            value = t[0].isdigit() or (out and out[-1][1] == "PROP_VALUE" and out[-1][0][0].isdigit() and t in ("K", "%", "°", "MPa", "GPa"))
            out.append((t, "PROP_VALUE" if value else by.get(t.lower(), "O")))
        return out


#: Bytes of paragraphs that a Python worker turns into spans or records before it hands them over.
CHUNK = 1 << 18


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Places and numbers of paragraphs, each run of them of ``CHUNK`` bytes or ended by the paragraph that reaches them."""
    lo = size = at = 0
    for at, n in enumerate(pc.binary_length(texts).to_pylist(), 1):
        size += n or 0
        if size >= CHUNK:
            yield lo, at - lo
            lo, size = at, 0
    if lo < at:
        yield lo, at - lo


def tagged(paragraphs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """paragraphs with ``spans``; the tagger is loaded once a task."""

    kind = to_arrow_type(DataType.fromDDL(SPANS))

    @F.arrow_udf(SPANS)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in batches:
            for lo, n in slices(t):
                yield pa.array([[{"text": a, "label": b} for a, b in tagger.tag(x or "")] for x in t.slice(lo, n).to_pylist()], kind)

    return paragraphs.withColumn("spans", run(F.col(text)))


def align(tokens: list[str], pieces: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Word pieces' labels on whole tokens: each token takes the label of the piece that begins it."""
    out, i, used = [], 0, 0
    for t in tokens:
        label = pieces[i][1] if i < len(pieces) else "O"
        out.append((t, label))
        used += len(t)
        while i < len(pieces) and used >= len(pieces[i][0].removeprefix("##")):
            used -= len(pieces[i][0].removeprefix("##"))
            i += 1
    return out


@dataclass
class Span:
    text: str
    label: str
    start: int
    end: int


@dataclass
class Material:
    entity_name: str
    material_class: str
    role: str = ""
    polymer_type: str = ""
    normalized_material_name: str = ""
    coreferents: list[str] = field(default_factory=list)
    components: list[str] = field(default_factory=list)


def joined(parts: list[str]) -> str:
    text = " ".join(parts)
    for a, b in TOKEN_GAPS:
        text = text.replace(a, b)
    if len(text) >= 2:
        round_, curly = text.count(")") - text.count("("), text.count("}") - text.count("{")
        text = text + ")" if round_ == -1 else text + "}" if curly == -1 else text[:-1] if round_ == 1 else text
    return text


def group(tags: list[tuple[str, str]]) -> list[Span]:
    """Runs of one label as spans; material runs are cut at ``/`` and ``:``, a last full stop is a span of its own."""
    out: list[Span] = []
    i = 0
    while i < len(tags):
        j = i + 1
        label = tags[i][1]
        while label != "O" and j < len(tags) and tags[j][1] == label:
            j += 1
        text = joined([t for t, _ in tags[i:j]]) if label != "O" else tags[i][0]
        numbered = re.search(r":(?=\d)", text)
        if label in MATERIAL_LABELS and len(text) > 1 and ("/" in text or (":" in text and not numbered)):
            out.extend(Span(p, "O" if p in "/:" else label, i, j - 1) for p in re.split(r"([/:])", text) if p)
        elif label in MATERIAL_LABELS and text in (")", "}"):
            pass
        elif label != "O" and len(text) > 1 and text.endswith("."):
            out += [Span(text[:-1], label, i, j - 1), Span(".", "O", j - 1, j - 1)]
        else:
            out.append(Span(text, label, i, j - 1))
        i = j
    return out


def sentences_of(spans: list[Span]) -> list[list[Span]]:
    out: list[list[Span]] = [[]]
    for s in spans:
        out[-1].append(s)
        if s.text.endswith("."):
            out.append([])
    return [x for x in out if x]


def listed_together(a: str, b: str, text: str) -> bool:
    """The two names stand in one list, so they are two things."""
    forms = [f"{x}{sep}{y}" for x, y in ((a, b), (b, a)) for sep in (", ", "/", ":", " and ", ", and ")]
    return any(f in text for f in forms)


def kind_of(name: str) -> str:
    capitals = "-" in name and name.upper() == name
    return "star_polymer" if "star" in name else "copolymer" if any(m in name for m in COPOLYMER_MARKS) or name.count("poly") > 1 or capitals else "homopolymer"


def edits_at_most_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def _absorb(found: list[Material], rule: Callable[[Material, Material], Material | None]) -> list[Material]:
    """Pairs in order; ``rule`` names the one of a pair that goes, and the other takes its coreferents."""
    gone: set[int] = set()
    for a, b in combinations(found, 2):
        if id(a) in gone or id(b) in gone:
            continue
        lost = rule(a, b)
        if lost is not None:
            gone.add(id(lost))
            kept = b if lost is a else a
            kept.coreferents += [c for c in lost.coreferents if c not in kept.coreferents]
    return [m for m in found if id(m) not in gone]


def materials_of(spans: list[Span], text: str) -> list[Material]:
    """Materials merged in five passes: abbreviations, case, containment, neighbours, one edit."""
    first = {s.text: s for s in reversed(spans) if s.label in MATERIAL_LABELS}
    found = [Material(s.text, s.label, coreferents=[s.text]) for s in spans if first.get(s.text) is s]
    for m in found:
        m.polymer_type = kind_of(m.entity_name) if m.material_class == "POLYMER" else ""
    pairs = set(abbreviation_pairs(text))
    found = _absorb(found, lambda a, b: a if (a.entity_name, b.entity_name) in pairs else b if (b.entity_name, a.entity_name) in pairs else None)
    lower = lambda n: {n.lower(), n[:1].lower() + n[1:]}
    found = _absorb(found, lambda a, b: b if a.entity_name in lower(b.entity_name) else a if b.entity_name in lower(a.entity_name) else None)

    def contained(a: Material, b: Material) -> Material | None:
        for long, part in ((a, b), (b, a)):
            if part.entity_name in long.entity_name and long.polymer_type != "copolymer" and long.material_class == part.material_class and len(part.entity_name) >= SHORT and not listed_together(a.entity_name, b.entity_name, text):
                return long
        return None

    found = _absorb(found, contained)
    beside = set()
    for i, s in enumerate(spans):
        for j in range(i + 1, min(len(spans), i + NEAR + 1)):
            if s.label not in MATERIAL_LABELS or spans[j].text in ("/", ":", "into"):
                break
            if spans[j].label == s.label and (len(spans[j].text) <= SHORT or spans[j - 1].text == "("):
                beside.add((s.text, spans[j].text))
    found = _absorb(found, lambda a, b: b if (a.entity_name, b.entity_name) in beside and not listed_together(a.entity_name, b.entity_name, text) else None)
    close = lambda a, b: any(edits_at_most_one(c, b.entity_name) and not listed_together(c, b.entity_name, text) for c in a.coreferents)
    return _absorb(found, lambda a, b: b if a.material_class == b.material_class and close(a, b) else None)


def _around(n: int, at: int, left_first: bool = False) -> Iterator[int]:
    for d in range(1, n):
        for j in ((at - d, at + d) if left_first else (at + d, at - d)):
            if 0 <= j < n:
                yield j


def refine(found: list[Material], parts: list[list[Span]], names: dict[str, list[str]], solvents: tuple[str, ...]) -> tuple[list[Material], list[Material], list[Material]]:
    """Roles, normal names, blends and copolymers; then monomers, families and solvents are set apart."""
    owner = lambda t: next((m for m in found if t in m.coreferents), None)
    variants = lambda c: {c, c[:1].upper() + c[1:], c[:1].lower() + c[1:], c.lower(), c.upper()}
    for m in found:
        if m.polymer_type == "homopolymer":
            mine = set().union(*map(variants, m.coreferents))
            m.normalized_material_name = next((n for n, corefs in names.items() if mine.intersection(corefs)), "")
    mixed: list[Material] = []
    for part in parts:
        for i, s in enumerate(part):
            if any(r in s.text for r in ROLES):
                near = next((owner(part[j].text) for j in _around(len(part), i) if part[j].label in ("ORGANIC", "INORGANIC", "POLYMER") and owner(part[j].text)), None)
                if near:
                    near.role = s.text
            for cue, reach in (("blend", _around(len(part), i)), ("copolymer", range(i + 1, len(part)))):
                if s.label == "O" and cue in s.text:
                    own = list(dict.fromkeys(m.entity_name for j in reach if part[j].label in ("POLYMER", "ORGANIC") and (m := owner(part[j].text))))
                    if len(own) > 1:
                        mixed.append(Material("", cue, components=own, coreferents=[c for n in own for c in owner(n).coreferents]))
                        found = [m for m in found if m.entity_name not in own]
    found = [m for m in found + mixed if not any(s in m.coreferents for s in solvents)]
    monomers = [m for m in found if m.material_class == "MONOMER"]
    families = [m for m in found if m.material_class == "POLYMER_FAMILY"]
    return [m for m in found if m.material_class != "MONOMER"], monomers, families


def property_names(spans: list[Span], text: str) -> dict[str, list[str]]:
    """Property names to their coreferents: definitions of abbreviations, and short forms close by."""
    names = list(dict.fromkeys(s.text for s in spans if s.label == "PROP_NAME"))
    same = {n: [n] for n in names}
    for short, long in abbreviation_pairs(text):
        for a, b in ((short, long), (long, short)):
            if a in same and b not in same[a]:
                same[a].append(b)
    for i, s in enumerate(spans):
        for t in spans[i + 1 : i + NEAR + 1]:
            if s.label == t.label == "PROP_NAME" and (len(t.text) <= SHORT) and t.text not in same[s.text] and not listed_together(s.text, t.text, text):
                same[s.text].append(t.text)
    return same


def properties_of(parts: list[list[Span]], text: str) -> list[dict]:
    """A pair for each value: the nearest property before it, the material and amount nearest to that."""
    same = property_names([s for p in parts for s in p], text)
    corefs = lambda n: next((c for c in same.values() if n in c), [])
    out: list[dict] = []
    for part in parts:
        labels = [s.label for s in part]
        made: list[dict] = []
        if labels.count("PROP_VALUE") >= 2 and labels.count("PROP_NAME") >= 2 and any(s.text == "respectively" for s in part):
            end = next(i for i, s in enumerate(part) if s.text == "respectively")
            values = [s for s in part[:end] if s.label == "PROP_VALUE"]
            for name, value in zip(reversed([s for s in part[:end] if s.label == "PROP_NAME"]), reversed(values), strict=False):
                made.append({"name": name, "value": value, "at": part.index(name)})
            made.reverse()
        else:
            at = None
            for i, s in enumerate(part):
                if s.label == "PROP_VALUE" and at is not None:
                    made.append({"name": part[at], "value": s, "at": at})
                at = i if s.label == "PROP_NAME" else at
        sentence = " ".join(s.text for s in part)
        for m in made:
            at, n = m["at"], len(part)
            amount = next((j for j in _around(n, at, True) if part[j].label == "MATERIAL_AMOUNT"), None) if "MATERIAL_AMOUNT" in labels else None
            beside = next((j for j in (amount + 1, amount - 1) if 0 <= j < n and part[j].label in MATERIAL_LABELS), None) if amount is not None else None
            entity = part[beside].text if beside is not None else ""
            material = next((part[j].text for j in _around(n, at, True) if part[j].label in MATERIAL_LABELS and part[j].text != entity), "")
            out.append(
                {
                    "entity_name": m["name"].text, "value": m["value"].text, "coreferents": corefs(m["name"].text), "material_name": material, "material_amount_entity": entity,
                    "material_amount": part[amount].text if beside is not None else "", "temperature_condition": "", "frequency_condition": "", "entity_start": m["name"].start, "value_start": m["value"].start,
                }
            )
        known = [p["value"] for p in out]
        heat = next((t for t in re.findall(r"\d+ ° C", sentence) if not any(t in v for v in known)), None)
        waves = re.findall(r"\d+ \w?Hz", sentence) + re.findall(r"10\^\{\d\s?\} Hz", sentence)
        wave = next((w for w in waves if w not in known), None)
        for p in out if heat or wave else ():
            if p["entity_name"] in sentence:
                p["temperature_condition"] = heat or p["temperature_condition"]
                if wave and p["entity_name"] in DIELECTRIC:
                    p["frequency_condition"] = wave.replace(" }", "}")
    return out


def amounts_of(parts: list[list[Span]]) -> list[dict]:
    """Each amount with the nearest material, the right one first."""
    out = []
    for part in parts:
        for i, s in enumerate(part):
            near = next((part[j].text for j in _around(len(part), i) if part[j].label in MATERIAL_LABELS), None) if s.label == "MATERIAL_AMOUNT" else None
            if near is not None:
                out.append({"entity_name": near, "material_amount": s.text})
    return out


def document(text: str, tags: list[tuple[str, str]], names: dict[str, list[str]], solvents: tuple[str, ...] = ()) -> dict:
    spans = group(tags)
    parts = sentences_of(spans)
    found, monomers, families = refine(materials_of(spans, text), parts, names, solvents)
    return {"materials": [vars(m) for m in found], "monomers": [vars(m) for m in monomers], "families": [vars(m) for m in families], "properties": properties_of(parts, text), "amounts": amounts_of(parts)}


def with_numbers(properties: Column, units: tuple[str, ...]) -> Column:
    """Property structs with number, error, average flag, descriptor and unit read from their values.

    A property without a unit takes that of the next one of its name.
    """
    values = F.transform(properties, lambda p: F.struct(p.alias("p"), bare_value(p["value"], units).alias("v")))
    blank = lambda u: F.coalesce(u, F.lit(""))

    def made(read: Column, x: Column, i: Column) -> Column:
        after = F.get(read, i + 1)
        borrowed = F.when((blank(x["v"]["unit"]) == "") & (after["p"]["entity_name"] == x["p"]["entity_name"]), after["v"]["unit"])
        own = [x["p"][f].alias(f) for f in ("entity_name", "value", "coreferents", "material_name", "material_amount_entity", "material_amount")]
        rest = [x["p"][f].alias(f) for f in ("temperature_condition", "frequency_condition", "entity_start", "value_start")]
        return F.struct(
            *own,
            x["v"]["value"].alias("numeric_value"),
            x["v"]["error"].alias("numeric_error"),
            x["v"]["average"].alias("value_average"),
            x["v"]["descriptor"].alias("value_descriptor"),
            blank(F.coalesce(borrowed, x["v"]["unit"])).alias("unit"),
            *rest,
        )

    # all values are read once, and not again for each property that looks at the next
    return once(values, lambda read: F.transform(read, lambda x, i: made(read, x, i)))


def extracted(paragraphs: DataFrame, names: dict[str, list[str]], units: tuple[str, ...] = (), solvents: tuple[str, ...] = (), polymer_only: bool = True) -> DataFrame:
    """Relevant paragraphs (text, spans) with ``result``: materials, monomers, families, properties, amounts."""

    kind = to_arrow_type(DataType.fromDDL(RESULT))

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            for lo, n in slices(texts):
                pairs = zip(texts.slice(lo, n).to_pylist(), spans.slice(lo, n).to_pylist(), strict=True)
                yield pa.array([document(t or "", [(s["text"], s["label"]) for s in x], names, solvents) for t, x in pairs], kind)

    relevant = paragraphs.where(tagged_record(F.transform("spans", lambda s: s["label"]), polymer_only))
    found = relevant.withColumn("result", run("text", "spans"))
    return found.withColumn("result", F.col("result").withField("properties", with_numbers(F.col("result.properties"), units)))


def records(paragraphs: DataFrame, names: dict[str, list[str]], key: str = "para_id", **settings) -> DataFrame:
    """(key, material, material_class, property, value, ...): every property linked to the material that its name refers to, else to all."""
    rows = extracted(paragraphs, names, **settings).select(key, "result")
    one = rows.select(key, F.col("result.materials").alias("m"), F.explode("result.properties").alias("p"))
    linked = F.filter("m", lambda m: F.array_contains(m["coreferents"], F.col("p.material_name")))
    own = F.when(F.size(linked) > 0, F.slice(linked, 1, 1)).when(F.col("p.material_name") == "", F.col("m")).otherwise(F.slice(F.col("m"), 1, 0))
    out = one.withColumn("__m", F.explode(own))
    return out.select(
        key, F.col("__m.entity_name").alias("material"), F.col("__m.material_class").alias("material_class"), F.col("__m.polymer_type").alias("polymer_type"), F.col("p.entity_name").alias("property"), "p.value",
        "p.numeric_value", "p.numeric_error", "p.unit", "p.material_amount", (F.col("p.material_name") == "").alias("one_to_many"),
    )


class Client(Protocol):
    def answer(self, messages: list[dict]) -> dict: ...


@dataclass(frozen=True)
class Replay:
    """Recorded answers by the last message's digest; an empty one where nothing is recorded."""

    answers: dict[str, str]

    def answer(self, messages: list[dict]) -> dict:
        content = self.answers.get(hashlib.sha256(messages[-1]["content"].encode()).hexdigest(), "[]")
        return {"choices": [{"message": {"content": content}}], "usage": {"prompt_tokens": sum(len(m["content"].split()) for m in messages), "completion_tokens": len(content.split())}}


def asked(requests: DataFrame, client: Client, key: str = "para_id", retries: int = 1, wait: Callable[[float], None] | None = None, delays: tuple[float, ...] = (2.0,)) -> DataFrame:
    """(key, request_obj, response_obj, status): one call for each row of (key, messages), again on failure; failed calls stay as rows."""
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, messages in zip(b[key], b["messages"], strict=True):
                plain = [{"role": m["role"], "content": m["content"]} for m in messages]
                response, status = None, "failed"
                for attempt in range(retries + 1):
                    try:
                        response, status = json.dumps(client.answer(plain), ensure_ascii=False), "done"
                        break
                    except Exception as e:  # any failure of the service is one to try again
                        status = f"error: {type(e).__name__}"
                        if wait and attempt < retries:
                            wait(delays[min(attempt, len(delays) - 1)])
                out.append((k, json.dumps(plain, ensure_ascii=False), response, status))
            yield pd.DataFrame(out, columns=[key, "request_obj", "response_obj", "status"])

    return requests.select(key, "messages").mapInPandas(run, f"{key} {kind}, request_obj string, response_obj string, status string")


def hashed_embedding(text: str, width: int = 64) -> list[float]:
    """A stand-in for a model's mean token vector: signed hashes of words, averaged."""
    words = text.lower().split()[:512]
    out = [0.0] * width
    for w in words:
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
        out[h % width] += 1.0 if h >> 63 else -1.0
    return [x / max(1, len(words)) for x in out]


def embedded(rows: DataFrame, embed: Callable[[str], list[float]] = hashed_embedding, text: str = "text") -> DataFrame:
    """rows with ``embedding``."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in batches:
            yield t.map(lambda x: embed(x or ""))

    return rows.withColumn("embedding", run(F.col(text)))


def crossrefs(paragraphs: DataFrame, existing: DataFrame | None = None, para: str = "id", paper: str = "pid", text: str = "text") -> DataFrame:
    """(para_id, paper_id, name, othername, reftype): abbreviations both ways, the first of each name and paper, without those known."""
    from quarry.functions.text import abbreviations
    from quarry.operators.ordered import keep_first

    pairs = paragraphs.select(F.col(para).alias("para_id"), F.col(paper).alias("paper_id"), F.explode(abbreviations(F.col(text))).alias("a"))
    ways = F.array(F.struct(F.col("a.short").alias("name"), F.col("a.long").alias("othername")), F.struct(F.col("a.long").alias("name"), F.col("a.short").alias("othername")))
    rows = pairs.select("para_id", "paper_id", F.explode(ways).alias("w")).select("para_id", "paper_id", "w.*", F.lit("abbr").alias("reftype"))
    rows = keep_first(rows, ["name", "reftype", "paper_id"], ["para_id", "othername"])
    return rows if existing is None else rows.join(existing.select("name", "reftype", "paper_id"), ["name", "reftype", "paper_id"], "left_anti").select(*rows.columns)
