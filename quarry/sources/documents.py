"""XML and HTML documents as rows: metadata, paragraphs and tables by a table of publisher rules.

Parsing needs a tolerant parser, which the JVM side lacks, so it is one Arrow UDF over whole
documents; everything after it (dedup, validity, insertion) is relational.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import arrow, caption_number, filename_to_doi, normalize_chars
from quarry.operators.joins import uncontained, without_contained
from quarry.operators.predicates import is_reference, valid_paragraph

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template".split())
#: Open elements of this kind end where a new one begins.
ENDS = {"p": {"p"}, "li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def find(self, *tags: str) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            if n is not self and n.tag in tags:
                yield n
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))


class _Builder(HTMLParser):
    """Open elements are a stack, so that nodes don't refer back and a tree is freed as soon as it is read."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Node("")]

    def handle_starttag(self, tag, attrs):
        tag = tag.rpartition(":")[2]
        ends = ENDS.get(tag, ())
        while len(self.open) > 1 and self.open[-1].tag in ends:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag.rpartition(":")[2], {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        tag = tag.rpartition(":")[2]
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if self.open[-1].tag not in SILENT:
            self.open[-1].children.append(data)


def tree(source: str) -> Node:
    b = _Builder()
    b.feed(source)
    b.close()
    return b.open[0]


# fixed values: how raised and lowered text is written
SCRIPTS = {"sup": "^", "sub": "_", "inf": "_"}


def inner_text(node: Node) -> str:
    """All text under a node; raised text as ``^{}``, lowered as ``_{}``, links to references dropped."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.tag in SILENT or n is not node and n.tag in ("xref", "cross-ref", "a") and re.search(r"bibr|ref|cit", " ".join((n.attrs.get("ref-type", ""), n.attrs.get("class", ""), n.attrs.get("href", "") if n.attrs.get("href", "").startswith("#") else ""))):
            continue
        body = list(reversed(n.children))
        if n.tag in SCRIPTS:
            todo.append("}")
            todo.extend(body)
            out.append(SCRIPTS[n.tag] + "{")
        else:
            todo.extend(body)
    return re.sub(r"\s+", " ", "".join(out)).strip()


@dataclass(frozen=True)
class Rule:
    """Where a publisher's documents keep their parts."""

    publisher: str
    kind: str
    paragraphs: tuple[str, ...]
    css: str = ""
    titles: tuple[str, ...] = ("article-title", "title", "h1")
    abstracts: tuple[str, ...] = ("abstract",)
    captions: tuple[str, ...] = ("caption", "label")
    doi_meta: tuple[str, ...] = ("citation_doi", "dc.identifier", "prism.doi")


# fixed values: publishers, the kind of their files, and the elements that are paragraphs
RULES = (
    Rule("acs", "xml", ("p",)),
    Rule("aip", "html", ("div",), "nlm_paragraph"),
    Rule("ecs", "html", ("p",)),
    Rule("elsevier", "xml", ("para", "simple-para")),
    Rule("hindawi", "xml", ("p",)),
    Rule("informa", "html", ("p",)),
    Rule("iop", "html", ("p",)),
    Rule("nature", "html", ("p",)),
    Rule("rsc", "html", ("p", "span")),
    Rule("springer", "html", ("p", "span")),
    Rule("wiley", "html", ("p",)),
)
GENERIC = Rule("", "html", ("p",))


def publisher_rules(spark: SparkSession, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The dimension of known publishers."""
    return spark.createDataFrame([(r.publisher, r.kind, list(r.paragraphs), r.css) for r in rules], "publisher string, kind string, paragraphs array<string>, css string")


def grid(table: Node) -> list[list[str]]:
    """A table's cells with row and column spans filled in; short rows are padded."""
    rows: list[list[str]] = []
    hanging: dict[int, tuple[int, str]] = {}
    span = lambda c, k: min(1000, max(1, int(v))) if (v := c.attrs.get(k, "1")).isdigit() else 1
    for tr in table.find("tr", "row"):
        cells = [c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th", "entry")]
        row: list[str] = []
        while cells or len(row) in hanging:
            if len(row) in hanging:
                left, text = hanging.pop(len(row))
                if left > 1:
                    hanging[len(row)] = (left - 1, text)
                row.append(text)
                continue
            c = cells.pop(0)
            text, down = inner_text(c), span(c, "rowspan")
            for _ in range(span(c, "colspan")):
                if down > 1:
                    hanging[len(row)] = (down - 1, text)
                row.append(text)
        rows.append(row)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _typed(cell: str):
    for kind in (int, float):
        try:
            return kind(cell)
        except ValueError:
            pass
    return cell


def table_records(cells: list[list[str]]) -> list[str]:
    """JSON lines of a grid whose first row is the header."""
    if len(cells) < 2:
        return []
    names = [h or f"column {i}" for i, h in enumerate(cells[0])]
    return [json.dumps(dict(zip(names, map(_typed, r), strict=True)), ensure_ascii=False) for r in cells[1:]]


#: A document's parts and their types.
PARTS = {
    "title": "string", "abstract": "string", "doi": "string", "paragraphs": "array<string>",
    "tables": "array<struct<caption:string,header:array<string>,body:array<array<string>>,jsonl:array<string>>>",
}
DOCUMENT = f"struct<{','.join(f'{k}:{v}' for k, v in PARTS.items())}>"
#: Characters of documents that a Python worker reads before it hands over their parts.
CHUNK = 1 << 20


def parse(source: str | None, rule: Rule = GENERIC, parts: Iterable[str] = tuple(PARTS)) -> dict:
    """Title, abstract, doi, paragraphs in order and tables of one document; only ``parts`` are looked for."""
    out = {"title": None, "abstract": None, "doi": None, "paragraphs": [], "tables": []}
    if not source:
        return out
    root = tree(source)
    first = lambda tags: next((t for n in root.find(*tags) if (t := inner_text(n))), None)
    metas = {n.attrs.get("name", "").lower(): n.attrs.get("content", "") for n in root.find("meta")}
    if "title" in parts:
        out["title"] = metas.get("citation_title") or first(rule.titles)
    if "abstract" in parts:
        out["abstract"] = first(rule.abstracts) or metas.get("citation_abstract") or metas.get("dc.description")
    if "doi" in parts:
        doi = next((metas[m] for m in rule.doi_meta if metas.get(m)), None) or next((inner_text(n) for n in root.find("article-id", "doi") if n.attrs.get("pub-id-type", "doi") == "doi"), None)
        out["doi"] = re.sub(r"^(doi:|https?://(dx\.)?doi\.org/)", "", doi) if doi else None
    for n in root.find(*rule.paragraphs) if "paragraphs" in parts else ():
        if rule.css and rule.css not in n.attrs.get("class", "").lower().split():
            continue
        text = inner_text(n)
        if text:
            out["paragraphs"].append(text)
    if "tables" not in parts:
        return out
    wrapped = {id(c) for n in root.find("table-wrap", "tbl") for c in n.children if isinstance(c, Node) and c.tag == "table"}
    for n in root.find("table", "table-wrap", "tbl"):
        if id(n) in wrapped:
            continue
        cells = grid(n)
        caption = next((t for c in n.find(*rule.captions) if (t := inner_text(c))), None)
        if cells:
            out["tables"].append({"caption": caption, "header": cells[0], "body": cells[1:], "jsonl": table_records(cells)})
    return out


def chunks(sources: Iterable[str | None], size: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of documents: a run ends with the document that brings it to ``size`` characters."""
    lo = n = hi = 0
    for hi, s in enumerate(sources, 1):
        n += len(s or "")
        if n >= size:
            yield lo, hi
            lo, n = hi, 0
    if lo < hi:
        yield lo, hi


def _parsed(content: Column, publisher: Column, parts: tuple[str, ...], kind: str) -> Column:
    """A struct of parts, or the one part itself; a worker holds the parts of a chunk of documents at a time."""

    @arrow(kind)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:  # a series of a single part, which Spark tells by the kind
        rules = {r.publisher: r for r in RULES}
        for sources, publishers in batches:
            for lo, hi in chunks(sources, CHUNK):
                rows = [parse(s, rules.get(p, GENERIC), parts) for s, p in zip(sources.iloc[lo:hi], publishers.iloc[lo:hi], strict=True)]
                yield pd.DataFrame(rows, columns=list(parts)) if kind.startswith("struct") else pd.Series([r[parts[0]] for r in rows], dtype=object)

    return run(content, publisher)


def parsed(content: Column, publisher: Column) -> Column:
    """Whole documents and their publishers, to their parts; unknown publishers are read by the generic rule."""
    return _parsed(content, publisher, tuple(PARTS), DOCUMENT)


def part_of(content: Column, publisher: Column, part: str) -> Column:
    """One part of whole documents; the others are not looked for."""
    return _parsed(content, publisher, (part,), PARTS[part])


def read_documents(spark: SparkSession, path: str, publisher: str | None = None) -> DataFrame:
    """(path, publisher, doi, doctype, content) of files under a path; the publisher is their folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.coalesce(F.get(F.split("path", "/"), F.size(F.split("path", "/")) - 2), F.lit(""))
    return files.select(
        "path", (F.lit(publisher) if publisher else F.lower(folder)).alias("publisher"), filename_to_doi(name).alias("doi"), F.element_at(F.split(name, r"\."), -1).alias("doctype"), F.col("content").cast("string").alias("content")
    )


def of_known_publishers(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a rule, and those without."""
    dim = F.broadcast(publisher_rules(documents.sparkSession).select("publisher"))
    return documents.join(dim, "publisher", "left_semi"), documents.join(dim, "publisher", "left_anti")


def paragraphs_of(documents: DataFrame, key: str, content: str = "content", publisher: str | None = "publisher", dedup: bool = True) -> DataFrame:
    """(key, pos, text): valid paragraphs in order, without references, repeats and parts of earlier ones."""
    by = F.col(publisher) if publisher else F.lit("")
    texts = F.transform(part_of(F.col(content), by, "paragraphs"), lambda t, i: F.struct(i.alias("pos"), normalize_chars(t).alias("text")))
    # a generated column is computed once, before the filters on it
    own = documents.select(key, F.explode(F.array(texts)).alias("p"))
    valid = F.filter("p", lambda x: valid_paragraph(x["text"]) & ~is_reference(x["text"]))
    if not dedup:
        return own.select(key, F.explode(valid).alias("p")).select(key, "p.pos", "p.text")
    own = own.select(key, F.explode(F.array(valid)).alias("p"))
    # most repeats go inside their row; documents of one key still meet
    rows = own.select(key, F.explode(uncontained(F.col("p"), "pos", "text")).alias("p")).select(key, "p.pos", "p.text")
    return without_contained(rows, key, "pos", "text")


def tables_of(documents: DataFrame, key: str, content: str = "content", publisher: str | None = "publisher") -> DataFrame:
    """(key, pos, caption, number, header, body, jsonl): tables with a caption, the first of each caption."""
    by = F.col(publisher) if publisher else F.lit("")
    rows = documents.select(key, F.posexplode(part_of(F.col(content), by, "tables")).alias("pos", "t")).select(key, "pos", "t.*")
    rows = rows.where(F.col("caption").isNotNull()).withColumn("number", caption_number("caption"))
    from quarry.operators.ordered import keep_first

    return keep_first(rows, [key, "caption"], ["pos"]).select(key, "pos", "caption", "number", "header", "body", "jsonl")


def summary(paragraphs: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """A line for each file: how many paragraphs it gave."""
    n = paragraphs.groupBy(key).agg(F.count(F.lit(1)).alias("paragraphs"))
    return files.select(key, "publisher", "doctype").join(n, key, "left").withColumn("paragraphs", F.coalesce("paragraphs", F.lit(0)))


def as_json(documents: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, json): a document's parts as one JSON object."""
    return documents.select(key, F.to_json(parsed(F.col(content), F.lit(""))).alias("json"))


def word_count(text, word: str):
    """Occurrences of a word, whatever its case."""
    return F.regexp_count(text, F.lit(rf"(?i)\b{re.escape(word)}\b"))
