"""Language ID by words first, then shorter and shorter character n-grams.

A known word scores by its log frequency in each language. An unseen word backs off:
its 4-grams are tried, then 3-, 2- and 1-grams, and the first length of which some
n-gram is known scores it by the mean log frequency of the known ones. Words are runs of
letters, lower-cased.

The model is fitted on a sample of at most ``max_docs`` different labelled texts, shared
evenly among the languages and drawn by a hash of the text, so that it is the same in every
run. Repeats of a text count as one, so a language of copies alone is still learned; with
more than ``max_docs`` languages those whose texts hash lowest are. Nothing else is cut: the
model has every word and n-gram of the sample, and its size is bounded by the sample alone.
All rows and whole texts are scored.

Texts of a batch are scored together: each different word is looked up once, and a text's
score is a sum of rows of one matrix.

Null texts and texts without a letter are ``und`` with score 0, as is every text where
there is nothing to learn from. Ties go to the language first in code point order.
Repeated rows are scored alike; columns named like the new ones are replaced. An empty
table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import quoted, string_field, table, unused, with_text_columns

#: What separates words (RE2).
GAPS = r"\P{L}+"
NGRAMS = (4, 3, 2, 1)
#: Unseen words a task remembers before it forgets them all.
CACHE = 60_000
#: Distinct words a counting task holds before it passes them on.
HELD = 100_000
#: Characters of text scored at a time.
CHUNK = 2_000_000
#: Most back-off steps a word, on average, of a text that is in some language.
MAX_STEPS = 1.0


def words_of(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts, one after another, and how many each text has."""
    parts = pc.split_pattern_regex(pc.utf8_lower(pa.array([t or "" for t in texts], pa.large_string())), GAPS)
    words = parts.flatten()
    own = np.repeat(np.arange(len(texts)), np.diff(parts.offsets.to_numpy()))
    real = pc.not_equal(words, "")
    return words.filter(real), np.bincount(own[real.to_numpy(zero_copy_only=False)], minlength=len(texts))


def grams_of(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class Model:
    """Log frequencies: ``words`` and ``index[n]`` give a word's or n-gram's row of ``rows``, one value per language.

    Words, by far the most, are one Arrow array and not a dictionary; a task holds little
    more than their letters and the matrix.
    """

    def __init__(self, counts):
        """counts: (language, n or 0 for words, key, occurrences), each once, as a list of tuples or an Arrow table."""
        if isinstance(counts, list):
            columns = list(zip(*counts, strict=True)) if counts else [[]] * 4
            counts = pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()), strict=True)], ["lang", "n", "key", "many"])
        self.langs = sorted(counts.column("lang").unique().to_pylist())
        lang = pc.index_in(counts.column("lang"), pa.array(self.langs, counts.column("lang").type)).to_numpy()
        level, many = counts.column("n").to_numpy(), counts.column("many").to_numpy()
        self.index: dict[int, dict[str, int]] = {}
        parts, first = [], 0
        for n in (0, *NGRAMS):
            at = np.flatnonzero(level == n)
            keys = counts.column("key").take(pa.array(at)).combine_chunks().dictionary_encode()
            table_ = np.zeros((len(keys.dictionary), max(1, len(self.langs))))
            table_[keys.indices.to_numpy(), lang[at]] = many[at]
            if n:
                self.index[n] = {k: first + i for i, k in enumerate(keys.dictionary.to_pylist())}
            else:
                self.words = keys.dictionary.cast(pa.large_string())
            parts.append(np.log((table_ + 0.5) / (table_.sum(axis=0) + 0.5 * len(table_))) if len(table_) else table_)
            first += len(table_)
        self.rows = np.concatenate(parts).astype(np.float32)

    def unseen(self, words: list[str]) -> np.ndarray:
        """Rows of unseen words, with the steps that each was backed off as a last column."""
        flat: list[int] = []
        sizes, steps = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i, word in enumerate(words):
            for step, n in enumerate(NGRAMS, 1):
                get = self.index[n].get
                known = [r for g in grams_of(word, n) if (r := get(g)) is not None]
                if known:
                    break
            else:
                step += 1
            flat += known
            sizes[i], steps[i] = len(known), step
        out = np.zeros((len(words), self.rows.shape[1] + 1), np.float32)
        out[:, -1] = steps
        full = np.flatnonzero(sizes)
        if len(full):
            out[full, :-1] = np.add.reduceat(self.rows[flat].astype(np.float64), (np.cumsum(sizes) - sizes)[full], axis=0) / sizes[full, None]
        return out


class Scorer:
    """Sums of rows by text; rows of unseen words are made on demand and now and then forgotten."""

    def __init__(self, model: Model):
        self.model, self.fresh = model, {}
        self.rows = np.zeros((0, model.rows.shape[1] + 1), np.float32)

    def rows_of(self, words: pa.Array) -> np.ndarray:
        """Rows of different words, with the number of back-off steps as a last column."""
        known = pc.index_in(words, value_set=self.model.words)
        out = np.zeros((len(words), self.rows.shape[1]), np.float32)
        seen = known.is_valid().to_numpy(zero_copy_only=False)
        out[seen, :-1] = self.model.rows[known.drop_null().to_numpy()]
        unseen = words.filter(pc.is_null(known)).to_pylist()
        if len(self.fresh) > CACHE:
            self.fresh, self.rows = {}, self.rows[:0]
        if more := [w for w in unseen if w not in self.fresh]:
            self.fresh.update(zip(more, range(len(self.fresh), len(self.fresh) + len(more)), strict=True))
            self.rows = np.concatenate([self.rows, self.model.unseen(more)])
        if unseen:
            out[~seen] = self.rows[[self.fresh[w] for w in unseen]]
        return out

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the rows of each text's words, and how many words it has."""
        words, sizes = words_of(texts)
        coded = words.dictionary_encode()
        rows, at = self.rows_of(coded.dictionary), coded.indices.to_numpy()
        out, ends = np.zeros((len(texts), rows.shape[1])), np.cumsum(sizes)
        full = np.flatnonzero(sizes)
        for lo in range(0, len(full), 512):
            part = full[lo : lo + 512]
            first, last = ends[part[0]] - sizes[part[0]], ends[part[-1]]
            out[part] = np.add.reduceat(rows[at[first:last]].astype(np.float64), ends[part] - sizes[part] - first, axis=0)
        return out, sizes

    def judged(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, posterior, and back-off steps a word, of each text."""
        out: list[tuple[str, float, float]] = []
        lo = 0
        while lo < len(texts):
            hi, held = lo, 0
            while hi < len(texts) and (hi == lo or held + len(texts[hi] or "") <= CHUNK):
                held += len(texts[hi] or "")
                hi += 1
            total, sizes = self.totals(texts[lo:hi])
            for row, n in zip(total, sizes.tolist(), strict=True):
                if not n or not self.model.langs:
                    out.append(("und", 0.0, 0.0))
                    continue
                best = int(row[:-1].argmax())
                out.append((self.model.langs[best], float(1 / np.exp(row[:-1] - row[best]).sum()), float(row[-1] / n)))
            lo = hi
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judged([text])[0][:2]


def sampled(docs: DataFrame, max_docs: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """(text, lang): at most ``max_docs`` different labelled texts with a letter, evenly from all languages.

    Only hashes are ranked, and each task passes on no more than a language's share of them;
    the picked hashes, ``max_docs`` at most, are broadcast to fetch their texts.
    """
    labelled = docs.where(F.col(text).rlike(r"\p{L}") & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("h"))
    share = max(1, max_docs // max(1, labelled.select("lang").distinct().count()))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = labelled.select("lang", "h").distinct().withColumn("place", order).where(F.col("place") <= share)
    picked = picked.orderBy("place", "h", "lang").limit(max_docs).select("lang", "h")
    once = labelled.join(F.broadcast(picked), ["lang", "h"], "left_semi")

    def first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in batches:
            keys = list(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            fresh = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
            yield b.take(pa.array(fresh, pa.int64()))

    return once.mapInArrow(first_of_task, once.schema).dropDuplicates(["lang", "h"]).select("text", "lang")


def fit(docs: DataFrame, max_docs: int = 20_000, text: str = "text", lang: str = "lang") -> Model:
    """A model from rows with a text and a language, of which at most ``max_docs`` different texts are read."""

    def emitted(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        """Words, then the n-grams of one length at a time."""
        for k, words in seen.items():
            for n in (0, *NGRAMS):
                found = words
                if n:
                    found = Counter()
                    for w, many in words.items():
                        for g in grams_of(w, n):
                            found[g] += many
                keys = list(found)
                for i in range(0, len(keys), 20_000):
                    part = keys[i : i + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k] * len(part)), pa.array([n] * len(part), pa.int32()), pa.array(part), pa.array([found[x] for x in part], pa.int64())],
                        names=["lang", "n", "key", "many"],
                    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for big in batches:
            for lo in range(0, big.num_rows, 256):
                texts, langs = (c.to_pylist() for c in big.slice(lo, 256).columns)
                for k in set(langs):
                    words, _ = words_of([t for t, x in zip(texts, langs, strict=True) if x == k])
                    found = words.value_counts()
                    mine = seen.setdefault(k, Counter())
                    for w, many in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True):
                        mine[w] += many
                if sum(map(len, seen.values())) > HELD:
                    yield from emitted(seen)
                    seen = {}
        yield from emitted(seen)

    counts = sampled(docs, max_docs, text, lang).mapInArrow(count, "lang string, n int, key string, many long")
    return Model(counts.groupBy("lang", "n", "key").agg(F.sum("many").alias("many")).toArrow())


def _judge(docs: DataFrame, model: Model, text: str, names: tuple[str, str, str]) -> DataFrame:
    def maker():
        scorer = Scorer(model)
        return lambda texts: [list(c) for c in zip(*scorer.judged(texts), strict=True)]

    return with_text_columns(docs, [string_field(names[0]), *(T.StructField(n, T.DoubleType()) for n in names[1:])], maker, text, binary=False)


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior of the best language."""
    steps = unused([*docs.columns, *names], "steps")
    return _judge(docs, model, text, (*names, steps)).drop(steps)


def recognised(docs: DataFrame, model: Model, max_steps: float = MAX_STEPS, text: str = "text") -> DataFrame:
    """The rows whose text is in some language of the model, with the columns of ``docs``.

    Texts without a letter go, and those whose words back off by more than ``max_steps`` on
    average: words of a learned language are known or made of its 4-grams, whereas those of
    another language or script, and noise, are met by short n-grams only.
    """
    lang = unused(docs.columns, "lang_pred")
    names = (lang, unused(docs.columns, "score"), unused(docs.columns, "steps"))
    found = _judge(docs, model, text, names)
    return found.where((F.col(lang) != "und") & (F.col(names[2]) <= max_steps)).select(*quoted(docs.columns))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 2 by 4 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


QUERIES = {"op3_language": op3_language}
ORACLES: dict[str, str] = {}
