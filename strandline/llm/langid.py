"""Language identification by words, backing off to ever shorter character n-grams.

A known word scores, for each language, the logarithm of its relative frequency there, or a
penalty where that language doesn't have it. An unseen word is cut, with a blank at either end, into n-grams of the longest
order of which any is known, and scores the mean of the known ones; with none known in any
order it says nothing. A text's score is the mean over its words, its prediction the language with the
highest (ties: the first in order), and ``score`` that language's share in exp(mean x words, 24 at most).

The model is fitted on a bounded sample of labelled rows: ``PER_LANG`` rows of each of the ``MOST_LANGS``
most frequent labels (rarer labels are never predicted), those with the least hash of the id; so what is broadcast doesn't grow with the data. Its tables hold all words and n-grams of the
sample. Only where these are more than ``ENTRIES`` are those left out that are seen least often, in all languages alike.

Texts that are null or without a letter get ``und`` and 0. Texts with letters of which none is
known get the most frequent label and 1 / languages; without any labelled row all get ``und``. Whole texts are read;
rows are kept one by one, repeated ones and null ids included; an empty table gives an empty one. Other columns are ignored or, in :func:`keep_known`, kept as they are,
whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PER_LANG, MOST_LANGS, ENTRIES, ORDERS = 1000, 256, 2_000_000, (5, 4, 3, 2, 1)
#: Words whose scores a task remembers, and scores in all.
CACHE, CELLS = 200_000, 8_000_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, order: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for word, n in Counter(words_of(text)).items():
                seen[lang, word] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "gram", "n")), strict=True):
            for order in ORDERS:
                for gram in grams_of(word, order):
                    seen[lang, order, gram] += n
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "order", "gram", "n"])


def fit(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict:
    """The model from the rows of ``docs`` for which ``learn`` holds: ``langs`` and logarithms by order (0: words)."""
    labelled = docs.filter(learn).select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()
    langs = [r["lang"] for r in counts]
    if not langs:
        return {"langs": [], "tables": {}}
    near = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    # twice the rows that are wanted pass by their hash alone, so that no task orders all rows of a language
    share = {r["lang"]: min(1.0, (2 * PER_LANG + 200) / r["count"]) for r in counts}
    bound = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), F.col("lang"))
    few = labelled.select("doc_id", "lang").filter(F.col("lang").isin(langs)).filter(F.xxhash64("doc_id") / 2.0**64 + 0.5 <= bound)
    chosen = few.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= PER_LANG).select("doc_id", "lang").distinct()
    sample = labelled.join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")  # PER_LANG x MOST_LANGS ids at most
    words = sample.select("lang", "text").mapInArrow(_count_words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    words = cut(words.select("lang", F.lit(0).alias("order"), "gram", "n"), "words")
    grams = words.select("lang", "gram", "n").mapInArrow(_count_grams, "lang string, order int, gram string, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
    known = cut(words.unionByName(grams), "grams")
    times = known.groupBy("n").agg(F.count("*").alias("entries")).orderBy(F.desc("n")).collect()  # different counts in a bounded sample
    least, held = 1, 0
    for r in times:
        held += r["entries"]
        if held > ENTRIES:
            least = r["n"] + 1
            break
    totals = known.groupBy("lang", "order").agg(F.sum("n").alias("total"))
    rows = known.filter(F.col("n") >= least).join(F.broadcast(totals), ["lang", "order"]).select("lang", "order", "gram", F.log(F.col("n") / F.col("total")).alias("log")).toArrow().to_pylist()  # ENTRIES at most
    if not rows:  # labelled rows without a word teach as little as none
        return {"langs": [], "tables": {}}
    at = {x: i for i, x in enumerate(sorted(langs))}
    tables: dict[int, dict[str, dict[int, float]]] = {}
    for r in rows:
        tables.setdefault(r["order"], {}).setdefault(r["gram"], {})[at[r["lang"]]] = r["log"]
    return {"langs": sorted(langs), "first": at[langs[0]], "tables": tables, "missing": min(r["log"] for r in rows) - 1}


class Scorer:
    """Predicts from a model; remembers the scores of words it has met, a bounded number of them."""

    def __init__(self, model: dict):
        self.langs, self.tables = model["langs"], model["tables"]
        self.missing, self.first = model.get("missing", 0.0), model.get("first", 0)
        self.most = max(1000, min(CACHE, CELLS // max(1, len(self.langs))))
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.langs)))
        self.known = np.zeros(1024)

    def word(self, word: str) -> list[float] | None:
        own = self.tables.get(0, {}).get(word)
        found = [own] if own else []
        for order in ORDERS:
            if found:
                break
            table = self.tables.get(order, {})
            found = [table[g] for g in grams_of(word, order) if g in table]
        if not found:
            return None
        out = [self.missing] * len(self.langs)
        for entry in found:
            for lang, log in entry.items():
                out[lang] += (log - self.missing) / len(found)
        return out

    def _row(self, word: str) -> int:
        i = self.at[word] = len(self.at)
        if i >= len(self.known):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.known = np.concatenate([self.known, np.zeros_like(self.known)])
        if (v := self.word(word)) is not None:
            self.scores[i], self.known[i] = v, 1
        return i

    def predict(self, text: str | None) -> tuple[str, float]:
        times = Counter(words_of(text))
        if not self.langs or not any(c.isalpha() for w in times for c in w):
            return "und", 0.0
        if len(self.at) > self.most:
            self._clear()
        at = self.at
        rows = [at[w] if w in at else self._row(w) for w in times]
        weight = np.fromiter(times.values(), float, len(times)) * self.known[rows]
        n = weight.sum()
        if not n:
            return self.langs[self.first], 1 / len(self.langs)
        mean = weight @ self.scores[rows] / n
        share = np.exp((mean - mean.max()) * min(n, 24))
        best = int(mean.argmax())
        return self.langs[best], float(share[best] / share.sum())


def predict(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is left out of learning; a null id is not held out, but isn't learnt from either."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def learnable(doc_id: str = "doc_id") -> Column:
    return F.col(doc_id).isNotNull() & ~held_out(doc_id)


def keep_known(docs: DataFrame, model: dict, text: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose language is known with a score of at least ``least``, all columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = (scorer.predict(t.as_py()) for t in batch.column(text))
            yield batch.filter(pa.array([lang != "und" and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


