"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

An item's windows are its runs of ``window`` words (the whole item, if it has fewer). A
window is a set of shingles (runs of ``shingle`` words with their place in the window), put
in one order for all: rarest first, by the number of windows that hold a shingle. As a
document must hold a window wholly, one prefix token is enough, its rarest shingle: a
document that lacks it can't hold the window. Where the token occurs, a positional bound (the window must
begin at or after the first word of the document) and a length bound (and end by its last)
are checked, then all words are compared: by their hashes first, and what passes byte by byte.

The index of windows is broadcast in blocks of at most ``block`` windows (a bound that doesn't
grow with the data; a benchmark of any size is done block by block, with a write to
the shared folder between blocks), and documents stay where they are: no shuffle, each text is
read once a block.

Very long texts are read whole, in parts of half a megabyte. An empty table on either side gives no hits.
Null or wordless texts and items have no windows and no hits. Rows are kept one by one, repeated or null
ids included; repeated item ids count once, a null item id as the empty string. Other columns are left out
of the result, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TO_WORDS, cut, raw, shingle_hashes, slices, word_hashes

WINDOW, SHINGLE, BLOCK = 10, 3, 200_000


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items as their words, space-separated, with the sorted ids of the items: ``words, items``."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (t or "").encode().translate(TO_WORDS).split()
                size = min(window, len(words))
                out += [(b" ".join(words[i : i + size]).decode(), item) for i in range(len(words) - size + 1)] if size else []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out, strict=True) if out else ((), ()))], ["words", "item"])

    ids = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    rows = items.select(ids.alias("item"), F.col(text).alias("text")).mapInArrow(cut_up, "words string, item string")
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class _Index:
    """Windows of a block by the hash of their rarest shingle."""

    def __init__(self, rows: list[tuple[str, list[str]]], shingle: int):
        self.items = [items for _, items in rows]
        self.words = [words.encode() for words, _ in rows]
        flat = pa.array([words for words, _ in rows], pa.string())
        hashes, _, _, first = word_hashes(flat)
        size = np.diff(first)
        self.groups = []
        for n in np.unique(size):
            k = min(shingle, int(n))
            ids = np.flatnonzero(size == n)
            words = hashes[first[ids][:, None] + np.arange(n)]
            tokens = np.stack([shingle_hashes(words[:, j : j + k].reshape(-1), k)[::k] for j in range(n - k + 1)], axis=1)
            self.groups.append([k, int(n), ids, words, tokens])
        seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {g[0] for g in self.groups}:
            seen[k] = np.unique(np.concatenate([np.unique(row) for g in self.groups if g[0] == k for row in g[4]]), return_counts=True)
        for g in self.groups:
            k, _, ids, words, tokens = g
            values, counts = seen[k]
            # rarest first; equal counts by hash, so that the order is total
            rank = np.empty(len(values), np.int64)
            rank[np.lexsort((values, counts))] = np.arange(len(values))
            at = rank[np.searchsorted(values, tokens)].argmin(axis=1)
            prefix = tokens[np.arange(len(ids)), at]
            order = np.argsort(prefix, kind="stable")
            g[2:] = [ids[order], words[order], at[order], prefix[order]]
            g += list(np.unique(prefix[order], return_index=True))

    def find(self, words: np.ndarray, row_end: np.ndarray, row_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Occurrences in the words: (first word, number of words, window)."""
        out: list[tuple[np.ndarray, ...]] = []
        tokens = {k: shingle_hashes(words, k) for k in {g[0] for g in self.groups}}
        for k, n, ids, own, at, prefix, keys, begin in self.groups:
            got = tokens[k]
            if not len(got):
                continue
            place = np.searchsorted(keys, got)
            place[place == len(keys)] = 0
            hit = np.flatnonzero(keys[place] == got)
            lo = begin[place[hit]]
            many = np.append(begin, len(prefix))[place[hit] + 1] - lo
            for a in range(0, len(hit), 65536):  # a part at a time: many windows may share a token
                c = many[a : a + 65536]
                which = np.repeat(lo[a : a + 65536], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                word = np.repeat(hit[a : a + 65536], c)
                start = word - at[which]
                fits = (start >= row_start[word]) & (start + n <= row_end[word])  # position and length
                start, which = start[fits], which[fits]
                same = (words[start[:, None] + np.arange(n)] == own[which]).all(axis=1)
                out.append((start[same], np.full(same.sum(), n), ids[which[same]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _occurrences(index: _Index, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts of a column: (number of words, first word of each text, first words, sizes and windows of what occurs)."""
    data, _ = raw(column)
    hashes, begin, end, first = word_hashes(column)
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start, size, which = index.find(hashes, first[1:][row_of], first[:-1][row_of])
    same = [b" ".join(data[begin[s] : end[s + n - 1]].tobytes().translate(TO_WORDS).split()) == index.words[w] for s, n, w in zip(start, size, which, strict=True)]
    keep = np.array(same, bool)
    return len(hashes), first, start[keep], size[keep], which[keep]


SPAN = "array<struct<first:int,last:int>>"


def _blocks(items: DataFrame, item_id: str, item_text: str, window: int, block: int) -> Iterator[Broadcast]:
    """The windows in broadcasts of about ``block`` each, one at least."""
    windows = cut(item_windows(items, item_id, item_text, window), "windows")
    blocks = max(1, -(-windows.count() // block))
    numbered = windows.withColumn("block", F.pmod(F.xxhash64("words"), F.lit(blocks)))
    for b in range(blocks):
        rows = [(r.words, r.items) for r in numbered.filter(F.col("block") == b).select("words", "items").orderBy("words").toLocalIterator()]
        yield items.sparkSession.sparkContext.broadcast(rows)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item, all columns as they are; rows are judged one by one, without a shuffle."""
    for sent in _blocks(items, item_id, item_text, window, block):
        docs = docs.mapInArrow(_sieve(sent, shingle, text), docs.schema)
    return docs


def _sieve(sent: Broadcast, shingle: int, text: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(sent.value, shingle)
        for whole in batches:
            for batch in slices(whole, text):
                _, first, start, _, _ = _occurrences(index, batch.column(text))
                clean = np.ones(batch.num_rows, bool)
                clean[np.searchsorted(first, start, "right") - 1] = False
                yield batch.filter(pa.array(clean))

    return rows


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, spans, items``.

    ``spans`` are the hit words as joined ranges (first and last word, from 0), ``items`` the ids of
    the items with a window in the document, sorted as strings.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.lit(None).cast(SPAN).alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    for b, sent in enumerate(_blocks(items, item_id, item_text, window, block)):
        out = cut(out, "hits") if b else out
        out = out.mapInArrow(_scan(sent, shingle), T.StructType(out.schema.fields))
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.last - s.first + 1), F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _scan(sent, shingle: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Index(sent.value, shingle)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, first, start, size, which = _occurrences(index, batch.column("text"))
                counts = np.diff(first)
                row_of = np.repeat(np.arange(batch.num_rows), counts)
                # words that are hit, by the difference of ranges that begin and end
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                hit = np.cumsum(edge[:-1]) > 0
                rows = row_of[start]
                spans, names = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for r in np.unique(rows):
                    lo, hi = first[r], first[r + 1]
                    mask = hit[lo:hi].copy()
                    for s in spans[r] or ():
                        mask[s["first"] : s["last"] + 1] = True
                    step = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    spans[r] = [{"first": int(a), "last": int(z) - 1} for a, z in step.reshape(-1, 2)]
                    found = set(names[r] or ())
                    for w in np.unique(which[rows == r]):
                        found.update(index.items[w])
                    names[r] = sorted(found)
                types = batch.schema
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(spans, types.field("spans").type), pa.array(names, types.field("items").type), pa.array(counts, pa.int64())], schema=types)

    return scan


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from :func:`contaminated`."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


