"""Near-duplicate classes by Order MinHash and banded alignment.

A document's tokens are its runs of five words, each with its occurrence number, so that they are
distinct within the document. For each of ``sketches`` hash orders the ``sampled`` least tokens are taken
and hashed in the order they have in the text: two documents share a sketch if the same tokens
are least and stand in the same order, which follows edit similarity rather than the bare set.

Documents with the same words are one node. Nodes that share a sketch are linked to the least node of
that bucket (one link a node: never all pairs of a bucket) and verified. A bucket is mixed while its members lie in more than one
component. Members of mixed buckets, and no others, are then joined by a prefix filter, which is exact: tokens are ordered by the number of
components that hold them (rarest first, ties by hash), and two documents of similarity ``threshold`` or more share one of their first
tokens, as many as the threshold lets them differ in. Pairs must also pass the length bound, the bound by the token's place and a bound by
bitmaps of all tokens (bits that differ are tokens that differ), and lie in different components. So every pair that shares a sketch is verified or joined already, and common
passages, being last in the order, make no pairs. Verification aligns the tokens of both documents in a band
around the diagonal whose width follows from the threshold: L is the longest common subsequence inside
it, the similarity L / (n_a + n_b - L), and links of at least ``threshold`` count. Since tokens are
distinct, the alignment is a longest increasing run over the shared tokens.

The order's counts are kept in ``CELLS`` cells of the token's hash, a bound that doesn't grow with the data: any order gives the same pairs,
a coarser one only more candidates.

Expected recall at similarity 0.8, three sampled tokens and 16 sketches: 1 - (1 - 0.8**3)**16 > 0.99998.

Every row gets a row. Texts of under five words are one token (all their words); texts without words,
null or empty, are never linked and form a class each. Null ids take part; repeated ids
and rows stay apart rows, of which one row of a class at most is kept. Very long texts are read whole (their words take 24 bytes each in a
task), an empty table gives an empty one, ties go to the least node. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, drop_rows, mix, shingle_hashes, slices, text_key, word_hashes
from .components import components

SHINGLE, THRESHOLD, SAMPLED, SKETCHES = 5, 0.8, 3, 16
#: Cells of token counts by which prefixes are ordered.
CELLS, ROUNDS = 1 << 20, 2


def tokens(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Occurrence-labelled k-mers of one document's word hashes, in text order."""
    if not len(words):
        return np.zeros(0, np.uint64)
    grams = shingle_hashes(words, min(k, len(words)))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if new.all():
        return grams
    at = np.arange(len(ranked))
    nth = np.empty(len(ranked), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return mix(grams + nth * np.uint64(0x9E3779B97F4A7C15)) if nth.any() else grams


def _odds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def sketch(own: np.ndarray, odds: np.ndarray, sampled: int) -> np.ndarray:
    """One 64-bit hash for each multiplier: the ``sampled`` least tokens in text order."""
    take = min(sampled, len(own))
    out = np.empty(len(odds), np.int64)
    step = max(1, (1 << 19) // len(own))
    for lo in range(0, len(odds), step):
        with np.errstate(over="ignore"):
            ranks = own[None, :] * odds[lo : lo + step, None]
        ranks ^= ranks >> np.uint64(29)
        least = np.argpartition(ranks, take - 1, axis=1)[:, :take] if take < len(own) else np.tile(np.arange(take), (len(ranks), 1))
        least.sort(axis=1)
        total = np.zeros(len(ranks), np.uint64)
        for j in range(take):
            total = mix(total * np.uint64(0xE7037ED1A0B428DB) + own[least[:, j]])
        out[lo : lo + step] = mix(total + odds[lo : lo + step]).view(np.int64)
    return out


def _sketch_rows(k: int, sampled: int, n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = _odds(n)
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, _, _, first = word_hashes(batch.column("text"))
                nodes, found = [], []
                for lo, hi in zip(first[:-1], first[1:], strict=True):
                    words = hashes[lo:hi]
                    nodes.append(blake2b(words.tobytes(), digest_size=16).digest() if hi > lo else None)
                    found.append(sketch(tokens(words, k), odds, sampled) if hi > lo else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.binary()), pa.array(found, pa.list_(pa.int64())), batch.column("key")], ["doc_id", "node", "sketch", "key"])

    return rows


def _packed(words: np.ndarray) -> bytes:
    """Three bytes a word: half of what is shuffled. Two different words look alike once in 17 million."""
    return (words >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    return wide.view("<u4")[:, 0].astype(np.uint64)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            hashes, _, _, first = word_hashes(batch.column("text"))
            spans = [hashes[lo:hi] for lo, hi in zip(first[:-1], first[1:], strict=True)]
            nodes = [blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in spans]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array([_packed(x) for x in spans], pa.binary())], ["node", "words"])


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Of two documents' tokens, by banded alignment; under the threshold an upper bound may be returned."""
    if not len(a) or not len(b):
        return 0.0
    both, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    total, bound = len(a) + len(b), len(both) / (len(a) + len(b) - len(both))
    if bound < threshold:
        return bound
    need = threshold * total / (1 + threshold)
    order = np.argsort(at)
    at, to = at[order], to[order]
    run = to[np.abs(at - to) <= max(len(a), len(b)) - need + 1]
    if len(run) > 1 and (np.diff(run) < 0).any():
        ends: list[int] = []
        for x in run.tolist():
            i = bisect_left(ends, x)
            ends[i : i + 1] = [x]
        best = len(ends)
    else:
        best = len(run)
    return best / (total - best)


def _verify_rows(k: int, threshold: float):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(64)
        def own(words: bytes) -> np.ndarray:
            return _own(words, k)

        for batch in batches:
            found = [similarity(own(a.as_py()), own(b.as_py()), threshold) for a, b in zip(batch.column("words_a"), batch.column("words_b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return rows


def _verify(pairs: DataFrame, words: DataFrame, k: int, threshold: float) -> DataFrame:
    both = pairs.select("a", "b")
    for side in ("a", "b"):
        both = both.join(words.select(F.col("node").alias(side), F.col("words").alias(f"words_{side}")), side)
    return cut(both.select("a", "b", "words_a", "words_b").mapInArrow(_verify_rows(k, threshold), "a binary, b binary, similarity double"), "verified")


def _own(words: bytes, k: int) -> np.ndarray:
    return tokens(mix(_unpacked(words) + np.uint64(1)), k)


def _cells(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(44)).astype(np.int64)


def _cell_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for words in batch.column("words"):
                np.add.at(total, _cells(_own(words.as_py(), k)), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 1 << 16):
            part = at[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["cell", "n"])

    return rows


def prefix(own: np.ndarray, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, int]:
    """A document's rarest tokens in order, and how many of them are enough where it isn't the longer one of a pair.

    Of n tokens, a partner of at least the threshold shares threshold x n; a partner as long or longer shares
    2 x threshold / (1 + threshold) x n. What may differ, and one more, is the prefix.
    """
    n = len(own)
    order = np.lexsort((own, counts[_cells(own)]))
    most = n - int(np.ceil(threshold * n - 1e-9)) + 1
    return own[order[:most]], min(most, n - int(np.ceil(2 * threshold / (1 + threshold) * n - 1e-9)) + 1)


def bitmap(own: np.ndarray) -> np.ndarray:
    """1024 bits of a document's tokens as sixteen numbers: where two documents' differ, so do tokens."""
    bits = np.zeros(1024, bool)
    bits[(own & np.uint64(1023)).astype(np.int64)] = True
    return np.packbits(bits).view(np.int64)


BITS = [f"b{i}" for i in range(16)]


def _bitmap_rows(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([bitmap(_own(words.as_py(), k)) for words in batch.column("words")], np.int64).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(np.ascontiguousarray(b)) for b in bits.T)], ["node", *BITS])

    return rows


def _prefix_rows(k: int, threshold: float, sent):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = []
                for words in part.column("words"):
                    own = _own(words.as_py(), k)
                    found.append((*prefix(own, sent.value, threshold), len(own)))
                many = [len(p) for p, *_ in found]
                row = pa.array(np.repeat(np.arange(part.num_rows), many))
                at = np.concatenate([np.arange(m, dtype=np.int32) for m in many]) if many else np.zeros(0, np.int32)
                token = np.concatenate([p for p, *_ in found]).view(np.int64) if many else np.zeros(0, np.int64)
                size = np.repeat(np.array([n for _, _, n in found], np.int32), many)
                short = at < np.repeat(np.array([s for _, s, _ in found], np.int32), many)
                yield pa.RecordBatch.from_arrays([pa.array(token), part.column("node").take(row), part.column("own").take(row), pa.array(size), pa.array(at), pa.array(short)], ["token", "node", "own", "size", "at", "short"])

    return rows


def _prefix_links(mixed: DataFrame, first: DataFrame, words: DataFrame, k: int, threshold: float) -> DataFrame:
    """All verified links: ``first``, and those between the ``node, words, label`` of mixed buckets that the prefix filter finds.

    In ``ROUNDS`` rounds, the members of an eighth of the prefix tokens are held against one of them each, so that families are
    joined by few pairs; then all that is still apart and passes the filter is verified.
    """
    spark = mixed.sparkSession
    # a component counts once, by its least node: thousands of near copies don't make their tokens common
    cells = mixed.filter("node = label").select("words").mapInArrow(_cell_rows(k), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows at most
    counts = np.zeros(CELLS, np.int64)
    counts[cells.column("cell").to_numpy()] = cells.column("n").to_numpy()
    sent = spark.sparkContext.broadcast(counts)
    rows = cut(mixed.select("node", "words", F.xxhash64("label").alias("own")).mapInArrow(_prefix_rows(k, threshold, sent), "token long, node binary, own long, size int, at int, short boolean"), "prefixes")

    def apart(rows: DataFrame) -> DataFrame:
        shared = rows.groupBy("token").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select("token")
        return cut(rows.join(shared, "token"), "shared-prefixes")

    def verified(pairs: DataFrame, links: DataFrame) -> DataFrame:
        ends = pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        return links.unionByName(_verify(ends.join(links.select("a", "b"), ["a", "b"], "left_anti"), words, k, threshold))

    x, y = F.col("a.size"), F.col("b.size")
    differ = sum((F.bit_count(F.col(f"a.{b}").bitwiseXOR(F.col(f"b.{b}"))) for b in BITS[1:]), F.bit_count(F.col("a.b0").bitwiseXOR(F.col("b.b0"))))
    near = (F.col("a.own") != F.col("b.own")) & (F.least(x, y) >= threshold * F.greatest(x, y) - 1e-6) & (differ <= (1 - threshold) / (1 + threshold) * (x + y) + 1e-6)
    bits = mixed.select("node", "words").mapInArrow(_bitmap_rows(k), f"node binary, {', '.join(f'{b} long' for b in BITS)}")
    shared, links = apart(rows), first
    drop(rows)
    held = cut(shared.join(bits, "node"), "bitmaps")
    drop(shared)
    for part in range(ROUNDS):
        some = held.filter(F.pmod("token", F.lit(8)) == part)
        pick = F.min_by(F.struct("size", "node", "own", *BITS), F.xxhash64("node", "token"))
        heads = some.groupBy("token").agg(pick.alias("h")).select("token", "h.*")
        links = verified(heads.alias("a").join(some.alias("b"), "token").filter(near), links)
        labels = components(links.filter(F.col("similarity") >= threshold))
        known = cut(held.withColumnRenamed("own", "was").join(labels, "node", "left").withColumn("own", F.xxhash64(F.coalesce("label", "node"))).drop("was", "label"), "prefixes")
        drop(held, labels)
        held = apart(known)
        drop(known)
    a, b = held.filter("short").alias("a"), held.alias("b")
    first_of = (x < y) | ((x == y) & (F.col("a.node") < F.col("b.node")))
    left = F.least(x - F.col("a.at"), y - F.col("b.at"))  # what they can still share, this token included
    fits = left >= threshold / (1 + threshold) * (x + y) - 1e-6
    links = verified(a.join(b, (F.col("a.token") == F.col("b.token")) & near & first_of & fits), links)
    drop(held)
    return links


def near_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, sampled: int = SAMPLED, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame]:
    """Rows as ``doc_id, node, key``, and verified links between nodes as ``a, b, similarity``."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("key"))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = cut(texts.mapInArrow(_sketch_rows(k, sampled, sketches), f"doc_id {kind}, node binary, sketch array<bigint>, key string"), "sketches")
    nodes = rows.filter("node IS NOT NULL").groupBy("node").agg(F.first("sketch").alias("sketch"))
    keys = nodes.select(F.explode("sketch").alias("band"), "node")
    heads = keys.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("n")).filter("n > 1").select("band", "head")
    buckets = cut(keys.join(heads, "band"), "buckets")
    star = buckets.filter("node <> head")
    pairs = star.select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    linked = star.select(F.col("head").alias("node")).union(star.select("node")).distinct()
    words = texts.filter("text IS NOT NULL").mapInArrow(_word_rows, "node binary, words binary")
    words = cut(words.join(linked, "node", "left_semi").dropDuplicates(["node"]), "words")
    first = _verify(pairs, words, k, threshold)
    if first.filter(F.col("similarity") < threshold).isEmpty():
        return rows.select("doc_id", "node", "key"), first
    labels = components(first.filter(F.col("similarity") >= threshold))
    placed = buckets.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    placed = placed.withColumn("own", F.xxhash64("label"))
    bands = placed.groupBy("band").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).filter("lo <> hi").select("band")
    mixed = placed.join(bands, "band", "left_semi").select("node", "label").distinct()
    mixed = cut(words.join(mixed, "node"), "mixed")
    drop(buckets, labels)
    links = _prefix_links(mixed, first, words, k, threshold)
    drop(mixed, words)
    return rows.select("doc_id", "node", "key"), links


def _classed(docs: DataFrame, doc_id: str, text: str, k: int, threshold: float, sampled: int, sketches: int) -> tuple[DataFrame, DataFrame]:
    """Rows with words by id and text as ``doc_id, class_id, class_size, own, node, key, copies``, ``own`` if a copy is kept; and rows without words."""
    rows, links = near_links(docs, doc_id, text, k, threshold, sampled, sketches)
    labels = components(links.filter(F.col("similarity") >= threshold))
    worded = rows.filter("node IS NOT NULL").groupBy("node", "doc_id", "key").agg(F.count("*").alias("copies"))
    classed = cut(worded.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "classed")
    least = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "node", "key"))
    heads = classed.groupBy("label").agg(least.alias("least"), F.sum("copies").alias("class_size"))
    own = (F.col("least.node") == F.col("node")) & (F.col("least.key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("least.doc_id"))
    return classed.join(heads, "label").select("doc_id", F.col("least.doc_id").alias("class_id"), "class_size", own.alias("own"), "node", "key", "copies"), rows.filter("node IS NULL")


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE, threshold: float = THRESHOLD, sampled: int = SAMPLED, sketches: int = SKETCHES) -> DataFrame:
    """One row per document row: ``doc_id, class_id, class_size, kept, node``.

    ``class_id`` is the least id of the class; one row of each class is kept, that with the least id (nulls last,
    then the least node, then the least hash of the text).
    """
    classed, wordless = _classed(docs, doc_id, text, k, threshold, sampled, sketches)
    out = classed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("nth"))
    out = out.select("doc_id", "class_id", "class_size", (F.col("own") & (F.col("nth") == 1)).alias("kept"), "node")
    # rows without words stand alone: each is a class
    alone = wordless.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "node")
    return out.unionByName(alone)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without all but one of each near-duplicate class, all columns as they are.

    Rows are told apart by id and text, so a class takes no row of another with it; of repeated rows at most one stays.
    """
    classed = cut(_classed(docs, doc_id, text, SHINGLE, THRESHOLD, SAMPLED, SKETCHES)[0].select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "own", "copies"), "classes")
    return drop_rows(docs, doc_id, text, classed.filter(~F.col("own")).select("_id", "_key"), classed.filter(F.col("own") & (F.col("copies") > 1)).select("_id", "_key"))
