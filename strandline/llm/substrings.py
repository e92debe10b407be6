"""Fuzzy passages that documents share, by collinear chaining of k-mer seeds.

1. Seeds: of every ``window`` successive runs of ``k`` words, the one with the least hash, with its place; and, for later (5.), of all runs of
   ``SHORT`` words, those whose hash is a multiple of ``ONE_IN``, wherever they stand.
2. A seed that several documents hold is linked, in each, to its first place in the document with the least id that holds it:
   one link an occurrence, never all pairs of a seed.
3. Chaining: the links of two documents, in text order, are chained. A link adds ``K``, a gap costs ``GAP`` for each word of either
   side; the best chain that ends before a link on both sides is a prefix maximum in a Fenwick tree. Chains
   are taken best first, and no link is in two.
4. Alignment: a chain is followed link by link (equal stretches word by word, unequal ones by a small edit table inside a
   band), and extended outward while the score doesn't drop by more than ``DROP``,
   by ``MARGIN`` words at most (what lies farther has seeds of its own). A passage has at least ``least`` words on both
   sides, of which at least ``identity`` match in order. A chain that is none as a whole is cut at its gaps: every stretch of it
   that no longer one holds is a passage, less those that the others cover.

5. What no passage covers: a seed may have been linked to a document that holds too little of a passage which others hold whole. So seeds
   outside the passages found are looked up again together with the seeds before and after them. And every run of ``least`` words
   around such a seed in which all seeds are shared is looked up by its hash, which is exact: two documents with ``least`` equal words in
   a row hold the same runs. Short seeds are linked as in 2. where one of the two places is in no passage: fuzzy passages may have no others. Each key's occurrences are linked to the document with the least id that holds it, chained and aligned as before.

Result: ``doc_id, match_id, first, last, match_first, match_last, n_matched, identity`` per passage, in words from 0; clean
documents have no row. ``match_id`` is the document with the least id that the passage was linked to, so that one with n copies has n - 1 rows.

Passages of ``least`` equal words in a row are all found (of a longer one, up to k + window - 1 words at an end may be left out where other documents hold the rest). Fuzzy ones are found where some run of k + window - 1 words is unchanged (any such run
holds a shared seed); otherwise each unchanged run of ``SHORT`` words is a seed with a chance of 1 in ``ONE_IN``, so that of n such runs all are missed
with probability (1 - 1 / ONE_IN) ** n. A passage in which no ``SHORT`` words in a row are unchanged has no seed and isn't found.

Ids are of any type that can be ordered. Rows with null ids take part and have null in ``doc_id`` or ``match_id``; they come after all others.
Different texts under one id are documents of their own (so ``doc_id`` and ``match_id`` can be equal), ordered by their hash; rows with the
same id and text are one. Null and short texts have no passages. Repeats within a document don't count. Very long texts are read whole; an empty table gives an empty
one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, mix, shingle_hashes, slices, word_hashes

K, WINDOW, LEAST, IDENTITY = 8, 16, 50, 0.8
SHORT, ONE_IN = 4, 8
GAP, DROP, BAND, MARGIN = 0.1, 8, 48, 80
PASSAGE = ["doc_id", "match_id", "first", "last", "match_first", "match_last", "n_matched", "identity"]


def minimizers(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least hash of every ``window`` successive ones (of all, if there are fewer)."""
    if len(grams) <= window:
        return np.array([grams.argmin()]) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)
    step = 1 << 16
    return np.unique(np.concatenate([views[i : i + step].argmin(axis=1) + np.arange(i, min(i + step, len(views))) for i in range(0, len(views), step)]))


def _seed_rows(k: int, window: int, least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, _, _, first = word_hashes(batch.column("text"))
                seeds, places, rows = [], [], []
                for r, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    if hi - lo < least:
                        continue
                    grams, short = shingle_hashes(hashes[lo:hi], k), shingle_hashes(hashes[lo:hi], SHORT)
                    at, some = minimizers(grams, window), np.flatnonzero(short % np.uint64(ONE_IN) == 0)
                    # the lowest bit tells short seeds from others
                    seeds += [(grams[at] & ~np.uint64(1)).view(np.int64), (short[some] | np.uint64(1)).view(np.int64)]
                    places += [at.astype(np.int32), some.astype(np.int32)]
                    rows.append(np.full(len(at) + len(some), r))
                ids = batch.column("doc_id").take(pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds) if seeds else [], pa.int64()), ids, pa.array(np.concatenate(places) if places else [], pa.int32())], ["seed", "doc_id", "at"])

    return rows


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three bytes of hash a word."""
    for whole in batches:
        for batch in slices(whole, "text"):
            hashes, _, _, first = word_hashes(batch.column("text"))
            small = (hashes >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([small[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["doc_id", "words"])


def chains(a: np.ndarray, b: np.ndarray, k: int) -> list[list[int]]:
    """Links (a[i], b[i]), ordered by a, as chains of their numbers; best first, each link once."""
    n = len(a)
    rank = np.unique(b, return_inverse=True)[1].tolist()
    size = max(rank) + 1
    best, who = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, back = [0.0] * n, [-1] * n
    x, y = a.tolist(), b.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:  # links at one place don't follow each other
            top, prev, p = float("-inf"), -1, rank[j]
            while p > 0:
                if best[p] > top:
                    top, prev = best[p], who[p]
                p &= p - 1
            gain = top - GAP * (x[j] + y[j])
            score[j], back[j] = (k + gain, prev) if prev >= 0 and gain > 0 else (float(k), -1)
            j += 1
        for m in range(i, j):
            value, p = score[m] + GAP * (x[m] + y[m]), rank[m] + 1
            while p <= size:
                if value > best[p]:
                    best[p], who[p] = value, m
                p += p & -p
        i = j
    used, out = [False] * n, []
    for end in sorted(range(n), key=lambda m: -score[m]):
        chain, m = [], end
        while m >= 0 and not used[m]:
            used[m] = True
            chain.append(m)
            m = back[m]
        if chain:
            out.append(chain[::-1])
    return out


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows with equal keys, of rows that come sorted by them."""
    held: list[pa.RecordBatch] = []

    def same(x: pa.RecordBatch, i: int, y: pa.RecordBatch, j: int) -> bool:
        return all(x.column(k)[i] == y.column(k)[j] for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if held and not same(held[-1], 0, batch, lo):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _key_rows(k: int, window: int, least: int):
    """Keys of what no passage covers, from ``doc_id, text, held, bare`` (places of shared seeds, and those that are uncovered)."""

    def keys(words: np.ndarray, held: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams = shingle_hashes(words, k)
        at = minimizers(grams, window)
        shared, open_ = np.isin(at, held), np.isin(at, bare)
        seeds, odd = grams[at], np.uint64(0x9E3779B97F4A7C15)
        both = shared[:-1] & shared[1:]
        pair = mix(seeds[:-1] * odd + seeds[1:])
        three = both[:-1] & both[1:] & open_[1:-1]
        # the least gram of each window of grams, and whether it is shared; a run of words holds `span` windows
        views = np.lib.stride_tricks.sliding_window_view(grams, min(window, len(grams)))
        lowest = np.concatenate([views[i : i + 65536].argmin(axis=1) + np.arange(i, min(i + 65536, len(views))) for i in range(0, len(views), 65536)])
        span, place = least - k - window + 2, np.searchsorted(at, lowest)
        good, bare_ = np.concatenate(([0], np.cumsum(shared[place]))), np.concatenate(([0], np.cumsum(open_[place])))
        run = np.flatnonzero((good[span:] - good[:-span] == span) & (bare_[span:] > bare_[:-span])) if len(views) >= span else np.zeros(0, np.int64)
        whole = shingle_hashes(words, least)[run] if len(run) else np.zeros(0, np.uint64)
        parts = [(mix(pair[:-1][three] * odd + pair[1:][three]), at[1:-1][three]), (whole, run)]
        return np.concatenate([x for x, _ in parts]).view(np.int64), np.concatenate([x for _, x in parts]).astype(np.int32)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                hashes, _, _, first = word_hashes(batch.column("text"))
                for r, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
                    if hi - lo >= least:
                        found, at = keys(hashes[lo:hi], np.array(batch.column("held")[r].as_py()), np.array(batch.column("bare")[r].as_py()))
                        yield pa.RecordBatch.from_arrays([pa.array(found), batch.column("doc_id").take(pa.array(np.full(len(at), r))), pa.array(at)], ["seed", "doc_id", "at"])

    return rows


def _chain_rows():
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

        def flush() -> pa.RecordBatch:
            cols = zip(*out, strict=True) if out else [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "head", "a", "b"])

        for group in _runs(batches, ("doc_id", "head")):
            a, b = group.column("at").to_numpy(), group.column("head_at").to_numpy()
            doc, head = group.column("doc_id")[0].as_py(), group.column("head")[0].as_py()
            for chain in chains(a, b, K):
                # one link may be enough: extension decides
                out.append((doc, head, a[chain], b[chain]))
            if len(out) >= 2000:
                yield flush()
                out.clear()
        yield flush()

    return rows


def _extend(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """Words to add, and how many match, along one diagonal from the start of x and y."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = x[:n] == y[:n]
    score = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(score, 0))
    dropped = np.flatnonzero(top - score > DROP)
    end = int(dropped[0]) if len(dropped) else n
    if not end or score[:end].max() <= 0:
        return 0, 0
    best = int(score[:end].argmax()) + 1
    return best, int(same[:best].sum())


def _matches(x: np.ndarray, y: np.ndarray) -> int:
    """Longest common subsequence of two short stretches, inside a band around the diagonal."""
    if len(x) == len(y) and (x == y).all():
        return len(x)
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    x, y = x[lo:].tolist(), y[lo:].tolist()
    if not x or not y:
        return lo
    row = [0] * (len(y) + 1)
    slope = len(y) / len(x)
    for i, w in enumerate(x):
        mid = int(i * slope)
        j0, j1 = max(0, mid - BAND), min(len(y), mid + BAND + 1)
        diagonal = row[j0]
        for j in range(j0, j1):
            up = row[j + 1]
            row[j + 1] = diagonal + 1 if w == y[j] else max(up, row[j])
            diagonal = up
        for j in range(j1, len(y)):  # beyond the band nothing is better
            if row[j + 1] >= row[j]:
                break
            row[j + 1] = row[j]
    return lo + max(row)


def align(a: list[int], b: list[int], x: np.ndarray, y: np.ndarray, k: int) -> tuple[int, int, int, int, int]:
    """(first, end, first, end, matches) of a chain's passage, in words of x and y, where the links' places are."""
    matched, ea, eb = 0, a[0], b[0]
    for i, j in zip(a, b, strict=True):
        if i < ea or j < eb:  # overlaps what is matched: go on behind it
            skip = max(ea - i, eb - j)
            if skip >= k:
                continue
            i, j, n = i + skip, j + skip, k - skip
        else:
            n = k
        if i > ea or j > eb:
            matched += _matches(x[ea:i], y[eb:j])
        matched, ea, eb = matched + n, i + n, j + n
    more, good = _extend(x[ea:], y[eb:])
    less, well = _extend(x[: a[0]][::-1], y[: b[0]][::-1])
    return a[0] - less, ea + more, b[0] - less, eb + more, matched + good + well


def _blocks(a: list[int], b: list[int], x: np.ndarray, y: np.ndarray, k: int) -> list[list[int]]:
    """``[first, end, first, end, matches]`` of a chain's links, each extended into the gaps around it; equal or touching ones are one."""
    out: list[list[int]] = []
    for i, j in zip(a, b, strict=True):
        n = k
        if out:
            _, ea, _, eb, _ = out[-1]
            skip = max(ea - i, eb - j)
            if skip > 0:  # overlaps what is matched: go on behind it
                if skip >= k:
                    continue
                i, j, n = i + skip, j + skip, k - skip
            more, good = _extend(x[ea:i], y[eb:j])
            out[-1][1], out[-1][3], out[-1][4] = ea + more, eb + more, out[-1][4] + good
        ea, eb = (out[-1][1], out[-1][3]) if out else (0, 0)
        less, well = _extend(x[ea:i][::-1], y[eb:j][::-1])
        if out and i - less == ea and j - less == eb:
            out[-1][1], out[-1][3], out[-1][4] = i + n, j + n, out[-1][4] + well + n
        else:
            out.append([i - less, i + n, j - less, j + n, well + n])
    _, ea, _, eb, _ = out[-1]
    more, good = _extend(x[ea:], y[eb:])
    out[-1][1], out[-1][3], out[-1][4] = ea + more, eb + more, out[-1][4] + good
    return out


def stretches(a: list[int], b: list[int], x: np.ndarray, y: np.ndarray, k: int, least: int, identity: float) -> list[tuple[int, int, int, int, int]]:
    """The passages of a chain as :func:`align` gives them: the whole of it, or the stretches that no longer one holds."""

    def enough(p: tuple[int, int, int, int, int]) -> bool:
        a0, a1, b0, b1, matched = p
        return min(a1 - a0, b1 - b0) >= least and matched / max(a1 - a0, b1 - b0) >= identity

    whole = align(a, b, x, y, k)
    if enough(whole):
        return [whole]
    if len(a) == 1 or min(whole[1] - whole[0], whole[3] - whole[2]) < least:
        return []
    blocks = _blocks(a, b, x, y, k)
    gaps = [0] + [_matches(x[p[1] : q[0]], y[p[3] : q[2]]) for p, q in zip(blocks[:-1], blocks[1:], strict=True)]
    a0, a1, b0, b1, own = np.array(blocks).T
    done = np.cumsum(own + np.array(gaps))  # matches up to a block's end
    before = done - own
    found: list[tuple[int, int]] = []
    for f in range(len(blocks)):  # the last block that a passage from f on can end with
        last = found[-1][1] + 1 if found else 0
        lo = max(f, last)
        size_a, size_b, matched = a1[lo:] - a0[f], b1[lo:] - b0[f], done[lo:] - before[f]
        good = np.flatnonzero((np.minimum(size_a, size_b) >= least) & (matched / np.maximum(size_a, size_b) >= identity))
        if len(good):
            found.append((f, lo + int(good[-1])))
    out, covered, n = [], -1, 0
    while n < len(found):  # of those that begin in what is covered, the one that reaches farthest
        while n + 1 < len(found) and found[n + 1][0] <= covered + 1:
            n += 1
        f, t = found[n]
        out.append((int(a0[f]), int(a1[t]), int(b0[f]), int(b1[t]), int(done[t] - before[f])))
        covered, n = t, n + 1
    return out


def _align_rows(k: int, least: int, identity: float):
    def wide(packed: bytes) -> np.ndarray:
        out = np.zeros((len(packed) // 3, 4), np.uint8)
        out[:, :3] = np.frombuffer(packed, np.uint8).reshape(-1, 3)
        return out.view("<u4")[:, 0]

    def found(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        i, j, n = int(a[0]), int(b[0]), int(a[-1] - a[0]) + k
        if (a - b == i - j).all() and (x[i : i + n] == y[j : j + n]).all():  # one equal stretch: only its ends are open
            more, good = _extend(x[i + n :], y[j + n :])
            less, well = _extend(x[:i][::-1], y[:j][::-1])
            size, matched = less + n + more, n + good + well
            return [(i - less, i + n + more, j - less, j + n + more, matched)] if size >= least and matched / size >= identity else []
        return stretches(a.tolist(), b.tolist(), x, y, k, least, identity)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            docs, heads, xs, ys, x0s, y0s = (batch.column(c).to_pylist() for c in ("doc_id", "head", "x", "y", "x0", "y0"))
            (a, a_at), (b, b_at) = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column("a"), batch.column("b")))
            for r, (doc, head, x, y, x0, y0) in enumerate(zip(docs, heads, xs, ys, x0s, y0s, strict=True)):
                for a0, a1, b0, b1, matched in found(a[a_at[r] : a_at[r + 1]] - x0, b[b_at[r] : b_at[r + 1]] - y0, wide(x), wide(y)):
                    out.append((doc, head, a0 + x0, a1 + x0 - 1, b0 + y0, b1 + y0 - 1, matched, matched / max(a1 - a0, b1 - b0)))
            cols = zip(*out, strict=True) if out else [()] * 8
            kinds = [pa.int64()] * 2 + [pa.int32()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], PASSAGE)

    return rows


def _linked(keys: DataFrame) -> DataFrame:
    """Each occurrence of a key (``seed, doc_id, at``) beside the first one in the least document that holds it; one link an occurrence."""
    heads = keys.groupBy("seed").agg(F.min(F.struct("doc_id", "at")).alias("h"), F.max("doc_id").alias("other"))
    heads = heads.filter("h.doc_id < other").select("seed", F.col("h.doc_id").alias("head"), F.col("h.at").alias("head_at"))
    return keys.join(heads, "seed").filter("doc_id <> head").select("doc_id", "head", "at", "head_at")


def _aligned(links: DataFrame, words: DataFrame, k: int, least: int, identity: float) -> DataFrame:
    """The passages that links between documents, of ``k`` words each, lead to."""
    chained = links.repartition("doc_id", "head").sortWithinPartitions("doc_id", "head", "at").mapInArrow(_chain_rows(), "doc_id long, head long, a array<int>, b array<int>")
    chained = cut(chained.select(F.xxhash64("doc_id", "head", "a", "b").alias("c"), "*"), "chains")
    begin = lambda p: F.greatest(F.element_at(p, 1) - MARGIN, F.lit(0))
    end = lambda p: F.element_at(p, -1) + k + MARGIN
    side = lambda d, p, left: F.struct(F.col(d).alias("doc_id"), begin(p).alias("lo"), end(p).alias("hi"), F.lit(left).alias("left"))
    sides = chained.select("c", F.col("doc_id").alias("of"), "head", F.inline(F.array(side("doc_id", "a", True), side("head", "b", False))))
    cuts = sides.join(words, "doc_id").select("c", "of", "head", "left", "lo", F.substring("words", F.col("lo") * 3 + 1, (F.col("hi") - F.col("lo")) * 3).alias("w"))
    take = lambda left, v: F.max(F.when(F.col("left") == left, F.col(v)))
    both = cuts.groupBy("c", "of", "head").agg(take(True, "w").alias("x"), take(False, "w").alias("y"), take(True, "lo").alias("x0"), take(False, "lo").alias("y0"))
    ready = chained.join(both.withColumnRenamed("of", "doc_id"), ["c", "doc_id", "head"])
    return cut(ready.mapInArrow(_align_rows(k, least, identity), "doc_id long, match_id long, first int, last int, match_first int, match_last int, n_matched int, identity double"), "passages")


def _marked(held: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``seed, doc_id, at, short, bare``: shared seeds, and whether no passage covers them."""
    spans = found.select("doc_id", "first", "last").union(found.select("match_id", "match_first", "match_last")).distinct()
    # passages open and close along a document, for short seeds a little later; a seed is covered while one is open
    step = lambda at, long, short: F.struct(at.alias("at"), F.lit(long).alias("step"), F.lit(short).alias("short_step"))
    steps = spans.filter(F.col("last") - F.col("first") >= k).select("doc_id", F.inline(F.array(step(F.col("first"), 1, 1), step(F.col("last") - k + 2, -1, 0), step(F.col("last") - SHORT + 2, 0, -1))))
    steps = steps.groupBy("doc_id", "at").agg(F.sum("step").cast("int").alias("step"), F.sum("short_step").cast("int").alias("short_step"))
    marks = held.withColumn("step", F.lit(0)).withColumn("short_step", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    along = Window.partitionBy("doc_id").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    opened = marks.withColumn("open", F.sum("step").over(along)).withColumn("short_open", F.sum("short_step").over(along)).filter("seed IS NOT NULL")
    return opened.withColumn("short", F.col("seed") % 2 != 0).select("seed", "doc_id", "at", "short", (F.when(F.col("short"), F.col("short_open")).otherwise(F.col("open")) == 0).alias("bare"))


def _places(marked: DataFrame) -> DataFrame:
    """``doc_id, held, bare``: places of shared long seeds, and those in no passage, of documents that have some of the latter."""
    places = marked.filter("NOT short").groupBy("doc_id").agg(F.collect_list("at").alias("held"), F.collect_list(F.when(F.col("bare"), F.col("at"))).alias("bare"))
    return places.filter(F.size("bare") > 0)


def _short_links(marked: DataFrame) -> DataFrame:
    """Links of short seeds: of each place in no passage to the seed's first one; and to a first one in no passage, that of the next document."""
    seeds = marked.filter("short")
    heads = seeds.groupBy("seed").agg(F.min(F.struct("doc_id", "at", "bare")).alias("h"), F.max("bare").alias("any")).filter("any").select("seed", "h")
    links = seeds.join(heads, "seed").filter("doc_id <> h.doc_id")
    following = links.filter("h.bare").groupBy("seed", "h").agg(F.min(F.struct("doc_id", "at")).alias("d")).select("d.doc_id", "h", "d.at")
    links = links.filter("bare").select("doc_id", "h", "at").union(following).distinct()
    return links.select("doc_id", F.col("h.doc_id").alias("head"), "at", F.col("h.at").alias("head_at"))


def _numbered(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text`` with a number for each id and text, in the order of ids and then hashes, and ``row, name`` that gives the ids back."""
    given = docs.select(F.col(doc_id).alias("name"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).filter("text IS NOT NULL")
    one = cut(given.groupBy("name", "h").agg(F.first("text").alias("text")), "rows")
    names = one.select("name", "h").orderBy(F.asc_nulls_last("name"), "h").select("name", "h", F.monotonically_increasing_id().alias("row"))
    names = cut(names, "names").alias("n")
    texts = one.alias("o").join(names, F.col("o.name").eqNullSafe(F.col("n.name")) & (F.col("o.h") == F.col("n.h"))).select(F.col("row").alias("doc_id"), "text")
    return cut(texts, "texts"), names.select("row", "name")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW, least: int = LEAST, identity: float = IDENTITY) -> DataFrame:
    """The passages of at least ``least`` words that documents share with others."""
    kind = docs.schema[doc_id].dataType
    # whole numbers that tell all rows apart serve as they are
    plain = isinstance(kind, IntegralType) and docs.groupBy(F.col(doc_id).alias("name")).count().filter("name IS NULL OR count > 1").isEmpty()
    if plain:
        texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    else:
        texts, names = _numbered(docs, doc_id, text)
    words = cut(texts.mapInArrow(_packed_rows, "doc_id long, words binary"), "words")
    seeds = texts.mapInArrow(_seed_rows(k, window, least), "seed long, doc_id long, at int")
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("seed")
    held = cut(seeds.join(shared, "seed"), "seeds")
    found = _aligned(_linked(held.filter("seed % 2 = 0")), words, k, least, identity)
    marked = cut(_marked(held, found, k), "marked")
    again = _places(marked).join(texts, "doc_id").select("doc_id", "text", "held", "bare").mapInArrow(_key_rows(k, window, least), "seed long, doc_id long, at int")
    links = _linked(cut(again, "keys"))
    # of links on one diagonal one in 25 words is enough
    thin = links.groupBy("doc_id", "head", (F.col("at") - F.col("head_at")).alias("diagonal"), F.floor(F.col("at") / 25)).agg(F.min("at").alias("at"), F.min("head_at").alias("head_at")).select("doc_id", "head", "at", "head_at")
    found = found.unionByName(_aligned(thin.unionByName(_short_links(marked)), words, SHORT, least, identity)).distinct()
    if plain:
        return found.select(F.col("doc_id").cast(kind).alias("doc_id"), F.col("match_id").cast(kind).alias("match_id"), *PASSAGE[2:])
    for c in ("doc_id", "match_id"):
        found = found.withColumnRenamed(c, "row").join(names, "row").drop("row").withColumnRenamed("name", c)
    return found.select(*PASSAGE)
