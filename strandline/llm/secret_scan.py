"""Secrets in texts: three fixed patterns, and tokens that a battery of randomness tests can't tell from random ones.

Candidates are maximal runs of the characters of encoded secrets. For each, the encoding is inferred (the smallest alphabet that holds
it), and its characters become ranks in that alphabet. Three tests ask whether the ranks could be uniform and independent: chi-squared over
equal stretches of the alphabet, the number of runs above and below its middle, and the correlation of each rank with the next. Their p-values are
combined: one very small one tells, and so do several small ones.

Random-looking isn't yet secret: short words look random too. So each candidate also gets evidence against being ordinary: its probability as a random
token over its probability under the character pairs of all words of the corpus (an e-value: under ordinary text its mean is at most 1). Candidates are compared within
bands of doubling length, and in each band the e-BH rule takes as many as keep the expected share of false discoveries at
``fdr``, however the candidates depend on each other. Longer tokens gather more evidence, and a band pays for its own candidates only.

Null texts are empty ones and give no spans; repeated rows give repeated rows; pure numbers and words in letters only of one case aren't candidates.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

#: The patterns, the group whose length counts, and the least length (fixed values, in their fixed order).
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: One of these is in every text with a match, in lower case.
_NEEDS = {"assign": (b"passw", b"secret", b"token", b"api"), "access": (b"akia",)}
KINDS = [k for k, *_ in BASE] + ["random"]
#: Shortest candidate.
LEAST = 20
_LONG = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
#: Hex runs that are long enough.
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings from the smallest alphabet to the largest; the first that holds a token is its own.
ENCODINGS = [
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
]
_RANKS = []
for _name, _alphabet in ENCODINGS:
    _rank = np.full(128, -1, np.int16)
    _rank[[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
    _RANKS.append((_name, len(_alphabet), _rank))
#: Symbols of the model of ordinary text: ASCII, and one for what lies between words.
SYMBOLS, EDGE = 128, 0
#: Bytes that are counted at a time.
STEP = 1 << 20
_TOKEN_BYTE = np.zeros(256, bool)
_TOKEN_BYTE[[ord(c) for c in _DIGITS + _LOWER + _UPPER + "+/_-"]] = True


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns' matches, by start, then by kind in its fixed order."""
    out, lower = [], text.encode().lower()  # bytes: ASCII letters only
    for place, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "hex":  # runs are maximal, so those long enough are found directly
            out += [(m.start(), place, m.end(), kind) for m in _HEX.finditer(text)]
        elif any(w in lower for w in _NEEDS[kind]):
            out += [(m.start(), place, m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def encoding(token: str) -> tuple[str, int, np.ndarray] | None:
    """The smallest encoding's name, the size of its alphabet, and the ranks; none for numbers, words in one case, and what fits no alphabet."""
    body = token.rstrip("=")
    if body.isdigit() or not body.isascii() or (body.isalpha() and (body.islower() or body.isupper() or body[1:].islower())):
        return None
    codes = np.frombuffer(body.encode(), np.uint8)
    for name, size, rank in _RANKS:
        found = rank[codes]
        if found.min() >= 0:
            return name, size, found
    return None


def _upper_tail(x: float, df: int) -> float:
    """P(chi-squared with ``df`` degrees > x), by the series of the incomplete gamma function or its continued fraction."""
    a, z = df / 2, x / 2
    if z <= 0:
        return 1.0
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - front * total)
    b, c = z + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        out *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, front * out)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(ranks: np.ndarray, size: int) -> tuple[float, float, float]:
    """p-values of uniform ranks (chi-squared), of the number of runs about the middle, and of serial correlation.

    The alphabet is cut in as many equal stretches as leave five expected ranks each, two at least, all ranks at most.
    """
    n = len(ranks)
    bins = max(2, min(size, n // 5))
    slot = ranks.astype(np.int64) * bins // size
    width = np.bincount(np.arange(size) * bins // size, minlength=bins)
    expected = n * width / size
    uniform = _upper_tail(float(((np.bincount(slot, minlength=bins) - expected) ** 2 / expected).sum()), bins - 1)
    high = ranks >= size // 2
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        runs = _two_sided((int((high[1:] != high[:-1]).sum()) + 1 - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        runs = 2.0 ** (1 - n)
    x = ranks - (size - 1) / 2  # the null is uniform, so its own mean and variance hold
    serial = _two_sided(float((x[1:] * x[:-1]).sum()) / ((size * size - 1) / 12 * math.sqrt(n - 1)))
    return uniform, runs, serial


def combined(p: tuple[float, ...]) -> float:
    """One p-value of a battery: twice the lesser of the least times their number, and of Fisher's sum of logarithms."""
    least = len(p) * min(p)
    fisher = _upper_tail(-2 * sum(math.log(max(x, 1e-300)) for x in p), 2 * len(p))
    return min(1.0, 2 * min(least, fisher))


def pair_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """How often each ASCII character follows each other one in words of all texts, over their whole length.

    A word is a run of token characters; its edges count as one symbol more. Runs as long as a candidate are left out, for the model to know ordinary
    words only. Tasks count on their own, so what is summed has at most 128 x 128 rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                b = np.frombuffer(f" {' '.join(part['text'].to_pylist())} ".encode(), np.uint8)
                lo = 0
                while lo < len(b) - 1:
                    hi = min(lo + STEP, len(b) - 1)
                    while _TOKEN_BYTE[b[hi]]:  # cut between words; the last byte is a space
                        hi += 1
                    total += _pairs(b[lo : hi + 1])
                    lo = hi
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])

    each = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(count, "pair long, n long")
    out = np.zeros(SYMBOLS * SYMBOLS)
    for r in each.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return out.reshape(SYMBOLS, SYMBOLS)


def _pairs(b: np.ndarray) -> np.ndarray:
    """Pair counts of bytes that begin and end between words."""
    inside = _TOKEN_BYTE[b]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, stop = edge[::2] + 1, edge[1::2] + 1
    symbol = np.where(inside, b, EDGE).astype(np.int64)
    keep = inside[:-1] | inside[1:]
    for s, e in zip(start[stop - start >= LEAST], stop[stop - start >= LEAST], strict=True):
        keep[s - 1 : e] = False
    return np.bincount((symbol[:-1] * SYMBOLS + symbol[1:])[keep], minlength=SYMBOLS * SYMBOLS)


def ordinary(counts: np.ndarray) -> np.ndarray:
    """Log probability of each next symbol in ordinary text: half by the corpus' pairs (rare symbols lean on the frequencies of all), four tenths by
    how lower case, upper case, digits and signs follow each other, a tenth of any kind, which bounds what an unseen pair can say."""
    known = np.array([_TOKEN_BYTE[i] for i in range(SYMBOLS)])
    share = np.where(known, counts, 0.0)
    flat = known / known.sum()
    each = share.sum(axis=0) + flat
    pairs = (share + 10 * each / each.sum()) / (share.sum(axis=1, keepdims=True) + 10)
    kind = np.array([1 if chr(i).islower() else 2 if chr(i).isupper() else 3 if chr(i).isdigit() else 4 if known[i] else 0 for i in range(SYMBOLS)])
    of = np.eye(5)[kind]
    follow = of.T @ share @ of + (of.sum(axis=0) > 0)
    follow[:, 0] = 0
    kinds = (follow / follow.sum(axis=1, keepdims=True) / of.sum(axis=0))[kind][:, kind]
    return np.log(0.5 * pairs + 0.4 * np.where(known, kinds, 0.0) + 0.1 * flat + 1e-300)


def evidence(token: str, size: int, log_next: np.ndarray) -> float:
    """Log of the token's probability as a random one of its encoding over that as ordinary text.

    That the encoding was chosen by looking at the token costs the logarithm of their number, which keeps the mean at 1 or less.
    """
    body = np.frombuffer(token.rstrip("=").encode(), np.uint8).astype(np.int64)
    before = np.concatenate([[EDGE], body[:-1]])
    return -len(body) * math.log(size) - math.log(len(ENCODINGS)) - float(log_next[before, body].sum())


def scan(docs: DataFrame, log_next: np.ndarray, doc_id: str = "doc_id", text: str = "text", alpha: float = 0.001) -> DataFrame:
    """``doc_id, base, tried, found`` of every text: the fixed patterns' spans, the lengths of all candidates, and those candidates that
    the battery doesn't tell from random ones at level ``alpha``, with their evidence. Candidates within a span of a fixed pattern are left out."""
    span = "start: bigint, end: bigint, kind: string"
    ends = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
    hit = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("length", pa.int32()), ("evidence", pa.float64()), ("encoding", pa.string()), ("p", pa.float64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                base, tried, found = [], [], []
                for t in part["text"].to_pylist():
                    fixed = base_spans(t)
                    lengths, hits = [], []
                    for m in _LONG.finditer(t):
                        kind = encoding(m.group())
                        if kind is None or any(s <= m.start() and m.end() <= e for s, e, _ in fixed):
                            continue
                        name, size, ranks = kind
                        lengths.append(len(ranks))
                        p = combined(battery(ranks, size))
                        if p >= alpha:
                            hits.append({"start": m.start(), "end": m.end(), "length": len(ranks), "evidence": evidence(m.group(), size, log_next), "encoding": name, "p": p})
                    base.append([{"start": s, "end": e, "kind": k} for s, e, k in fixed])
                    tried.append(lengths)
                    found.append(hits)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(base, pa.list_(ends)), pa.array(tried, pa.list_(pa.int32())), pa.array(found, pa.list_(hit))], ["doc_id", "base", "tried", "found"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(rows, f"doc_id {kind}, base array<struct<{span}>>, tried array<int>, found array<struct<start: bigint, end: bigint, length: int, evidence: double, encoding: string, p: double>>")


def _band(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double"))).cast("int")


def thresholds(scanned: DataFrame, fdr: float = 0.01) -> dict[int, float]:
    """By band of doubling length, the least evidence (a logarithm) of a discovery; bands without one aren't in it.

    With m candidates, e-BH takes the k best where the k-th has evidence of at least m / (fdr k), for the largest such k. From k = m the
    bound is raised to what the number of candidates above it allows, until that number stays: the largest k is never jumped over.
    Each round counts candidates by band; nothing but those few counts comes to the driver.
    """
    m = {r["band"]: r["n"] for r in scanned.select(F.explode("tried").alias("length")).groupBy(_band(F.col("length")).alias("band")).agg(F.count("*").alias("n")).collect()}
    each = cut(scanned.select(F.explode("found").alias("f")).select(_band(F.col("f.length")).alias("band"), F.col("f.evidence").alias("evidence")), "evidence")
    k = dict(m)
    while True:
        bound = {b: math.log(m[b] / (fdr * k[b])) for b in k if k[b]}
        if not bound:
            return {}
        reach = F.element_at(F.create_map(*[F.lit(x) for b, t in sorted(bound.items()) for x in (b, t)]), F.col("band"))
        now = {r["band"]: r["n"] for r in each.filter(F.col("evidence") >= reach).groupBy("band").agg(F.count("*").alias("n")).collect()}
        now = {b: now.get(b, 0) for b in bound}
        if now == k:
            return bound
        k = now


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fdr: float = 0.01, alpha: float = 0.001) -> DataFrame:
    """``doc_id, base, spans``: the fixed patterns' spans, and those with the discoveries added (kind ``random``), both by start and then kind.

    Texts are read twice, once for the character pairs and once for the spans; nothing of them is shuffled.
    """
    scanned = cut(scan(docs, ordinary(pair_counts(docs, text)), doc_id, text, alpha), "secrets")
    bound = thresholds(scanned, fdr)
    place = lambda s: F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"], s["kind"])
    if bound:
        reach = F.create_map(*[F.lit(x) for b, t in sorted(bound.items()) for x in (b, t)])
        more = F.transform(F.filter("found", lambda f: f["evidence"] >= F.element_at(reach, _band(f["length"]))), lambda f: F.struct(f["start"], f["end"], F.lit("random").alias("kind")))
        every = F.concat("base", more)
    else:
        every = F.col("base")
    return scanned.select("doc_id", "base", F.array_sort(F.transform(every, place)).alias("spans"))


def joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined("base")
    return found.select("doc_id", *(count(k) for k, *_ in BASE), F.sha2(base, 256).alias("base_sha256"), joined("spans").alias("spans"))
