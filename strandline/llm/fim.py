"""Fill-in-middle: texts cut in three at unit ranks and put together as prefix-suffix-middle or suffix-prefix-middle.

One automaton finds, in a single scan, the ASCII characters at which the class of characters changes and the sentinels. Between two
events lies a run of one class, whose units are plain arithmetic, so the few events and their running unit counts answer "where
does unit r end" by binary search, in characters, words or lines.

Null and empty texts, and texts that hold a sentinel, stay plain; null ids hash as the empty string. Repeated rows give repeated rows.
Rows are independent: nothing is shuffled, and very long texts cost four bytes an event beside the text itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: ASCII characters that are neither letters nor digits end a word.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
UNITS = ("chars", "words", "lines")
#: Events that are taken from the automaton at a time.
STEP = 1 << 20


def automaton(sentinels: tuple[str, ...] = SENTINELS):
    """Finds separators (value 0), line ends (1) and sentinels (2)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for c in SEPARATORS:
        found.add_word(c, int(c == "\n"))
    for s in sentinels:
        found.add_word(s, 2)
    found.make_automaton()
    return found


class Events:
    """The events of one text: where a separator or a line end stands, and whether a sentinel does."""

    def __init__(self, text: str, found) -> None:
        self.size, scan = len(text), found.iter(text)
        at, ends, self.marked = [], [], False
        while len(part := np.fromiter(islice(scan, STEP), dtype=[("at", np.int32), ("kind", np.int8)])):
            self.marked |= bool((part["kind"] == 2).any())
            at.append(part["at"][part["kind"] < 2])
            ends.append(part["at"][part["kind"] == 1])
        none = np.zeros(0, np.int32)
        self.separators, self.ends = np.concatenate([none, *at]), np.concatenate([none, *ends])
        # gaps before each separator and after the last one
        edges = np.concatenate([[-1], self.separators, [self.size]]).astype(np.int64)
        self.gap_at, self.gap = edges[:-1] + 1, np.diff(edges) - 1

    def table(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Event places and units up to and with each: an event is one unit, and the gap before it as many as its length says."""
        if unit == "chars":
            return self.separators, self.separators.astype(np.int64) + 1
        if unit == "lines":
            return self.ends, np.arange(1, len(self.ends) + 1)
        return self.separators, np.cumsum(np.minimum(self.gap[:-1], 1) + 1)

    def units(self, unit: str) -> int:
        at, upto = self.table(unit)
        last = self.size - (int(at[-1]) + 1 if len(at) else 0)
        return (int(upto[-1]) if len(at) else 0) + (last if unit == "chars" else min(last, 1))

    def place(self, rank: int, unit: str) -> int:
        """Characters that the first ``rank`` units take: those up to the last event within them, and what the gap behind it gives."""
        at, upto = self.table(unit)
        i = int(np.searchsorted(upto, rank, "right"))
        start, rest = (int(at[i - 1]) + 1, rank - int(upto[i - 1])) if i else (0, rank)
        gap = (int(at[i]) if i < len(at) else self.size) - start
        return start + (rest if unit == "chars" else gap * min(rest, 1))

    def words_before(self, place: int) -> int:
        """Words that begin before a place."""
        return int((self.gap[: np.searchsorted(self.gap_at, place)] > 0).sum())


def _seeds(doc_id: str, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of the hash of ``seed:doc_id``, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "chars", plain: int = 10, spm: int = 20, seed: int = 1, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, n_words, middle_words, output`` of every text.

    ``n`` counts units. Prefix and middle end after two hashed numbers of units, so any of the three pieces may be empty; ``plain`` percent stay
    as they are, and ``spm`` percent of the others have the suffix first. ``middle_words`` counts words that begin in the middle. Lengths are
    code points, null where the form is plain.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels are needed")
    if any(a != b and (a in b or any(a[-k:] == b[:k] for k in range(1, len(a)))) for a in sentinels for b in sentinels) or any(s[-k:] == s[:k] for s in sentinels for k in range(1, len(s))):
        raise ValueError("sentinels must not overlap each other or themselves, or the output can't be read back")
    first, second, third = sentinels

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(sentinels)
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for t, h1, h2, h3, h4 in zip(part["text"].to_pylist(), *(part[f"h{i}"].to_pylist() for i in range(1, 5)), strict=True):
                    e = Events(t, found)
                    n, words = e.units(unit), e.words_before(e.size)
                    if not t or e.marked or h3 % 100 >= 100 - plain:
                        out.append((n, "plain", None, None, words, None, t))
                        continue
                    a, b = (e.place(r, unit) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
                    prefix, middle, suffix = t[:a], t[a:b], t[b:]
                    form = "spm" if h4 % 100 < spm else "psm"
                    said = f"{second}{suffix}{first}{prefix}{third}{middle}" if form == "spm" else f"{first}{prefix}{second}{suffix}{third}{middle}"
                    out.append((n, form, a, b - a, words, e.words_before(b) - e.words_before(a), said))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part["doc_id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "n_words", "middle_words", "output"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), *_seeds(doc_id, seed))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(rows, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, n_words long, middle_words long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made from: pieces between the sentinels, which no piece holds, in their first order."""
    first, second, third = sentinels
    at = lambda s: F.instr(output, s)
    rest = 1 << 30
    between = lambda s, until: F.substring(output, at(s) + len(s), at(until) - at(s) - len(s))
    middle = F.substring(output, at(third) + len(third), F.lit(rest))
    psm = F.concat(between(first, second), middle, between(second, third))
    spm = F.concat(between(first, third), middle, between(second, first))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(made: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Texts as hashes: of the output, and of the text rebuilt from output and form."""
    back = restored(F.col("output"), F.col("form"), sentinels)
    return made.select(*(c for c in made.columns if c != "output"), F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
