"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a chunk that is scored by itself, and of a concept key.
CHUNK_CHARS, KEY_CHARS = 1500, 50


def chunks(text: Column, size: int = CHUNK_CHARS) -> Column:
    """Consecutive parts of ``size`` characters; null and empty text give no part."""
    n = F.length(F.coalesce(text, F.lit("")))
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def sentences(text: Column) -> Column:
    """Parts that end in ``.``, ``!`` or ``?`` before white space, trimmed, without empty ones."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \n\t\r]+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^[ \n\t\r]+|[ \n\t\r]+$", "")), lambda s: s != "")


def concept_key(text: Column) -> Column:
    """The first characters as a lower-case key of letters, digits, ``_`` and ``-``; blanks become ``_``."""
    return F.lower(F.regexp_replace(F.translate(F.left(text, F.lit(KEY_CHARS)), " ", "_"), "[^A-Za-z0-9_-]", ""))


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down; null has none."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def cache_key(*parts: Column) -> Column:
    """SHA-256 of the parts between ``|``; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def has_all(words: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), words)) == 0


def has_any(words: Column, wanted: list[str]) -> Column:
    """Overlap of two lists; an empty list of wanted words lets all rows through."""
    return F.coalesce(F.arrays_overlap(words, F.array(*map(F.lit, wanted))), F.lit(False)) if wanted else F.lit(True)
