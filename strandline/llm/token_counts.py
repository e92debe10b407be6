"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A text is cut into pre-tokens by the tokenizer's own pattern; no token crosses their ends, so a
document's count is the sum over them. Leaves hold ``LEAF`` pre-tokens each, and a tree of sums stands over the leaves. An edit
re-cuts the text from two pre-tokens before it (the pattern looks one character ahead, never back) until a cut falls on
an old one past the edit, from where on all are as before; only leaves in between change, and the
sums above them.

Counts of pre-tokens are remembered, ``CACHE`` of them at most. Null and empty texts have no tokens. Edits of one document are
applied in order, each to the text that the one before it left; an edit past the end is clipped to it. A null edit, or a null list, changes nothing; a
null start is 0, a null end the start (nothing is removed), a null text empty. Very long texts, and long runs of one
kind of character, are counted whole. Rows are kept one by one, repeated ones and null ids included; an empty table gives an empty one; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY, LEAF, CACHE = "/opt/tokenizers/byte_bpe_50k.tiktoken", 64, 200_000
#: The pattern by which this vocabulary's texts are cut (fixed value of the tokenizer).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_of(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file, which only the driver reads; tasks get them by broadcast (its size doesn't depend on the data)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Counter:
    """Tokens of a pre-token, and the pre-tokens of a text."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.cut = regex.compile(PATTERN)
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.merge = own.encode_ordinary, own._encode_single_piece
        self.seen: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            n = len(self.merge(piece))  # the piece as it is: its pattern isn't matched again
            if len(piece) <= 64:
                self.seen[piece] = n
        return n


class TokenTree:
    """A document's pre-token lengths and token counts in leaves, with sums of both over them."""

    def __init__(self, text: str, counter: Counter):
        self.text, self.counter, self.recut = text, counter, 0
        pieces = counter.cut.findall(text)
        seen, count = counter.seen, counter.count
        pairs = [(len(p), seen.get(p) or count(p)) for p in pieces]
        self._build([pairs[i : i + LEAF] for i in range(0, len(pairs), LEAF)] or [[]])

    def _build(self, leaves: list[list[tuple[int, int]]]) -> None:
        self.leaves, self.size = leaves, 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(x for x, _ in leaf), sum(x for _, x in leaf)
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and its first character."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if char >= begin + self.chars[i] and self.chars[i + 1]:
                begin += self.chars[i]
                i += 1
        return i - self.size, begin

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end) and return the new total."""
        start = max(0, min(start, len(self.text)))
        end = max(start, min(end, len(self.text)))
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first, begin = self._leaf_at(max(0, start - 1))
        # two pre-tokens of context before the edit
        head = self.leaves[first]
        ends = list(accumulate((n for n, _ in head), initial=begin))
        keep = max(0, sum(e <= start for e in ends) - 3)
        while keep == 0 and first and start - begin < 2 or not head and first:
            first -= 1
            head = self.leaves[first]
            begin -= self.chars[self.size + first]
            ends = list(accumulate((n for n, _ in head), initial=begin))
            keep = max(0, len(head) - 2)
        if keep == 0 and first:
            first -= 1
            head = self.leaves[first]
            begin -= self.chars[self.size + first]
            ends = list(accumulate((n for n, _ in head), initial=begin))
            keep = max(0, len(head) - 2)
        at, pairs = ends[keep], list(head[:keep])
        # old cuts past the edit, leaf by leaf
        leaf, cut = first, ends[-1]
        rest = list(zip(ends[keep + 1 :], head[keep:], strict=True))

        def more() -> bool:
            nonlocal leaf, cut
            if leaf + 1 >= len(self.leaves):
                return False
            leaf += 1
            for n, t in self.leaves[leaf]:
                cut += n
                rest.append((cut, (n, t)))
            return True

        i = 0
        scan = self.counter.cut
        done = False
        while at < len(self.text):
            m = scan.match(self.text, at)
            pairs.append((m.end() - at, self.counter.count(m.group())))
            self.recut += m.end() - at
            at = m.end()
            while i < len(rest) and rest[i][0] + shift < at or i >= len(rest) and more():
                if i < len(rest) and rest[i][0] + shift < at:
                    i += 1
            if i < len(rest) and rest[i][0] >= end and rest[i][0] + shift == at:
                pairs += [p for _, p in rest[i + 1 :]]
                done = True
                break
        if not done:
            while more():
                pass
        parts = leaf - first + 1
        if len(pairs) > 4 * LEAF * parts:
            self._build([*self.leaves[:first], *[pairs[j : j + LEAF] for j in range(0, len(pairs), LEAF)], *self.leaves[leaf + 1 :]])
            return self.total
        step = -(-len(pairs) // parts) or 1
        for j in range(parts):
            self.leaves[first + j] = pairs[j * step : (j + 1) * step]
            k = self.size + first + j
            self.chars[k], self.tokens[k] = sum(x for x, _ in self.leaves[first + j]), sum(x for _, x in self.leaves[first + j])
        touched = {(self.size + first + j) // 2 for j in range(parts)}
        while touched and 0 not in touched:
            for k in touched:
                self._sum(k)
            touched = {k // 2 for k in touched}
        return self.total


def count_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, n_tokens_after, n_chars_after, n_recut`` of every row.

    ``edits`` names a column of array<struct<start:int,end:int,text:string>>; ``n_recut`` counts the characters cut again.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    changes = F.col(edits) if edits else F.array().cast("array<struct<start:int,end:int,text:string>>")

    sent = docs.sparkSession.sparkContext.broadcast(vocabulary_of(vocabulary))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(sent.value)
        for batch in batches:
            out = []
            for t, todo in zip(batch.column("text"), batch.column("edits"), strict=True):
                tree = TokenTree(t.as_py() or "", counter)
                pieces, before = sum(map(len, tree.leaves)), tree.total
                for e in todo.as_py() or ():
                    if e is not None:
                        start = e["start"] or 0
                        tree.edit(start, start if e["end"] is None else e["end"], e["text"] or "")
                out.append((pieces, before, tree.total, len(tree.text), tree.recut))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [()] * 5))], ["doc_id", "n_pretokens", "n_tokens", "n_tokens_after", "n_chars_after", "n_recut"])

    schema = f"doc_id {kind}, n_pretokens long, n_tokens long, n_tokens_after long, n_chars_after long, n_recut long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), changes.alias("edits")).mapInArrow(rows, schema)
