"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

Byte-pair encoding never merges across pre-tokens, so a text's count is the sum over its pre-tokens.
Leaves hold some consecutive pre-tokens with their texts; inner nodes hold the sums of characters and
tokens. An edit finds its leaves by descending, splits and encodes anew only those and as much
around them as the pattern can look at, and updates the sums on the way up.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import REMEMBERED, values

#: The vocabulary as lines of base64 token and rank; every executor reads it from this path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that splits text before the merges of that vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens in a leaf when a tree is built.
LEAF = 32
EDITS = "array<struct<at:long,delete:long,insert:string>>"


class PieceCounts(dict):
    """The number of tokens of each pre-token, remembered up to a bound."""

    def __init__(self, path: str):
        super().__init__()
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < REMEMBERED:
            self[piece] = n
        return n


@lru_cache(1)
def piece_counts(path: str) -> PieceCounts:
    """One per Python worker."""
    return PieceCounts(path)


class SegmentTree:
    """Leaves of pre-tokens under sums of characters and tokens."""

    def __init__(self, text: str, counts: PieceCounts):
        self.counts = counts
        self.encoded = 0
        self._build(counts.split(text))

    def _build(self, pieces: list[str]):
        self.leaves = [pieces[i:i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.base = 1
        while self.base < len(self.leaves):
            self.base *= 2
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, leaf in enumerate(self.leaves):
            self._sum(i, leaf)
        for i in range(self.base - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _sum(self, i: int, leaf: list[str]):
        self.chars[self.base + i] = sum(map(len, leaf))
        self.tokens[self.base + i] = sum(map(self.counts.__getitem__, leaf))

    @property
    def count(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with the at-th character (the last leaf beyond the end), and the offset there."""
        node = 1
        while node < self.base:
            node *= 2
            if at >= self.chars[node] and self.chars[node + 1]:
                at -= self.chars[node]
                node += 1
        return min(node - self.base, len(self.leaves) - 1), at

    def edit(self, at: int, delete: int, insert: str) -> int:
        """Deletes characters from a place on and inserts others there; places beyond the end mean the
        end. Returns the number of pre-tokens that were encoded anew."""
        at = min(max(at, 0), self.length)
        delete = min(max(delete, 0), self.length - at)
        first, offset = self._find(at)
        # A pre-token looks one character beyond itself: two whole pre-tokens and three
        # characters before the edit make everything before them safe.
        passed = before = 0
        for p in self.leaves[first]:
            if passed + len(p) >= offset:
                break
            passed += len(p)
            before += 1
        while first and (before < 3 or offset < 3):
            first -= 1
            before += len(self.leaves[first])
            offset += self.chars[self.base + first]
        last, _ = self._find(at + delete)
        last = max(last, first)
        region = "".join(p for leaf in self.leaves[first:last + 1] for p in leaf)
        region = region[:offset] + insert + region[offset + delete:]
        while True:
            after, beyond = last + 1, ""
            while after < len(self.leaves) and len(beyond) < 2:
                beyond += "".join(self.leaves[after])
                after += 1
            pieces, n = [], 0
            for p in self.counts.split(region + beyond):
                if n >= len(region):
                    break
                pieces.append(p)
                n += len(p)
            if n == len(region):  # a boundary where the next leaf starts: all after it stays
                break
            region += beyond
            last = after - 1
        self.encoded += len(pieces)
        slots = last - first + 1
        if len(pieces) > 8 * LEAF * slots:  # too much for these leaves: cut the leaves anew, same pre-tokens
            self._build([p for leaf in (*self.leaves[:first], pieces, *self.leaves[last + 1:]) for p in leaf])
            return len(pieces)
        each = -(-len(pieces) // slots) if pieces else 0
        for k in range(slots):
            self.leaves[first + k] = pieces[k * each:(k + 1) * each]
            self._sum(first + k, self.leaves[first + k])
        lo, hi = (self.base + first) // 2, (self.base + last) // 2
        while lo:
            for i in range(lo, hi + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            lo, hi = lo // 2, hi // 2
        return len(pieces)


def count_tokens(docs: DataFrame, edits: Column, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: doc_id, n_pieces and n_tokens of the text, then after its edits n_edits, n_chars_after,
    n_tokens_after, and n_reencoded, the pre-tokens that all edits together encoded anew.

    ``edits`` is an array of struct<at, delete, insert> in code points, applied in order, each to
    the outcome of the one before. A null text is empty; null edits are none, a null edit is passed
    over, and a null field is 0 or empty. Repeated rows are counted alike. Other columns
    are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = piece_counts(vocabulary)
        for b in batches:
            rows = []
            for i, text, changes in zip(values(b["id"]), values(b["body"]), values(b["edits"])):
                tree = SegmentTree(text, counts)
                pieces, tokens = sum(map(len, tree.leaves)), tree.count
                changes = [c for c in changes or [] if c is not None]
                for c in changes:
                    tree.edit(c["at"] or 0, c["delete"] or 0, c["insert"] or "")
                rows.append((i, pieces, tokens, len(changes), tree.length, tree.count, tree.encoded))
            names = ["doc_id", "n_pieces", "n_tokens", "n_edits", "n_chars_after", "n_tokens_after", "n_reencoded"]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"),
                       edits.cast(EDITS).alias("edits")).mapInArrow(
        run, "doc_id long, n_pieces long, n_tokens long, n_edits long, n_chars_after long, "
             "n_tokens_after long, n_reencoded long")


def drawn_edits(n: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """n edits for each row, drawn by hashes of its id: delete up to 11 characters somewhere and insert
    up to 23 from another place of the text."""
    size = F.coalesce(F.length(text_col), F.lit(0))

    def draw(k, below):
        return F.pmod(F.xxhash64(F.col(id_col), F.lit(k)), below)
    return F.array(*[F.struct(
        draw(4 * j, size + 1).alias("at"), draw(4 * j + 1, F.lit(12)).alias("delete"),
        F.coalesce(F.substring(F.col(text_col), (draw(4 * j + 2, size + 1) + 1).cast("int"),
                               draw(4 * j + 3, F.lit(24)).cast("int")), F.lit("")).alias("insert"))
        for j in range(n)])
