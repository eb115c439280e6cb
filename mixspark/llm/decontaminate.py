"""Benchmark decontamination: a broadcast set of test n-grams is looked up at every window of the texts.

Words are numbered by the benchmark's own vocabulary, so only runs of known words are
hashed; a hash found in the set is verified word by word before it counts as a hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import body, free_names, parts_for, values

WINDOW = 13
#: Bytes of benchmark text that one broadcast set is made of; a larger benchmark takes several passes.
SLICE_BYTES = 4 << 20
#: A document is contaminated when 20 times its hit words reach the number of its words.
SHARE = 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
HITS = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"
MIX = np.uint64(0x9E3779B97F4A7C15)


class Windows:
    """The n-grams of benchmark items as word numbers, by length."""

    def __init__(self, items: list[tuple[str, bytes]], width: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.found: dict[int, dict[bytes, tuple[str, ...]]] = {}
        for item, text in items:
            words = WORD.findall(text.lower())
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int32)
            n = min(width, len(ids))
            only = (item,)  # shared by all windows that no other item has
            for i in range(len(ids) - n + 1 if n else 0):
                of = self.found.setdefault(n, {})
                had = of.setdefault(key := ids[i:i + n].tobytes(), only)
                if item not in had:
                    of[key] = (*had, item)
        self.hashes = {n: np.unique(hashed(np.frombuffer(b"".join(w), np.int32), n)[::n])
                       for n, w in self.found.items()}

    def scan(self, text: bytes) -> tuple[int, np.ndarray, set[str]]:
        """The number of words, a mask of the hit ones, and the items found."""
        words = WORD.findall(text.lower())
        ids = np.fromiter(map(self.vocab.get, words, repeat(0)), np.int32, len(words))
        hit, items = np.zeros(len(ids), bool), set()
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        for n, hashes in self.hashes.items():
            starts = np.flatnonzero(known[n:] - known[:-n] == n) if len(ids) >= n else []
            if not len(starts):
                continue
            h = hashed(ids, n)[starts]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in starts[hashes[at] == h]:
                if (of := self.found[n].get(ids[i:i + n].tobytes())) is not None:
                    hit[i:i + n] = True
                    items.update(of)
        return len(ids), hit, items


def hashed(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of the n numbers from each position on."""
    wide, h = ids.astype(np.uint64), np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * MIX + wide[k:len(ids) - n + 1 + k]
    return h


def runs(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(edge[::2], edge[1::2])]


FOUND = ("_dc_words", "_dc_hits", "_dc_items")


def scanned(index, rows: list[str], text: str, found: list[str]):
    """A task's work: adds what this slice of the benchmark hits to what earlier slices did."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = index.value
        words, was_hit, was_in = found
        for b in batches:
            n, hits, items = [], [], []
            for line, before, had in zip(values(b[text]), values(b[was_hit]), values(b[was_in])):
                count, mask, now = windows.scan(line)
                for r in before:
                    mask[r["first"]:r["last"] + 1] = True
                n.append(count)
                hits.append(runs(mask) if mask.any() else [])
                items.append(sorted(now.union(had)))
            out = [pa.array(n, pa.int64()), pa.array(hits, b[was_hit].type),
                   pa.array(items, b[was_in].type)]
            yield pa.RecordBatch.from_arrays(
                [b[c] for c in rows] + out, [*rows, words, was_hit, was_in])
    return run


def find_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", width: int = WINDOW,
              slice_bytes: int = SLICE_BYTES, names=FOUND) -> DataFrame:
    """``docs`` with three more columns: _dc_words (number of words), _dc_hits (runs of hit words as
    array<struct<first,last>>, counted from 0) and _dc_items (the items whose windows occur), or other
    ``names``.

    A null or empty text has no words. Items without words match nothing, items of fewer words than
    the window match as a whole; a null item id is written "null". Repeated rows are judged
    alike. With an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    rows = docs.columns
    slices = parts_for(benchmark.agg(F.sum(F.octet_length(item_text))).head()[0] or 0, slice_bytes)
    [line] = free_names(docs, "_dc_body")
    words, hits, items = names
    out = (docs.withColumn(line, body(F.col(text_col))).withColumn(words, F.lit(0).cast("long"))
           .withColumn(hits, F.expr("cast(array() as array<struct<first:bigint,last:bigint>>)"))
           .withColumn(items, F.expr("cast(array() as array<string>)")))
    shape = out.schema
    for k in range(slices):
        part = benchmark.where(F.pmod(F.xxhash64(item_text), F.lit(slices)) == k).select(
            F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"),
            body(F.col(item_text)).alias("text"))
        index = spark.sparkContext.broadcast(
            Windows([(r["item"], bytes(r["text"])) for r in part.toLocalIterator()], width))
        keep = [*rows, line]
        from_columns = {f.name: f for f in shape}
        schema = type(shape)([from_columns[c] for c in [*keep, *names]])
        out = out.mapInArrow(scanned(index, keep, line, list(names)), schema)
    return out.drop(line)


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)


def contaminated(share: int = SHARE, words: str = FOUND[0], hits: str = FOUND[1]) -> Column:
    n = hit_words(F.col(hits))
    return (n > 0) & (share * n >= F.col(words))


def without_hits(batches: Iterator[pa.RecordBatch], text_col: str, hit_col: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cut = []
        for text, hits in zip(values(b[text_col]), values(b[hit_col])):
            if hits:
                raw = text.encode()
                at = [m.span() for m in WORD.finditer(raw.lower())]
                keep, last = [], 0
                for r in hits:
                    keep.append(raw[last:at[r["first"]][0]])
                    last = at[r["last"]][1]
                text = b"".join([*keep, raw[last:]]).decode()
            cut.append(text)
        names = b.schema.names
        yield pa.RecordBatch.from_arrays(
            [pa.array(cut, b[c].type) if c == text_col else b[c] for c in names], names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents",
                  text_col: str = "text", **options) -> DataFrame:
    """``docs`` without contaminated documents (remove="documents"), or with all documents but
    without the hit words and what stands between them (remove="spans")."""
    words, hits, items = free_names(docs, *FOUND)
    found = find_hits(docs, benchmark, text_col, names=(words, hits, items), **options)
    if remove == "spans":
        found = found.mapInArrow(lambda it: without_hits(it, text_col, hits), found.schema)
    else:
        found = found.where(~contaminated(words=words, hits=hits))
    return found.select(*docs.columns)
