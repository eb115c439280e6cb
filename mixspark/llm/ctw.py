"""Language-model scores by context-tree weighting over bytes.

A text is its bytes with A-Z in lower case and an end byte. Each byte is eight binary decisions; a
decision's context is the part of the byte already seen and the ``depth`` bytes before it. Every
context of every depth holds a Krichevsky-Trofimov estimate of its decisions, and the weighting
mixes all depths. An estimate depends on counts alone, so the tree of the whole training corpus is
counted in one pass, and its weights follow from the counts.

Documents travel in packed blocks. A block asks for the counts of the words and byte strings it
has: each answer sheet is a hash range of the words, or one group of contexts of the tree, where
all blocks' requests meet already summed. The answers go back to the blocks, which add up their
documents' scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import (WordHashes, body, fold, packed, packed_sorted, parts_for, total_bytes, unpacked,
                                 unpacked_sorted, values)
from mixspark.sources.scratch import stored

DEPTH = 5
#: Bytes of text in a block of documents, and about how many one answer sheet stands for.
BLOCK_BYTES, SHEET_BYTES = 4 << 20, 12 << 20
END = 255  # never occurs in UTF-8
END_TOKEN = b""  # never a word
HALF = log(0.5)
LN10 = log(10.0)


# ---- estimates ---------------------------------------------------------------------------------

def ln_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, shifted until it is exact to about 1e-12; for x > 0."""
    shift = np.zeros_like(x)
    y = x.copy()
    while (low := y < 10).any():
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (
        1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


_SMALL = np.arange(1 << 16)
_GAMMA_HALF, _GAMMA_ONE = ln_gamma(_SMALL + 0.5), ln_gamma(_SMALL + 1.0)


def _tabled(n: np.ndarray, table: np.ndarray, offset: float) -> np.ndarray:
    out = table[np.minimum(n, len(table) - 1)]
    big = n >= len(table)
    if big.any():
        out[big] = ln_gamma(n[big] + offset)
    return out


def ln_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return (_tabled(zeros, _GAMMA_HALF, 0.5) + _tabled(ones, _GAMMA_HALF, 0.5)
            - _tabled(zeros + ones, _GAMMA_ONE, 1.0) - log(np.pi))


# ---- byte strings of a text --------------------------------------------------------------------

def ranks(code: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and where each code is among them."""
    if bound <= 8 * len(code) + (1 << 16):  # a table of marks is faster than sorting
        mark = np.zeros(bound, bool)
        mark[code] = True
        distinct = np.flatnonzero(mark)
        place = np.zeros(bound, np.int32)
        place[distinct] = np.arange(len(distinct), dtype=np.int32)
        return distinct, place[code]
    distinct, place = np.unique(code, return_inverse=True)
    return distinct, place.astype(np.int32)


def grams(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct byte strings (the byte before, the one before that, ..., then the byte itself
    last) as ascending codes, and the string at each byte of ``text``; ``text`` has ``depth`` end
    bytes in front."""
    n = len(text) - depth
    code = np.zeros(n, np.uint64)
    for k in [*range(depth - 1, -1, -1), depth]:
        code <<= np.uint64(8)
        code |= text[k:k + n]
    return ranked_codes(code)


# ---- the tree ----------------------------------------------------------------------------------

def group_starts(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def decisions(gram: np.ndarray, count: np.ndarray, depth: int, d: int, k: int):
    """For the contexts of d bytes and the k-th bit: where the decision nodes start in the ascending
    strings, and how often each decided 0 and 1."""
    cut = np.uint64(8 * (depth - d))
    ctx = (gram >> np.uint64(8)) >> cut  # the d bytes before
    byte = gram & np.uint64(255)
    node = (ctx << np.uint64(8)) | (byte >> np.uint64(8 - k))
    if d < depth:  # strings of one shorter context are not in the order of their last byte
        order = np.argsort(node, kind="stable")
    else:
        order = np.arange(len(gram))
    at = group_starts(node[order])
    one = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(np.int64) * count
    total = np.add.reduceat(count[order], at)
    ones = np.add.reduceat(one[order], at)
    member = np.zeros(len(gram), np.int64)  # the node of each string
    member[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(gram))))
    return member, total - ones, ones


class Tree:
    """The weighted contexts of depth ``top`` to ``depth`` over some strings, which share no node of
    depth ``top`` with other sheets. Strings without a count stand for contexts never seen."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, depth: int, top: int):
        self.gram, self.depth, self.top = gram, depth, top
        self.levels = {}  # (d, k): node of each string, log weight of stopping here, probability of a 1
        self.roots = []  # per bit: node of each string at depth top, its log probability
        for k in range(8):
            below = None
            for d in range(depth, top - 1, -1):
                member, zeros, ones = decisions(gram, count, depth, d, k)
                here = ln_kt(zeros, ones)
                if below is None:
                    total, stop = here, np.zeros(len(here))
                else:
                    child, child_total = below
                    first = np.zeros(len(child_total), np.int64)
                    first[child] = member  # the parent of each child
                    deeper = np.bincount(first, weights=child_total, minlength=len(here))
                    total = HALF + np.logaddexp(here, deeper)
                    stop = HALF + here - total
                self.levels[d, k] = member, stop, (ones + 0.5) / (zeros + ones + 1)
                below = member, total
            self.roots.append((*below, zeros, ones))

    def upper(self) -> tuple[np.ndarray, ...]:
        """What the contexts above need of each node of depth ``top``: its byte context less the
        oldest byte, its decision, log probability and counts, summed by parent."""
        ctx = ((self.gram >> np.uint64(8)) >> np.uint64(8 * (self.depth - self.top))) >> np.uint64(8)
        rows = []
        for k, (member, total, zeros, ones) in enumerate(self.roots):
            first = np.zeros(len(total), np.int64)
            first[member] = np.arange(len(member))
            step = (np.uint64(1) << np.uint64(k)) | ((self.gram & np.uint64(255)) >> np.uint64(8 - k))
            key = ((ctx << np.uint64(8)) | step)[first]
            parent, at = np.unique(key, return_inverse=True)
            rows.append((parent, *(np.bincount(at, weights=v) for v in (total, zeros, ones))))
        return tuple(np.concatenate(x) for x in zip(*rows))

    def log10(self, above: dict[int, tuple]) -> np.ndarray:
        """log10 of the probability of each string's last byte after the ones before it.
        ``above``: by depth, ascending node keys, log weights of stopping and probabilities of a 1."""
        out = np.zeros(len(self.gram))
        byte = self.gram & np.uint64(255)
        for k in range(8):
            p = None
            for d in range(self.depth, -1, -1):
                if d >= self.top:
                    member, stop, one = self.levels[d, k]
                else:
                    ctx = (self.gram >> np.uint64(8)) >> np.uint64(8 * (self.depth - d))
                    step = (np.uint64(1) << np.uint64(k)) | (byte >> np.uint64(8 - k))
                    keys, stop, one = above[d]
                    member = np.searchsorted(keys, (ctx << np.uint64(8)) | step)
                w = np.exp(stop)[member]
                p = one[member] if p is None else w * one[member] + (1 - w) * p
            bit = ((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            out += np.log(np.where(bit, p, 1 - p))
        return out / LN10


def upper_levels(key: np.ndarray, total: np.ndarray, zeros: np.ndarray, ones: np.ndarray, top: int) -> dict:
    """The levels above depth ``top`` from the sums of ``Tree.upper``: at most 256 ** top contexts."""
    levels = {}
    for d in range(top - 1, -1, -1):
        keys, at = np.unique(key, return_inverse=True)
        deeper, zeros, ones = (np.bincount(at, weights=v) for v in (total, zeros, ones))
        here = ln_kt(zeros.astype(np.int64), ones.astype(np.int64))
        total = HALF + np.logaddexp(here, deeper)
        levels[d] = keys, HALF + here - total, (ones + 0.5) / (zeros + ones + 1)
        key = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))
    return levels


#: Depth at which the tree is cut into answer sheets; the part above has at most 256 contexts.
TOP = 2


def sheet_of(gram: np.ndarray, depth: int, sheets: int) -> np.ndarray:
    """Strings with the same two bytes before the last one share a sheet."""
    pair = (gram >> np.uint64(8)) >> np.uint64(8 * (depth - TOP))
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(sheets)


# ---- blocks of documents -----------------------------------------------------------------------

def pack_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of a batch in compressed fragments, one for each block."""
    for b in batches:
        block = b["block"].to_numpy()
        order = np.argsort(block, kind="stable")
        at = np.append(group_starts(block[order]), len(order))
        for i, j in zip(at[:-1], at[1:]):
            part = b.take(pa.array(order[i:j]))
            texts = [v.lower() for v in values(part["body"])]
            yield pa.RecordBatch.from_arrays(
                [part["block"].slice(0, 1), pa.array([part["id"].to_pylist()], pa.list_(pa.int64())),
                 pa.array([part["train"].to_pylist()], pa.list_(pa.bool_())),
                 pa.array([packed(np.array([len(t) for t in texts], np.int64))], pa.binary()),
                 pa.array([packed(np.frombuffer(b"".join(texts), np.uint8))], pa.binary())],
                ["block", "ids", "train", "sizes", "texts"])


def fragments(table: pa.Table, each: int = BLOCK_BYTES) -> Iterator[tuple[list, np.ndarray, list[bytes]]]:
    """The ids, training marks and texts of a block's fragments, in portions of about ``each`` bytes."""
    ids, train, texts, held = [], [], [], 0
    for row in range(len(table)):
        raw, at = unpacked(table["texts"][row].as_py(), np.uint8).tobytes(), 0
        for n in unpacked(table["sizes"][row].as_py(), np.int64).tolist():
            texts.append(raw[at:at + n])
            at += n
        ids += table["ids"][row].as_py()
        train += table["train"][row].as_py()
        held += len(raw)
        if held >= each:
            yield ids, np.array(train, bool), texts
            ids, train, texts, held = [], [], [], 0
    if ids:
        yield ids, np.array(train, bool), texts


END_HASH = xxhash.xxh3_64_intdigest(END_TOKEN)


def block_words(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of a block's tokens in the order of its texts, how many each text has, its training marks."""
    hashes, words, sizes, marks = WordHashes(), [], [], []
    end = np.array([END_HASH], np.uint64)
    for _, learn, texts in fragments(table):
        for t in texts:
            mine = hashes.of(t)
            words += [mine, end]
            sizes.append(len(mine) + 1)
        marks.append(learn)
    return np.concatenate(words), np.array(sizes, np.int64), np.concatenate(marks)


def ranked_codes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, ascending, and where each code is among them."""
    seen, name = pd.factorize(code)  # a hash table, in the order of first occurrence
    order = np.argsort(name)
    rank = np.empty(len(name), np.int32)
    rank[order] = np.arange(len(name), dtype=np.int32)
    return name[order], rank[seen]


def block_tokens(table: pa.Table):
    """The hashes of a block's distinct tokens, ascending, their counts in its training texts, and of each
    token its place among them, with the texts' sizes."""
    words, sizes, learn = block_words(table)
    h, place = ranked_codes(words)
    n = np.bincount(place[np.repeat(learn, sizes)], minlength=len(h))
    return h, n, place, sizes


def block_grams(table: pa.Table, depth: int):
    """The block's distinct byte strings, and per fragment its ids, training marks, the texts' sizes and each
    byte's string."""
    names, parts = [], []
    for ids, learn, texts in fragments(table):
        head = bytes([END]) * depth
        line = np.frombuffer(b"".join(head + t + bytes([END]) for t in texts) or head, np.uint8)
        size = np.array([len(t) + 1 for t in texts], np.int64)
        name, place = grams(line, depth)
        # Bytes of the heads between two texts are not coded.
        starts = np.cumsum(size + depth) - (size + depth)
        coded = np.ones(len(place), bool)
        for s in starts[1:]:
            coded[s - depth:s] = False
        used, place = ranks(place[coded], len(name))  # what stands in heads depends on the texts' order
        name = name[used]
        names.append(name)
        parts.append((ids, learn, size, place))
    if len(names) == 1:
        return names[0], parts
    gram = np.unique(np.concatenate(names))
    return gram, [(i, w, n, np.searchsorted(gram, name)[p]) for name, (i, w, n, p) in zip(names, parts)]


def cut(at: np.ndarray, count: int) -> np.ndarray:
    return np.searchsorted(at, np.arange(count + 1))


def requests(depth: int, sheets: int):
    """What a block asks: rows (kind, sheet, block, keys, counts in the block's training texts)."""
    def run(table: pa.Table) -> pa.Table:
        block, rows = table["block"][0].as_py(), []
        h, n, _, _ = block_tokens(table)
        # Ranges of hashes: the sheets follow each other in the ascending order.
        edge = cut((h >> np.uint64(32)) * np.uint64(sheets) >> np.uint64(32), sheets)
        rows += [("word", s, block, packed_sorted(h[i:j]), packed(n[i:j].astype(np.int32)))
                 for s, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if j > i]
        gram, parts = block_grams(table, depth)
        count = np.zeros(len(gram), np.int64)
        for _, learn, size, place in parts:
            count += np.bincount(place[np.repeat(learn, size)], minlength=len(gram))
        sheet = sheet_of(gram, depth, sheets)
        order = np.argsort(sheet, kind="stable")
        edge = cut(sheet[order], sheets)
        rows += [("byte", s, block, packed_sorted(gram[order[i:j]]), packed(count[order[i:j]].astype(np.int32)))
                 for s, (i, j) in enumerate(zip(edge[:-1], edge[1:])) if j > i]
        kind, s, b, keys, n = zip(*rows)
        return pa.table({"kind": list(kind), "sheet": pa.array(s, pa.int64()), "block": pa.array(b, pa.int64()),
                         "keys": pa.array(keys, pa.binary()), "n": pa.array(n, pa.binary())})
    return run


REQUEST = "kind string, sheet long, block long, keys binary, n binary"


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A sheet's distinct keys with the counts of all blocks, and where each request's keys are."""
    asked = [unpacked_sorted(v.as_py(), np.uint64) for v in table["keys"]]
    key, at = np.unique(np.concatenate(asked), return_inverse=True)
    n = np.concatenate([unpacked(v.as_py(), np.int32) for v in table["n"]])
    count = np.bincount(at, weights=n, minlength=len(key)).astype(np.int64)
    return key, count, np.split(at, np.cumsum([len(a) for a in asked])[:-1])


def upper_sums(depth: int):
    def run(table: pa.Table) -> pa.Table:
        key, count, _ = summed(table)
        parent, total, zeros, ones = Tree(key, count, depth, TOP).upper()
        return pa.table({"parent": pa.array(parent.astype(np.int64)), "total": total,
                         "zeros": zeros.astype(np.int64), "ones": ones.astype(np.int64)})
    return run


def vocabulary(table: pa.Table) -> pa.Table:
    _, count, _ = summed(table)
    return pa.table({"types": [int((count > 0).sum())], "tokens": [int(count.sum())]})


def answers(depth: int, upper):
    """Back to each block, in the order of its keys: the words' counts, or the strings' log10."""
    def run(table: pa.Table) -> pa.Table:
        key, count, at = summed(table)
        kind = table["kind"][0].as_py()
        value = count if kind == "word" else Tree(key, count, depth, TOP).log10(upper.value).astype(np.float32)
        return pa.table({"block": table["block"], "kind": table["kind"], "sheet": table["sheet"],
                         "value": pa.array([packed(value[a]) for a in at], pa.binary())})
    return run


def scores(depth: int, sheets: int):
    def run(table: pa.Table, answer: pa.Table) -> pa.Table:
        got = {}
        for kind, dtype in (("word", np.int64), ("byte", np.float32)):
            mine = [(s, v) for k, s, v in zip(*(answer[c].to_pylist() for c in ("kind", "sheet", "value")))
                    if k == kind]
            got[kind] = np.concatenate([unpacked(v, dtype) for _, v in sorted(mine)])
        _, _, token, tokens = block_tokens(table)
        c = got["word"][token]
        first = np.cumsum(tokens) - tokens
        known = np.add.reduceat((c > 0).astype(np.int64), first).tolist()
        logs = np.add.reduceat(np.log10(c + 0.5), first).tolist()
        gram, parts = block_grams(table, depth)
        value = np.empty(len(gram))
        value[np.argsort(sheet_of(gram, depth, sheets), kind="stable")] = got["byte"]
        out, at = [], 0
        for ids, learn, size, place in parts:
            ends = np.cumsum(size)
            byte = np.add.reduceat(value[place], ends - size)
            mine = slice(at, at + len(ids))
            out += zip(ids, (~learn).tolist(), tokens[mine].tolist(), known[mine], logs[mine], byte.tolist(), size.tolist())
            at += len(ids)
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(SCORED.items(), zip(*out))})
    return run


SCORED = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(),
          "known_log10": pa.float64(), "score": pa.float64(), "n_bytes": pa.int64()}


def ctw_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH,
               held_out_fold: int = 1, folds: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram log10),
    score (log10 probability of the text with its end), bits_per_byte (code length, end included).

    A null text is the empty text: its one token and its one byte are the end. Learns from documents
    whose crc32 of the id modulo ``folds`` is not ``held_out_fold``; a null id counts as the empty
    text there and stays null. Repeated rows count as often as they occur. Without any training
    text every decision has probability one half. Words are told apart by 64-bit hashes.
    """
    total = total_bytes(docs, text_col)
    blocks, sheets = parts_for(total, block_bytes), parts_for(total, SHEET_BYTES)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), (fold(F.col(id_col), folds) != held_out_fold).alias("train"),
        body(F.col(text_col)).alias("body"))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks)))
    packs = texts.mapInArrow(
        pack_documents, "block long, ids array<long>, train array<boolean>, sizes binary, texts binary")
    asked = stored(packs.groupBy("block").applyInArrow(requests(depth, sheets), REQUEST), "requests")

    words, strings = asked.where("kind = 'word'"), asked.where("kind = 'byte'")
    size = words.groupBy("sheet").applyInArrow(vocabulary, "types long, tokens long").agg(
        F.sum("types").alias("v"), F.sum("tokens").alias("n")).head()
    n, v = size["n"] or 0, size["v"] or 0
    # At most 256 * 255 rows, whatever the corpus.
    top = (strings.groupBy("sheet").applyInArrow(
        upper_sums(depth), "parent long, total double, zeros long, ones long")
        .groupBy("parent").agg(F.sum("total").alias("total"), F.sum("zeros").alias("zeros"),
                               F.sum("ones").alias("ones")).orderBy("parent").toPandas())
    upper = docs.sparkSession.sparkContext.broadcast(upper_levels(
        top["parent"].to_numpy(np.uint64), *(top[c].to_numpy() for c in ("total", "zeros", "ones")), TOP))

    replies = asked.groupBy("kind", "sheet").applyInArrow(
        answers(depth, upper), "block long, kind string, sheet long, value binary")
    got = packs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        scores(depth, sheets), "doc_id long, held_out boolean, n_tokens long, n_known long, "
        "known_log10 double, score double, n_bytes long")
    whole = F.log10(F.lit(n + 0.5 * (v + 1)))
    return got.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("known_log10") - F.col("n_tokens") * whole).alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte"))
