"""Word-shingle Jaccard join as a blocked sparse product of the document by shingle incidence.

The incidence matrix is cut into blocks of columns (hash ranges of shingles). In each row only the
rare columns that any partner above the threshold must share are multiplied (the size-derived
bound); a pair survives if the positions of the shared column still allow the needed overlap.
Surviving pairs are multiplied in full, in blocks of rows, and their overlap counts decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.llm.common import (WordHashes, body, free_names, mixed, packed, packed_sorted,
                                 parts_for, total_bytes, unpacked, unpacked_sorted, values)
from mixspark.llm.components import components
from mixspark.sources.scratch import stored

WIDTH = 5
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Shingles a task gathers before it writes them out, and about how many a block of columns gets.
GATHERED = 1 << 20
COLUMN_BYTES = 12 << 20
#: The order of columns knows which are in at least this many sets, for at most so many columns (the
#: most frequent ones). It decides only which rare columns are tried first, never which pairs are found.
COMMON, COMMON_MAX = 6, 1 << 20
MARKS = 1 << 23
#: Documents a task gathers before it writes their records out, and groups it deals them to by a hash of
#: the id. No two tasks share a group, so the groups grow in number with the input and not in size.
NODES, NODE_GROUPS = 1 << 14, 16
#: Up to this size a group of entries is searched for useless ones where it is gathered.
GROUP = 64
#: Star rounds before the pairs that remain are tried one by one; their number only saves work.
STARS = 1
NO_ID = -(2 ** 63)  # stands for a null id inside
K = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)


def shingles(ids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The distinct shingle hashes of a word sequence, ascending; a shorter sequence is one shingle."""
    n = len(ids)
    if n < width:
        h = np.array([n] * (n > 0), np.uint64)
        for k in range(n):
            h = mixed(h * K + ids[k:k + 1])
        return h
    h = ids[:n - width + 1]  # word hashes are uniform, so a polynomial of them is
    for k in range(1, width):
        h = h * K + ids[k:n - width + 1 + k]
    return np.unique(mixed(h))


def prefix(n: int, percent: int = PERCENT) -> int:
    """Of n columns in a common order, so many are enough to meet any partner that links."""
    return n - -(-percent * n // 100) + 1


def key_of(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sets_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    hashes = WordHashes()
    for b in batches:
        for i, text in zip(values(b["id"]), values(b["body"])):
            s = shingles(hashes.of(text), width)
            yield i, s, hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def columns_of(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of columns a shingle is in and its 32-bit number there."""
    return ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), h & LOW


def _by_block(block: np.ndarray, blocks: int) -> np.ndarray:
    return np.searchsorted(block, np.arange(blocks + 1))


def count_columns(blocks: int, width: int):
    """Per block of columns: which columns this task's sets have, and in how many sets."""
    def run(batches):
        held, seen, size = [], set(), 0

        def out():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            block, low = columns_of(h, blocks)
            at = _by_block(block, blocks)
            rows = [(k, low[i:j], c[i:j]) for k, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
            for k, x, n in rows:
                order = np.argsort(x, kind="stable")
                yield (k, packed_sorted(x[order].astype(np.uint32)), packed(n[order].astype(np.uint32)))

        def batch():
            k, x, n = zip(*out())
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(x, pa.binary()),
                                               pa.array(n, pa.binary())], ["block", "cols", "n"])

        for _, s, d in sets_of(batches, width):
            if d and d not in seen:
                seen.add(d)
                held.append(s)
                size += len(s)
                if size >= GATHERED:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()
    return run


def common_columns(table: pa.Table) -> pa.Table:
    """Of one block: the columns in at least COMMON sets, and in how many."""
    x = np.concatenate([unpacked_sorted(v.as_py(), np.uint32) for v in table["cols"]])
    n = np.concatenate([unpacked(v.as_py(), np.uint32) for v in table["n"]])
    col, at = np.unique(x, return_inverse=True)
    n = np.bincount(at, weights=n).astype(np.int64)
    big = n >= COMMON
    key = (table["block"][0].as_py() << 32) + col[big].astype(np.int64)
    return pa.table({"col": key, "n": n[big]})


def index_rows(blocks: int, width: int, percent: int, common):
    """Per block of columns: the entries (column, set, set size, position) of each set's prefix in the
    common order, which has rare columns first."""
    def run(batches):
        keys, counts = common.value
        marked = np.zeros(MARKS, bool)
        marked[keys & (MARKS - 1)] = True
        held, seen, size, nodes = [], set(), 0, []
        task = TaskContext.get().partitionId()

        def described():
            """The documents themselves: id, set size, digest; under a negative block."""
            i, n = (np.fromiter((x[k] for x in nodes), np.int64, len(nodes)) for k in (0, 1))
            d = np.frombuffer(b"".join(x[2] or bytes(16) for x in nodes), np.uint8).reshape(-1, 16)
            nodes.clear()
            group = (mixed(i.view(np.uint64)) % np.uint64(NODE_GROUPS)).astype(np.int64)
            rows = [(-1 - (task * NODE_GROUPS + g), packed(i[at]), packed(n[at]), packed(d[at]), b"")
                    for g in range(NODE_GROUPS) if (at := group == g).any()]
            k, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)],
                ["block", "cols", "s", "size", "pos"])

        def batch():
            h, s, n, pos = (np.concatenate(x) for x in zip(*held))
            block, low = columns_of(h, blocks)
            order = np.lexsort((low, block))
            block, low, s, n, pos = block[order], low[order], s[order], n[order], pos[order]
            at = _by_block(block, blocks)
            rows = [(k, packed_sorted(low[i:j].astype(np.uint32)), packed(s[i:j]),
                     packed(n[i:j]), packed(pos[i:j]))
                    for k, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
            k, *rest = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(k, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)],
                ["block", "cols", "s", "size", "pos"])

        for i, h, d in sets_of(batches, width):
            nodes.append((i, len(h), d))
            if len(nodes) == NODES:
                yield described()
            if not d or d in seen:
                continue
            seen.add(d)
            n, p = len(h), prefix(len(h), percent)
            block, low = columns_of(h, blocks)
            col = (block << np.uint64(32)).astype(np.int64) + low.astype(np.int64)
            maybe = np.flatnonzero(marked[col & (MARKS - 1)])
            often = np.zeros(n, np.int64)
            if len(maybe):
                at = np.minimum(np.searchsorted(keys, col[maybe]), len(keys) - 1)
                often[maybe] = np.where(keys[at] == col[maybe], counts[at], 0)
            first = np.flatnonzero(often == 0)[:p]  # ascending, as the hashes are
            if len(first) < p:
                rest = np.flatnonzero(often)
                first = np.concatenate([first, rest[np.lexsort((h[rest], often[rest]))][:p - len(first)]])
            held.append((h[first], np.full(p, key_of(d), np.int64), np.full(p, n, np.uint32),
                         np.arange(p, dtype=np.uint32)))
            size += p
            if size >= GATHERED // 2:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()
        if nodes:
            yield described()
    return run


PRODUCT = "col long, s long, n long, pos long, id long, digest binary"


def product_rows(**columns) -> pa.Table:
    size = len(next(iter(columns.values())))
    kinds = {f.name: f.type for f in pa.schema([(c, pa.int64()) for c in ("col", "s", "n", "pos", "id")] + [("digest", pa.binary())])}
    return pa.table({c: pa.array(columns[c], t) if c in columns else pa.nulls(size, t) for c, t in kinds.items()})


def allowed(n, m, i, j, percent):
    """Sets of n and m elements that first share a column at places i and j may still link."""
    return np.minimum(n - i, m - j) >= (percent * (n + m) + 99 + percent) // (100 + percent)


def shared_columns(percent: int):
    def run(table: pa.Table) -> pa.Table:
        if table["block"][0].as_py() < 0:  # documents, as they are
            ids, n = (np.concatenate([unpacked(v.as_py(), np.int64) for v in table[c]]) for c in ("cols", "s"))
            raw = b"".join(unpacked(v.as_py(), np.uint8).tobytes() for v in table["size"])
            digests = [raw[k:k + 16] for k in range(0, len(raw), 16)]
            return product_rows(id=ids, n=n, digest=[d if m else b"" for d, m in zip(digests, n)],
                                s=[key_of(d) for d in digests])
        col, s, n, pos = _shared(table)
        # In a small group an entry that no other one may link with is of no use.
        keep = np.zeros(len(col), bool)
        _, at, c = np.unique(col, return_inverse=True, return_counts=True)
        keep[c[at] > GROUP] = True
        for k in range(1, min(GROUP, max(c, default=1))):
            i = np.flatnonzero(col[k:] == col[:-k])
            if not len(i):
                break
            i = i[allowed(n[i], n[i + k], pos[i], pos[i + k], percent)]
            keep[i] = keep[i + k] = True
        return product_rows(col=col[keep], s=s[keep], n=n[keep], pos=pos[keep])
    return run


def _shared(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of one block: the prefix entries whose column at least two different sets share, by column."""
    x = np.concatenate([unpacked_sorted(v.as_py(), np.uint32) for v in table["cols"]])
    s = np.concatenate([unpacked(v.as_py(), np.int64) for v in table["s"]])
    n = np.concatenate([unpacked(v.as_py(), np.uint32) for v in table["size"]])
    pos = np.concatenate([unpacked(v.as_py(), np.uint32) for v in table["pos"]])
    order = np.lexsort((s, x))
    x, s, n, pos = x[order], s[order], n[order], pos[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1])  # a set comes from several tasks
    x, s, n, pos = x[new], s[new], n[new], pos[new]
    _, at, c = np.unique(x, return_inverse=True, return_counts=True)
    keep = c[at] > 1
    col = (table["block"][0].as_py() << 32) + x[keep].astype(np.int64)
    return col, s[keep], n[keep].astype(np.int64), pos[keep].astype(np.int64)


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows times blocks of rows: for each pair the number of columns both have."""
    for b in batches:
        for i in range(0, len(b), 512):
            part = b.slice(i, 512)
            rows, row_of = [], []
            for side in ("x_set", "y_set"):
                sets = [unpacked_sorted(v, np.uint64) for v in values(part[side])]
                rows += sets
                row_of += [np.repeat(np.arange(len(sets)), [len(v) for v in sets])]
            col, row = np.concatenate(rows), np.concatenate(row_of)
            order = np.lexsort((col, row))
            col, row = col[order], row[order]
            both = (col[1:] == col[:-1]) & (row[1:] == row[:-1])
            n = np.bincount(row[1:][both], minlength=len(part))
            yield pa.RecordBatch.from_arrays(
                [part["x"], part["y"], part["x_n"], part["y_n"], pa.array(n, pa.int64())],
                ["x", "y", "x_n", "y_n", "both"])


def packed_sets(width: int):
    def run(batches):
        sets = ((key_of(d), d, len(s), packed_sorted(s)) for _, s, d in sets_of(batches, width))
        while rows := list(islice(sets, 256)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.int64(), pa.binary()))],
                ["s", "digest", "n", "cols"])
    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (x, y) of set keys those that link, as digests (a, b)."""
    x = sets.select(F.col("s").alias("x"), F.col("digest").alias("a"), F.col("n").alias("x_n"),
                    F.col("cols").alias("x_set"))
    y = sets.select(F.col("s").alias("y"), F.col("digest").alias("b"), F.col("n").alias("y_n"),
                    F.col("cols").alias("y_set"))
    both = pairs.join(x, "x").join(y, "y").select(
        F.col("a").alias("x"), F.col("b").alias("y"), "x_n", "y_n", "x_set", "y_set")
    counted = both.mapInArrow(overlaps, "x binary, y binary, x_n long, y_n long, both long")
    return counted.where(100 * F.col("both") >= percent * (F.col("x_n") + F.col("y_n") - F.col("both"))
                         ).select(F.col("x").alias("a"), F.col("y").alias("b"))


def within_bounds(x: str, y: str, percent: int):
    """Sizes and positions of a shared column still allow the overlap that a link needs."""
    need = f"({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent}"
    return F.expr(f"least({x}.n - {x}.pos, {y}.n - {y}.pos) >= {need}")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id that links reach).

    Words are what stands between white space, A-Z in lower case. A text of fewer than ``width``
    words is one shingle; a null or empty text, or one of white space, has none, links with nothing
    and is a component of its own. Copies have the same set and always share a component. A null id
    stays null, its text links like any other. Shingles are 64-bit hashes; two different shingles
    meet in one hash with a chance of 5e-20 a pair.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), body(F.col(text_col)).alias("body"))
    blocks = parts_for(total_bytes(docs, text_col), COLUMN_BYTES)

    # The order of columns.
    counted = stored(texts.mapInArrow(count_columns(blocks, width), "block long, cols binary, n binary")
                     .groupBy("block").applyInArrow(common_columns, "col long, n long"), "columns")
    level = F.floor(F.log2("n") * 4).cast("int")  # some hundred levels at most
    fits = counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect()
    held = np.cumsum([r["count"] for r in fits])
    lowest = min([r["level"] for r, n in zip(fits, held) if n <= COMMON_MAX], default=1 << 20)
    common = counted.where(level >= lowest).toArrow().sort_by("col")
    order = spark.sparkContext.broadcast((common["col"].to_numpy(), common["n"].to_numpy()))

    # The product over prefix columns; the documents and the keys of their sets come along.
    product = stored(texts.mapInArrow(index_rows(blocks, width, percent, order),
                                      "block long, cols binary, s binary, size binary, pos binary")
                     .groupBy("block").applyInArrow(shared_columns(percent), PRODUCT), "product")
    entries = product.where("col is not null").select("col", "s", "n", "pos")
    nodes = product.where("col is null").select("id", "n", "digest", "s")
    sets = stored(_sets(texts, nodes, entries, width), "rows")

    # Star rounds: in each column every set meets one set of another component, so large groups of
    # near copies soon hang together without trying all their pairs.
    keys = sets.select("s", "digest")
    links = tried = found = None
    for turn in range(STARS):
        entry = _labelled(entries, keys, found)
        rank = F.struct(*([F.col("pos").alias("first")] if not turn else []), F.xxhash64("s", F.lit(turn)), "s", "n", "pos", "root")
        hub = entry.groupBy("col").agg(F.min(rank).alias("hub"))
        star = (entry.alias("e").join(hub, "col").where("e.root != hub.root")
                .where(within_bounds("e", "hub", percent))
                .select(F.least("e.s", "hub.s").alias("x"), F.greatest("e.s", "hub.s").alias("y")).distinct())
        star = stored(star if tried is None else star.join(tried, ["x", "y"], "left_anti"), "star")
        tried = star if tried is None else tried.union(star)
        new = stored(linked(star, sets, percent), "links")
        links = new if links is None else links.union(new)
        found = components(links)
        if not new.take(1):
            break
    # Then all pairs that share a column and are not in one component yet.
    entry = stored(_labelled(entries, keys, found), "labelled")
    open_cols = entry.groupBy("col").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(
        "lo != hi").select("col")
    left = entry.join(open_cols, "col", "left_semi")
    rest = (left.alias("e").join(left.alias("f"), "col").where("e.root < f.root")
            .where(within_bounds("e", "f", percent))
            .select(F.least("e.s", "f.s").alias("x"), F.greatest("e.s", "f.s").alias("y")).distinct())
    more = stored(linked(rest.join(tried, ["x", "y"], "left_anti"), sets, percent), "links")
    if more.take(1):
        found = components(links.union(more))

    lowest = nodes.where("n > 0").groupBy("digest").agg(F.min(F.nullif("id", F.lit(NO_ID))).alias("low")).join(
        found, F.col("digest") == F.col("node"), "left").select(
        "digest", "low", F.coalesce("root", "digest").alias("root"))
    least = lowest.groupBy("root").agg(F.min("low").alias("component_id"))
    of = lowest.join(least, "root").select("digest", "component_id")
    own = F.nullif("id", F.lit(NO_ID))
    return nodes.join(of, "digest", "left").select(
        own.alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(own).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose id is the smallest of its component. Rows
    that repeat that id stay, as do rows without an id."""
    [name] = free_names(docs, "_jj_id")
    gone = jaccard_join(docs, id_col, text_col, **options).where("doc_id > component_id").select(
        F.col("doc_id").alias(name))
    return docs.join(gone, F.col(id_col) == F.col(name), "left_anti")


def _labelled(entries: DataFrame, keys: DataFrame, found: DataFrame | None) -> DataFrame:
    """The entries with the root of their set's component."""
    if found is None:
        roots = keys.withColumn("root", F.col("digest"))
    else:
        roots = keys.join(found, F.col("digest") == F.col("node"), "left").withColumn(
            "root", F.coalesce("root", "digest"))
    return entries.join(roots.select("s", "root"), "s")


def _sets(texts: DataFrame, nodes: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """The whole rows of the sets that any pair may need, one for each digest."""
    needed = entries.select("s").distinct()
    one = nodes.join(needed, "s", "left_semi").groupBy("digest").agg(F.min("id").alias("id"))
    rows = texts.join(one, "id", "left_semi").mapInArrow(
        packed_sets(width), "s long, digest binary, n long, cols binary")
    return rows.join(one.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
