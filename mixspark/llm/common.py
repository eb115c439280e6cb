"""What the operators share: normal forms of texts, folds, sizes, word hashes, packed arrays."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
#: Texts beyond this many bytes are split into words piece by piece.
PIECE = 1 << 22
#: Distinct words whose hash a task remembers.
REMEMBERED = 1 << 19
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def lowered(c: Column) -> Column:
    """The text with A-Z in lower case, other letters as they are; null is the empty text."""
    return F.translate(F.coalesce(c, F.lit("")), UPPER, LOWER)


def fold(c: Column, n: int = 5) -> Column:
    """crc32 of the id as text modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def body(c: Column) -> Column:
    """The text's UTF-8 bytes, empty for null."""
    return F.coalesce(c, F.lit("")).cast("binary")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores at the end where a column of ``docs`` has one of them."""
    taken, end = {c.lower() for c in docs.columns}, ""
    while any((n + end).lower() in taken for n in names):
        end += "_"
    return [n + end for n in names]


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).head()[0] or 0


def parts_for(total: int, each: int) -> int:
    """How many parts of about ``each`` bytes."""
    return max(1, -(-total // each))


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The lower-case words between white space, in lists of bounded length."""
    at = 0
    while len(text) - at > PIECE:
        m = SPACE.search(text, at + PIECE)
        end = m.start() if m else len(text)
        yield text[at:end].lower().split()
        at = end
    yield text[at:].lower().split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h

    def of(self, text: bytes) -> np.ndarray:
        got = [np.fromiter(map(self.__getitem__, w), np.uint64, len(w)) for w in word_lists(text)]
        return got[0] if len(got) == 1 else np.concatenate(got)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of the input."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def packed(a: np.ndarray) -> bytes:
    """The array's bytes, compressed. ``unpacked`` needs the type again."""
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked(b: bytes, dtype) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, dtype)
    return np.frombuffer(pa.decompress(b[8:], n, codec="zstd", asbytes=True), dtype)


def packed_sorted(a: np.ndarray) -> bytes:
    """Ascending integers as packed differences, byte plane by byte plane."""
    d = np.diff(a, prepend=a.dtype.type(0))
    return packed(d.view(np.uint8).reshape(-1, a.dtype.itemsize).T)


def unpacked_sorted(b: bytes, dtype) -> np.ndarray:
    planes = unpacked(b, np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(dtype).ravel(), dtype=dtype)


def values(column: pa.Array) -> Iterator:
    """The values one by one, so that a batch is not copied whole."""
    for v in column:
        yield v.as_py()


def as_signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


#: A key with more than this share of the rows goes by broadcast; there are fewer such keys than its inverse.
HOT_SHARE = 1.0 / 1024


def joined(rows: DataFrame, table: DataFrame, key: str, times: str) -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key and, as ``times``, at most the rows of that key
    in ``rows``. The frequent keys, at most 1023, go by broadcast, the rest by shuffle, so no task gets all
    rows of a frequent key. ``table`` is read several times: a written one."""
    limit = F.lit(HOT_SHARE * (table.agg(F.sum(times)).first()[0] or 0))
    hot = F.broadcast(table.where(F.col(times) > limit))
    cold = table.where(F.col(times) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))


#: Bits of a bitmap per repeated digest, and at most (16 MB). A full one only lets more rows through.
BITS_EACH, BITS_MOST = 64, 1 << 27


def marked_among(rows: DataFrame, among: DataFrame, digest: str, n: int, out: str) -> DataFrame:
    """Add a boolean: surely false where the row's digest (binary, four bytes or more) is not one of the n in
    ``among``, but for a few. A bitmap of bounded size is broadcast, so no row moves."""
    bits = 1 << max(15, min(BITS_EACH * n, BITS_MOST).bit_length() - 1)
    at = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("bigint") % bits
    maps = among.groupBy(F.bitmap_bucket_number(at).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("__bits"))
    found = rows.withColumn("__bucket", F.bitmap_bucket_number(at)).join(F.broadcast(maps), "__bucket", "left")
    found = found.withColumn("__at", F.bitmap_bit_position(at))
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    found = found.withColumn("__byte", byte)
    bit = F.expr("shiftright(__byte, cast(__at % 8 as int)) & 1") == 1
    return found.withColumn(out, F.coalesce(bit, F.lit(False))).drop("__bucket", "__bits", "__at", "__byte")


def maybe_among(rows: DataFrame, among: DataFrame, digest: str, n: int) -> DataFrame:
    """The rows whose digest is in ``among``, and a few others."""
    return marked_among(rows, among, digest, n, "__maybe").where("__maybe").drop("__maybe")
