"""Repeatable random draws keyed by row.

``F.rand`` depends on how rows are partitioned; these draws depend only on the key and the
salts, so a lost executor, another partition count or another engine gives the same result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from mixspark.functions.digest import md5_words

# 13 hex digits = 52 bits: exact in a double, and still fine-grained for sampling rates far
# below the 2^-32 that a 32-bit draw can resolve.
_DIGITS = 13
_SCALE = float(16**_DIGITS)

# Stands among the parts of ``uniforms`` and ``wide_draws`` where the number of the draw goes.
EACH = object()
# How many draws of a row are worth numpy: fewer do not pay the way to Python, more make too large
# batches.
WIDE = range(8, 1025)
# Texts hashed at a time.
_BLOCK = 32_768


def _text(parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def uniform(*parts) -> Column:
    """U[0,1) from the md5 of the parts joined by '|'. Columns or plain values."""
    digits = F.substring(F.md5(_text(parts)), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_SCALE)


def uniforms(n: int, *parts) -> Column:
    """An array of n draws: ``uniform`` of the parts with 0 to n-1 in the place of ``EACH``."""
    if n < 1:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                       lambda i: uniform(*[i if p is EACH else p for p in parts]))


def wide_draws(n: int, parts, finish, dtype: str, *inputs: Column) -> Column:
    """``finish`` of the draws of ``uniforms``, made in numpy over Arrow batches. It gets them as a
    matrix, a row's draws in a line, and the inputs as Arrow arrays; it gives a matrix of the same
    shape, not a number where the value is null. What follows ``EACH`` must be plain values."""
    at = next(i for i, p in enumerate(parts) if p is EACH)
    by_size = {}
    for i in range(n):
        tail = "|".join(str(p) for p in (i, *parts[at + 1:])).encode()
        by_size.setdefault(len(tail), []).append((i, list(tail)))
    tails = [(np.array([i for i, _ in same]), np.array([t for _, t in same], np.uint8))
             for same in by_size.values()]

    @F.arrow_udf(f"array<{dtype}>")
    def values(heads: pa.Array, *more: pa.Array) -> pa.Array:
        out = finish(_draws(heads, tails, n), *more)
        places = pa.array(np.arange(len(heads) + 1, dtype=np.int32) * n)
        flat = pa.array(out.ravel(), from_pandas=True)
        return pa.ListArray.from_arrays(places, flat.cast({"int": pa.int32()}.get(dtype, pa.float64())))

    return values(_text([*parts[:at], ""]).cast("binary"), *inputs)


def _draws(heads: pa.Array, tails, n: int) -> np.ndarray:
    """The draws of each head with each tail. Texts of one length are hashed together."""
    heads = heads.cast(pa.large_binary())
    _, places, data = heads.buffers()
    places = np.frombuffer(places, np.int64)[heads.offset:heads.offset + len(heads) + 1]
    data = np.frombuffer(data or b"", np.uint8)
    sizes = np.diff(places)
    out = np.empty((len(heads), n))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        for cols, ends in tails:
            step = max(1, _BLOCK // len(cols))
            for low in range(0, len(rows), step):
                some = rows[low:low + step]
                text = data[places[some][:, None] + np.arange(size)]
                a, b = (w.byteswap() for w in md5_words(text, ends)[:2])
                out[np.ix_(some, cols)] = (a * 2.0**20 + (b >> np.uint32(12))) / _SCALE
    return out


def uniform_value(*parts) -> float:
    """The same draw for plain values, on the driver."""
    text = "|".join(str(p) for p in parts)
    return int(hashlib.md5(text.encode()).hexdigest()[:_DIGITS], 16) / _SCALE


def normal(*parts) -> Column:
    """N(0,1) by Box-Muller from two uniforms."""
    u1, u2 = uniform(*parts, "r"), uniform(*parts, "a")
    return F.sqrt(-2.0 * F.log(1.0 - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def uniform_int(n, *parts) -> Column:
    """Uniform integer in [0, n)."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(*parts) * n).cast("int")


def first_hit(u: Column, p) -> Column:
    """Number (from 1) of the first success in repeated trials of probability p."""
    if not isinstance(p, Column):
        if p >= 1.0:
            return F.lit(1).cast("bigint")
        p = F.lit(float(p))
    return F.greatest(
        F.lit(1).cast("bigint"),
        F.when(p >= 1.0, F.lit(1).cast("bigint")).otherwise(
            F.ceil(F.log(1.0 - u) / F.log1p(-p))
        ),
    )
