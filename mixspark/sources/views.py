"""The mixed view: key string, cats array<int>, nums array<double>, label int."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def _array(cols, dtype: str) -> Column:
    if not cols:
        return F.array().cast(f"array<{dtype}>")
    return F.array(*[_col(c).cast(dtype) for c in cols])


def mixed_view(df: DataFrame, key, cats, nums, label=None, keep=()) -> DataFrame:
    """Project an ordinary table to the mixed view. A projection only: the scan below still
    reads just the named columns. ``cats`` must already be integers from 0 (``index_categories``
    makes them); ``label`` is 1 for a known anomaly."""
    out = [
        _col(key).cast("string").alias("key"),
        _array(list(cats), "int").alias("cats", metadata={"size": len(cats)}),
        _array(list(nums), "double").alias("nums", metadata={"size": len(nums)}),
    ]
    if label is not None:
        out.append((_col(label) == 1).cast("int").alias("label"))
    return df.select(*out, *[_col(k) for k in keep])


def vector_view(df: DataFrame, n_cats: int, key, features="features", label="label",
                keep=()) -> DataFrame:
    """Mixed view of (label, feature array): the first ``n_cats`` features are categorical."""
    f = _col(features)
    n = F.size(f)
    return df.select(
        _col(key).cast("string").alias("key"),
        F.slice(f, 1, n_cats).cast("array<int>").alias("cats", metadata={"size": n_cats}),
        F.slice(f, n_cats + 1, F.greatest(n - n_cats, F.lit(0))).alias("nums"),
        (_col(label) == 1).cast("int").alias("label"),
        *[_col(k) for k in keep],
    )
