"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) if cols else F.lit(0.0)


def horner(x: Column, coefficients) -> Column:
    """Polynomial with coefficients from the constant term up."""
    out = F.lit(float(coefficients[-1]))
    for a in reversed(coefficients[:-1]):
        out = out * x + F.lit(float(a))
    return out


def constants(values, dtype: str = "double") -> Column:
    """A constant array as one literal. Spark keeps it as an object outside the generated code, so
    plans that differ only in these numbers share compiled code from step to step."""
    if len(values) == 0:
        return F.array().cast(f"array<{dtype}>")
    return F.lit(np.asarray(values, dtype={"double": "float64", "int": "int32"}[dtype]))


def log_sum_exp(cols: list[Column]) -> Column:
    if len(cols) == 1:
        return cols[0]
    top = F.greatest(*cols)
    return top + F.log(total([F.exp(c - top) for c in cols]))


def dot(array: Column, values) -> Column:
    """Dot product of an array column with a constant vector, unrolled."""
    c = constants([float(v) for v in values])
    return total([array[i] * c[i] for i in range(len(values))])


def kept_apart(c: Column) -> Column:
    """The same value, marked as tied to its task, so that a filter on it stays above the projection
    that computes it. Pushed below, the filter would repeat the columns the value is built from
    once per use."""
    return F.when(F.spark_partition_id() >= 0, c)
