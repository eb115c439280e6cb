"""Category indexing: string values to integers from 0, in ascending order of value."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.operators.ordered import dense_index

# Up to this many values in all are looked up through a broadcast table.
BROADCAST_VALUES = 100_000
BROADCAST_CHARS = 50_000_000
# Up to this many values of a column are searched in a constant array instead: no join at all.
INLINE_VALUES = 32


def fit_categories(df: DataFrame, cols, limit: int = BROADCAST_VALUES) -> dict[str, list] | None:
    """Sorted values per column, or None when there are more than ``limit`` in all or they are too
    long to broadcast. One pass for all columns; the sizes are known before any value reaches the
    driver."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("value")) for c in cols
    ])
    values = (
        df.select(F.explode(cells).alias("cell")).select("cell.*")
        .where("value IS NOT NULL").distinct()
    )
    values = values.persist()
    try:
        size = values.agg(F.count("*").alias("n"), F.sum(F.length("value")).alias("chars")).first()
        if size["n"] > limit or (size["chars"] or 0) > BROADCAST_CHARS:
            return None
        rows = values.collect()
    finally:
        values.unpersist()
    found: dict[str, list] = {c: [] for c in cols}
    for r in rows:
        found[r["col"]].append(r["value"])
    # Code-point order, the order in which Spark sorts UTF-8 strings.
    return {c: sorted(v) for c, v in found.items()}


def apply_categories(df: DataFrame, values: dict[str, list], suffix: str = "_idx") -> DataFrame:
    """Add ``<col>_idx``; null for a value not in the list."""
    spark = df.sparkSession
    for c, labels in values.items():
        text = F.col(c).cast("string")
        if len(labels) <= INLINE_VALUES:
            at = F.array_position(F.array(*[F.lit(v) for v in labels]).cast("array<string>"), text)
            df = df.withColumn(c + suffix, (F.nullif(at, F.lit(0)) - 1).cast("int"))
            continue
        table = spark.createDataFrame(pa.table({
            f"__{c}": pa.array(labels, pa.string()),
            c + suffix: pa.array(range(len(labels)), pa.int32()),
        }))
        df = df.join(F.broadcast(table), text == F.col(f"__{c}"), "left").drop(f"__{c}")
    return df


def index_categories(df: DataFrame, cols, suffix: str = "_idx",
                     limit: int = BROADCAST_VALUES) -> DataFrame:
    """Add ``<col>_idx`` for each column. Small value sets are broadcast; beyond ``limit`` values
    the index is built by a distributed ranking and joined by shuffle."""
    values = fit_categories(df, cols, limit)
    if values is not None:
        return apply_categories(df, values, suffix)
    for c in cols:
        one = fit_categories(df, [c], limit)
        if one is not None:
            df = apply_categories(df, one, suffix)
        else:
            df = dense_index(df, c, c + suffix)
    return df
