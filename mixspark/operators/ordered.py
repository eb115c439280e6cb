"""Order-based work without a single-partition window: cut the value range into buckets at
sampled edges, work inside each bucket, and shift by the totals of the buckets below."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mixspark.sources.scratch import stored

INF = float("inf")
HOT_SHARE = 1.0 / 1024
HOT_CHARS = 1000
BUCKET_ROWS = 2_000_000


def bucket_count(df: DataFrame, rows: int = 0) -> int:
    """Buckets for ordered work: a few per shuffle partition, so it scales with the cluster, and
    enough that one holds about BUCKET_ROWS rows where their number is known."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, 4 * n, -(-rows // BUCKET_ROWS))


def number_edges(df: DataFrame, col: str, buckets: int, *extra) -> tuple[list[float], list]:
    """Ascending cut points so that buckets hold about equal numbers of rows, and the values of extra
    aggregates from the same pass. Edges only balance the work; results never depend on them."""
    probs = np.arange(1, buckets) / buckets
    sketch = F.kll_sketch_agg_double(F.when(~F.isnan(col), F.col(col)), F.lit(min(4096, 4 * buckets)))
    row = df.agg(
        F.kll_sketch_get_quantile_double(sketch, F.lit(probs)).alias("edges"),
        F.count_if(F.isnan(col)).alias("bad"), *extra,
    ).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} values of {col} are not a number")
    edges = {float(e) for e in (row["edges"] or []) if e is not None and abs(e) != INF}
    return sorted(edges), list(row[2:])


def number_bucket(df: DataFrame, col: str, edges, out: str = "bucket") -> DataFrame:
    """Bucket of a double column by binary search over the edges."""
    edges = list(edges)
    if not edges:
        return df.withColumn(out, F.lit(0))
    b = Bucketizer(splits=[-INF, *edges, INF], inputCol=col, outputCol=out, handleInvalid="error")
    return b.transform(df).withColumn(out, F.col(out).cast("int"))


def ranked_values(values: DataFrame, col: str, rank: str) -> DataFrame:
    """Rank from 0 of each row by a column of distinct values. The rows are sorted in ranges, and a range
    begins with the number of rows in those before it: one row per range is all that is put in one order."""
    placed = stored(
        values.repartitionByRange(col).sortWithinPartitions(col)
        .withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    below = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n")).select(
        "__part", "__first", F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__below"))
    return (
        placed.join(F.broadcast(ranges), "__part")
        .withColumn(rank, F.col("__below") + F.col("__at") - F.col("__first"))
        .drop("__part", "__at", "__first", "__below")
    )


def dense_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Dense rank from 0 of a column of any cardinality, joined back to the rows. A value that holds more
    than a quarter of an even share of a join task, or 1/1024 of the rows, goes by broadcast (there are fewer
    of them than four times the tasks, or than 1024; only short ones, so their size is bounded). Of the rest, long
    values are joined with their rows spread over as many salts as they have shares. The ranked values are written
    once to the shared folder."""
    keyed = df.withColumn("__v", F.col(col).cast("string"))
    counts = stored(
        keyed.where("__v IS NOT NULL").groupBy("__v").agg(F.count("*").alias("__c")), "values")
    rows = counts.agg(F.sum("__c")).first()[0] or 0
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1.0, rows * min(HOT_SHARE, 1.0 / (4 * tasks)))
    ranked = ranked_values(counts, "__v", out).withColumn(out, F.col(out).cast("int"))
    frequent = F.col("__c") > F.lit(share)
    short = F.length("__v") <= HOT_CHARS
    ranked = stored(ranked, "ranks")
    hot = F.broadcast(ranked.where(frequent & short).select("__v", out))
    cold = ranked.where(~(frequent & short))
    salts = max(1, math.ceil((cold.agg(F.max("__c")).first()[0] or 0) / share))
    cold = cold.withColumn("__salt", F.explode(F.when(frequent, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(-1))))).select("__v", "__salt", out)
    unknown = keyed.where("__v IS NULL").withColumn(out, F.lit(None).cast("int"))
    rest = keyed.join(hot, "__v", "left_anti")
    if salts == 1:
        found = rest.join(cold.drop("__salt"), "__v")
    else:  # long values that are frequent: rare, so the rows are looked up under both salts
        number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")
        found = rest.withColumn("__salt", F.explode(F.array(F.lit(-1), number))).join(cold, ["__v", "__salt"])
    return (
        keyed.join(hot, "__v")
        .unionByName(found.drop("__salt"))
        .unionByName(unknown)
        .drop("__v")
    )


# Quantiles looked at in a pass, and the accuracy of their sketch: its rank error is at most 1/2000.
GRID = 1000
ACCURACY = 2000


def bracket(c: Column, bad: bool = True) -> list[Column]:
    """Aggregates a search for a rank begins with: rows, quantiles and, unless ``bad`` is off, unusable values."""
    probs = np.linspace(0.0, 1.0, GRID + 1)
    out = [F.count("*").alias("n"), F.percentile_approx(c, F.lit(probs), ACCURACY).alias("q")]
    return out + [F.count_if(c.isNull() | F.isnan(c.cast("double"))).alias("bad")] * bad


def kth_lowest(df: DataFrame, col: str, rank, small: int = 100_000, first: dict | None = None) -> tuple:
    """Exact k-th lowest value of a numeric column as (value, k, rows); ``rank`` is k or a function
    of the row count. Values that are null or not a number have no rank: they are an error.

    Each pass is one aggregate with partial aggregation: quantile sketches cut the bracket that holds
    the rank by a factor of a few hundred, until its distinct values fit on the driver. The table
    is never sorted, whatever k is. ``first`` has the values of ``bracket`` where they are known. Later passes
    filter by the bracket's upper end, so files with sorted values are read in part."""
    c = F.col(col)
    row = first or df.agg(*bracket(c)).first().asDict()
    if row["bad"]:
        raise ValueError(f"{row['bad']} values of {col} are missing or not a number")
    n = row["n"]
    k = rank(n) if callable(rank) else rank
    if not 1 <= k <= n:
        raise ValueError(f"rank {k} is outside 1..{n}")
    lo = hi = None
    below, size = 0, n
    while True:
        p, q = (k - below) / row["n"], row["q"]
        i = max(0, int(np.floor((p - 2.0 / ACCURACY) * GRID)))
        j = min(GRID, int(np.ceil((p + 2.0 / ACCURACY) * GRID)))
        lo = q[i] if i > 0 or lo is None else lo
        hi = q[j] if j < GRID or hi is None else hi
        before, size = size, row["n"] * (j - i + 1) / GRID
        if isinstance(lo, int):  # sketches hold doubles: large integers come back rounded
            lo, hi = lo - (abs(lo) >> 52), hi + (abs(hi) >> 52)
        if lo == hi or size <= small or (before < n and size > before / 2):
            break
        inside = c >= F.lit(lo)
        row = df.where(c <= F.lit(hi)).agg(
            F.count_if(~inside).alias("below"), F.count_if(inside).alias("n"),
            bracket(F.when(inside, c), bad=False)[1]).first().asDict()
        below = row["below"]
        if not row["n"]:
            break  # a sketch outside its error bound
    while True:
        side = F.when(c < lo, 0).otherwise(1).alias("side")
        near = df if hi == INF else df.where(c <= F.lit(hi))
        counts = near.select(side, F.when(c >= lo, c).alias("v")).groupBy("side", "v")
        rows = counts.agg(F.count("*").alias("n")).orderBy("side", "v").limit(small + 2).collect()
        seen, last = 0, None
        for r in rows:
            if seen + r["n"] >= k:
                break
            seen += r["n"]
            last = r
        else:
            r = None
        if r is not None and r["side"] == 1:
            return r["v"], k, n
        if r is not None and lo != -INF:
            lo = -INF  # a sketch outside its error bound
        elif r is None and len(rows) < small + 2 and hi != INF:
            hi = INF
        elif r is None and last is not None and last["side"] == 1 and last["v"] != lo:
            lo = last["v"]  # more distinct values than fit: go on from the last one
        else:
            raise RuntimeError(f"no value of {col} has rank {k}")
