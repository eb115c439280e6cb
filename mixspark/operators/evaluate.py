"""AUROC, folds, grids and the choice of parameters."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixspark.functions.expr import constants
from mixspark.functions.rand import uniform_int
from mixspark.operators.ordered import INF, bucket_count, number_bucket, number_edges


def positive(label: Column) -> Column:
    """Normal rows are the positive class: 1.0, anomalies 0.0."""
    return (1 - label).cast("double")


def between_cuts(df: DataFrame, col: str, cuts: list[float]) -> DataFrame:
    """Replace values by their place among the cut points: odd at a cut point, even between two."""
    cut = number_bucket(df, col, cuts, "__cut")
    at = F.get(constants(cuts), F.col("__cut") - 1) == F.col(col)
    place = 2.0 * F.col("__cut") - F.when(at, 1.0).otherwise(0.0)
    return cut.withColumn(col, place).drop("__cut")


# Up to this many rows of the rarer class, their scores serve as cut points.
RARE_ROWS = 20_000


def auroc(scored: DataFrame, by=(), score: str = "score", pos: str = "positive",
          edges: list[float] | None = None) -> DataFrame:
    """Exact area under the ROC curve per group, ties by the trapezoid rule.

    Equal scores are counted together before any shuffle, so a score shared by a third of the rows
    is one row. Ranks come from running totals inside score buckets plus the totals of the buckets
    below; no task sees more than a bucket. When one class is rare, all that matters of the other
    class is how many rows fall between its scores, and only those counts are shuffled.
    """
    by = list(by)
    # + 0.0 makes -0.0 and 0.0 one score.
    flags = scored.select(*by, (F.col(score) + 0.0).alias(score),
                          (F.col(pos) > 0.5).cast("long").alias("p"))
    if edges is None:
        buckets = bucket_count(scored)
        edges, counts = number_edges(flags, score, buckets, F.sum("p"), F.sum(1 - F.col("p")))
        few = min(counts, key=lambda c: c or 0)
        if few and few <= RARE_ROWS:
            rare = 1 if few == counts[0] else 0
            rows = flags.where(F.col("p") == rare).select(score).distinct().collect()
            cuts = sorted(r[0] for r in rows)
            if abs(cuts[0]) != INF and abs(cuts[-1]) != INF:
                flags = between_cuts(flags, score, cuts)
                edges = [2.0 * i + 1.5 for i in range(0, len(cuts), max(1, len(cuts) // buckets))]
    ties = flags.groupBy(*by, score).agg(
        F.sum("p").alias("p"), (F.count("*") - F.sum("p")).alias("q"))
    cut = number_bucket(ties, score, edges, "__bucket")
    w = Window.partitionBy(*by, "__bucket").orderBy(score)
    under = F.sum("q").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("q")
    inner = F.col("p") * (F.col("under") + F.col("q") / 2.0)
    parts = (
        cut.withColumn("under", under).groupBy(*by, "__bucket")
        .agg(F.sum(inner).alias("area"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    )
    # One row per group and bucket from here on.
    below = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("off", F.coalesce(F.sum("q").over(below), F.lit(0)))
    pos_n, neg_n = F.sum("p"), F.sum("q")
    both = (pos_n > 0) & (neg_n > 0)
    area = F.sum(F.col("area") + F.col("p").cast("double") * F.col("off"))
    out = parts.groupBy(*by) if by else parts.groupBy()
    return out.agg(
        F.when(both, area / (pos_n.cast("double") * neg_n)).alias("auroc"),
        pos_n.alias("n_pos"), neg_n.alias("n_neg"),
        F.when(~both, F.lit("one class only")).alias("warning"),
    )


def assign_folds(view: DataFrame, folds: int, seed=0, out: str = "fold") -> DataFrame:
    """Disjoint folds by keyed draw; the training set of a fold is every row outside it."""
    return view.withColumn(out, uniform_int(folds, F.col("key"), "fold", seed))


def fold_sizes(folded: DataFrame, by=()) -> DataFrame:
    """(fold, n_train, n_test) from one count per fold."""
    counts = folded.groupBy(*by, "fold").agg(F.count("*").alias("n_test"))
    everything = F.sum("n_test").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counts.select(*by, "fold", (everything - F.col("n_test")).alias("n_train"), "n_test")


# Names in nesting order, with the default value lists.
GRID_DEFAULTS = {
    "k": [4],
    "reg": [0.1, 1.0, 10.0, 100.0, 1000.0],
    "lr_start": [1.0],
    "lr_speed": [0.0001, 0.001, 0.01, 0.1, 1.0],
    "lam": [1.0],
}


def grid_points(**lists) -> list[dict]:
    """All combinations in nesting order, numbered from 0."""
    unknown = set(lists) - set(GRID_DEFAULTS)
    if unknown:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    values = {**GRID_DEFAULTS, **lists}
    names = list(GRID_DEFAULTS)
    return [
        {"combo": i, **dict(zip(names, point))}
        for i, point in enumerate(itertools.product(*(values[n] for n in names)))
    ]


GRID_SCHEMA = "combo int, k int, reg double, lr_start double, lr_speed double, lam double"


def grid_frame(spark: SparkSession, points: list[dict]) -> DataFrame:
    rows = [(p["combo"], int(p["k"]), float(p["reg"]), float(p["lr_start"]),
             float(p["lr_speed"]), float(p["lam"])) for p in points]
    return spark.createDataFrame(rows, GRID_SCHEMA)


def mean_auroc(results: DataFrame, params=("combo",)) -> DataFrame:
    """Mean over folds. A fold of one class has no value and is left out of the mean."""
    return results.groupBy(*params).agg(
        F.avg("auroc").alias("auroc"), F.count("auroc").alias("folds"))


def best_params(means: DataFrame, by=()) -> DataFrame:
    """(combo, auroc, inverted): the highest mean, the first combination winning ties. When one
    minus the lowest mean is higher still, the lowest combination is the answer and its own value
    is reported."""
    from_top = F.struct(F.col("auroc"), (-F.col("combo")).alias("o"))
    from_bottom = F.struct(F.col("auroc"), F.col("combo").alias("o"))
    ends = means.where("auroc IS NOT NULL").groupBy(*by).agg(
        F.max(from_top).alias("best"), F.min(from_bottom).alias("worst"))
    flip = 1.0 - F.col("worst.auroc") > F.col("best.auroc")
    return ends.select(
        *by,
        F.when(flip, F.col("worst.o")).otherwise(-F.col("best.o")).cast("int").alias("combo"),
        F.when(flip, F.col("worst.auroc")).otherwise(F.col("best.auroc")).alias("auroc"),
        flip.alias("inverted"),
    )


def timing(results: DataFrame, by=(), col: str = "seconds") -> DataFrame:
    """Total and mean seconds per fit."""
    return results.groupBy(*by).agg(
        F.count("*").alias("fits"), F.sum(col).alias("total_seconds"),
        F.avg(col).alias("mean_seconds"))
