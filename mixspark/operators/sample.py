"""Row selection and repeatable sampling."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixspark.functions.rand import first_hit, uniform

# Redraws of an empty minibatch that one pass looks at.
ATTEMPTS_A_PASS = 32


def normal_rows(view: DataFrame) -> DataFrame:
    return view.where("label = 0")


def anomalous_rows(flagged: DataFrame) -> DataFrame:
    return flagged.where("is_anomaly")


def bernoulli(df: DataFrame, fraction: float, *salt) -> DataFrame:
    """Keep each row with the given probability."""
    if fraction >= 1.0:
        return df
    return df.where(uniform(F.col("key"), *salt) < F.lit(float(fraction)))


def minibatch_fraction(n: int, minibatch: int) -> float:
    return min(1.0, minibatch / n)


def minibatch_sample(df: DataFrame, n: int, minibatch: int, *salt) -> tuple[DataFrame, int]:
    """A non-empty minibatch: draws again with the next salt while none is selected. Returns the
    rows and the attempt they came from."""
    f = minibatch_fraction(n, minibatch)
    rows = bernoulli(df, f, *salt, 0)
    if f >= 1.0 or rows.limit(1).count():
        return rows, 0
    # Rare: look at many attempts in one pass.
    for start in itertools.count(1, ATTEMPTS_A_PASS):
        hits = [F.max(uniform(F.col("key"), *salt, a) < F.lit(float(f))).alias(str(a))
                for a in range(start, start + ATTEMPTS_A_PASS)]
        found = df.agg(F.count("*").alias("n"), *hits).first()
        if not found["n"]:
            raise ValueError("no rows to draw from")
        for attempt in range(start, start + ATTEMPTS_A_PASS):
            if found[str(attempt)]:
                return bernoulli(df, f, *salt, attempt), attempt


def mixture_target(k: int, ratio: float) -> float:
    """Rows the mixture is fitted on: enough that each component sees some rows, while groups
    rarer than ``ratio`` get no component of their own."""
    return k * (math.log(0.5) / math.log(1.0 - ratio)) * 10


def mixture_fraction(n: int, k: int, ratio: float) -> float:
    return min(1.0, mixture_target(k, ratio) / n)


def mixture_sample(df: DataFrame, n: int, k: int, ratio: float, *salt) -> DataFrame:
    return bernoulli(df, mixture_fraction(n, k, ratio), *salt)


def steps_to_draw(needed: int, n: int, fraction: float) -> int:
    """Steps to draw so that ``needed`` of them will almost surely be non-empty."""
    empty = math.exp(n * math.log1p(-fraction)) if fraction < 1.0 else 0.0
    return needed if empty < 1e-12 else math.ceil(needed / (1.0 - empty) * 1.25) + 30


def may_draw(steps: int, fraction: float, *salt, groups: Column | None = None) -> Column:
    """Whether ``draw_steps`` takes a row at least once: one draw per row, no explode."""
    n_groups = F.lit(1) if groups is None else F.size(groups)
    return first_hit(uniform(F.col("key"), *salt, "first"), fraction) <= n_groups * F.lit(steps)


def few_tasks(spark) -> int:
    """Partitions for a set of drawn rows: as many as the session shuffles to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mixture_draw(rate, *salt, group: Column | None = None) -> Column:
    """Whether the mixture's sample of a training set takes a row. A row has one draw per set, so the
    sample depends on its own rate alone, and larger rates hold smaller ones."""
    return uniform(F.col("key"), "mix", *salt, F.lit(0) if group is None else group) < rate


def draw_steps(df: DataFrame, steps: int, fraction: float, *salt,
               groups: Column | None = None, rates: dict[int, float] | None = None) -> DataFrame:
    """All minibatches of a training run in one pass: a row comes out once for every (group, step)
    that draws it, each independently with probability ``fraction``, as columns ``grp`` and ``it``.

    Nearly every row is settled by a single draw, the number of the first step that takes it; only
    the few rows that are taken at all look at later steps. ``groups`` lists the training sets a
    row belongs to, ``rates`` their own fractions where they are below ``fraction``.
    """
    groups = F.array(F.lit(0)) if groups is None else groups
    key = F.col("key")
    first = first_hit(uniform(key, *salt, "first"), fraction)
    n_groups = F.size("__groups")
    taken = (
        df.withColumn("__groups", groups)
        .withColumn("__first", first)
        .where(F.col("__first") <= n_groups * F.lit(steps))
    )
    # The group and step of the first hit; later groups start afresh.
    taken = taken.withColumn("__p0", F.floor((F.col("__first") - 1) / steps).cast("int"))
    start = (F.col("__first") - 1 - F.col("__p0") * steps + 1).cast("int")
    taken = taken.withColumn("__p", F.explode(F.sequence(F.col("__p0"), n_groups - 1)))
    taken = taken.withColumn("grp", F.col("__groups")[F.col("__p")])
    later = first_hit(uniform(key, *salt, F.col("grp"), "first"), fraction)
    taken = taken.withColumn(
        "__from",
        F.when(F.col("__p") == F.col("__p0"), start)
        .otherwise(F.least(later, F.lit(steps + 1).cast("bigint")).cast("int")),
    ).where(F.col("__from") <= steps)
    taken = taken.withColumn("it", F.explode(F.sequence(F.col("__from"), F.lit(steps))))
    hit = (F.col("it") == F.col("__from")) | (
        uniform(key, *salt, F.col("grp"), F.col("it")) < F.lit(float(fraction))
    )
    taken = taken.where(hit)
    if rates and any(r < fraction for r in rates.values()):
        keep = F.create_map(*[F.lit(x) for g, r in rates.items() for x in (g, r / fraction)])
        taken = taken.where(uniform(key, *salt, F.col("grp"), F.col("it"), "keep")
                            < keep[F.col("grp")])
    return taken.drop("__groups", "__first", "__p0", "__p", "__from")
