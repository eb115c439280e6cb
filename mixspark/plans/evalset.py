"""Build a labelled evaluation set: clean train rows, dev and test rows with injected anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.operators import evalset as es
from mixspark.operators.profile import dimensions


def drafted(spark: SparkSession, n_rules: int, size: int, seed) -> list[list[int]]:
    """Rules as lists: one per generated column, so their number is a width, not a row count."""
    ids = spark.range(n_rules).select(F.col("id").alias("rule"))
    return [list(r["bits"]) for r in es.draft_rules(ids, size, seed).orderBy("rule").collect()]


def generate(rows: DataFrame, n_random: int = es.DEFAULT_RANDOM_CATEGORICAL,
             n_related: int = es.DEFAULT_RELATED_CATEGORICAL, n_nums: int = es.DEFAULT_NUMERIC,
             p: float = es.DEFAULT_BINARY_PROBABILITY, seed=0) -> DataFrame:
    """A mixed view with one generated row per ``key``: random binary columns, binary columns that
    depend on them, and numerics that depend on both. A row costs far more than its key, so the keys
    are dealt over all tasks first: a small file of keys is one task otherwise."""
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                spark.sparkContext.defaultParallelism)
    out = es.independent_binary(rows.select("key").repartition(tasks), n_random, p, seed)
    out = es.dependent_binary(out, drafted(spark, n_related, n_random, f"{seed}|b"), seed)
    out = es.dependent_numeric(
        out, drafted(spark, n_nums, n_related + n_random, f"{seed}|n"), seed)
    return out.select("key", F.col("bits").alias("cats"), "nums", F.lit(0).alias("label"))


def inject(split: DataFrame, fraction: float = es.DEFAULT_FRACTION,
           m: int = es.DEFAULT_NOISE_VARIABLES, sigma: float = es.DEFAULT_NOISE_SIGMA,
           choice: str = "scan", seed=0, dims: tuple[int, int] | None = None) -> DataFrame:
    """Corrupt a fraction of dev and test rows; train rows stay clean."""
    n_cats, n_nums = dims or dimensions(split)
    hit = (F.col("split") != "train") & es.inject_rows(fraction, seed)
    return es.noise_inject(split, n_cats, n_nums, m, sigma, hit, choice, seed)


def build(spark: SparkSession, n_train: int = es.DEFAULT_TRAIN, n_dev: int = es.DEFAULT_DEV,
          n_test: int = es.DEFAULT_TEST, n_random: int = es.DEFAULT_RANDOM_CATEGORICAL,
          n_related: int = es.DEFAULT_RELATED_CATEGORICAL, n_nums: int = es.DEFAULT_NUMERIC,
          fraction: float = es.DEFAULT_FRACTION, m: int = es.DEFAULT_NOISE_VARIABLES,
          sigma: float = es.DEFAULT_NOISE_SIGMA, seed=0) -> DataFrame:
    """The whole set from nothing but its sizes, split by position of the row number."""
    ids = spark.range(n_train + n_dev + n_test)
    split = F.when(F.col("id") < n_train, "train").when(
        F.col("id") < n_train + n_dev, "dev").otherwise("test")
    keys = ids.select(F.col("id").cast("string").alias("key"))
    rows = generate(keys, n_random, n_related, n_nums, seed=seed)
    split = F.when(F.col("key").cast("bigint") < n_train, "train").when(
        F.col("key").cast("bigint") < n_train + n_dev, "dev").otherwise("test")
    return inject(rows.withColumn("split", split), fraction, m, sigma, seed=seed,
                  dims=(n_random + n_related, n_nums))
