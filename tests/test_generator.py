"""Wide generated rows: draws made in numpy are those of the expressions, and rows are dealt out."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixspark.functions.digest import md5_words
from mixspark.functions.rand import EACH, uniforms, wide_draws
from mixspark.operators import evalset as es
from mixspark.plans import evalset as pe

KEYS = ["1", "22", "333", "", None, "ä|b", "x" * 50, "y" * 64, "z" * 200]


def test_digests_of_every_length():
    r = np.random.default_rng(0)
    for p in (0, 1, 4, 46, 47, 54, 55, 56, 63, 64, 119, 300):
        for q in (0, 1, 9):
            heads = r.integers(0, 256, (2, p), dtype=np.uint8)
            tails = r.integers(0, 256, (3, q), dtype=np.uint8)
            got = np.stack(md5_words(heads, tails), axis=-1).astype("<u4")
            for i, j in np.ndindex(2, 3):
                want = hashlib.md5(heads[i].tobytes() + tails[j].tobytes()).digest()
                assert got[i, j].tobytes() == want


@pytest.mark.parametrize("n", [8, 105])
def test_wide_draws_equal_uniform(spark, n):
    rows = spark.createDataFrame([(k,) for k in KEYS], "key string")
    for parts in ((F.col("key"), "bit", EACH, 7), (F.col("key"), "num", "7|n", EACH),
                  (F.col("key"), EACH), (EACH, "s")):
        got = rows.select(wide_draws(n, parts, lambda u: u, "double").alias("a"),
                          uniforms(n, *parts).alias("b")).collect()
        assert len(got) == len(KEYS) and all(len(r["a"]) == n and r["a"] == r["b"] for r in got)


def both_forms(monkeypatch, make):
    wide = make().collect()
    monkeypatch.setattr(es, "WIDE", range(0))
    return wide, make().collect()


def test_wide_generator_equals_expressions(spark, monkeypatch):
    keys = spark.range(300).select(F.col("id").cast("string").alias("key"))
    a, b = both_forms(monkeypatch, lambda: pe.generate(keys, n_nums=20, seed=3).orderBy("key"))
    assert len(a) == 300 and a == b
    assert all(len(r["cats"]) == 30 and len(r["nums"]) == 20 for r in a)


def test_missing_columns_give_null_in_both_forms(spark, monkeypatch):
    rows = spark.createDataFrame([("a", [1, 0, 1]), ("b", [1]), ("c", None), ("d", [None, 1, 1]), ("e", [])],
                                 "key string, bits array<int>")
    rules = [[1, 0, 0], [0, 1, 1], [1, 1, 1]] * 3

    def make():
        out = es.dependent_numeric(rows, rules, 5).select("key", "nums")
        return out.join(es.dependent_binary(rows, rules, 5), "key").orderBy("key")

    a, b = both_forms(monkeypatch, make)
    assert a == b and a[1]["nums"][0] is not None and a[1]["nums"][1] is None and a[2]["bits"] is None


def test_generated_rows_are_dealt_over_tasks(spark):
    keys = spark.range(1000, numPartitions=1).select(F.col("id").cast("string").alias("key"))
    rows = pe.generate(keys, seed=3)
    assert rows.rdd.getNumPartitions() >= 8
    # No draw is a call of md5 on its own.
    assert "md5" not in rows._jdf.queryExecution().executedPlan().toString()


def test_no_columns_no_bits(spark):
    rows = spark.createDataFrame([("a",)], "key string")
    assert es.independent_binary(rows, 0).first()["bits"] == []
