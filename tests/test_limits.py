"""Odd values, large counts, plans and folders."""

import math
import types

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from mixspark.functions.rand import uniform
from mixspark.operators import category, evaluate as ev, score as sc
from mixspark.operators import ordered
from mixspark.operators.ordered import kth_lowest, ranked_values
from mixspark.operators.sample import minibatch_sample
from mixspark.plans.detect import flag_rows
from mixspark.plans.model import fit
from mixspark.queries import mv_events
from mixspark.sources import libsvm, scratch


@pytest.fixture(scope="module")
def model(spark):
    return fit(mv_events(spark, SMALL), k=2, max_iterations=3)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_an_error(spark, bad):
    df = spark.createDataFrame([(float(i),) for i in range(97)] + [(bad,)] * 3, "score double")
    with pytest.raises(ValueError, match="3 values of score"):
        kth_lowest(df, "score", 99)
    with pytest.raises(ValueError, match="3 values of score"):
        sc.threshold_exact(df, 1.0)


@pytest.mark.parametrize("small", [5, 100_000])
def test_every_rank_is_found_and_ends(spark, small):
    values = [-math.inf, *map(float, range(40)), 7.0, 7.0, math.inf, math.inf]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    for k in (1, 2, 9, 10, len(values) - 1, len(values)):
        assert kth_lowest(df, "score", k, small)[0] == sorted(values)[k - 1]
    assert sc.threshold_exact(df, 1.0)[0] == math.inf
    with pytest.raises(ValueError):
        kth_lowest(df, "score", len(values) + 1)


def test_area_of_large_classes_does_not_overflow(spark):
    """Tied groups of billions of rows, as the sums of a large table would be."""
    n = 4_000_000_000
    p, off = F.lit(n).cast("long"), F.lit(n).cast("long")
    assert spark.range(1).select((p.cast("double") * off).alias("a")).head().a == float(n) ** 2
    scored = spark.createDataFrame([(0.1, 0.0), (0.1, 1.0), (0.2, 1.0), (0.05, 0.0)], "score double, positive double")
    assert ev.auroc(scored).head().auroc == 0.875


def test_filters_on_columns_of_the_view_reach_the_scan(spark, model):
    plan = model.transform(mv_events(spark, SMALL)).where("user_id = 5")._jdf.queryExecution().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "EqualTo(user_id,5)" in pushed
    flagged = flag_rows(model, mv_events(spark, SMALL), 0.03).where("is_anomaly")
    assert flagged.count() == 30


def test_null_categories_can_be_fitted(spark):
    view = mv_events(spark, SMALL).withColumn("cats", F.when(F.col("key") == "3", F.array(F.lit(None).cast("int"), F.lit(1)))
                                              .otherwise(F.col("cats")))
    assert fit(view, k=1, max_iterations=3, handle_unseen="zero").w is not None
    wide = fit(mv_events(spark, SMALL), k=1, max_iterations=3, loose=True)
    assert wide.profile.slots > fit(mv_events(spark, SMALL), k=1, max_iterations=3).profile.slots


def test_a_cluster_needs_the_shared_folder():
    session = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *_: None),
                                    sparkContext=types.SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_path(session, "x")


def test_siblings_differ_in_the_last_part_only():
    assert libsvm.sibling_path("/data/training/set_train", "dev") == "/data/training/set_dev"
    assert libsvm.sibling_path("train.libsvm", "test") == "test.libsvm"


def test_libsvm_keys_do_not_depend_on_splits(spark, tmp_path):
    rows = [(float(i % 2), i % 3, i % 4) for i in range(40)]
    view = spark.createDataFrame(rows, "label double, a int, b int").select(
        "label", F.array("a").alias("cats"), F.array(F.col("b").cast("double")).alias("nums"))
    path = str(tmp_path / "set")
    libsvm.write_libsvm(view.repartition(3), path)
    keys = []
    for split in (1, 7, 10**6):
        got = libsvm.read_libsvm(spark, path, 1, 2, split)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        keys.append(sorted((r.key, r.label, tuple(r.cats), tuple(r.nums)) for r in got.collect()))
    assert keys[0] == keys[1] == keys[2] and len({k[0] for k in keys[0]}) == 40
    assert sorted((k[1], k[2][0], int(k[3][0])) for k in keys[0]) == sorted(rows)
    assert libsvm.read_libsvm(spark, path, 1).count() == 40


def test_lines_of_odd_files(spark, tmp_path):
    text = b"1 1:2 3:4.5\n\n# note\n0\r\n1 2:-1e3"
    (tmp_path / "odd").write_bytes(text)
    for split in (1, 5, 100):
        got = {r.key: (r.label, list(r.cats), list(r.nums)) for r in libsvm.read_libsvm(
            spark, str(tmp_path / "odd"), 1, split_bytes=split).collect()}
        assert got == {":0": (1, [2], [0.0, 4.5]), ":20": (0, [0], [0.0, 0.0]), ":23": (1, [0], [-1000.0, 0.0])}
    (tmp_path / "bad").write_bytes(b"1 2:1 1:1\n")
    with pytest.raises(Exception, match="ascend"):
        libsvm.read_libsvm(spark, str(tmp_path / "bad"), 1, 2).collect()
    (tmp_path / "none").write_bytes(b"")
    assert libsvm.read_libsvm(spark, str(tmp_path / "none"), 1, 2).count() == 0


def test_long_values_never_reach_the_driver(spark, monkeypatch):
    monkeypatch.setattr(category, "BROADCAST_CHARS", 50)
    df = spark.createDataFrame([("x" * 40,), ("y" * 40,)], "c string")
    assert category.fit_categories(df, ["c"]) is None
    assert category.fit_categories(df.limit(1), ["c"]) == {"c": ["x" * 40]}


def test_ranks_of_values_in_ranges(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("v"))
    got = ranked_values(values.repartition(7), "v", "r").collect()
    assert all(r.v == f"v{r.r:05d}" for r in got) and len(got) == 5000
    assert ranked_values(values.limit(0), "v", "r").count() == 0


def test_frequent_long_values_are_salted(spark, monkeypatch):
    monkeypatch.setattr(ordered, "HOT_CHARS", 3)
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "frequent").when(F.col("id") % 3 == 1, "hot").otherwise(
        F.concat(F.lit("w"), F.col("id").cast("string"))).alias("c"))
    got = {r.id: r.c_idx for r in ordered.dense_index(df, "c", "c_idx").collect()}
    names = sorted({r.c for r in df.collect()})
    assert len(got) == 3000 and all(names[got[r.id]] == r.c for r in df.collect())


def test_no_rows_give_no_minibatch(spark):
    empty = spark.createDataFrame([], "key string")
    with pytest.raises(ValueError, match="no rows"):
        minibatch_sample(empty, 1000, 10)


def test_redraws_until_a_row_is_taken(spark):
    df = spark.range(3).select(F.col("id").cast("string").alias("key"))
    rows, attempt = minibatch_sample(df, 100, 1, "mb", 5)  # chances of 1 in 100
    assert rows.count() >= 1 and attempt > 0
    for a in range(attempt):
        assert not df.where(uniform(F.col("key"), "mb", 5, a) < 0.01).count()
