"""Cross-validation, tuning and files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixspark.operators import evaluate as ev, mixture as mx, profile as pf
from mixspark.plans import evalset as pe, search
from mixspark.plans.model import MixedModel
from mixspark.sources import libsvm
from mixspark.sources.scratch import scratch_path

GRID = dict(k=[1, 2], reg=[0.1, 1000.0], lr_speed=[0.1])


@pytest.fixture(scope="module")
def labelled(spark):
    return pe.build(spark, 400, 300, 300, 4, 3, 4, fraction=0.2, m=4, seed=5).cache()


def test_cross_validation(spark, labelled):
    rows = labelled.where("split <> 'train'")
    report = search.cross_validate(rows, folds=3, max_iterations=20, **GRID)
    res = report.results.toPandas()
    assert len(res) == 12 and res["auroc"].notna().all()
    assert report.best["auroc"] > 0.7 and not report.best["inverted"]
    sizes = report.sizes.toPandas()
    assert sizes["n_test"].sum() == 600 and (sizes["n_train"] + sizes["n_test"] == 600).all()
    assert (res["n_pos"] + res["n_neg"]).sum() == 4 * 600
    again = search.cross_validate(rows.repartition(3), folds=3, max_iterations=20, **GRID)
    assert np.allclose(res["auroc"], again.results.toPandas()["auroc"], atol=1e-9)


def test_grid_scores_equal_single_model_scores(spark, labelled):
    v = labelled.where("split = 'dev'")
    p = pf.profile(v)
    r = np.random.default_rng(0)
    models = [{
        "combo": c, "grp": 0, "k": 1, "lam": lam, "w": r.normal(size=p.d + p.slots),
        "mixture": mx.Mixture(np.ones(1), np.full((1, p.d), 0.5), np.eye(p.d)[None] * 0.1),
    } for c, lam in enumerate((1.0, 2.0))]
    rows = search._prepare(v, p).withColumn("test_in", F.lit(0))
    got = search.score_grid(rows, {0: p}, models).groupBy("combo").agg(F.sum("score").alias("s"))
    got = {x["combo"]: x["s"] for x in got.collect()}
    for m in models:
        one = MixedModel(p, m["w"], m["mixture"], m["lam"], floor=1e-9).transform(v)
        assert got[m["combo"]] == pytest.approx(one.agg(F.sum("score")).first()[0], rel=1e-9)


def test_a_fit_depends_neither_on_solver_nor_on_neighbours(spark, labelled):
    v = labelled.where("split = 'train'")
    p = pf.profile(v)
    rows = search._prepare(v, p).withColumn("train_in", F.when(F.col("label") == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array().cast("array<int>")))
    n = v.where("label = 0").count()
    profs, sizes = {0: p, 1: p}, {0: n, 1: n}

    def run(solver="auto", **grid):
        found = search.fit_grid(rows, profs, sizes, ev.grid_points(**grid), 6, 50, 3, "std", 1e-9, solver)
        return {(m["k"], m["grp"], ev.grid_points(**grid)[m["combo"]]["reg"]): m for m in found}

    alone = run(k=[2], reg=[1.0], lr_speed=[0.1])
    pooled = run("pooled", k=[2], reg=[1.0], lr_speed=[0.1])
    among = run(k=[1, 2, 4], reg=[0.1, 1.0], lr_speed=[0.1])
    for key, m in alone.items():
        for other in (pooled[key], among[key]):
            assert np.abs(other["w"] - m["w"]).max() < 1e-12
            assert np.allclose(other["mixture"].mu, m["mixture"].mu, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("scope", ["train", "each"])
def test_tune(spark, labelled, scope, tmp_path):
    report = search.tune(labelled, max_iterations=20, profile_scope=scope, **GRID)
    auroc = report.test.first()["auroc"]
    # Scaling the test rows by their own limits hides part of what makes them differ.
    assert auroc > (0.7 if scope == "train" else 0.5)
    assert report.scored.count() == 300
    report.write(str(tmp_path / "report"))
    best = spark.read.parquet(str(tmp_path / "report" / "best")).first()
    assert best["auroc"] == report.best["auroc"]


def test_diverged_fits_rank_nothing(spark, labelled):
    report = search.tune(labelled, max_iterations=60, k=[1], reg=[1.0, 1e12], lr_start=[1.0],
                         lr_speed=[0.0001])
    by = {r["reg"]: r["auroc"] for r in report.results.collect()}
    assert by[1.0] > 0.7 and by[1e12] == 0.5


def test_one_class_only(spark, labelled):
    clean = labelled.where("label = 0")
    with pytest.raises(ValueError, match="one class"):
        search.cross_validate(clean, folds=2, max_iterations=4, k=[1], reg=[1.0], lr_speed=[0.1])


def test_libsvm_files(spark, labelled, tmp_path):
    train = str(tmp_path / "set_train.libsvm")
    for s in ("train", "dev", "test"):
        libsvm.write_libsvm(labelled.where(F.col("split") == s), libsvm.sibling_path(train, s))
    back = libsvm.read_splits(spark, train, 7, 11)
    assert back.select("key").distinct().count() == 1000
    for s in ("train", "dev", "test"):
        a, b = labelled.where(F.col("split") == s), back.where(F.col("split") == s)
        total = F.sum(F.aggregate("nums", F.lit(0.0), lambda t, x: t + x))
        ones = F.sum(F.aggregate("cats", F.lit(0), lambda t, x: t + x))
        x, y = (v.agg(F.count("*"), F.sum("label"), ones, total).first() for v in (a, b))
        assert x[:3] == y[:3] and x[3] == pytest.approx(y[3])
    inferred = libsvm.read_libsvm(spark, train, 7)
    assert inferred.count() == 400
    p = pf.profile(labelled)
    model = MixedModel(p, np.zeros(p.d + p.slots), mx.Mixture(
        np.ones(1), np.zeros((1, p.d)), np.eye(p.d)[None]))
    scored = model.transform(labelled.where("split = 'test'"))
    libsvm.export_scored(scored, str(tmp_path / "out"), "libsvm")
    out = spark.read.format("libsvm").option("numFeatures", 12).load(str(tmp_path / "out"))
    assert out.where("label = 1").count() == scored.where("label = 1").count() > 0


def test_scratch_path_follows_the_session(spark):
    class Session:
        def __init__(self, **settings):
            self.conf = {k.replace("_", "."): v for k, v in settings.items()}

    assert scratch_path(Session(spark_checkpoint_dir="/shared/"), "x").startswith("/shared/x-")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_timing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "seconds double")
    assert tuple(ev.timing(df).first()) == (2, 4.0, 2.0)
