"""Fits in rounds: the same over any number of tasks, in one job, job by job, and after a lost task."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixspark.operators import evaluate as ev, logistic as lg, mixture as mx, profile as pf, rounds
from mixspark.plans import evalset as pe, search


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(150, 3)) * 0.5 + c for c in (0, 2, 5)])
    rows = [(g, k, str(i), v.tolist()) for g in (0, 1) for k in (1, 3) for i, v in enumerate(x + g)]
    df = spark.createDataFrame(rows, "grp int, k int, key string, nums array<double>").withColumn(
        "u", F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("bigint") / 2.0**32)
    return df.cache()


def alone(df, key):
    rows = df.where((F.col("grp") == key[0]) & (F.col("k") == key[1])).toPandas()
    return mx.fit_batch(np.stack(rows["nums"]), rows["u"].to_numpy(), key[1])


@pytest.mark.parametrize("tasks,one_job", [(1, True), (4, True), (3, False)])
def test_mixtures_depend_neither_on_tasks_nor_on_jobs(blobs, monkeypatch, tasks, one_job):
    monkeypatch.setattr(mx, "tasks_for", lambda *_: tasks)
    keys = [(0, 1), (0, 3), (1, 3)]
    found = mx.fit_mixtures(blobs, keys, 3, 1800, mx.FitOptions(), one_job=one_job)
    for key in keys:
        want, got = alone(blobs, key), found[key]
        assert got.iterations == want.iterations and got.attempt == want.attempt == 0
        for a, b in ((got.centres, want.centres), (got.mixture.mu, want.mixture.mu),
                     (got.mixture.sigma, want.mixture.sigma), (got.mixture.weights, want.mixture.weights)):
            assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
        assert got.seconds > 0


def test_many_messages_are_merged_in_tasks(blobs, monkeypatch):
    monkeypatch.setattr(mx, "tasks_for", lambda *_: 5)
    monkeypatch.setattr(rounds, "FAN_IN", 2)
    got = mx.fit_mixtures(blobs, [(0, 3)], 3, 450, mx.FitOptions(max_iter=3), one_job=False)[0, 3]
    rows = blobs.where("grp = 0 and k = 3").toPandas()
    want = mx.fit_batch(np.stack(rows["nums"]), rows["u"].to_numpy(), 3, max_iter=3)
    assert np.allclose(got.mixture.mu, want.mixture.mu, rtol=1e-9)


def test_a_lost_task_starts_the_stage_again(blobs, monkeypatch, tmp_path):
    monkeypatch.setattr(mx, "tasks_for", lambda *_: 3)
    mark, real = str(tmp_path / "lost"), mx.Fits.message

    def failing(self, blocks):
        self.calls = getattr(self, "calls", 0) + 1
        if self.calls == 5:  # in the middle of the first attempt, by whichever task comes first
            try:
                os.close(os.open(mark, os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                pass
            else:
                os._exit(1)
        return real(self, blocks)

    monkeypatch.setattr(mx.Fits, "message", failing)
    got = mx.fit_mixtures(blobs, [(0, 3)], 3, 450, mx.FitOptions(), one_job=True)[0, 3]
    assert os.path.exists(mark)
    monkeypatch.setattr(mx.Fits, "message", real)
    assert np.allclose(got.mixture.mu, alone(blobs, (0, 3)).mixture.mu, rtol=1e-9)


def test_failed_fits_start_again_and_the_others_go_on(blobs):
    singular = mx.Mixture(np.ones(1), np.zeros((1, 3)), np.zeros((1, 3, 3)))
    found = mx.fit_mixtures(blobs, [(0, 3), (1, 3)], 3, 900, mx.FitOptions(), starts={(0, 3): singular})
    assert (found[0, 3].attempt, found[1, 3].attempt) == (1, 0) and len(found[0, 3].failures) == 1
    with pytest.raises(RuntimeError, match="no rows"):
        mx.fit_mixtures(blobs, [(7, 3)], 3, 900, mx.FitOptions())
    same = blobs.withColumn("nums", F.array(*[F.lit(1.0)] * 3))
    with pytest.raises(RuntimeError, match="20 attempts: a component has no variance"):
        mx.fit_mixtures(same, [(0, 3)], 3, 900, mx.FitOptions())


def test_kmeans_ends_with_the_means_of_its_rows(spark, blobs):
    sample = blobs.where("grp = 0 and k = 3")
    centres = mx.kmeans(sample, 3, 1, max_iter=50)
    near = mx.assign(sample, centres.tolist()).groupBy("comp").agg(*[F.avg(F.col("nums")[j]) for j in range(3)]).collect()
    for r in near:
        assert np.allclose(r[1:], centres[r["comp"]], atol=1e-3)
    assert len(mx.kmeans(sample.limit(0).union(spark.createDataFrame(
        [(0, 3, "a", [1.0] * 3, 0.1), (0, 3, "b", [1.0] * 3, 0.2)], sample.schema)), 3, 1)) == 1


def test_deviation_forms(spark):
    df = spark.createDataFrame([([0.0],), ([2.0],), ([4.0],), ([10.0],)], "nums array<double>")
    near = mx.assign(df, [[2.0], [10.0]])
    rms, summed = ({r["comp"]: r["dev"][0] for r in mx.cluster_deviation(near, [[2.0], [10.0]], f).collect()}
                   for f in ("rms", "summed"))
    assert rms[0] == pytest.approx((8 / 3) ** 0.5) and summed[0] == pytest.approx(8**0.5 / 3) and rms[1] == summed[1] == 0
    with pytest.raises(ValueError):
        mx.cluster_deviation(near, [[2.0], [10.0]], "mean")


@pytest.mark.parametrize("tasks", [2, 5])
def test_training_over_tasks(spark, monkeypatch, tasks):
    pool = spark.createDataFrame(
        [(g, it, [float((i * 7 + it) % 11) / 11, float(i % 3)], (i * it) % 4, 1 if i % 3 else -1)
         for g in (0, 1) for it in range(1, 8) if it != 4 for i in range(40)],
        "grp int, it int, nums array<double>, slot int, z int")
    params = [lg.LogisticParams(), lg.LogisticParams(10.0, 0.5)]
    w0 = {g: lg.init_weights(6, g) for g in (0, 1)}
    want = {(r["combo"], r["grp"]): lg.trained_from_row(r) for r in lg.train_pooled(pool, w0, 2, params, 6).collect()}
    monkeypatch.setattr(lg, "tasks_for", lambda *_: tasks)
    for one_job in (True, False):
        got = lg.train_together(pool, w0, 2, params, 6, 7, 480, one_job=one_job)
        for key, t in got.items():
            assert np.abs(t.w - want[key].w).max() < 1e-12 and len(t.history) == 6 and t.seconds > 0
    with pytest.raises(RuntimeError, match="drawn steps had rows"):
        lg.train_together(pool, w0, 2, params, 7, 7, 480)


@pytest.mark.parametrize("flip", [False, True])
def test_interval_counts_give_the_area_of_all_scores(spark, flip):
    view = pe.build(spark, 10, 300, 10, 4, 3, 4, fraction=0.2, m=4, seed=5).where("split = 'dev'")
    if flip:
        view = view.withColumn("label", 1 - F.col("label"))
    p = pf.profile(view)
    r = np.random.default_rng(0)
    models = [{
        "combo": c, "grp": g, "k": 1, "lam": 1.0, "w": r.normal(size=p.d + p.slots) * (c < 2),
        "mixture": mx.Mixture(np.ones(1), np.full((1, p.d), 0.5), np.eye(p.d)[None] * 0.1),
    } for c in range(3) for g in (0, 1)]
    models[0]["w"] = models[0]["w"] * np.nan  # a diverged fit
    rows = search._prepare(view, p).withColumn("test_in", (F.crc32("key") % 2).cast("int"))
    profs = {0: p, 1: p}
    fast = search.grid_auroc(rows, profs, models, 300)
    whole = search.grid_auroc(rows, profs, models, 300, rare_cells=0)
    assert set(fast) == set(whole) == {(c, g) for c in range(3) for g in (0, 1)}
    for key, found in fast.items():
        assert found[0] == pytest.approx(whole[key][0], abs=1e-12) and found[1:] == tuple(whole[key][1:])
    assert fast[0, 0][0] == 0.5
    one = search.grid_auroc(rows.where("label = 0"), profs, models, 300)
    assert all(v[0] is None and v[3] == "one class only" for v in one.values())
    bad = rows.withColumn("nums", F.array(*[F.lit(None).cast("double")] * p.d))
    with pytest.raises(Exception, match="missing or not a number"):
        search.grid_auroc(bad, profs, models, 300)


def test_results_of_a_search_tell_their_seconds(spark):
    view = pe.build(spark, 10, 300, 10, 4, 3, 4, fraction=0.2, m=4, seed=5).where("split = 'dev'")
    report = search.cross_validate(view, folds=2, max_iterations=4, k=[1], reg=[0.1, 1.0], lr_speed=[0.1], loose=True,
                                   init="zeros", deviation="summed")
    total = ev.timing(report.results).first()
    assert total["fits"] == 4 and 0 < total["total_seconds"] <= report.seconds
