"""Rows small enough to work by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mixspark.functions.rand import uniform, uniform_value
from mixspark.operators import encode as en, evalset as es, evaluate as ev
from mixspark.operators import logistic as lg, mixture as mx, profile as pf, sample as sm, score as sc

SCHEMA = "key string, cats array<int>, nums array<double>, label int"


def view(spark, rows):
    return spark.createDataFrame(
        [(str(i), list(c), [float(x) for x in n], l) for i, (c, n, l) in enumerate(rows)], SCHEMA)


def test_uniform(spark):
    got = spark.createDataFrame([("k1",), ("k2",)], "k string").select(uniform(F.col("k"))).collect()
    for row, key, want in zip(got, ("k1", "k2"), (0.7117873118259013, 0.380402168026194)):
        assert abs(row[0] - want) < 2**-32
        assert row[0] == uniform_value(key)


def test_scale(spark):
    v = view(spark, [((0,), (2, 5), 0), ((1,), (4, 5), 0), ((0,), (6, 5), 0)])
    p = pf.profile(v)
    got = [r["nums"] for r in en.encode(v, p).orderBy("key").collect()]
    assert np.allclose(got, [[0, 0], [0.5, 0], [1, 0]], atol=1e-12)
    assert (p.n, p.cat_max, p.num_min, p.num_max) == (3, (1,), (2.0, 5.0), (6.0, 5.0))


def test_one_hot(spark):
    p = pf.Profile(1, (2, 1), (), ())
    assert (p.slots, p.combinations, p.offsets) == (5, 6.0, (0, 3))
    assert pf.Profile(1, (3, 1), (), ()).loose().widths == (5, 2)
    v = view(spark, [((1, 0), (), 0)])
    bits = en.one_hot(en.slot_array(F.col("cats"), p), 5)
    row = v.select(bits.alias("b"), en.with_bias(bits).alias("c")).first()
    assert row["b"] == [0, 1, 0, 1, 0]
    assert row["c"] == [0, 1, 0, 1, 0, 1]


W = np.array([0.4, -0.2, 0.1, 0.3, -0.1, 0.2, 0.0])


def one_row(spark):
    return view(spark, [((1, 0), (0.5, 0.25), 0)]).withColumn("slots", F.lit(np.array([1, 3], "int32")))


def test_categorical_score(spark):
    row = lg.add_log_prob(one_row(spark), W, 2, 2).first()
    assert row["score_cat"] == pytest.approx(-3.341987217, abs=1e-9)
    batch = lg.log_prob_batch(np.array([[0.5, 0.25]]), [[1, 3]], W[None], 2, np.ones(1))
    assert batch[0, 0] == pytest.approx(-3.341987217, abs=1e-9)


GRADIENT = [0.080936, 0.040468, 0.112435, -0.077872, 0.102499, -0.082676, 0.107486]


def test_full_gradient_and_update(spark):
    masked = en.masked_all(one_row(spark), 5)
    grad, n = lg.gradient(masked, W, 2)
    assert n == 5 and np.allclose(grad, GRADIENT, atol=1e-6)
    rows = lg.gradient_rows(masked, W, 2).orderBy("idx").collect()
    assert np.allclose([r["grad"] for r in rows], GRADIENT, atol=1e-6)
    wide = {r["idx"]: r["g"] for r in lg._slot_sums_wide(masked, W, 2, 1.0).collect()}
    assert wide.pop(-1) == 5
    assert np.allclose([wide[i] / 5 for i in range(7)], GRADIENT, atol=1e-6)
    new = lg.update(W, grad, 1.0, 1.0)
    assert np.allclose(
        new, [0.016692, -0.089282, -0.088028, 0.151093, -0.126907, 0.131491, -0.107486], atol=1e-6)


def test_learning_rate():
    p = lg.LogisticParams()
    assert [round(lg.learning_rate(p, i), 6) for i in (1, 2, 11)] == [1.0, 0.909091, 0.5]


def test_mixture_target():
    assert sm.mixture_target(4, 0.03) == pytest.approx(910.263, abs=1e-3)
    assert sm.mixture_target(4, 0.01) == pytest.approx(2758.703, abs=1e-3)


def test_unweighted_mixture(spark):
    m = mx.Mixture(np.array([0.5, 0.5]), np.zeros((2, 1)), np.ones((2, 1, 1)))
    v = view(spark, [((), (0,), 0)])
    row = mx.add_log_density(mx.add_log_density(v, m), m, weighted=True, out="w").first()
    assert row["score_num"] == pytest.approx(-0.225791, abs=1e-6)
    assert row["w"] == pytest.approx(-0.918939, abs=1e-6)


@pytest.mark.parametrize("ratio,k", [(0.03, 3), (0.001, 1), (0.5, 50)])
def test_exact_threshold(spark, ratio, k):
    s = spark.range(1, 101).select(F.col("id").cast("double").alias("score"))
    assert sc.threshold_exact(s, ratio) == (float(k), k, 100)
    flags = [sc.flag(s, float(k), inc).where("is_anomaly").count() for inc in (True, False)]
    assert flags == [k, k - 1]


def scores(spark, rows):
    return spark.createDataFrame(rows, "score double, positive double")


def test_auroc(spark):
    row = ev.auroc(scores(spark, [(.1, 0.), (.1, 1.), (.2, 1.), (.05, 0.)])).first()
    assert row["auroc"] == pytest.approx(0.875) and row["warning"] is None
    for p in (0.0, 1.0):
        row = ev.auroc(scores(spark, [(.1, p), (.2, p)])).first()
        assert row["auroc"] is None and row["warning"] == "one class only"
    with pytest.raises(ValueError):
        ev.auroc(scores(spark, [(float("nan"), 0.), (.1, 1.)]))


def test_best_or_inverted(spark):
    means = spark.createDataFrame([(0, .6), (1, .7), (2, .2)], "combo int, auroc double")
    assert tuple(ev.best_params(means).first()) == (2, 0.2, True)
    ties = spark.createDataFrame([(0, .6), (1, .7), (2, .7), (3, .6)], "combo int, auroc double")
    assert tuple(ev.best_params(ties).first()) == (1, 0.7, False)


def test_grid_order():
    points = ev.grid_points()
    assert len(points) == 25
    assert [p["reg"] for p in points[:6]] == [0.1] * 5 + [1.0]
    with pytest.raises(ValueError):
        ev.grid_points(radius=[1])


def test_generator_formulas(spark):
    assert [round(es.decaying_probability(i), 6) for i in range(3)] == [0.666667, 0.5, 0.4]
    df = spark.createDataFrame([([1, 0, 1, 1],)], "bits array<int>")
    p = df.select(es.shares(F.col("bits"), [[1, 1, 0, 1], [1, 0, 0, 1]])).first()[0]
    assert p == pytest.approx([2 / 3, 1.0])


def test_convergence_log():
    info = np.finfo(float)
    assert lg.convergence_log(lg.Trained(np.zeros(1), [], True)) == [info.min] * 5
    assert lg.convergence_log(lg.Trained(np.zeros(1))) == [info.max] * 5
    h = [(i, 1.0, math.exp(i), 1) for i in range(1, 8)]
    assert lg.convergence_log(lg.Trained(np.zeros(1), h)) == pytest.approx([3, 4, 5, 6, 7])


def test_stops_when_quiet():
    n = 40
    x, slot = np.zeros((n, 1)), np.zeros(n, dtype=int)
    z = np.ones(n)
    w0 = np.array([0.0, 60.0])  # the slot is certain: no gradient
    t = lg.run_steps(x, slot, z, np.arange(n), w0, 1, [lg.LogisticParams(reg=0.0)], n)[0]
    assert t.converged and len(t.history) == lg.QUIET_STEPS


def test_unseen_category(spark):
    p = pf.Profile(1, (1,), (0.0,), (1.0,))
    v = view(spark, [((5,), (0.5,), 0)])
    assert en.encode(v, p, handle_unseen="zero").first()["slots"] == [None]
    with pytest.raises(Exception, match="outside 0..1"):
        en.encode(v, p).collect()
    scored = lg.add_log_prob(en.encode(v, p, handle_unseen="zero"), [0.4, 0.1, 0.3], 1, 1).first()
    m = np.array([0.3, 0.5])
    assert scored["score_cat"] == pytest.approx(-np.logaddexp(0, m).sum())


def test_bad_input(spark):
    with pytest.raises(ValueError, match="integers from 0"):
        pf.profile(view(spark, [((-1,), (0.5,), 0)]))
    with pytest.raises(ValueError):
        es.draft_rules(spark.range(1), 1)
    with pytest.raises(ValueError):
        es.category_flip(view(spark, [((0,), (0.5,), 0)]), 1)
