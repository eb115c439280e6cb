"""Operators against brute force, other partitionings and Spark's own library."""

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from mixspark import queries as q
from mixspark.operators import category, encode as en, evalset as es, evaluate as ev
from mixspark.operators import logistic as lg, mixture as mx, ordered, profile as pf, sample as sm
from mixspark.plans import evalset as pe
from mixspark.plans.detect import detect, flag_rows
from mixspark.plans.model import MixedModel, fit

RNG = np.random.default_rng(5)


def frame(spark, n=400, d=2, seed=0, widths=(3, 4)):
    r = np.random.default_rng(seed)
    rows = [(f"k{i}", [int(r.integers(w)) for w in widths], r.normal(size=d).tolist(),
             int(r.random() < 0.1)) for i in range(n)]
    return spark.createDataFrame(rows, "key string, cats array<int>, nums array<double>, label int")


# ---- ordered work ----------------------------------------------------------------------------

@pytest.mark.parametrize("values", [
    RNG.normal(size=30_000),
    np.where(RNG.random(30_000) < 0.4, 0.25, RNG.normal(size=30_000)),
    RNG.integers(0, 7, 30_000).astype(float),
    np.concatenate([np.full(10_000, -np.inf), RNG.random(20_000)]),
])
@pytest.mark.parametrize("k", [1, 17, 900, 15_000, 30_000])
def test_kth_lowest(spark, values, k):
    df = spark.createDataFrame([(float(v),) for v in values], "s double").cache()
    want = np.sort(values)[k - 1]
    assert ordered.kth_lowest(df, "s", k, small=50)[0] == want


def test_kth_lowest_of_large_integers(spark):
    df = spark.range(3000).select((F.col("id") * 7 + 2**60).alias("s"))
    for k in (1, 1500, 3000):
        assert ordered.kth_lowest(df, "s", k, small=20)[0] == 2**60 + 7 * (k - 1)


def test_dense_index_with_a_hot_value(spark):
    values = ["hot"] * 700 + [f"v{i % 300:03d}" for i in range(1300)] + [None] * 3
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    rank = {v: i for i, v in enumerate(sorted(set(x for x in values if x)))}
    got = {r["id"]: r["i"] for r in ordered.dense_index(df, "v", "i").collect()}
    assert len(got) == len(values)
    assert all(got[i] == (rank[v] if v else None) for i, v in enumerate(values))
    small = category.index_categories(df, ["v"]).collect()
    assert all(r["v_idx"] == got[r["id"]] for r in small)


@pytest.mark.parametrize("order", ["id", "text"])
def test_split_by_position(spark, order):
    df = spark.range(1000).withColumn("text", F.format_string("%05d", "id")).repartition(7)
    got = es.split_by_position(df, 500, 300, 150, order).groupBy("split").agg(
        F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()
    assert {r["split"]: (r["n"], r["lo"], r["hi"]) for r in got} == {
        "train": (500, 0, 499), "dev": (300, 500, 799), "test": (150, 800, 949)}


# ---- AUROC -----------------------------------------------------------------------------------

def test_auroc_against_the_library(spark, monkeypatch):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    s = np.round(RNG.normal(size=5000), 1) + 0.0  # no -0.0: the library takes it for another score
    s[:1700] = 0.3  # a third of the rows share a score
    rows = [(float(x), float(RNG.random() < 1 / (1 + np.exp(-x))), i % 3) for i, x in enumerate(s)]
    df = spark.createDataFrame(rows, "score double, positive double, g int").repartition(5)
    library = BinaryClassificationEvaluator(
        rawPredictionCol="score", labelCol="positive", numBins=0)
    got = ev.auroc(df).first()["auroc"]
    assert got == pytest.approx(library.evaluate(df), abs=1e-12)
    p = np.array([r[1] for r in rows]) == 1
    pairs = (s[p][:, None] > s[~p]).mean() + (s[p][:, None] == s[~p]).mean() / 2
    assert got == pytest.approx(pairs, abs=1e-12)
    flipped = ev.auroc(df.withColumn("score", -F.col("score"))).first()["auroc"]
    assert flipped == pytest.approx(1 - got, abs=1e-12)
    by = {r["g"]: r["auroc"] for r in ev.auroc(df, ("g",)).collect()}
    for g in range(3):
        assert by[g] == pytest.approx(library.evaluate(df.where(F.col("g") == g)), abs=1e-12)
    monkeypatch.setattr(ev, "RARE_ROWS", 0)  # the path for two large classes
    assert ev.auroc(df).first()["auroc"] == pytest.approx(got, abs=1e-12)
    for r in ev.auroc(df, ("g",)).collect():
        assert r["auroc"] == pytest.approx(by[r["g"]], abs=1e-12)
    # Edges balance the work only.
    odd = ev.auroc(df, edges=[-5.0, 0.3, 0.31]).first()["auroc"]
    assert odd == pytest.approx(got, abs=1e-12)


# ---- sampling --------------------------------------------------------------------------------

@pytest.mark.parametrize("f", [1.0, 0.4, 0.02])
def test_draws_are_independent_per_step(spark, f):
    n, steps = 2000, 30
    df = spark.range(n).select(F.col("id").cast("string").alias("key"))
    df = df.withColumn("in", F.array(F.lit(3), F.lit(8)))
    got = sm.draw_steps(df, steps, f, "t", 1, groups=F.col("in")).toPandas()
    assert not got.duplicated(["key", "grp", "it"]).any()
    counts = got.groupby(["grp", "it"]).size()
    assert len(counts) == 2 * steps
    sd = max(np.sqrt(n * f * (1 - f)), 1e-9)
    assert (np.abs(counts - n * f) <= 5 * sd).all()
    taken = df.where(sm.may_draw(steps, f, "t", 1, groups=F.col("in"))).count()
    assert taken == got["key"].nunique()


def test_draw_rates_per_group(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    df = df.withColumn("in", F.array(F.lit(0), F.lit(1)))
    got = sm.draw_steps(df, 5, 0.1, "r", groups=F.col("in"), rates={0: 0.1, 1: 0.05})
    n = {r["grp"]: r["count"] for r in got.groupBy("grp").count().collect()}
    assert abs(n[0] - 10_000) < 500 and abs(n[1] - 5000) < 400


def test_partitioning_does_not_matter(spark):
    v = q.mv_events(spark, SMALL)
    a = fit(v.repartition(1), max_iterations=20, seed=3)
    b = fit(v.repartition(8), max_iterations=20, seed=3)
    assert np.allclose(a.w, b.w, atol=1e-12)
    assert np.allclose(a.mixture.mu, b.mixture.mu, atol=1e-9)


# ---- slot model ------------------------------------------------------------------------------

@pytest.mark.parametrize("minibatch", [40, 5000])
def test_solvers_agree(spark, minibatch):
    v = frame(spark)
    p = pf.profile(v)
    e = en.encode(v, p)
    run = [lg.train(e, p.n, p.d, p.slots, lg.LogisticParams(), 8, minibatch, 2, solver=s)
           for s in ("pooled", "aggregate", "barrier", "auto")]
    for other in run[1:]:
        assert np.allclose(run[0].w, other.w, atol=1e-12)
        assert np.allclose([h[1:] for h in run[0].history], [h[1:] for h in other.history])
    assert len(run[0].history) == 7


def test_small_minibatches_skip_empty_steps(spark):
    v = frame(spark, n=60)
    p = pf.profile(v)
    t = lg.train(en.encode(v, p), p.n, p.d, p.slots, lg.LogisticParams(), 20, 1, 4)
    assert len(t.history) == 19 and all(h[3] >= 1 for h in t.history)


def test_all_slots_training(spark):
    v = frame(spark, n=100)
    p = pf.profile(v)
    t = lg.train(en.encode(v, p), p.n, p.d, p.slots, lg.LogisticParams(), 4, 1000, slots="all")
    assert [h[3] for h in t.history] == [100 * p.slots] * 3


@pytest.mark.parametrize("scale,spread", [(0.5, 1), (3, 50), (20, 1), (20, 1000), (400, 50)])
def test_categorical_score_against_brute_force(spark, scale, spread):
    v = frame(spark, n=200, widths=(9, 5, 7))
    e = en.encode(v, pf.profile(v))
    r = np.random.default_rng(1)
    w = np.concatenate([r.normal(size=2) * spread, r.normal(size=21) * scale])
    rows = lg.add_log_prob(e, w, 2, 3, 0.7).toPandas()
    m = (np.stack(rows["nums"]) @ w[:2])[:, None] + w[2:]
    z = -np.ones_like(m)
    for i, s in enumerate(rows["slots"]):
        z[i, list(s)] = 1
    want = -np.logaddexp(0, -z * m / 0.7).sum(axis=1)
    assert np.allclose(rows["score_cat"], want, rtol=1e-12, atol=1e-12)
    batch = e.select(lg.log_prob_slots(F.col("nums"), F.col("slots"), w, 2, 0.7)).toPandas()
    assert np.allclose(batch.iloc[:, 0], rows["score_cat"], rtol=1e-12, atol=1e-12)


def test_wide_rows(spark):
    v = frame(spark, n=300, d=70, widths=(60, 90))
    p = pf.profile(v)
    assert p.d == 70 and p.n == 300
    model = fit(v, k=2, max_iterations=6, minibatch=50)
    rows = model.transform(v).toPandas()
    x = (np.stack(rows["nums"]) - np.array(p.num_min)) / np.array(p.spans)
    slots = [[c[0], p.widths[0] + c[1]] for c in rows["cats"]]
    want = lg.log_prob_batch(x, slots, model.w[None], 70, np.ones(1))[:, 0]
    want = want + mx.log_density_batch(x, model.mixture.roots(1e-9), model.mixture.mu)
    assert np.allclose(rows["score"], want)
    slow = fit(v, k=2, max_iterations=6, minibatch=50, solver="aggregate")
    assert np.allclose(model.w, slow.w, atol=1e-12)


def test_indicators(spark):
    v = frame(spark, n=200, widths=(2, 2, 2))
    p = pf.profile(v, encoding="indicator")
    assert (p.slots, p.combinations) == (3, 8.0)
    model = fit(v, k=2, max_iterations=8, encoding="indicator")
    rows = model.transform(v).toPandas()
    x = (np.stack(rows["nums"]) - np.array(p.num_min)) / np.array(p.spans)
    m = (x @ model.w[:2])[:, None] + model.w[2:]
    z = 2 * np.stack(rows["cats"]) - 1
    assert np.allclose(rows["score_cat"], -np.logaddexp(0, -z * m).sum(axis=1))
    with pytest.raises(ValueError, match="0 or 1"):
        pf.profile(frame(spark), encoding="indicator")


def test_no_numerics_or_no_categoricals(spark):
    v = frame(spark, n=200)
    cats = v.withColumn("nums", F.array().cast("array<double>"))
    assert np.isfinite(fit(cats, max_iterations=5).transform(cats).toPandas()["score"]).all()
    nums = v.withColumn("cats", F.array().cast("array<int>"))
    scored = fit(nums, k=2, max_iterations=5).transform(nums).toPandas()
    assert (scored["score_cat"] == 0).all() and np.isfinite(scored["score"]).all()


# ---- mixture ---------------------------------------------------------------------------------

def blobs(spark, d=2):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(200, d)) * 0.3 + c for c in (0, 2, 5)])
    return x, spark.createDataFrame([(row.tolist(),) for row in x], "nums array<double>")


def test_em_against_the_library(spark):
    from pyspark.mllib.clustering import GaussianMixture
    from pyspark.mllib.linalg import DenseMatrix, Vectors
    from pyspark.mllib.stat.distribution import MultivariateGaussian
    x, df = blobs(spark)
    start = mx.initial_mixture(df, x[[0, 200, 400]])

    class Start:
        k = 3
        weights = start.weights.tolist()
        gaussians = [MultivariateGaussian(Vectors.dense(u), DenseMatrix(2, 2, s.ravel().tolist()))
                     for u, s in zip(start.mu, start.sigma)]

    lib = GaussianMixture.train(spark.sparkContext.parallelize(x.tolist(), 2), 3, initialModel=Start)
    m = mx.fit_mixture(df, 3, start=start).mixture
    assert np.allclose(m.weights, lib.weights, atol=1e-6)
    assert np.allclose(m.mu, [g.mu.toArray() for g in lib.gaussians], atol=1e-6)
    assert np.allclose(m.sigma, [g.sigma.toArray() for g in lib.gaussians], atol=1e-6)


def test_fits_find_the_blobs(spark):
    x, df = blobs(spark)
    m = mx.fit_mixture(df, 3, 1).mixture
    assert np.allclose(np.sort(m.mu[:, 0]), [0, 2, 5], atol=0.1)
    assert np.allclose(np.sort(mx.kmeans(df, 3, 1)[:, 0]), [0, 2, 5], atol=0.1)


def test_initial_mixture_covariance_and_empty_clusters(spark):
    x, df = blobs(spark)
    centres = [[0.0, 0.0], [2.0, 2.0], [5.0, 5.0], [99.0, 99.0]]
    std, var = (mx.initial_mixture(df, centres, c) for c in ("std", "var"))
    assert std.k == 3 and np.allclose(std.weights, 1 / 3)
    assert np.allclose(std.sigma**2, var.sigma)


def test_singular_covariance():
    m = mx.Mixture(np.ones(1), np.zeros((1, 2)), np.array([[[2.0, 0.0], [0.0, 0.0]]]))
    root, c = m.roots()[0]
    assert c == pytest.approx(-0.5 * (2 * np.log(2 * np.pi) + np.log(2.0)))
    assert (np.abs(root @ np.array([1.0, 7.0]))).max() == pytest.approx(2**-0.5)
    with pytest.raises(ValueError):
        mx.Mixture(np.ones(1), np.zeros((1, 2)), np.zeros((1, 2, 2))).roots()
    with pytest.raises(RuntimeError, match="attempts"):
        mx.fit_batch(np.zeros((10, 2)), np.linspace(0, 0.9, 10), 2)


def test_density_paths_agree(spark, monkeypatch):
    v = frame(spark, n=100, d=6)
    r = np.random.default_rng(0)
    a = r.normal(size=(3, 6, 6))
    m = mx.Mixture(np.array([.2, .3, .5]), r.normal(size=(3, 6)), a @ a.transpose(0, 2, 1) + np.eye(6))
    for weighted in (False, True):
        code = mx.add_log_density(v, m, weighted).toPandas()["score_num"]
        monkeypatch.setattr(mx, "DENSITY_TERMS", 0)
        batch = mx.add_log_density(v, m, weighted).toPandas()["score_num"]
        monkeypatch.setattr(mx, "DENSITY_TERMS", 320)
        assert np.allclose(code, batch)


def test_score_falls_away_from_the_mean(spark):
    p = pf.Profile(9, (1,), (0.0,), (1.0,))
    m = MixedModel(p, np.zeros(3), mx.Mixture(np.ones(1), np.zeros((1, 1)), np.ones((1, 1, 1))))
    v = spark.range(50).select(
        F.col("id").cast("string").alias("key"), F.array(F.lit(0)).alias("cats"),
        F.array(F.col("id") / 10.0).alias("nums"))
    s = [r["score"] for r in m.transform(v).orderBy(F.col("nums")[0]).collect()]
    assert all(a > b for a, b in zip(s, s[1:]))


# ---- evaluation sets -------------------------------------------------------------------------

@pytest.mark.parametrize("choice", ["scan", "uniform"])
@pytest.mark.parametrize("m", [1, 3, 50])
def test_noise_changes_exactly_m_columns(spark, choice, m):
    v = frame(spark, n=200, widths=(2, 2, 2))
    out = es.noise_inject(v, 3, 2, m, 1.0, es.inject_rows(0.5), choice)
    pairs = v.alias("a").join(out.alias("b"), "key").select("a.*", F.struct("b.*").alias("o")).collect()
    hits = 0
    for r in pairs:
        changed = sum(x != y for x, y in zip(r["cats"] + r["nums"], r["o"]["cats"] + r["o"]["nums"]))
        assert changed in (0, min(m, 5))
        hits += changed > 0
        assert r["o"]["label"] == (1 if changed else r["label"])
    assert 60 < hits < 140


def test_noise_scan_prefers_early_columns(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("key"))
    got = df.select(F.explode(es.noise_positions(2, 2, 2)).alias("p")).groupBy("p").count().collect()
    n = {r["p"]: r["count"] / 20_000 for r in got}
    # Brute force of the passes.
    r, want = np.random.default_rng(0), np.zeros(4)
    for _ in range(20_000):
        taken = set()
        while len(taken) < 2:
            for i in range(4):
                if len(taken) < 2 and i not in taken and r.random() < 0.5:
                    taken.add(i)
        for i in taken:
            want[i] += 1 / 20_000
    assert np.allclose([n[i] for i in range(4)], want, atol=0.02)


def test_drafted_rules(spark):
    rows = es.draft_rules(spark.range(20_000).withColumnRenamed("id", "rule"), 5).toPandas()
    bits = np.stack(rows["bits"])
    assert bits.sum(axis=1).min() == 2
    r, want = np.random.default_rng(0), np.zeros(6)
    for _ in range(20_000):
        v = np.zeros(5, dtype=bool)
        while v.sum() < 2:
            v |= r.random(5) < 0.2
        want[v.sum()] += 1 / 20_000
    got = np.bincount(bits.sum(axis=1), minlength=6) / 20_000
    assert np.allclose(got, want, atol=0.015)


def test_large_groups_are_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(es, "CHUNK", 10)
    specs = spark.createDataFrame([(0, 35, [1.0, 2.0], [0.5, 3.0]), (1, 10, [0.0, 0.0], [1.0, 1.0]),
                                   (2, 0, [0.0, 0.0], [1.0, 1.0])],
                                  "grp int, n bigint, means array<double>, sigmas array<double>")
    rows = es.group_rows(specs).toPandas()
    assert rows["key"].nunique() == 45 and rows["key"].str.startswith("0:").sum() == 35
    x = np.stack(rows[rows["key"].str.startswith("0:")]["nums"])
    assert np.allclose((x[:, 0] - 1.0) / 0.5, (x[:, 1] - 2.0) / 3.0)


def test_conditional_resample_frequencies(spark):
    v = spark.range(20_000).select(
        F.col("id").cast("string").alias("key"), F.array(F.lit(0), F.lit(1)).alias("cats"),
        F.array(F.lit(0.5)).alias("nums"))
    out = es.conditional_resample(v, 0, 2, lambda c, n: c[0] + n[0])
    got = {r["c"]: r["count"] / 20_000 for r in
           out.groupBy(F.col("cats")[0].alias("c")).count().collect()}
    for c, w in enumerate((0.5, 1.5, 2.5)):
        assert got[c] == pytest.approx(w / 4.5, abs=0.015)
    assert out.where("cats[1] != 1").count() == 0


def test_category_flip_always_changes(spark):
    v = frame(spark, widths=(4, 2))
    out = es.category_flip(v, 4)
    both = v.alias("a").join(out.alias("b"), "key")
    assert both.where("a.cats[0] = b.cats[0] or b.cats[0] not between 0 and 3").count() == 0
    assert both.where("a.cats[1] <> b.cats[1] or b.label <> 1").count() == 0


# ---- whole workflows -------------------------------------------------------------------------

def test_injected_anomalies_are_found(spark):
    es_rows = pe.build(spark, 1500, 10, 500, 6, 4, 10, fraction=0.1, m=6, sigma=1.0, seed=1).cache()
    sizes = {r["split"]: (r["n"], r["anomalies"]) for r in es.set_summary(es_rows).collect()}
    assert sizes["train"] == (1500, 0) and sizes["test"][0] == 500 and 20 < sizes["test"][1] < 90
    model = fit(es_rows.where("split = 'train'"), k=2)
    scored = model.transform(es_rows.where("split = 'test'"))
    a = ev.auroc(scored.withColumn("positive", ev.positive(F.col("label")))).first()["auroc"]
    assert a > 0.8


def test_detect(spark):
    v = q.mv_events(spark, SMALL)
    assert detect(v, 0.03, max_iterations=20).count() == 30
    model = fit(v, max_iterations=20)
    strict = flag_rows(model, v, 0.03, inclusive=False).where("is_anomaly").count()
    assert strict == 29
    approx = flag_rows(model, v, 0.03, method="approx").where("is_anomaly").count()
    assert 25 <= approx <= 35
    fixed = flag_rows(model, v, threshold=1e9).where("is_anomaly").count()
    assert fixed == 1000


def test_streaming_rows_get_the_same_flags(spark, tmp_path):
    from mixspark.streaming.flag import flag_stream
    v = q.mv_events(spark, SMALL)
    model = q.event_model(v)
    batch = flag_rows(model, v, threshold=-18.0).where("is_anomaly")
    v.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(v.schema).parquet(str(tmp_path / "in"))
    query = (flag_stream(model, stream, -18.0).where("is_anomaly").writeStream.format("memory")
             .queryName("flags").option("checkpointLocation", str(tmp_path / "cp")).start())
    query.processAllAvailable()
    query.stop()
    got = {r["key"] for r in spark.table("flags").collect()}
    assert got == {r["key"] for r in batch.collect()} and got
