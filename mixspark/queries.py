"""The registered queries: each operator over whole tables. ``oracle`` holds their SQL twins."""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.functions.rand import uniform
from mixspark.operators import category, encode as en, evalset as es, evaluate as ev
from mixspark.operators import logistic as lg, mixture as mx, profile as pf
from mixspark.operators import sample as sm, score as sc
from mixspark.plans import detect as dt, evalset as pe, search
from mixspark.plans.model import MixedModel
from mixspark.sources import libsvm
from mixspark.sources.scratch import scratch_path
from mixspark.sources.views import mixed_view

SEED = 7
RATIO = 0.03

# Fixed models for queries that check one operator by itself.
EVENT_MIXTURE = mx.Mixture(
    np.array([0.5, 0.3, 0.2]),
    np.array([[0.05], [0.3], [0.7]]),
    np.array([[[0.002]], [[0.02]], [[0.05]]]),
)
PAIR_MIXTURE = mx.Mixture(
    np.array([0.5, 0.3, 0.2]),
    np.array([[0.2, 0.2], [0.5, 0.6], [0.8, 0.4]]),
    np.array([[[0.04, 0.01], [0.01, 0.09]], [[0.05, -0.02], [-0.02, 0.06]],
              [[0.03, 0.0], [0.0, 0.08]]]),
)
CENTRES = [[0.2, 0.2], [0.5, 0.7], [0.8, 0.4]]
RULES = [
    es.Rule((0, 1), (1.0, -2.0), (0.5, 0.25)),
    es.Rule((2,), (10.0, 0.0), (1.0, 2.0)),
    es.Rule((1, 3), (-5.0, 3.0), (2.0, 0.125)),
]
DEFAULT_RULE = es.Rule((), (100.0, 50.0), (10.0, 5.0))
BIT_RULES = [[1, 1, 0, 0, 0], [0, 1, 1, 0, 1], [1, 0, 0, 1, 1]]
NUM_RULES = [[1, 0, 1, 0, 0, 1, 0, 0], [0, 1, 0, 1, 1, 0, 0, 1]]
WEIGHT_SEEDS = [11, 12, 13, 14]
FOLDS = 5
EMBEDDING = 64  # width of the embeddings table


def rounded(c):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- mixed views -----------------------------------------------------------------------------

def mv_events(spark, d):
    t = category.index_categories(table(spark, d, "events"), ["event_type"])
    return mixed_view(t, "event_id", ["event_type_idx", F.hour("ts")], ["value"])


def mv_orders(spark, d, keep=()):
    t = category.index_categories(
        table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])
    return mixed_view(t, "o_orderkey", ["o_orderstatus_idx", "o_orderpriority_idx"],
                      ["o_totalprice", F.year("o_orderdate")], keep=keep)


def mv_lineitem(spark, d):
    t = category.index_categories(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])
    key = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return mixed_view(t, key, ["l_returnflag_idx", "l_linestatus_idx", F.col("l_linenumber") - 1],
                      ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def mv_customer(spark, d):
    t = category.index_categories(table(spark, d, "customer"), ["c_mktsegment"])
    return mixed_view(t, "c_custkey", ["c_mktsegment_idx", "c_nationkey"], ["c_acctbal"])


def mv_docs(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    t = category.index_categories(
        docs.join(table(spark, d, "labels"), "doc_id"), ["lang", "source"])
    return mixed_view(t, "doc_id", ["lang_idx", "source_idx"],
                      ["n_chars", F.log(1 + F.col("n_chars"))], "toxic")


def mv_embed(spark, d):
    t = table(spark, d, "embeddings")
    return mixed_view(t, "vec_id", ["label"], [F.col("embedding")[j] for j in range(EMBEDDING)])


def order_keys(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"))


def _encoded(view):
    p = pf.profile(view)
    return en.encode(view, p), p


# ---- profile and encoding --------------------------------------------------------------------

def profile_minmax(spark, d):
    out = pf.profile_rows(mv_lineitem(spark, d), (3, 4))
    return out.select("kind", "pos", "lo", "hi", "n")


def category_index(spark, d):
    t = category.index_categories(
        table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"),
        ["o_orderstatus", "o_orderpriority"])
    return t.select("o_orderkey", "o_orderstatus_idx", "o_orderpriority_idx")


def category_index_large(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_name")
    return category.index_categories(t, ["c_name"], limit=100).select("c_custkey", "c_name_idx")


def scale_minmax(spark, d):
    e, _ = _encoded(mv_orders(spark, d))
    return e.select("key", F.posexplode("nums").alias("pos", "x")).withColumn("x", rounded("x"))


def unscaled_view(spark, d):
    view = mv_orders(spark, d)
    e = en.encode(view, pf.profile(view), scale=False)
    return e.select("key", F.posexplode("nums").alias("pos", "x"))


def loose_widths(spark, d):
    view = mv_orders(spark, d)
    p = pf.profile(view)
    loose = p.loose()
    columns = pf.profile_rows(view, (2, 2)).where("kind = 'cat'")
    at = F.col("pos").cast("int")

    def of(values):
        return F.get(F.array(*[F.lit(int(v)) for v in values]), at)
    return columns.select("pos", (of(p.cat_max) + 1).alias("width"), of(loose.cat_max).alias("stored"),
                          (of(loose.cat_max) + 1).alias("loose_width"))


def discrete_combinations(spark, d):
    p = pf.profile(mv_orders(spark, d))
    labels = table(spark, d, "labels")
    i = pf.profile(mixed_view(labels, "doc_id", ["quality", "toxic"], []), encoding="indicator")
    return labels.agg(F.count("*").alias("n_labels")).select(
        F.lit(p.combinations).alias("combinations"), F.lit(p.slots).alias("slots"),
        F.lit(i.combinations).alias("indicator_combinations"), "n_labels")


def onehot_slots(spark, d):
    e, p = _encoded(mv_events(spark, d))
    bits = en.one_hot(F.col("slots"), p.slots)
    return e.select("key", F.posexplode(bits).alias("slot", "bit"))


def indicator_passthrough(spark, d):
    view = mixed_view(table(spark, d, "labels"), "doc_id", ["quality", "toxic"], [])
    e = view.withColumn("slots", en.indicator_slots(F.col("cats")))
    return e.select("key", F.posexplode(en.one_hot(F.col("slots"), 2)).alias("slot", "bit"))


def bias_slot(spark, d):
    e, p = _encoded(mv_events(spark, d))
    bits = e.select("key", en.with_bias(en.one_hot(F.col("slots"), p.slots)).alias("b"))
    return bits.select("key", F.size("b").alias("size"), F.element_at("b", -1).alias("bias"),
                       F.aggregate("b", F.lit(0.0), lambda s, x: s + x).alias("ones"))


def set_category(spark, d):
    view = mv_orders(spark, d)
    cats = en.set_category(F.col("cats"), 0, (F.col("cats")[0] + 1) % 3)
    return view.select("key", cats.alias("c")).select(
        "key", F.col("c")[0].alias("c0"), F.col("c")[1].alias("c1"))


def row_text(spark, d):
    e, p = _encoded(mv_orders(spark, d))
    e = e.withColumn("anomaly", F.when(F.col("cats")[0] == 0, 1).otherwise(0))
    m = en.masked_random(e, p.slots, "text", SEED)
    return m.select(
        "key", en.row_text(F.col("nums"), F.col("cats"), F.col("anomaly")).alias("row_text"),
        en.masked_text(F.col("nums"), F.col("slot"), p.slots, F.col("bit")).alias("masked_text"))


def masked_all(spark, d):
    e, p = _encoded(mv_events(spark, d))
    return en.masked_all(e, p.slots).select("key", "slot", "bit", "z")


def masked_random(spark, d):
    e, p = _encoded(mv_events(spark, d))
    return en.masked_random(e, p.slots, "mask", SEED).select("key", "slot", "bit", "z")


# ---- sampling --------------------------------------------------------------------------------

def normal_rows(spark, d):
    return sm.normal_rows(mv_docs(spark, d)).select("key", "label")


def minibatch_sample(spark, d):
    view = mv_events(spark, d)
    rows, _ = sm.minibatch_sample(view, view.count(), 100, "batch", SEED)
    return rows.select("key")


def mixture_sample(spark, d):
    view = mv_events(spark, d)
    return sm.mixture_sample(view, view.count(), 4, RATIO, "sample", SEED).select("key")


def training_draws(spark, d):
    view = mv_events(spark, d)
    f = sm.minibatch_fraction(view.count(), 100)
    return sm.draw_steps(view.select("key"), 20, f, "mb", SEED).select("key", "it")


# ---- slot model ------------------------------------------------------------------------------

def init_weights(spark, d):
    p = pf.profile(mv_events(spark, d))
    w = lg.init_weights(p.d + p.slots, SEED)
    return lg.weights_frame(spark, w, p.d, p.offsets, p.widths)


def lr_schedule(spark, d):
    steps = table(spark, d, "events").agg(F.ceil(F.count("*") / 100).cast("int").alias("steps"))
    return lg.rate_rows(steps, lg.LogisticParams()).withColumn("lr", rounded("lr"))


def _gradient(spark, d, masked):
    e, p = _encoded(mv_events(spark, d))
    w = lg.init_weights(p.d + p.slots, SEED)
    rows = lg.gradient_rows(masked(e, p.slots), w, p.d)
    return rows, w, p


def gradient_step(spark, d):
    rows, _, _ = _gradient(spark, d, lambda e, n: en.masked_random(e, n, "mask", SEED))
    return rows.select("idx", rounded("grad").alias("grad"), "n")


def _gradient_all(spark, d):
    e, p = _encoded(mv_events(spark, d))
    w = lg.init_weights(p.d + p.slots, SEED)
    return lg.gradient_all(e, w, p.d), w, p


def gradient_full(spark, d):
    rows, _, _ = _gradient_all(spark, d)
    return rows.select("idx", rounded("grad").alias("grad"), "n")


def weight_update(spark, d):
    grad, w, p = _gradient_all(spark, d)
    weights = lg.weights_frame(spark, w, p.d, p.offsets, p.widths)
    out = lg.update_rows(weights, grad, 1.0, 1.0, len(w))
    return out.select("idx", "name", rounded("w").alias("w"), rounded("w_new").alias("w_new"))


def sgd_history(spark, d):
    e, p = _encoded(mv_events(spark, d))
    t = lg.train(e, p.n, p.d, p.slots, lg.LogisticParams(), 4, 200, SEED, solver="aggregate")
    h = lg.history_frame(spark, t)
    return h.select("iter", rounded("lr").alias("lr"), rounded("grad_l1").alias("grad_l1"), "n",
                    "converged")


def sgd_weights(spark, d):
    e, p = _encoded(mv_events(spark, d))
    t = lg.train(e, p.n, p.d, p.slots, lg.LogisticParams(), 4, 200, SEED)
    out = lg.weights_frame(spark, t.w, p.d, p.offsets, p.widths)
    return out.select("idx", "name", rounded("w").alias("w"))


# ---- mixture ---------------------------------------------------------------------------------

def kmeans_assign(spark, d):
    e, _ = _encoded(mv_orders(spark, d))
    return mx.assign(e, CENTRES).select("key", "comp", rounded("dist").alias("dist"))


def cluster_deviation(spark, d):
    """Both forms of the deviation."""
    e, _ = _encoded(mv_orders(spark, d))
    near = mx.assign(e, CENTRES)
    rms, summed = (mx.cluster_deviation(near, CENTRES, form).select(
        "comp", "n", F.posexplode("dev").alias("dim", form)) for form in mx.DEVIATIONS)
    return rms.join(summed.drop("n"), ["comp", "dim"]).select(
        "comp", "n", "dim", rounded("rms").alias("dev"), F.round("summed", 9).alias("summed"))


def initial_mixture(spark, d):
    """Both forms of the first covariances."""
    e, _ = _encoded(mv_orders(spark, d))
    rms, summed = (mx.mixture_frame(spark, mx.initial_mixture(e, CENTRES, deviation=form)).select(
        "comp", "weight", F.posexplode("mu").alias("dim", "mu"), "sigma").select(
        "comp", "weight", "dim", "mu", F.col("sigma")[F.col("dim")][F.col("dim")].alias(form))
        for form in mx.DEVIATIONS)
    return rms.join(summed.select("comp", "dim", "summed"), ["comp", "dim"]).select(
        "comp", rounded("weight").alias("weight"), "dim", "mu", rounded("rms").alias("variance"),
        F.round("summed", 9).alias("variance_summed"))


def em_step(spark, d):
    e, _ = _encoded(mv_orders(spark, d))
    return mx.maximise_rows(mx.em_sums(e, PAIR_MIXTURE), 2).select(
        "comp", *[rounded(c).alias(c) for c in ("weight", "mu0", "mu1", "s00", "s01", "s11")],
        F.round("loglik", 4).alias("loglik"))


def _centres(spark, centres):
    return spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(centres)], "comp int, centre array<double>")


def kmeans_fit(spark, d):
    e, _ = _encoded(mv_embed(spark, d))
    return _centres(spark, mx.kmeans(e, 4, SEED))


def kmeans_small(spark, d):
    """The same algorithm in two dimensions, three mean updates."""
    e, _ = _encoded(mv_orders(spark, d))
    out = _centres(spark, mx.kmeans(e, 3, SEED, max_iter=3))
    return out.select("comp", F.posexplode("centre").alias("dim", "x")).withColumn("x", rounded("x"))


def mixture_fit(spark, d):
    e, _ = _encoded(mv_embed(spark, d))
    return mx.mixture_frame(spark, mx.fit_mixture(e, 4, SEED, floor=1e-9).mixture)


def mixture_em(spark, d):
    """Three EM iterations from given components."""
    e, _ = _encoded(mv_orders(spark, d))
    fit = mx.fit_mixture(e, 3, SEED, start=PAIR_MIXTURE, max_iter=3, tol=0.0)
    m = mx.mixture_frame(spark, fit.mixture)
    return m.select(
        "comp", rounded("weight").alias("weight"), *[rounded(F.col("mu")[j]).alias(f"mu{j}") for j in (0, 1)],
        *[rounded(F.col("sigma")[i][j]).alias(f"s{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))],
        F.lit(fit.iterations).alias("iterations"), F.round(F.lit(float(fit.loglik)), 3).alias("loglik"))


def _moments(spark, fit):
    """Mean and second moments of a mixture, which any M-step makes those of the rows."""
    m, rows = mx.mixture_frame(spark, fit.mixture), []
    w, mu, sigma = F.col("weight"), F.col("mu"), F.col("sigma")
    rows = [F.sum(w * mu[j]).alias(f"mean{j}") for j in (0, 1)]
    rows += [F.sum(w * (sigma[i][j] + mu[i] * mu[j])).alias(f"m{i}{j}") for i, j in ((0, 0), (0, 1), (1, 1))]
    return m.agg(rounded(F.sum(w)).alias("weight"), *rows).select(
        "weight", *[rounded(c).alias(c) for c in ("mean0", "mean1", "m00", "m01", "m11")])


def mixture_moments(spark, d):
    """A whole fit, from its own start to the end of EM."""
    e, _ = _encoded(mv_orders(spark, d))
    return _moments(spark, mx.fit_mixture(e, 3, SEED, floor=1e-9))


def mixture_retry(spark, d):
    """A first start without any variance fails; the next attempt, with its own start, succeeds."""
    e, _ = _encoded(mv_orders(spark, d))
    singular = mx.Mixture(np.ones(1), np.zeros((1, 2)), np.zeros((1, 2, 2)))
    fit = mx.fit_mixture(e, 2, SEED, start=singular)
    return _moments(spark, fit).withColumn("failures", F.lit(len(fit.failures)))


# ---- scoring ---------------------------------------------------------------------------------

def event_model(view):
    p = pf.profile(view)
    return MixedModel(p, lg.init_weights(p.d + p.slots, SEED), EVENT_MIXTURE)


def _event_scores(spark, d):
    view = mv_events(spark, d)
    return event_model(view).transform(view)


def score_categorical(spark, d):
    e, p = _encoded(mv_events(spark, d))
    w = lg.init_weights(p.d + p.slots, SEED)
    return lg.add_log_prob(e, w, p.d, len(p.cat_max)).select(
        "key", rounded("score_cat").alias("score_cat"))


def score_gaussian(spark, d):
    e, _ = _encoded(mv_orders(spark, d))
    e = mx.add_log_density(e, PAIR_MIXTURE)
    e = mx.add_log_density(e, PAIR_MIXTURE, weighted=True, out="score_weighted")
    return e.select("key", *[rounded(c).alias(c) for c in ("score_num", "score_weighted")])


def score_joint(spark, d):
    return _event_scores(spark, d).select(
        "key", *[rounded(c).alias(c) for c in ("score_cat", "score_num", "score")])


def score_lineitem(spark, d):
    """Four numerics and twelve slots, limits of the scores per category."""
    view = mv_lineitem(spark, d)
    p = pf.profile(view)
    mix = mx.Mixture(np.array([0.5, 0.5]), np.array([[0.3] * 4, [0.7] * 4]),
                     np.array([np.eye(4) * 0.05, np.eye(4) * 0.08]))
    scored = MixedModel(p, lg.init_weights(p.d + p.slots, SEED), mix).transform(view)
    out = sc.score_limits(
        scored.select(F.col("cats")[0].alias("flag_idx"), "score"), by=("flag_idx",))
    return out.select("flag_idx", *[rounded(c).alias(c) for c in ("min_score", "max_score")])


def threshold_exact(spark, d):
    scored = sc.scored_once(_event_scores(spark, d).select("score"))
    t, k, n = scored.threshold(RATIO)
    return scored.rows.agg(F.count_if(F.col("score") <= t).alias("flagged")).select(
        F.lit(n).cast("bigint").alias("n"), F.lit(k).cast("bigint").alias("k"),
        rounded(F.lit(t)).alias("threshold"), "flagged")


def threshold_approx(spark, d):
    scored = _event_scores(spark, d)
    t = sc.threshold_approx(scored, RATIO)
    return scored.agg(F.count_if(F.col("score") <= t).alias("flagged"),
                      F.lit(t).alias("threshold"))


def threshold_rank(spark, d):
    """The approximate threshold's rank lies within its promised error of the exact one."""
    scored = _event_scores(spark, d)
    t = sc.threshold_approx(scored, RATIO)
    n, k = F.count("*"), F.greatest(F.lit(1), F.floor(F.count("*") * RATIO))
    at_most, below = F.count_if(F.col("score") <= t), F.count_if(F.col("score") < t)
    near = (below <= k + n / 10_000 + 1) & (at_most >= k - n / 10_000 - 1)
    return scored.agg(n.alias("n"), k.alias("k"), near.alias("within"))


def score_minmax(spark, d):
    return sc.score_limits(_event_scores(spark, d)).select(
        *[rounded(c).alias(c) for c in ("min_score", "max_score")])


def flag_fixed(spark, d):
    return sc.flag(_event_scores(spark, d), -20.0, inclusive=False).select("key", "is_anomaly")


def anomalies(spark, d):
    view = mv_events(spark, d)
    flagged = sm.anomalous_rows(dt.flag_rows(event_model(view), view, RATIO))
    return flagged.select("key", F.col("cats")[0].alias("event_type_idx"),
                          F.col("cats")[1].alias("hour"), F.col("nums")[0].alias("value"),
                          rounded("score").alias("score"))


# ---- evaluation ------------------------------------------------------------------------------

def _doc_scores(spark, d, seed=SEED):
    view = mv_docs(spark, d)
    p = pf.profile(view)
    scored = MixedModel(p, lg.init_weights(p.d + p.slots, seed), PAIR_MIXTURE).transform(view)
    return scored.withColumn("positive", ev.positive(F.col("label")))


def auroc(spark, d):
    return ev.auroc(_doc_scores(spark, d)).select(
        rounded("auroc").alias("auroc"), "n_pos", "n_neg")


def auroc_ties(spark, d):
    """A score with few values: most pairs are ties."""
    scored = _doc_scores(spark, d).withColumn("score", F.round("score", 0))
    return ev.auroc(scored).select(rounded("auroc").alias("auroc"), "n_pos", "n_neg")


def auroc_events(spark, d):
    """Error events as the anomalies, per hour: many groups over the whole table."""
    scored = _event_scores(spark, d)
    scored = scored.select(F.col("cats")[1].alias("hour"), F.col("score_num").alias("score"),
                           (F.col("cats")[0] != 1).cast("double").alias("positive"))
    return ev.auroc(scored, ("hour",)).select(
        "hour", rounded("auroc").alias("auroc"), "n_pos", "n_neg")


def fold_assign(spark, d):
    return ev.assign_folds(mv_docs(spark, d), FOLDS, SEED).select("key", "fold")


def fold_sizes(spark, d):
    return ev.fold_sizes(ev.assign_folds(mv_docs(spark, d), FOLDS, SEED))


def _cv_results(spark, d):
    """Several weight sets scored in one pass over the rows, then measured per fold."""
    e, p = _encoded(mv_docs(spark, d))
    rows = mx.add_log_density(ev.assign_folds(e, FOLDS, SEED), PAIR_MIXTURE)
    for i, seed in enumerate(WEIGHT_SEEDS):
        rows = lg.add_log_prob(rows, lg.init_weights(p.d + p.slots, seed), p.d, len(p.cat_max),
                               out=f"c{i}")
    scores = F.array(*[F.col(f"c{i}") + F.col("score_num") for i in range(len(WEIGHT_SEEDS))])
    rows = rows.select("fold", ev.positive(F.col("label")).alias("positive"),
                       F.posexplode(scores).alias("combo", "score"))
    return ev.auroc(rows, ("combo", "fold"))


def cv_scores(spark, d):
    return _cv_results(spark, d).select(
        "combo", "fold", rounded("auroc").alias("auroc"), "n_pos", "n_neg")


def cv_means(spark, d):
    return ev.mean_auroc(_cv_results(spark, d)).select(
        "combo", rounded("auroc").alias("auroc"), "folds")


def best_params(spark, d):
    return ev.best_params(ev.mean_auroc(_cv_results(spark, d))).select(
        "combo", rounded("auroc").alias("auroc"), "inverted")


def param_grid(spark, d):
    """The plan of a search: every combination on every fold, with its row counts."""
    sizes = ev.fold_sizes(ev.assign_folds(mv_docs(spark, d), FOLDS, SEED))
    grid = ev.grid_frame(spark, ev.grid_points(k=[2, 4], reg=[0.1, 1.0], lr_speed=[0.01, 0.1, 1.0]))
    return grid.crossJoin(F.broadcast(sizes))


def run_timing(spark, d):
    """Total and mean of what a search's fits score, in thousands of rows: the sums that the seconds of a
    search's results are put through (``search_report`` has measured ones)."""
    runs = param_grid(spark, d).withColumn("scored", F.col("n_test") / 1000.0)
    return ev.timing(runs, col="scored").select(
        "fits", rounded("total_seconds").alias("total_thousands"), rounded("mean_seconds").alias("mean_thousands"))


def cv_job(spark, d):
    """The default grid: 25 combinations, 10 folds, 100 iterations."""
    return search.cross_validate(mv_docs(spark, d), seed=SEED).results


#: Settings small enough to be followed in SQL: whole training sets as minibatches, two steps, one component.
SMALL_SEARCH = dict(max_iterations=3, minibatch=10**9, k=[1], reg=[0.1, 1.0], lr_speed=[0.1])


def cv_small(spark, d):
    """The whole search at small settings."""
    found = search.cross_validate(mv_docs(spark, d), folds=2, seed=SEED, **SMALL_SEARCH).results
    return found.select("combo", "fold", rounded("auroc").alias("auroc"), "n_pos", "n_neg")


def tune_small(spark, d):
    """Choice on dev, refit and export of the test rows at small settings."""
    view = es.split_by_fraction(mv_docs(spark, d), 0.6, 0.2, SEED)
    report = search.tune(view, SEED, **SMALL_SEARCH)
    return report.scored.select(
        "key", "label", rounded("score").alias("score"), F.lit(report.best["combo"]).alias("combo"),
        rounded(F.lit(report.best["auroc"])).alias("dev_auroc"))


def detect_small(spark, d):
    """The whole job at small settings: three steps, one component."""
    out = dt.detect(mv_events(spark, d), RATIO, seed=SEED, k=1, max_iterations=4, minibatch=200)
    return out.select("key", rounded("score").alias("score"))


def search_report(spark, d):
    """A run's report written and read back: rows of each table, and that times add up."""
    view = es.split_by_fraction(mv_docs(spark, d), 0.6, 0.2, SEED)
    path = scratch_path(spark, "report")
    search.tune(view, SEED, **SMALL_SEARCH).write(path)
    results, best = spark.read.parquet(f"{path}/results"), spark.read.parquet(f"{path}/best")
    timed = ev.timing(results).select("fits", (F.col("total_seconds") > 0).alias("timed"))
    spent = best.select("combo", (F.col("seconds") >= F.col("seconds_per_fit")).alias("adds_up"))
    sizes = spark.read.parquet(f"{path}/sizes").select("split", "n")
    return sizes.crossJoin(F.broadcast(timed)).crossJoin(F.broadcast(spent)).select(
        "split", "n", "fits", "timed", "adds_up", F.col("combo").cast("int").alias("combo"))


def tune_job(spark, d):
    view = es.split_by_fraction(mv_docs(spark, d), 0.6, 0.2, SEED)
    return search.tune(view, SEED).scored.select("key", "label", "score")


def detect_job(spark, d):
    return dt.detect(mv_events(spark, d), RATIO, seed=SEED).select("key", "score")


# ---- sources and sinks -----------------------------------------------------------------------

def _customer_labelled(spark, d):
    return mv_customer(spark, d).withColumn(
        "label", (uniform(F.col("key"), "label", SEED) < 0.1).cast("int"))


def libsvm_roundtrip(spark, d):
    path = scratch_path(spark, "libsvm")
    libsvm.write_libsvm(_customer_labelled(spark, d), path)
    back = libsvm.read_libsvm(spark, path, 2, 3)
    return back.groupBy(F.col("cats")[0].alias("c0"), F.col("cats")[1].alias("c1"), "label").agg(
        F.count("*").alias("n"), rounded(F.sum(F.col("nums")[0])).alias("total"))


def split_view(spark, d):
    view = es.split_by_fraction(_customer_labelled(spark, d), 0.6, 0.2, SEED)
    train = scratch_path(spark, "set_train")
    for s in ("train", "dev", "test"):
        libsvm.write_libsvm(view.where(F.col("split") == s), libsvm.sibling_path(train, s))
    back = libsvm.read_splits(spark, train, 2, 3)
    return back.groupBy("split", "label").agg(
        F.count("*").alias("n"), rounded(F.sum(F.col("nums")[0])).alias("total"))


def scored_export(spark, d):
    view = _customer_labelled(spark, d)
    path = scratch_path(spark, "scored")
    libsvm.export_scored(event_model(view).transform(view), path)
    return spark.read.parquet(path).select(
        "key", "label", F.posexplode("features").alias("pos", "x")).withColumn("x", rounded("x"))


# ---- evaluation sets -------------------------------------------------------------------------

def group_rows(spark, d):
    t = category.index_categories(table(spark, d, "part"), ["p_brand"])
    specs = t.groupBy(F.col("p_brand_idx").alias("grp")).agg(
        F.count("*").alias("n"),
        F.array(F.avg("p_size"), F.avg("p_retailprice")).alias("means"),
        F.array(F.stddev_pop("p_size"), F.stddev_pop("p_retailprice")).alias("sigmas"))
    rows = es.group_rows(specs, SEED)
    return rows.select("key", F.col("cats")[0].alias("grp"),
                       F.round(F.col("nums")[0], 4).alias("x0"),
                       F.round(F.col("nums")[1], 4).alias("x1"))


def _bits(rows):
    return rows.select("key", F.posexplode("bits").alias("pos", "bit"))


def decaying_binary(spark, d):
    return _bits(es.decaying_binary(order_keys(spark, d), 4, seed=SEED))


def _rule_rows(spark, d, match="listed"):
    rows = es.decaying_binary(order_keys(spark, d), 4, seed=SEED)
    return es.rule_match(rows, RULES, DEFAULT_RULE, match, SEED)


def rule_match(spark, d):
    return _rule_rows(spark, d).select(
        "key", F.concat_ws(",", F.transform("rules", lambda r: r.cast("string"))).alias("rules"),
        rounded(F.col("nums")[0]).alias("x0"), rounded(F.col("nums")[1]).alias("x1"))


def rule_coverage(spark, d):
    return es.rule_coverage(_rule_rows(spark, d)).select("rule", "n", rounded("share").alias("share"))


def rule_coverage_prefix(spark, d):
    return es.rule_coverage(_rule_rows(spark, d, "prefix")).select(
        "rule", "n", rounded("share").alias("share"))


def location_scale(spark, d):
    view = mv_orders(spark, d)
    means = F.array(F.col("nums")[0], F.lit(-1.0))
    nums = es.location_scale(means, F.array(F.lit(10.0), F.lit(2.0)), "ls", SEED)
    return view.select("key", nums.alias("x")).select(
        "key", rounded(F.col("x")[0]).alias("x0"), rounded(F.col("x")[1]).alias("x1"))


def independent_binary(spark, d):
    return _bits(es.independent_binary(order_keys(spark, d), 5, 0.5, SEED))


def _dependent(spark, d):
    rows = es.independent_binary(order_keys(spark, d), 5, 0.5, SEED)
    return es.dependent_binary(rows, BIT_RULES, SEED)


def dependent_binary(spark, d):
    return _bits(_dependent(spark, d))


def dependent_numeric(spark, d):
    rows = es.dependent_numeric(_dependent(spark, d), NUM_RULES, SEED)
    return rows.select("key", rounded(F.col("nums")[0]).alias("x0"),
                       rounded(F.col("nums")[1]).alias("x1"))


def draft_rules(spark, d):
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("rule"))
    return es.draft_rules(ids, 6, SEED).select("rule", F.posexplode("bits").alias("pos", "bit"))


def category_flip(spark, d):
    out = es.category_flip(mv_orders(spark, d), 3, SEED)
    return out.select("key", F.col("cats")[0].alias("c0"), F.col("cats")[1].alias("c1"), "label")


def inject_rows(spark, d):
    return mv_events(spark, d).select("key", es.inject_rows(0.01, SEED).alias("hit"))


def noise_inject(spark, d):
    out = es.noise_inject(mv_events(spark, d), 2, 1, 2, 1.0, es.inject_rows(0.25, SEED), seed=SEED)
    return out.select("key", F.col("cats")[0].alias("c0"), F.col("cats")[1].alias("c1"),
                      rounded(F.col("nums")[0]).alias("x0"), "label")


def noise_uniform(spark, d):
    chosen = es.noise_positions(2, 1, 2, "uniform", SEED)
    return mv_events(spark, d).select("key", F.explode(chosen).alias("pos"))


def split_rows(spark, d):
    return es.split_by_fraction(mv_events(spark, d), 0.7, 0.2, SEED).select("key", "split")


def split_position(spark, d):
    view = mv_orders(spark, d, keep=["o_orderkey"])
    n = view.count()
    out = es.split_by_position(view, n // 2, n // 4, n // 8, "o_orderkey")
    return out.select("key", "split")


def set_summary(spark, d):
    split = es.split_by_fraction(mv_events(spark, d), 0.7, 0.2, SEED)
    return es.set_summary(pe.inject(split, 0.1, 1, 1.0, seed=SEED, dims=(2, 1))).withColumn(
        "anomalies", F.col("anomalies").cast("bigint"))


def generated_set(spark, d):
    """The default generator over the keys of a table, 30 categoricals and 100 numerics a row."""
    rows = pe.generate(order_keys(spark, d), seed=SEED)
    return rows.select(
        "key", F.aggregate("cats", F.lit(0), lambda s, x: s + x).alias("ones"),
        F.aggregate("nums", F.lit(0.0), lambda s, x: s + x).alias("total"))


def conditional_resample(spark, d):
    e, _ = _encoded(mv_orders(spark, d))

    def factor(cats, nums):
        return 1.0 + cats[0] * nums[0] + F.when(cats[0] == cats[1], 2.0).otherwise(0.0)

    out = es.conditional_resample(e, 0, 2, factor, SEED)
    return out.select("key", F.col("cats")[0].alias("c0"), F.col("cats")[1].alias("c1"))


QUERIES = {f.__name__: f for f in (
    profile_minmax, category_index, category_index_large, scale_minmax, unscaled_view, loose_widths,
    discrete_combinations, onehot_slots, indicator_passthrough, bias_slot, set_category, row_text,
    masked_all, masked_random, normal_rows, minibatch_sample, mixture_sample, training_draws,
    init_weights, lr_schedule, gradient_step, gradient_full, weight_update, sgd_history, sgd_weights,
    kmeans_assign, cluster_deviation, initial_mixture, em_step, kmeans_fit, kmeans_small,
    mixture_fit, mixture_em, mixture_moments, mixture_retry,
    score_categorical, score_gaussian, score_joint, score_lineitem, threshold_exact,
    threshold_approx, threshold_rank, score_minmax, flag_fixed, anomalies, auroc, auroc_ties, auroc_events,
    fold_assign, fold_sizes, cv_scores, cv_means, best_params, param_grid, run_timing, cv_job,
    cv_small, tune_job, tune_small, search_report, detect_job, detect_small, libsvm_roundtrip, split_view, scored_export, group_rows, decaying_binary,
    rule_match, rule_coverage, rule_coverage_prefix, location_scale, independent_binary,
    dependent_binary, dependent_numeric, draft_rules, category_flip, inject_rows, noise_inject,
    noise_uniform, split_rows, split_position, set_summary, generated_set, conditional_resample,
)}
