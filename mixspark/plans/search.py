"""Parameter search by k-fold cross-validation or on a dev set."""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.operators import evaluate as ev
from mixspark.operators import logistic as lg
from mixspark.operators import mixture as mx
from mixspark.operators.encode import scaled, slot_array
from mixspark.operators.ordered import bucket_count, number_edges
from mixspark.operators.profile import Profile, dimensions, profile, profiles_without
from mixspark.functions.rand import uniform
from mixspark.operators.sample import (
    few_tasks, may_draw, minibatch_fraction, mixture_draw, mixture_fraction, steps_to_draw,
)
from mixspark.plans.model import MixedModel, fit
from mixspark.sources.libsvm import scored_rows

# Fixed value: searches size the mixture sample for this share of anomalies.
SEARCH_RATIO = 0.01
EDGE_ROWS = 50_000
# Scores of the rarer class, rows times combinations, that may serve as cut points.
RARE_CELLS = 2_000_000


@dataclass
class SearchReport:
    """What a run reports: one row per fit, means, the choice, fold sizes and seconds."""

    results: DataFrame
    means: DataFrame
    best: dict
    sizes: DataFrame
    seconds: float
    seconds_per_fit: float
    model: MixedModel | None = None
    test: DataFrame | None = None
    scored: DataFrame | None = None

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Write the run's tables under one folder."""
        spark = self.results.sparkSession
        best = {**self.best, "seconds": self.seconds, "seconds_per_fit": self.seconds_per_fit}
        parts = {
            "results": self.results, "means": self.means, "sizes": self.sizes,
            "best": spark.createDataFrame(pd.DataFrame([best])),
        }
        if self.test is not None:
            parts["test"] = self.test
        if self.scored is not None:
            parts["scored"] = scored_rows(self.scored)
        for name, df in parts.items():
            df.write.mode(mode).parquet(f"{path}/{name}")


class GridScorer:
    """Scores rows with all models of their group. ``models`` holds combo, grp, w, lam and mixture. Work is
    Arrow batches through numpy, because the number of models is data, not code."""

    def __init__(self, profs: dict[int, Profile], models: list[dict], weighted: bool = False,
                 floor: float = 1e-9):
        self.packed = {}
        for g in {m["grp"] for m in models}:
            mine = [m for m in models if m["grp"] == g]
            mixtures = {m["k"]: m["mixture"] for m in mine}
            self.packed[g] = {
                "combo": np.array([m["combo"] for m in mine]),
                "w": np.stack([m["w"] for m in mine]), "lam": np.array([m["lam"] for m in mine]),
                "k": [m["k"] for m in mine],
                "mix": {k: (mx_.roots(floor), mx_.mu, mx_.weights if weighted else None)
                        for k, mx_ in mixtures.items()},
                "lo": np.array(profs[g].num_min), "span": np.array(profs[g].spans),
            }

    def of(self, batches):
        """(group, combinations, rows x combinations scores, labels) of frames with test_in, nums, slots and
        label. Missing numerics are an error; a diverged fit ranks no row above another."""
        for pdf in batches:
            for g, part in pdf.groupby("test_in"):
                p = self.packed[int(g)]
                x = np.stack(part["nums"].to_numpy()).astype(float).reshape(len(part), -1)
                if not np.isfinite(x).all():
                    raise ValueError("numerics are missing or not a number")
                x = (x - p["lo"]) / p["span"]
                with np.errstate(all="ignore"):
                    s = lg.log_prob_batch(x, part["slots"].to_numpy(), p["w"], len(p["lo"]),
                                          p["lam"])
                    dens = {k: mx.log_density_batch(x, *m) for k, m in p["mix"].items()}
                    s = s + np.stack([dens[k] for k in p["k"]], axis=1)
                s[:, ~np.isfinite(p["w"]).all(axis=1)] = 0.0
                yield int(g), p["combo"], np.where(np.isnan(s), -np.inf, s), part["label"].to_numpy(dtype=float)


def score_grid(rows: DataFrame, profs: dict[int, Profile], models: list[dict],
               weighted: bool = False, floor: float = 1e-9) -> DataFrame:
    """Score every row with all models of its group: (grp, combo, score, positive)."""
    scorer = GridScorer(profs, models, weighted, floor)

    def score(batches):
        for g, combo, s, label in scorer.of(batches):
            n, m = s.shape
            yield pd.DataFrame({
                "grp": np.full(n * m, g), "combo": np.tile(combo, n), "score": s.ravel(),
                "positive": np.repeat(1.0 - label, m),
            })

    return rows.where("test_in IS NOT NULL").select("test_in", "nums", "slots", "label") \
        .mapInPandas(score, "grp int, combo int, score double, positive double")


def grid_auroc(rows: DataFrame, profs: dict[int, Profile], models: list[dict], n_rows: int,
               weighted: bool = False, floor: float = 1e-9, rare_cells: int = RARE_CELLS) -> dict:
    """Exact (auroc, n_pos, n_neg, warning) by (combination, group).

    All that an AUROC needs of the frequent class is how many of its rows lie between the scores of the rare
    one. So the rare rows are scored first, and tasks then count the others between their scores and hand
    over the counts: what is shuffled follows from the rare rows and the models, not from the table. Only
    where both classes are too large for that, all scores are shuffled."""
    tested = rows.where("test_in IS NOT NULL")
    sizes = {(r["test_in"], r["label"]): r["n"] for r in
             tested.groupBy("test_in", "label").agg(F.count("*").alias("n")).collect()}
    total = [sum(n for (_, label), n in sizes.items() if label == c) for c in (0, 1)]
    rare = 1 if total[1] <= total[0] else 0
    fits = {}
    for m in models:
        fits.setdefault(m["grp"], []).append(m["combo"])
    if total[rare] * max(map(len, fits.values())) > rare_cells:
        few = rows.where(uniform(F.col("key"), "edge") < F.lit(min(1.0, EDGE_ROWS / max(n_rows, 1))))
        edges, _ = number_edges(score_grid(few, profs, models, weighted, floor), "score", bucket_count(rows))
        scored = score_grid(rows, profs, models, weighted, floor)
        return {(r["combo"], r["grp"]): (r["auroc"], r["n_pos"], r["n_neg"], r["warning"])
                for r in ev.auroc(scored, ("combo", "grp"), edges=edges).collect()}

    scored = score_grid(tested.where(F.col("label") == rare), profs, models, weighted, floor).groupBy("grp", "combo").agg(
        F.collect_list(F.col("score") + 0.0).alias("scores"))
    cuts = {(r["grp"], r["combo"]): np.unique(np.array(r["scores"], dtype=float), return_counts=True)
            for r in scored.collect()}
    spark = rows.sparkSession
    scorer = GridScorer(profs, models, weighted, floor)
    shared = spark.sparkContext.broadcast({key: values for key, (values, _) in cuts.items()})

    def count(batches):
        counts: dict = {}
        for g, combos, s, _ in scorer.of(batches):
            for j, c in enumerate(combos.tolist()):
                at = shared.value.get((g, c))
                if at is None:
                    continue
                # Even places lie between two scores of the rare class, odd ones on one.
                place = np.searchsorted(at, s[:, j], "left") + np.searchsorted(at, s[:, j], "right")
                n = np.bincount(place, minlength=2 * len(at) + 1)
                counts[g, c] = counts[g, c] + n if (g, c) in counts else n
        for (g, c), n in counts.items():
            place = np.flatnonzero(n)
            yield pd.DataFrame({"grp": g, "combo": c, "place": place, "n": n[place]})

    cells = (
        tested.where(F.col("label") != rare).select("test_in", "nums", "slots", "label")
        .mapInPandas(count, "grp int, combo int, place int, n bigint")
        .groupBy("grp", "combo", "place").agg(F.sum("n").alias("n"))
        .groupBy("grp", "combo").agg(F.collect_list("place").alias("place"), F.collect_list("n").alias("n")))
    between = {(r["grp"], r["combo"]): (r["place"], r["n"]) for r in cells.collect()}
    shared.unpersist()

    found = {}
    for g, combos in fits.items():
        n_neg, n_pos = sizes.get((g, 1), 0), sizes.get((g, 0), 0)
        for c in combos:
            area = None
            if n_pos and n_neg:
                values, times = cuts[g, c]
                n = np.zeros(2 * len(values) + 1)
                n[between[g, c][0]] = between[g, c][1]
                ties, below = n[1::2], np.cumsum(n)[:-1:2]
                above = n.sum() - below - ties
                area = float((times * ((above if rare else below) + ties / 2)).sum() / (n_pos * n_neg))
            if n_pos or n_neg:
                found[c, g] = area, n_pos, n_neg, None if area is not None else "one class only"
    return found


def fit_grid(rows: DataFrame, profs: dict[int, Profile], sizes: dict[int, int],
             points: list[dict], max_iterations: int, minibatch: int, seed: int, init_cov: str,
             floor: float, solver: str = "auto", deviation: str = "rms", init: str = "uniform") -> list[dict]:
    """Fit every combination on every training set. One pass keeps the rows that any fit draws; one job
    of many rounds fits all slot weights, another all mixtures. A mixture depends only on
    (k, training set) and the weights only on the rest, never on other combinations. A model's ``seconds`` are
    its share of the rounds it took part in. ``solver="aggregate"`` makes each round a job, ``"pooled"``
    runs all steps of a training set in one task, with the same outcome."""
    some = next(iter(profs.values()))
    d, slots = some.d, some.slots
    steps = max_iterations - 1
    rates = {g: minibatch_fraction(n, minibatch) for g, n in sizes.items()}
    f = max(rates.values())
    drawn = max(steps_to_draw(steps, n, rates[g]) for g, n in sizes.items())
    ks = sorted({p["k"] for p in points})
    mix_rate = {(g, k): mixture_fraction(n, k, SEARCH_RATIO) for g, n in sizes.items() for k in ks}
    params = [lg.LogisticParams(p["reg"], p["lr_start"], p["lr_speed"], p["lam"]) for p in points]
    w0 = {g: lg.init_weights(d + slots, f"{seed}|{g}", init) for g in profs}
    scale = {g: (np.array(p.num_min), np.array(p.spans)) for g, p in profs.items()}

    together = {"aggregate": False, "barrier": True}.get(solver)
    train_in = F.col("train_in")
    most = {g: max(mix_rate[g, k] for k in ks) for g in sizes}
    wanted = may_draw(drawn, f, "mb", seed, groups=train_in)
    for g, rate in most.items():
        wanted = wanted | (F.array_contains(train_in, g) & mixture_draw(F.lit(rate), seed, group=F.lit(g)))
    base = rows.select("key", "nums", "slots", "train_in")
    taken = base.where(wanted).repartition(few_tasks(rows.sparkSession)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weights: dict[tuple, lg.Trained] = {}
        if slots == 0 or steps < 1:
            weights = {(c, g): lg.Trained(w0[g]) for c in range(len(points)) for g in profs}
        else:
            pool = lg.draw_pool(taken, slots, drawn, f, seed, train_in, rates)
            if solver == "pooled":
                for r in lg.train_pooled(pool, w0, d, params, steps, scale=scale).collect():
                    weights[(r["combo"], r["grp"])] = lg.trained_from_row(r)
            else:
                n_pool = drawn * sum(rates[g] * n for g, n in sizes.items())
                weights = lg.train_together(pool, w0, d, params, steps, drawn, n_pool, scale, together)
        # A row's draw for a training set decides for every k, each by its own rate.
        pairs = F.array(*[
            F.struct(F.lit(g).alias("g"), F.lit(k).alias("k"), F.lit(r).alias("rate"))
            for (g, k), r in mix_rate.items()
        ])
        sample = (
            taken.select("key", "nums", F.explode("train_in").alias("grp"))
            .select("key", "grp", "nums", F.explode(pairs).alias("p"))
            .where((F.col("p.g") == F.col("grp")) & mixture_draw(F.col("p.rate"), seed, group=F.col("grp")))
            .select("grp", F.col("p.k").alias("k"), mx.draw_of(F.col("key"), seed, F.col("grp")).alias("u"), "nums")
        )
        n_sample = sum(r * sizes[g] for (g, _), r in mix_rate.items())
        mixtures = mx.fit_mixtures(sample, list(mix_rate), d, n_sample, mx.FitOptions(init_cov, deviation, floor),
                                   scale, one_job=together)
    finally:
        taken.unpersist()
    share = {k: sum(p["k"] == k for p in points) for k in ks}
    return [
        {"combo": p["combo"], "grp": g, "k": p["k"], "lam": p["lam"],
         "w": weights[(c, g)].w, "trained": weights[(c, g)], "mixture": mixtures[g, p["k"]].mixture,
         "seconds": weights[(c, g)].seconds + mixtures[g, p["k"]].seconds / share[p["k"]]}
        for c, p in enumerate(points) for g in profs
    ]


def run_grid(rows: DataFrame, profs: dict[int, Profile], sizes: dict[int, int],
             points: list[dict], n_rows: int, max_iterations: int = 100, minibatch: int = 100,
             seed: int = 0, init_cov: str = "std", floor: float = 1e-9, weighted: bool = False,
             solver: str = "auto", deviation: str = "rms", init: str = "uniform") -> DataFrame:
    """Fit, score and measure the whole grid: one row per (combination, fold)."""
    models = fit_grid(rows, profs, sizes, points, max_iterations, minibatch, seed, init_cov, floor, solver,
                      deviation, init)
    found = grid_auroc(rows, profs, models, n_rows, weighted, floor)
    point = {p["combo"]: p for p in points}
    out = []
    for m in models:
        t, p = m["trained"], point[m["combo"]]
        out.append((
            m["combo"], m["grp"], int(p["k"]), float(p["reg"]), float(p["lr_start"]),
            float(p["lr_speed"]), float(p["lam"]), *found.get((m["combo"], m["grp"]), (None, 0, 0, "no rows")),
            lg.convergence_log(t), bool(t.converged), float(m["seconds"]),
        ))
    return rows.sparkSession.createDataFrame(
        out, "combo int, fold int, k int, reg double, lr_start double, lr_speed double, "
        "lam double, auroc double, n_pos bigint, n_neg bigint, warning string, "
        "gradient_logs array<double>, converged boolean, seconds double")


def _prepare(view: DataFrame, prof: Profile, handle_unseen: str = "zero") -> DataFrame:
    return view.withColumn("slots", slot_array(F.col("cats"), prof, handle_unseen))


def _choose(results: DataFrame) -> tuple[DataFrame, dict]:
    params = ["combo", "k", "reg", "lr_start", "lr_speed", "lam"]
    means = ev.mean_auroc(results, params)
    rows = means.collect()  # one row per combination
    means = results.sparkSession.createDataFrame(rows, means.schema)
    row = ev.best_params(means).first()
    if row is None or row["combo"] is None:
        raise ValueError("no combination has an AUROC: the test rows hold one class only")
    point = next(r for r in rows if r["combo"] == row["combo"])
    return means, {**{n: point[n] for n in params}, "auroc": row["auroc"],
                   "inverted": row["inverted"]}


def cross_validate(view: DataFrame, folds: int = 10, seed: int = 0, profile_scope: str = "train",
                   max_iterations: int = 100, minibatch: int = 100, init_cov: str = "std",
                   floor: float = 1e-9, weighted: bool = False, solver: str = "auto",
                   handle_unseen: str = "zero", deviation: str = "rms", init: str = "uniform",
                   loose: bool = False, **grid) -> SearchReport:
    """Mean AUROC over folds for every combination; fits see normal rows outside the fold.
    ``profile_scope="each"`` scales by the limits of the whole table instead of the training rows'."""
    if profile_scope not in ("train", "each"):
        raise ValueError("profile_scope must be 'train' or 'each'")
    started = time.time()
    points = ev.grid_points(**grid)
    folded = ev.assign_folds(view, folds, seed)
    dims = dimensions(view)
    counts = {r["fold"]: r for r in folded.groupBy("fold").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("normal")).collect()}
    n_rows = sum(r["n"] for r in counts.values())
    if profile_scope == "train":
        profs = dict(enumerate(profiles_without(folded, "fold", folds, dims)))
    else:
        profs = {f: profile(view, dims) for f in range(folds)}
    if loose:
        profs = {f: p.loose() for f, p in profs.items()}
    sizes = {f: sum(r["normal"] for g, r in counts.items() if g != f) for f in range(folds)}
    others = F.array_remove(F.sequence(F.lit(0), F.lit(folds - 1)), F.col("fold"))
    rows = _prepare(folded, profs[0], handle_unseen).select(
        "key", "nums", "slots", "label",
        F.when(F.col("label") == 0, others).otherwise(F.array().cast("array<int>")).alias("train_in"),
        F.col("fold").alias("test_in"))
    results = run_grid(rows, profs, sizes, points, n_rows, max_iterations, minibatch, seed, init_cov,
                       floor, weighted, solver, deviation, init)
    means, best = _choose(results)
    seconds = time.time() - started
    return SearchReport(results, means, best, ev.fold_sizes(folded), seconds,
                        seconds / (len(points) * folds))


def tune(view: DataFrame, seed: int = 0, profile_scope: str = "train", max_iterations: int = 100,
         minibatch: int = 100, init_cov: str = "std", floor: float = 1e-9, weighted: bool = False,
         solver: str = "auto", handle_unseen: str = "zero", deviation: str = "rms", init: str = "uniform",
         loose: bool = False, **grid) -> SearchReport:
    """Choose on dev rows, refit the choice on all train rows, measure on test rows. ``view`` has a
    ``split`` column of train, dev and test. ``profile_scope="each"`` scales every split by its own
    limits."""
    if profile_scope not in ("train", "each"):
        raise ValueError("profile_scope must be 'train' or 'each'")
    started = time.time()
    points = ev.grid_points(**grid)
    dims = dimensions(view)
    counts = {r["split"]: r for r in view.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("normal")).collect()}
    train = view.where("split = 'train'")
    prof = profile(train, dims)
    if profile_scope == "each":
        limits = {s: profile(view.where(F.col("split") == s), dims) for s in counts}
        cases = F.lit(None)
        for s, p in limits.items():
            cases = F.when(F.col("split") == s, scaled(F.col("nums"), p)).otherwise(cases)
        view = view.withColumn("nums", cases)
        train = view.where("split = 'train'")
        one = 1.0 - 1e-13
        prof = Profile(prof.n, prof.cat_max, (0.0,) * prof.d, (one,) * prof.d)
    if loose:
        prof = prof.loose()
    is_train = (F.col("split") == "train") & (F.col("label") == 0)
    rows = _prepare(view, prof, handle_unseen).where("split <> 'test'").select(
        "key", "nums", "slots", "label",
        F.when(is_train, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        .alias("train_in"),
        F.when(F.col("split") == "dev", F.lit(0)).alias("test_in"))
    results = run_grid(rows, {0: prof}, {0: counts["train"]["normal"]}, points,
                       sum(r["n"] for r in counts.values()), max_iterations, minibatch, seed,
                       init_cov, floor, weighted, solver, deviation, init)
    means, best = _choose(results)
    model = fit(
        train, lg.LogisticParams(best["reg"], best["lr_start"], best["lr_speed"], best["lam"]),
        best["k"], SEARCH_RATIO, max_iterations, minibatch, seed, solver, init_cov=init_cov, floor=floor,
        weighted=weighted, prof=prof, handle_unseen=handle_unseen, init=init, deviation=deviation)
    scored = model.transform(view.where("split = 'test'"))
    test = ev.auroc(scored.withColumn("positive", ev.positive(F.col("label"))))
    sizes = view.groupBy("split").agg(F.count("*").alias("n"))
    row = test.first()
    test = test.sparkSession.createDataFrame([tuple(row)], test.schema)
    seconds = time.time() - started
    return SearchReport(results, means, best, sizes, seconds, seconds / len(points), model, test,
                        scored)
