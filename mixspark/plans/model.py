"""The fitted model and how to fit one."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.operators import logistic as lg
from mixspark.operators import mixture as mx
from mixspark.operators.encode import encode
from mixspark.operators.profile import Profile, profile
from mixspark.operators.sample import (
    few_tasks, may_draw, minibatch_fraction, mixture_draw, mixture_fraction, steps_to_draw,
)


@dataclass
class MixedModel:
    """Profile, slot weights and mixture: everything scoring needs, a few numbers per column."""

    profile: Profile
    w: np.ndarray
    mixture: mx.Mixture | None
    lam: float = 1.0
    weighted: bool = False
    floor: float = 0.0
    trained: lg.Trained | None = field(default=None, repr=False)

    def score_encoded(self, encoded: DataFrame) -> DataFrame:
        """Add score_cat, score_num and score to encoded rows. A narrow projection."""
        p = self.profile
        scored = lg.add_log_prob(encoded, self.w, p.d, len(p.cat_max), self.lam)
        if self.mixture is None:  # no numerics
            scored = scored.withColumn("score_num", F.lit(0.0))
        else:
            scored = mx.add_log_density(scored, self.mixture, self.weighted, self.floor)
        return scored.withColumn("score", F.col("score_cat") + F.col("score_num"))

    def transform(self, view: DataFrame, handle_unseen: str = "zero") -> DataFrame:
        """Score a mixed view, batch or streaming; its own columns stay as they were."""
        p = self.profile
        rows = view.withColumns({"__cats": F.col("cats"), "__nums": F.col("nums")})
        scored = self.score_encoded(encode(rows, p, handle_unseen=handle_unseen))
        return scored.select(
            *[F.col(f"__{c}").alias(c) if c in ("cats", "nums") else F.col(c)
              for c in view.columns], "score_cat", "score_num", "score")


def fit(view: DataFrame, params: lg.LogisticParams | None = None, k: int = 4,
        anomaly_ratio: float = 0.03, max_iterations: int = 100, minibatch: int = 100, seed: int = 0,
        solver: str = "auto", init_cov: str = "std", floor: float = 1e-9, weighted: bool = False,
        train_on: str = "all", prof: Profile | None = None,
        encoding: str = "onehot", handle_unseen: str = "error", slots: str = "random",
        init: str = "uniform", loose: bool = False, deviation: str = "rms") -> MixedModel:
    """Fit on a mixed view. Two passes over the data: one for the profile, one that draws the
    minibatches and the mixture's sample together; all later work is on those bounded draws.

    ``handle_unseen="zero"`` lets null categories, and those outside a given profile, set no slot.
    ``loose`` takes the looser slot widths. The mixture's sample has about as many rows as ``k`` and
    ``anomaly_ratio`` ask for, at most the table's. Weights and mixture are fitted over all tasks, each in one
    job of many rounds ("auto", "barrier") or a job per round ("aggregate", and "auto" where a session
    cannot run its tasks at once or they cannot hold the rows); "pooled" runs the weights' steps in one task.
    All give the same model."""
    if train_on not in ("all", "normal"):
        raise ValueError("train_on must be 'all' or 'normal'")
    params = params or lg.LogisticParams()
    rows = view.where("label = 0") if train_on == "normal" else view
    if prof is None:
        prof = profile(rows, encoding=encoding)
        n = prof.n
    else:
        n = rows.count()
    if loose:
        prof = prof.loose()
    encoded = encode(rows.select("key", "cats", "nums"), prof, handle_unseen=handle_unseen).select("key", "nums", "slots")
    d, width = prof.d, prof.slots
    steps = max_iterations - 1
    f = minibatch_fraction(n, minibatch)
    drawn = steps_to_draw(steps, n, f)
    mix_f = mixture_fraction(n, k, anomaly_ratio)
    in_mixture = mixture_draw(F.lit(mix_f), seed)
    pooled = slots == "random" and lg.pool_fits(drawn, f)  # else a step may need any row
    wanted = in_mixture
    if pooled:
        wanted = wanted | may_draw(drawn, f, "mb", seed)
    # A few thousand rows from all over the table: even them out over a few tasks.
    taken = encoded.where(wanted).repartition(few_tasks(view.sparkSession)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trained = lg.train(
            taken if pooled else encoded, n, d, width, params, max_iterations, minibatch, seed,
            solver, slots, init)
        sample = taken.where(in_mixture)
        if d == 0:
            mixture = None
        else:
            rows = sample.select(
                F.lit(0).alias("grp"), F.lit(k).alias("k"), mx.draw_of(F.col("key"), seed).alias("u"), "nums")
            options = mx.FitOptions(init_cov, deviation, floor)
            together = {"aggregate": False, "barrier": True}.get(solver)
            mixture = mx.fit_mixtures(rows, [(0, k)], d, n * mix_f, options, one_job=together)[0, k].mixture
    finally:
        taken.unpersist()
    return MixedModel(prof, trained.w, mixture, params.lam, weighted, floor, trained)
