"""Find the least likely rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mixspark.functions.expr import kept_apart
from mixspark.operators import score as sc
from mixspark.plans.model import MixedModel, fit


def flag_rows(model: MixedModel, view: DataFrame, ratio: float = 0.03,
              threshold: float | None = None, method: str = "exact", inclusive: bool = True,
              handle_unseen: str = "zero") -> DataFrame:
    """Score and flag. The threshold is the ``ratio`` rank of the scores, exactly or by sketch,
    unless a fixed one is given. Rows are scored once: where the threshold follows from the scores, the scored
    rows are written and the flagged ones read back, from the row groups with scores that low."""
    scored = model.transform(view, handle_unseen)
    if threshold is not None:
        # Kept apart, a filter on the flag does not repeat the columns the score is built from.
        scored = scored.withColumn("score", kept_apart(F.col("score")))
    else:
        if method not in ("exact", "approx"):
            raise ValueError("method must be 'exact' or 'approx'")
        once = sc.scored_once(scored)
        scored = once.rows
        if method == "exact":
            threshold, _, _ = once.threshold(ratio)
        else:
            threshold = sc.threshold_approx(scored, ratio)
    return sc.flag(scored, threshold, inclusive)


def detect(view: DataFrame, ratio: float = 0.03, threshold: float | None = None,
           method: str = "exact", inclusive: bool = True, handle_unseen: str = "zero",
           **fit_options) -> DataFrame:
    """Fit on all rows and return the flagged ones. A null category sets no slot; with
    ``handle_unseen="error"`` it stops the fit."""
    model = fit(view, anomaly_ratio=ratio, handle_unseen=handle_unseen, **fit_options)
    return flag_rows(model, view, ratio, threshold, method, inclusive, handle_unseen).where("is_anomaly")
