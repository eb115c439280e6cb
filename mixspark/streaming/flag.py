"""Scoring and flagging hold no state, so a fitted model also applies to a stream of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from mixspark.operators.score import flag
from mixspark.plans.model import MixedModel


def flag_stream(model: MixedModel, view: DataFrame, threshold: float,
                inclusive: bool = True) -> DataFrame:
    """Flag rows of a streaming mixed view against a threshold fixed beforehand."""
    return flag(model.transform(view), threshold, inclusive)
