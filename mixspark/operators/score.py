"""Thresholds and flags over scored rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from mixspark.operators.ordered import bracket, kth_lowest
from mixspark.sources.scratch import stored


@dataclass
class Scored:
    """Scored rows in files, ascending by score in each, and what the search for a rank begins with."""

    rows: DataFrame
    first: dict
    col: str = "score"

    def threshold(self, ratio: float) -> tuple[float, int, int]:
        """(threshold, rank, rows): the score of the last row within the ratio."""
        return kth_lowest(self.rows, self.col, lambda n: target_rank(n, ratio), first=self.first)


def scored_once(scored: DataFrame, col: str = "score") -> Scored:
    """Compute and write the scores in one pass that also takes their quantiles. Whatever asks for low
    scores afterwards reads only the row groups that hold some."""
    seen = Observation()
    watched = scored.observe(seen, *bracket(F.col(col)))
    rows = stored(watched.sortWithinPartitions(col), "scored")
    return Scored(rows, seen.get, col)


def target_rank(n: int, ratio: float) -> int:
    """How many rows a ratio stands for: at least one."""
    return max(1, int(n * ratio))


def threshold_exact(scored: DataFrame, ratio: float, col: str = "score") -> tuple[float, int, int]:
    """(threshold, rank, rows): the score of the last row within the ratio."""
    return kth_lowest(scored, col, lambda n: target_rank(n, ratio))


def threshold_approx(scored: DataFrame, ratio: float, accuracy: int = 10_000,
                     col: str = "score") -> float:
    """A threshold from one pass of mergeable sketches."""
    return scored.agg(F.percentile_approx(col, float(ratio), accuracy).alias("t")).first()["t"]


def score_limits(scored: DataFrame, col: str = "score", by=()) -> DataFrame:
    out = [F.min(col).alias("min_score"), F.max(col).alias("max_score")]
    return scored.groupBy(*by).agg(*out) if by else scored.agg(*out)


def flag(scored: DataFrame, threshold: float, inclusive: bool = True,
         col: str = "score") -> DataFrame:
    """Add ``is_anomaly``. Inclusive flags the threshold row itself, so a rank-k threshold flags k
    rows (and ties); ``inclusive=False`` keeps only rows strictly below."""
    t: Column = F.lit(float(threshold))
    hit = F.col(col) <= t if inclusive else F.col(col) < t
    return scored.withColumn("is_anomaly", hit)
