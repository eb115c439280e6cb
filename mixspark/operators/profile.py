"""Column limits of a mixed view, in one pass."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Above this many columns the limits are taken per position instead of as one wide aggregate.
WIDE = 64
# Fixed value: added to the range so that a constant column scales to 0.
RANGE_FLOOR = 1e-13


@dataclass(frozen=True)
class Profile:
    """Row count, largest value of each categorical, limits of each numeric. With ``indicator`` the
    categoricals are 0/1 already and each is its own slot."""

    n: int
    cat_max: tuple[int, ...]
    num_min: tuple[float, ...]
    num_max: tuple[float, ...]
    indicator: bool = False

    @property
    def d(self) -> int:
        return len(self.num_min)

    @property
    def widths(self) -> tuple[int, ...]:
        return tuple(1 if self.indicator else m + 1 for m in self.cat_max)

    @property
    def offsets(self) -> tuple[int, ...]:
        return tuple(sum(self.widths[:v]) for v in range(len(self.widths)))

    @property
    def slots(self) -> int:
        return sum(self.widths)

    @property
    def combinations(self) -> float:
        """Number of different categorical rows."""
        return float(math.prod(2 if self.indicator else w for w in self.widths))

    @property
    def spans(self) -> tuple[float, ...]:
        return tuple((b - a) + RANGE_FLOOR for a, b in zip(self.num_min, self.num_max))

    def loose(self) -> Profile:
        """The looser width rule: a column with values above 1 gets one slot more."""
        loose = tuple(m + 1 if m > 1 else 1 for m in self.cat_max)
        return replace(self, cat_max=loose)


def dimensions(view: DataFrame) -> tuple[int, int]:
    """(categoricals, numerics): as noted on the columns by the view, else from the first row."""
    noted = [view.schema[c].metadata.get("size") for c in ("cats", "nums")]
    if None not in noted:
        return noted[0], noted[1]
    row = view.select(F.size("cats").alias("c"), F.size("nums").alias("d")).first()
    if row is None:
        raise ValueError("the table is empty")
    return row["c"], row["d"]


def limit_columns(n_cats: int, n_nums: int) -> list:
    """The aggregate columns behind a profile."""
    out = [F.count("*").alias("n")]
    for v in range(n_cats):
        out += [F.max(F.col("cats")[v]).alias(f"cmax{v}"), F.min(F.col("cats")[v]).alias(f"cmin{v}")]
    for j in range(n_nums):
        out += [F.min(F.col("nums")[j]).alias(f"min{j}"), F.max(F.col("nums")[j]).alias(f"max{j}")]
    return out


def _profile(row, n_cats: int, n_nums: int) -> Profile:
    for v in range(n_cats):
        if row[f"cmin{v}"] is None or row[f"cmin{v}"] < 0:
            raise ValueError(f"categorical {v} must hold integers from 0")
    return Profile(
        int(row["n"]),
        tuple(int(row[f"cmax{v}"]) for v in range(n_cats)),
        tuple(float(row[f"min{j}"]) for j in range(n_nums)),
        tuple(float(row[f"max{j}"]) for j in range(n_nums)),
    )


def limits_by_position(view: DataFrame, group=()) -> DataFrame:
    """(kind, pos, lo, hi) rows: the form for tables with many columns."""
    cells = F.concat(
        F.transform("cats", lambda x, i: F.struct(
            F.lit("cat").alias("kind"), i.alias("pos"), x.cast("double").alias("x"))),
        F.transform("nums", lambda x, i: F.struct(
            F.lit("num").alias("kind"), i.alias("pos"), x.alias("x"))),
    )
    return (
        view.select(*group, F.explode(cells).alias("cell")).select(*group, "cell.*")
        .groupBy(*group, "kind", "pos")
        .agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    )


def _from_positions(rows) -> dict[str, float]:
    out = {"n": max((r["n"] for r in rows), default=0)}
    for r in rows:
        p = r["pos"]
        names = (f"cmin{p}", f"cmax{p}") if r["kind"] == "cat" else (f"min{p}", f"max{p}")
        out[names[0]], out[names[1]] = r["lo"], r["hi"]
    return out


def profile(view: DataFrame, dims: tuple[int, int] | None = None,
            encoding: str = "onehot") -> Profile:
    """Profile of a mixed view: one aggregate with partial aggregation on the map side."""
    if encoding not in ("onehot", "indicator"):
        raise ValueError("encoding must be 'onehot' or 'indicator'")
    n_cats, n_nums = dims or dimensions(view)
    if n_cats + n_nums > WIDE:
        row = _from_positions(limits_by_position(view).collect())
    else:
        row = view.agg(*limit_columns(n_cats, n_nums)).first()
    if not row["n"]:
        raise ValueError("the table is empty")
    p = _profile(row, n_cats, n_nums)
    if encoding == "onehot":
        return p
    if max(p.cat_max, default=0) > 1:
        raise ValueError("indicators must be 0 or 1")
    return replace(p, indicator=True)


def profiles_without(view: DataFrame, fold: str, folds: int,
                     dims: tuple[int, int] | None = None) -> list[Profile]:
    """For each fold, the profile of all rows outside it, from one aggregate by fold. Category
    widths are those of the whole table: they are its domain, not a fitted quantity."""
    n_cats, n_nums = dims or dimensions(view)
    if n_cats + n_nums > WIDE:
        rows: dict[int, list] = {}
        for r in limits_by_position(view, (fold,)).collect():
            rows.setdefault(r[fold], []).append(r)
        parts = {f: _profile(_from_positions(r), n_cats, n_nums) for f, r in rows.items()}
    else:
        found = view.groupBy(fold).agg(*limit_columns(n_cats, n_nums)).collect()
        parts = {r[fold]: _profile(r, n_cats, n_nums) for r in found}
    cat_max = tuple(max(p.cat_max[v] for p in parts.values()) for v in range(n_cats))
    out = []
    for f in range(folds):
        rest = [p for g, p in parts.items() if g != f]
        if not rest:
            raise ValueError(f"no training rows outside fold {f}")
        out.append(Profile(
            sum(p.n for p in rest), cat_max,
            tuple(min(p.num_min[j] for p in rest) for j in range(n_nums)),
            tuple(max(p.num_max[j] for p in rest) for j in range(n_nums)),
        ))
    return out


def profile_rows(view: DataFrame, dims: tuple[int, int]) -> DataFrame:
    """The profile as (kind, pos, lo, hi, n) rows, computed lazily from one wide aggregate."""
    n_cats, n_nums = dims
    cells = [
        F.struct(F.lit("cat").alias("kind"), F.lit(v).alias("pos"),
                 F.col(f"cmin{v}").cast("double").alias("lo"),
                 F.col(f"cmax{v}").cast("double").alias("hi"), F.col("n").alias("n"))
        for v in range(n_cats)
    ] + [
        F.struct(F.lit("num").alias("kind"), F.lit(j).alias("pos"), F.col(f"min{j}").alias("lo"),
                 F.col(f"max{j}").alias("hi"), F.col("n").alias("n"))
        for j in range(n_nums)
    ]
    wide = view.agg(*limit_columns(n_cats, n_nums))
    return wide.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
