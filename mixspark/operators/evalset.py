"""Columns and rows for labelled evaluation sets. Every draw is keyed by row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from mixspark.functions.expr import constants, kept_apart, total
from mixspark.functions.rand import EACH, WIDE, first_hit, normal, uniform, uniforms, wide_draws
from mixspark.operators.encode import set_category
from mixspark.operators.ordered import kth_lowest, ranked_values

# Rows a single expanded chunk stands for.
CHUNK = 65_536

# The default sizes of a generated set.
DEFAULT_TRAIN = 2500
DEFAULT_DEV = 500
DEFAULT_TEST = 500
DEFAULT_RANDOM_CATEGORICAL = 20
DEFAULT_RELATED_CATEGORICAL = 10
DEFAULT_NUMERIC = 100
DEFAULT_FRACTION = 0.01
DEFAULT_NOISE_SIGMA = 1.0
DEFAULT_NOISE_VARIABLES = 32
DEFAULT_BINARY_PROBABILITY = 0.5


@dataclass(frozen=True)
class Rule:
    """Columns that must all be 1, and the location and scale of each numeric it adds."""

    cols: tuple[int, ...]
    means: tuple[float, ...]
    sigmas: tuple[float, ...]


def group_rows(specs: DataFrame, seed=0) -> DataFrame:
    """Rows of each (grp, n, means, sigmas): one normal draw v per row, numeric j is
    v * sigma_j + mean_j, and the group is the category. Large groups are expanded in chunks that
    spread over all tasks."""
    chunks = specs.where("n > 0").withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                      ((F.col("n") - 1) / CHUNK).cast("bigint"))))
    chunks = chunks.repartition("grp", "chunk")
    low = F.col("chunk") * CHUNK + 1
    rows = chunks.withColumn(
        "id", F.explode(F.sequence(low, F.least(F.col("n"), low + (CHUNK - 1)))))
    v = normal(F.col("grp"), F.col("id"), "group", seed)
    rows = rows.withColumn("v", v)
    return rows.select(
        F.concat_ws(":", "grp", "id").alias("key"),
        F.array(F.col("grp").cast("int")).alias("cats"),
        F.zip_with("means", "sigmas", lambda m, s: F.col("v") * s + m).alias("nums"),
    )


def decaying_probability(i: int, xm: float = 2, alpha: float = 1.0) -> float:
    return (xm / (xm + i + 1.0)) ** alpha


def decaying_binary(rows: DataFrame, n_cols: int, xm: float = 2, alpha: float = 1.0,
                    seed=0) -> DataFrame:
    """Add ``bits``: 0/1 columns that get rarer from left to right."""
    p = constants([decaying_probability(i, xm, alpha) for i in range(n_cols)])
    return rows.withColumn("bits", F.transform(
        p, lambda x, i: (uniform(F.col("key"), "base", i, seed) < x).cast("int")))


def independent_binary(rows: DataFrame, n_cols: int, p: float = DEFAULT_BINARY_PROBABILITY,
                       seed=0) -> DataFrame:
    """Add ``bits``: independent 0/1 columns."""
    parts, p = (F.col("key"), "bit", EACH, seed), float(p)
    if _wide(n_cols, seed):
        bits = wide_draws(n_cols, parts, lambda u: u < p, "int")
    else:
        bits = F.transform(uniforms(n_cols, *parts), lambda u: (u < F.lit(p)).cast("int"))
    return rows.withColumn("bits", kept_apart(bits))


def location_scale(means: Column, sigmas: Column, *salt) -> Column:
    """U[0,1) * sigma + mean for each numeric of two arrays."""
    return F.transform(
        F.arrays_zip(means.alias("m"), sigmas.alias("s")),
        lambda t, j: uniform(F.col("key"), *salt, j) * t["s"] + t["m"])


def rule_holds(bits: Column, rule: Rule, match: str = "listed") -> Column:
    """All listed columns are 1; ``match="prefix"`` tests the first columns instead, as many as the
    rule lists."""
    if match not in ("listed", "prefix"):
        raise ValueError("match must be 'listed' or 'prefix'")
    cols = rule.cols if match == "listed" else range(len(rule.cols))
    out = F.lit(True)
    for c in cols:
        out = out & (bits[c] == 1)
    return out


def rule_match(rows: DataFrame, rules: list[Rule], default: Rule, match: str = "listed",
               seed=0) -> DataFrame:
    """Add ``rules``, the matched rule numbers (-1 alone if none), and ``nums``: the sum of one
    location-scale draw per matched rule, or the default's draw."""
    bits, key = F.col("bits"), F.col("key")
    matched = F.array_compact(F.array(*[
        F.when(rule_holds(bits, r, match), F.lit(i)) for i, r in enumerate(rules)
    ])) if rules else F.array().cast("array<int>")
    rows = rows.withColumn("rules", matched)
    rows = rows.withColumn(
        "rules", F.when(F.size("rules") == 0, F.array(F.lit(-1))).otherwise(F.col("rules")))

    def draw(i, r, j):
        return uniform(key, "rule", i, j, seed) * F.lit(float(r.sigmas[j])) + F.lit(float(r.means[j]))

    nums = []
    for j in range(len(default.means)):
        parts = [F.when(F.array_contains("rules", i), draw(i, r, j)).otherwise(0.0)
                 for i, r in [(-1, default), *enumerate(rules)]]
        nums.append(total(parts))
    return rows.withColumn("nums", F.array(*nums))


def rule_coverage(matched: DataFrame) -> DataFrame:
    """(rule, n, share) of rows per rule, largest first. Row total and rule counts come from one
    pass: each row also counts once under no rule."""
    marks = F.concat("rules", F.array(F.lit(None).cast("int")))
    counts = matched.select(F.explode(marks).alias("rule")).groupBy("rule").agg(
        F.count("*").alias("n"))
    everything = counts.where("rule IS NULL").select(F.col("n").alias("__all"))
    return (
        counts.where("rule IS NOT NULL").crossJoin(F.broadcast(everything))
        .select("rule", "n", (F.col("n") / F.col("__all")).alias("share"))
        .orderBy(F.desc("n"), "rule")
    )


def draft_rules(ids: DataFrame, size: int, seed=0, rule: str = "rule") -> DataFrame:
    """Add ``bits``, a random 0/1 vector with at least two ones per rule. Bits are drawn in passes
    until two are set; a bit's first successful pass is one draw, so the passes need no loop."""
    if size < 2:
        raise ValueError("a rule needs at least two columns")
    t = F.array(*[
        first_hit(uniform(F.col(rule), "draft", c, seed), 1.0 / size) for c in range(size)
    ])
    rows = ids.withColumn("__t", t).withColumn("__last", F.array_sort("__t")[1])
    bits = F.transform("__t", lambda x: (x <= F.col("__last")).cast("int"))
    return rows.withColumn("bits", bits).drop("__t", "__last")


def shares(bits: Column, rules: list[list[int]]) -> Column:
    """For each rule, the share of its columns that are 1."""
    ones = F.array(*[constants([c for c, on in enumerate(r) if on], "int") for r in rules])
    return F.transform(ones, lambda cols: F.aggregate(
        cols, F.lit(0.0), lambda acc, c: acc + F.get(bits, c)) / F.size(cols))


def _wide(n: int, seed, rules: list[list[int]] = ()) -> bool:
    """Whether n draws of a row are made in numpy. A rule without columns has no share."""
    return n in WIDE and not isinstance(seed, Column) and all(any(r) for r in rules)


def _shares_of(bits: pa.Array, rules: list[list[int]]) -> np.ndarray:
    """``shares`` of an Arrow batch; not a number where a column of the rule is missing."""
    width = max(len(r) for r in rules)
    places = bits.offsets.to_numpy()
    at = places[:-1, None] + np.arange(width)
    flat = np.append(bits.values.to_numpy(zero_copy_only=False).astype(float), np.nan)
    # A line for each column, so that a sum runs over whole lines.
    cols = np.where(at < places[1:, None], flat[np.minimum(at, len(flat) - 1)], np.nan).T.copy()
    out = np.empty((len(bits), len(rules)))
    for i, r in enumerate(rules):
        on = [c for c, x in enumerate(r) if x]
        out[:, i] = sum(cols[c] for c in on) / len(on)
    return out


def dependent_binary(rows: DataFrame, rules: list[list[int]], seed=0) -> DataFrame:
    """Put one 0/1 column per rule before ``bits``: 1 with the rule's share as probability."""
    parts, n = (F.col("key"), "dep", EACH, seed), len(rules)
    if _wide(n, seed, rules):
        def set_where_below(u, bits):
            p = _shares_of(bits, rules)
            return np.where(np.isnan(p), p, u < p)

        extra = wide_draws(n, parts, set_where_below, "int", F.col("bits"))
    else:
        extra = F.zip_with(uniforms(n, *parts), shares(F.col("bits"), rules),
                           lambda u, p: (u < p).cast("int"))
    return rows.withColumn("bits", kept_apart(F.concat(extra, F.col("bits"))))


def dependent_numeric(rows: DataFrame, rules: list[list[int]], seed=0) -> DataFrame:
    """Add ``nums``: one per rule with the share p as location and 1/(p+1) as scale."""
    parts, n = (F.col("key"), "num", seed, EACH), len(rules)
    if _wide(n, seed, rules):
        def located(u, bits):
            p = _shares_of(bits, rules)
            return u * (1.0 / (p + 1.0)) + p

        return rows.withColumn("nums", wide_draws(n, parts, located, "double", F.col("bits")))
    return rows.withColumn("nums", F.zip_with(
        uniforms(n, *parts), shares(F.col("bits"), rules),
        lambda u, p: u * (1.0 / (p + 1.0)) + p))


def category_flip(view: DataFrame, options: int, seed=0) -> DataFrame:
    """Replace the first categorical by a different value and label the row an anomaly."""
    if options < 2:
        raise ValueError("a different value needs at least two options")
    v, u = F.col("cats")[0], uniform(F.col("key"), "flip", seed)
    other = F.when(
        v < options, (v + 1 + F.floor(u * (options - 1)).cast("int")) % options
    ).otherwise(F.floor(u * options).cast("int"))
    return view.withColumns({"cats": set_category(F.col("cats"), 0, other), "label": F.lit(1)})


def noise_positions(n_cats: int, n_nums: int, m: int, choice: str = "scan", seed=0) -> Column:
    """The m positions to corrupt (categoricals first). ``scan`` favours earlier columns: columns
    are passed over in order, each taken with probability m/total, until m are taken;
    ``uniform`` gives every set of m the same chance."""
    n = n_cats + n_nums
    m = min(m, n)
    if m < 1:
        return F.array().cast("array<int>")
    f, key = m / n, F.col("key")
    order = {
        "scan": lambda i: first_hit(uniform(key, "pick", i, seed), f),
        "uniform": lambda i: uniform(key, "pick", i, seed),
    }[choice]
    ranked = F.array_sort(F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct(order(i).alias("t"), i.alias("pos"))))
    return F.transform(F.slice(ranked, 1, m), lambda s: s["pos"])


def noise_inject(view: DataFrame, n_cats: int, n_nums: int, m: int = DEFAULT_NOISE_VARIABLES,
                 sigma: float = DEFAULT_NOISE_SIGMA, hit: Column | None = None,
                 choice: str = "scan", seed=0) -> DataFrame:
    """Corrupt m columns of the rows where ``hit`` holds (all by default): a chosen categorical c
    becomes (c+1) % 2, a chosen numeric gets N(0, sigma) added, and the label becomes 1."""
    hit = F.lit(True) if hit is None else hit
    key, chosen = F.col("key"), F.col("__chosen")
    rows = view.withColumn("__hit", hit)
    rows = rows.withColumn(
        "__chosen", F.when(F.col("__hit"), noise_positions(n_cats, n_nums, m, choice, seed)))
    cats = F.transform(
        "cats", lambda c, i: F.when(F.array_contains(chosen, i), (c + 1) % 2).otherwise(c))
    nums = F.transform(
        "nums", lambda x, i: F.when(
            F.array_contains(chosen, i + n_cats), x + normal(key, "noise", i, seed) * F.lit(sigma)
        ).otherwise(x))
    label = F.col("label") if "label" in view.columns else F.lit(0)
    return rows.withColumns({
        "cats": F.when(F.col("__hit"), cats).otherwise(F.col("cats")),
        "nums": F.when(F.col("__hit"), nums).otherwise(F.col("nums")),
        "label": F.when(F.col("__hit"), F.lit(1)).otherwise(label),
    }).drop("__hit", "__chosen")


def inject_rows(fraction: float, seed=0) -> Column:
    """Whether a row is picked for corruption."""
    return uniform(F.col("key"), "inject", seed) < F.lit(float(fraction))


def split_by_fraction(view: DataFrame, train: float, dev: float, seed=0) -> DataFrame:
    """Add ``split`` by keyed draw; what is left over is the test set."""
    u = uniform(F.col("key"), "split", seed)
    return view.withColumn(
        "split", F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test"))


def split_by_position(view: DataFrame, train: int, dev: int, test: int,
                      order: str = "key") -> DataFrame:
    """Exact set sizes: the first rows in order of a unique column train, the next dev, then test;
    rows beyond are left out. For a numeric column the sets are cut at exact order statistics and
    no row moves; another column is ranked in buckets."""
    names = ("train", "dev", "test")
    ends = [train, train + dev, train + dev + test]
    if isinstance(view.schema[order].dataType, NumericType):
        n, split = view.count(), None
        for name, end in zip(names, ends):
            if end >= n:
                here = F.lit(True)
            elif end < 1:
                here = F.lit(False)
            else:
                here = F.col(order) <= F.lit(kth_lowest(view, order, end)[0])
            split = F.when(here, name) if split is None else split.when(here, name)
        return view.withColumn("split", split).where("split IS NOT NULL")
    ranked = ranked_values(view, order, "__pos")
    p = F.col("__pos")
    split = F.when(p < ends[0], "train").when(p < ends[1], "dev").when(p < ends[2], "test")
    return ranked.withColumn("split", split).where("split IS NOT NULL").drop("__pos")


def set_summary(view: DataFrame) -> DataFrame:
    return view.groupBy("split").agg(
        F.count("*").alias("n"), F.sum("label").alias("anomalies"))


def conditional_resample(view: DataFrame, index: int, max_value: int,
                         factor: Callable[[Column, Column], Column], seed=0) -> DataFrame:
    """Redraw one categorical: value v with probability proportional to
    ``factor(cats with v in place, nums)``. A row's candidates are few and stay within the row."""
    cats, nums = F.col("cats"), F.col("nums")
    weights = F.transform(
        F.sequence(F.lit(0), F.lit(max_value)),
        lambda v: factor(set_category(cats, index, v), nums).cast("double"))
    rows = view.withColumn("__w", weights)
    # Running totals; the pick falls into the first one above it, or the last value if none is.
    sums = F.aggregate(
        "__w", F.array(F.lit(0.0)),
        lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w)))
    rows = rows.withColumn("__cum", F.slice(sums, 2, max_value + 1))
    pick = uniform(F.col("key"), "resample", index, seed) * F.element_at("__cum", -1)
    rows = rows.withColumn("__pick", pick)
    value = F.least(F.size(F.filter("__cum", lambda c: c <= F.col("__pick"))), F.lit(max_value))
    return rows.withColumn("cats", set_category(cats, index, value)).drop("__w", "__cum", "__pick")
