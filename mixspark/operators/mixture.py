"""Gaussian mixture over the numerics: k-means start, EM, density."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.functions.expr import constants, log_sum_exp, total
from mixspark.functions.rand import uniform
from mixspark.operators.rounds import Rounds, run, run_here, tasks_for

# The iteration limits and tolerance of the fit, and the attempts before giving up.
KMEANS_ITERATIONS = 10
EM_ITERATIONS = 100
EM_TOLERANCE = 0.01
ATTEMPTS = 20
EPS = float(np.finfo(float).eps)
# Fixed value: centres that move no further than this end k-means.
KMEANS_MOVE = 1e-4
# Turns of drawing candidates for the start of k-means, and what sets a row's draws of the turns apart.
OVERSAMPLING = 2
TURN = 0.618033988749895

# Terms of the quadratic forms written out as generated code (its methods must stay small enough
# to be compiled to machine code); beyond that, numpy over Arrow batches.
DENSITY_TERMS = 320


@dataclass
class Mixture:
    weights: np.ndarray  # (k,)
    mu: np.ndarray  # (k, d)
    sigma: np.ndarray  # (k, d, d)

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def d(self) -> int:
        return self.mu.shape[1]

    @property
    def terms(self) -> int:
        return self.k * self.d * (self.d + 1) // 2

    def roots(self, floor: float = 0.0):
        """Per component the matrix R and constant c of ln pdf(x) = c - |R (x - mu)|^2 / 2.
        Directions without variance are left out of both, as a pseudo-inverse does."""
        out = []
        for cov in self.sigma:
            values, vectors = np.linalg.eigh(cov + floor * np.eye(self.d))
            keep = values > EPS * max(values.max(), 0.0) * self.d
            if not keep.any():
                raise ValueError("a component has no variance in any direction")
            root = vectors[:, keep].T / np.sqrt(values[keep])[:, None]
            root = np.linalg.qr(root, mode="r")  # same norm, half the terms
            c = -0.5 * (self.d * math.log(2 * math.pi) + np.log(values[keep]).sum())
            out.append((root, float(c)))
        return out


# ---- density ---------------------------------------------------------------------------------

def add_log_density(df: DataFrame, m: Mixture, weighted: bool = False, floor: float = 0.0,
                    out: str = "score_num") -> DataFrame:
    """Add ln of the sum of the component densities of ``nums``, unweighted unless asked for."""
    roots, mu, weights = m.roots(floor), m.mu, m.weights
    if m.terms > DENSITY_TERMS:

        @F.pandas_udf("double")
        def density(n: pd.Series) -> pd.Series:
            x = np.stack(n.to_numpy()) if len(n) else np.zeros((0, mu.shape[1]))
            return pd.Series(log_density_batch(x, roots, mu, weights if weighted else None))

        return df.withColumn(out, density("nums"))
    # Numerics and component terms are columns of their own: each is computed once.
    rows = df.withColumns({
        f"__x{j}": F.coalesce(F.col("nums")[j], F.lit(float("nan"))) for j in range(m.d)})
    logs = {}
    for i, (root, c) in enumerate(roots):
        if weighted:
            if weights[i] <= 0:
                continue
            c += math.log(weights[i])
        squares = []
        for row in root:
            y = total([(F.col(f"__x{j}") - F.lit(float(mu[i][j]))) * F.lit(float(row[j]))
                       for j in range(m.d) if row[j] != 0.0])
            squares.append(y * y)
        logs[f"__l{i}"] = F.lit(c) - 0.5 * total(squares)
    rows = rows.withColumns(logs)
    return rows.withColumn(out, log_sum_exp([F.col(c) for c in logs])).drop(
        *logs, *[f"__x{j}" for j in range(m.d)])


def log_pdf_batch(x, roots, mu):
    """Rows x components ln pdf."""
    return np.stack([
        c - 0.5 * (((x - mu[i]) @ root.T) ** 2).sum(axis=1) for i, (root, c) in enumerate(roots)
    ], axis=1)


def log_density_batch(x, roots, mu, weights=None):
    logs = log_pdf_batch(x, roots, mu)
    if weights is not None:
        with np.errstate(divide="ignore"):
            logs = logs + np.log(weights)
    top = logs.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True)))[:, 0]


# ---- k-means and the initial mixture ---------------------------------------------------------

def squared_distance(nums: Column, centre) -> Column:
    if len(centre) <= 64:
        at = constants([float(c) for c in centre])
        return total([(nums[j] - at[j]) * (nums[j] - at[j]) for j in range(len(centre))])
    terms = F.zip_with(nums, constants([float(c) for c in centre]), lambda x, c: (x - c) * (x - c))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def assign(sample: DataFrame, centres) -> DataFrame:
    """Add the nearest centre as ``comp`` and its squared distance; the first wins ties."""
    best = F.least(*[
        F.struct(squared_distance(F.col("nums"), c).alias("dist"), F.lit(i).alias("comp"))
        for i, c in enumerate(centres)
    ]) if len(centres) > 1 else F.struct(
        squared_distance(F.col("nums"), centres[0]).alias("dist"), F.lit(0).alias("comp"))
    return sample.withColumn("__best", best).select(
        *sample.columns, F.col("__best.comp").alias("comp"), F.col("__best.dist").alias("dist"))


DEVIATIONS = ("rms", "summed")


def cluster_deviation(assigned: DataFrame, centres, deviation: str = "rms") -> DataFrame:
    """(comp, n, dev): deviation from the centre in each dimension. "rms" is the root of the mean square,
    "summed" the root of the sum of squares, divided by the rows."""
    if deviation not in DEVIATIONS:
        raise ValueError("deviation must be 'rms' or 'summed'")

    def spread(x: Column) -> Column:
        return F.sqrt(F.avg(x)) if deviation == "rms" else F.sqrt(F.sum(x)) / F.count(x)

    d = len(centres[0])
    at = F.create_map(*[x for i, c in enumerate(centres)
                        for x in (F.lit(i), constants([float(v) for v in c]))])
    diff = F.zip_with("nums", at[F.col("comp")], lambda x, c: (x - c) * (x - c))
    rows = assigned.select("comp", diff.alias("sq"))
    if d <= 64:
        return rows.groupBy("comp").agg(
            F.count("*").alias("n"),
            F.array(*[spread(F.col("sq")[j]) for j in range(d)]).alias("dev"))
    cells = rows.select("comp", F.posexplode("sq").alias("pos", "x"))
    parts = cells.groupBy("comp", "pos").agg(F.count("*").alias("n"), spread(F.col("x")).alias("s"))
    return parts.groupBy("comp").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda t: t["s"])
        .alias("dev"))


def initial_from_deviation(rows, centres, init_cov: str = "std") -> Mixture:
    """Equal weights, centres as means, diagonal covariances. Empty clusters vanish.
    ``init_cov="std"`` puts the deviation itself on the diagonal, ``"var"`` its square."""
    if init_cov not in ("std", "var"):
        raise ValueError("init_cov must be 'std' or 'var'")
    rows = sorted(rows, key=lambda r: r["comp"])
    power = 1 if init_cov == "std" else 2
    return Mixture(
        np.full(len(rows), 1.0 / len(rows)),
        np.array([centres[r["comp"]] for r in rows], dtype=float),
        np.array([np.diag(np.asarray(r["dev"], dtype=float) ** power) for r in rows]),
    )


def initial_mixture(sample: DataFrame, centres, init_cov: str = "std", deviation: str = "rms") -> Mixture:
    return initial_from_deviation(
        cluster_deviation(assign(sample, centres), centres, deviation).collect(), centres, init_cov)


def mixture_frame(spark: SparkSession, m: Mixture) -> DataFrame:
    """(comp, weight, mu, sigma): k rows."""
    rows = [(i, float(m.weights[i]), m.mu[i].tolist(), m.sigma[i].tolist()) for i in range(m.k)]
    return spark.createDataFrame(
        rows, "comp int, weight double, mu array<double>, sigma array<array<double>>")


# ---- EM --------------------------------------------------------------------------------------

def em_sums(sample: DataFrame, m: Mixture, floor: float = 0.0) -> DataFrame:
    """Sufficient statistics of one E-step as one row per component:
    (comp, loglik, r, s0.., s0_0, s0_1..). A row's responsibilities never leave its task."""
    d = m.d
    flat = []
    for root, c in m.roots(floor):
        square = np.zeros((d, d))
        square[:len(root)] = root
        flat.append((square, c))
    # Model numbers sit in constant arrays, so every iteration reuses the same compiled code.
    roots = constants([float(v) for r, _ in flat for v in r.ravel()])
    consts = constants([c for _, c in flat])
    mus = constants([float(v) for v in m.mu.ravel()])
    weights = constants([float(v) for v in m.weights])
    rows = sample.select(*[
        F.coalesce(F.col("nums")[j], F.lit(float("nan"))).alias(f"x{j}") for j in range(d)])
    x = [F.col(f"x{j}") for j in range(d)]
    p = []
    for i in range(m.k):
        diff = [x[j] - mus[i * d + j] for j in range(d)]
        q = total([
            (lambda y: y * y)(total([diff[j] * roots[(i * d + a) * d + j] for j in range(a, d)]))
            for a in range(d)
        ])
        p.append(F.lit(EPS) + weights[i] * F.exp(consts[i] - 0.5 * q))
    rows = rows.withColumn("p", F.array(*p))
    rows = rows.withColumn("t", total([F.col("p")[i] for i in range(m.k)]))
    rows = rows.select("*", F.posexplode("p").alias("comp", "pc"))
    r = F.col("r")
    return rows.withColumn("r", F.col("pc") / F.col("t")).groupBy("comp").agg(
        F.sum(F.log("t")).alias("loglik"), F.count("*").alias("n"), F.sum(r).alias("r"),
        *[F.sum(r * x[j]).alias(f"s{j}") for j in range(d)],
        *[F.sum(r * x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)],
    )


def maximise_rows(sums: DataFrame, d: int) -> DataFrame:
    """M-step as columns: (comp, weight, mu0.., s00, s01.., loglik)."""
    r = F.col("r")
    mu = [F.col(f"s{j}") / r for j in range(d)]
    return sums.select(
        "comp", (r / F.col("n")).alias("weight"), *[mu[j].alias(f"mu{j}") for j in range(d)],
        *[(F.col(f"s{i}_{j}") / r - mu[i] * mu[j]).alias(f"s{i}{j}")
          for i in range(d) for j in range(i, d)],
        "loglik")


def em_batch(x, m: Mixture, floor: float = 0.0, roots=None):
    """The same statistics of a batch: (loglik, n, r[k], s[k,d], ss[k,d,d])."""
    p = EPS + m.weights * np.exp(log_pdf_batch(x, roots or m.roots(floor), m.mu))
    t = p.sum(axis=1)
    r = p / t[:, None]
    return (float(np.log(t).sum()), len(x), r.sum(axis=0), r.T @ x,
            np.einsum("nk,ni,nj->kij", r, x, x, optimize=True))


def maximise(r, s, ss) -> Mixture:
    """M-step."""
    mu = s / r[:, None]
    sigma = ss / r[:, None, None] - np.einsum("ki,kj->kij", mu, mu)
    return Mixture(r / r.sum(), mu, sigma)


# ---- fits in rounds --------------------------------------------------------------------------

@dataclass(frozen=True)
class FitOptions:
    """What holds for all fits of a call. ``only_centres`` ends a fit after its k-means."""

    init_cov: str = "std"
    deviation: str = "rms"
    floor: float = 0.0
    max_iter: int = EM_ITERATIONS
    tol: float = EM_TOLERANCE
    kmeans_iter: int = KMEANS_ITERATIONS
    attempts: int = ATTEMPTS
    only_centres: bool = False


def shifted(u, attempt: int, turn: int):
    """A row's draw for one turn of one attempt, from its one draw in [0, 1)."""
    return (u + (attempt * (OVERSAMPLING + 1) + turn) * TURN) % 1.0


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the first of equals, and its squared distance."""
    d2 = np.stack([((x - c) ** 2).sum(axis=1) for c in centres], axis=1)
    near = d2.argmin(axis=1)
    return near, d2[np.arange(len(x)), near]


def spread_out(candidates: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """At most k of the candidates: the heaviest, then again and again the one of the largest weight times
    squared distance to those chosen. Candidates in one place count once; the first wins ties."""
    chosen = [int(np.argmax(weights))]
    while len(chosen) < k:
        gain = weights * nearest(candidates, candidates[chosen])[1]
        if gain.max() <= 0:
            break
        chosen.append(int(np.argmax(gain)))
    return candidates[chosen]


class Fit:
    """One mixture: k-means (a start by oversampling, then mean updates), first covariances, EM. A round
    computes what its ``stage`` names from the rows of each task. A fit that fails starts again with other
    draws; that is its next attempt."""

    def __init__(self, k: int, options: FitOptions, start: Mixture | None = None):
        self.k, self.options = k, options
        self.attempt, self.done, self.error, self.failures = 0, False, None, []
        self.seconds = 0.0
        if start is None:
            self._begin()
        else:
            self._tried(lambda: self._expect(start))

    def _begin(self):
        self.stage, self.turn, self.iterations, self.previous = "first", 0, 0, None

    def _expect(self, m: Mixture):
        """Go on with an E-step under ``m``."""
        self.mixture, self.roots = m, m.roots(self.options.floor)
        if self.stage_is_new("em"):
            self.iterations, self.previous = 0, None

    def stage_is_new(self, name: str) -> bool:
        new, self.stage = getattr(self, "stage", None) != name, name
        return new

    # ---- in the tasks

    def part(self, x: np.ndarray, u: np.ndarray):
        if self.stage == "first":
            turn = shifted(u, self.attempt, 0)
            at = np.lexsort((*x.T[::-1], turn))[:1]
            return np.column_stack([turn[at], x[at]])
        if self.stage == "cost":
            return nearest(x, self.centres)[1].sum()
        if self.stage == "draw":
            d2 = nearest(x, self.centres)[1]
            turn = shifted(u, self.attempt, self.turn)
            hit = turn < 2 * self.k * d2 / self.cost
            return np.column_stack([turn[hit], x[hit]])
        if self.stage in ("weigh", "lloyd", "deviation"):
            near, d2 = nearest(x, self.centres)
            n = np.bincount(near, minlength=len(self.centres)).astype(float)
            if self.stage == "weigh":
                return n
            values = x if self.stage == "lloyd" else (x - self.centres[near]) ** 2
            return np.column_stack([n, np.eye(len(n))[near].T @ values])
        return em_batch(x, self.mixture, roots=self.roots)

    def merge(self, parts: list):
        if self.stage == "em":
            return tuple(sum(p) for p in zip(*parts))
        if self.stage in ("first", "draw"):
            rows = np.concatenate(parts)
            return rows[np.lexsort(rows.T[::-1])][:1 if self.stage == "first" else None]
        return sum(parts)

    # ---- the same everywhere

    def advance(self, merged) -> None:
        self._tried(lambda: getattr(self, f"_{self.stage}")(merged))

    def _tried(self, step) -> None:
        try:
            step()
        except (ValueError, np.linalg.LinAlgError, ZeroDivisionError) as e:
            self.failures.append(str(e))
            self.attempt += 1
            if self.attempt >= self.options.attempts:
                self.done = True
                self.error = f"the mixture could not be fitted in {self.attempt} attempts: {e}"
            else:
                self._begin()

    def _first(self, rows):
        if not len(rows):
            raise ValueError("no rows")
        self.centres, self.turn, self.stage = rows[:, 1:], 0, "cost"

    def _cost(self, cost):
        self.cost, self.turn = float(cost), self.turn + 1
        if not np.isfinite(self.cost):
            raise ValueError("a row is not finite")
        self.stage = "draw" if self.cost > 0 else "weigh"

    def _draw(self, rows):
        self.centres = np.concatenate([self.centres, rows[:, 1:]])
        self.stage = "cost" if self.turn < OVERSAMPLING else "weigh"

    def _weigh(self, n):
        self.centres = spread_out(self.centres, n, self.k)
        self.stage = "lloyd"

    def _lloyd(self, sums):
        n = sums[:, 0]
        mean = sums[:, 1:] / np.maximum(n, 1.0)[:, None]
        new = np.where(n[:, None] > 0, mean, self.centres)
        moved = ((new - self.centres) ** 2).sum(axis=1).max()
        self.centres, self.iterations = new, self.iterations + 1
        if self.iterations >= self.options.kmeans_iter or moved <= KMEANS_MOVE ** 2:
            self.stage, self.done = "deviation", self.options.only_centres

    def _deviation(self, sums):
        n = sums[:, 0]
        if self.options.deviation == "summed":
            dev = np.sqrt(sums[:, 1:]) / np.maximum(n, 1.0)[:, None]
        else:
            dev = np.sqrt(sums[:, 1:] / np.maximum(n, 1.0)[:, None])
        rows = [{"comp": c, "dev": dev[c]} for c in np.flatnonzero(n)]
        self._expect(initial_from_deviation(rows, self.centres, self.options.init_cov))

    def _em(self, sums):
        ll, _, r, s, ss = sums
        with np.errstate(all="ignore"):
            m = maximise(r, s, ss)
        if not (np.isfinite(m.mu).all() and np.isfinite(m.sigma).all()):
            raise ValueError("EM left the finite range")
        self.iterations, self.loglik = self.iterations + 1, ll
        if self.iterations >= self.options.max_iter or (
                self.previous is not None and abs(ll - self.previous) <= self.options.tol):
            self.mixture, self.done = m, True
        else:
            self.previous = ll
            self._expect(m)


FOUND = ("centres", "loglik", "iterations", "attempt", "failures", "seconds", "error", "done")


class Fits(Rounds):
    """Several mixtures in common rounds, by (training set, k); each leaves when it is done. Rows of a fit
    are (numerics, draw) pairs."""

    def __init__(self, keys, d: int, options: FitOptions, scale: dict | None = None,
                 starts: dict | None = None):
        super().__init__()
        self.d, self.scale = d, scale
        self.fits = {key: Fit(key[1], options, (starts or {}).get(key)) for key in keys}

    def load(self, batches):
        """Blocks {key: (numerics, draws)}."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch["nums"].to_pylist(), dtype=float).reshape(batch.num_rows, self.d)
            grp, k, u = (batch[c].to_numpy() for c in ("grp", "k", "u"))
            block = {}
            for key in self.fits:
                mine = (grp == key[0]) & (k == key[1])
                if mine.any():
                    nums = x[mine]
                    if self.scale is not None:
                        nums = (nums - self.scale[key[0]][0]) / self.scale[key[0]][1]
                    block[key] = nums, u[mine]
            yield block

    def message(self, blocks):
        parts: dict = {}
        with np.errstate(all="ignore"):
            for block in blocks:
                for key, rows in block.items():
                    if not self.fits[key].done:
                        parts.setdefault(key, []).append(self.fits[key].part(*rows))
            return {key: self.fits[key].merge(p) for key, p in parts.items()}

    def merge(self, messages):
        parts: dict = {}
        for message in messages:
            for key, part in message.items():
                parts.setdefault(key, []).append(part)
        return {key: self.fits[key].merge(p) for key, p in parts.items()}

    def advance(self, merged):
        live = [f for f in self.fits.values() if not f.done]
        share = self.lap() / max(1, len(live))
        for key, fit in self.fits.items():
            if not fit.done:
                fit.seconds += share
                if key not in merged:
                    fit.done, fit.error = True, "no rows to fit a mixture on"
                else:
                    fit.advance(merged[key])
        self.done = all(f.done for f in self.fits.values())
        self.error = next((f.error for f in self.fits.values() if f.error), None)


    def outcome(self):
        found = {}
        for key, f in self.fits.items():
            plain = {c: getattr(f, c, None) for c in FOUND}
            m = getattr(f, "mixture", None)
            found[key] = plain, None if m is None else (m.weights, m.mu, m.sigma)
        return found

    def take(self, outcome):
        for key, (plain, m) in outcome.items():
            self.fits[key].__dict__.update(plain, mixture=None if m is None else Mixture(*m))


def draw_of(key: Column, seed, grp=0) -> Column:
    """The row's draw for the start of k-means."""
    return uniform(key, "start", seed, grp)


def fit_mixtures(samples: DataFrame, keys, d: int, rows: float, options: FitOptions,
                 scale: dict | None = None, starts: dict | None = None, one_job: bool | None = None) -> dict:
    """The fits of all keys (training set, k) over samples (grp, k, u, nums) of about ``rows`` rows, by key.
    The samples stay in their tasks, which exchange packed sums in each round: all rounds in one job, or a
    job per round where the samples or the session do not allow that."""
    fits = Fits(keys, d, options, scale, starts)
    most = max(k for _, k in fits.fits)
    message = len(fits.fits) * 8 * most * (2 + d + d * d) * 4 / 3
    tasks = tasks_for(samples.sparkSession, rows)
    return run(fits, samples.select("grp", "k", "u", "nums"), fits.load, tasks, rows * 8 * (d + 4), message,
               one_job).fits


def _alone(sample: DataFrame, k: int, seed) -> tuple[DataFrame, int, int]:
    """A sample as the only training set, its width and its size. Rows without a key are told apart by
    their numerics."""
    key = F.col("key") if "key" in sample.columns else F.array_join(F.col("nums").cast("array<string>"), ",")
    one = sample.agg(F.count("*").alias("n"), F.max(F.size("nums")).alias("d")).first()
    rows = sample.select(F.lit(0).alias("grp"), F.lit(k).alias("k"), draw_of(key, seed).alias("u"), "nums")
    return rows, one["d"] or 0, one["n"]


def kmeans(sample: DataFrame, k: int, seed=0, max_iter: int = KMEANS_ITERATIONS, one_job: bool | None = None):
    """Centres of a sample of any size. The start draws candidates with chances in proportion to their
    squared distance, twice over, weighs them by the rows next to them and spreads k of them out. Fewer
    distinct rows give fewer centres."""
    rows, d, n = _alone(sample, k, seed)
    options = FitOptions(kmeans_iter=max_iter, only_centres=True)
    return fit_mixtures(rows, [(0, k)], d, n, options, one_job=one_job)[0, k].centres


def fit_mixture(sample: DataFrame, k: int, seed=0, one_job: bool | None = None, start: Mixture | None = None,
                **options) -> Fit:
    """The fit of one mixture to a sample of any size: ``mixture``, ``loglik``, ``iterations``, ``attempt``."""
    rows, d, n = _alone(sample, k, seed)
    starts = None if start is None else {(0, k): start}
    return fit_mixtures(rows, [(0, k)], d, n, FitOptions(**options), starts=starts, one_job=one_job)[0, k]


def fit_batch(x, u, k: int, **options) -> Fit:
    """The same fit of rows and their draws in this process."""
    fits = Fits([(0, k)], x.shape[1], FitOptions(**options))
    return run_here(fits, [{(0, k): (x, u)}]).fits[0, k]
