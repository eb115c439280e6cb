"""The model of each category slot given the numerics: scoring, gradient, training."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixspark.functions.expr import constants, dot, horner, total
from mixspark.functions.rand import first_hit, uniform, uniform_int, uniform_value
from mixspark.operators.rounds import Rounds, run, tasks_for
from mixspark.operators.sample import draw_steps, minibatch_fraction, steps_to_draw

# Fixed values of the stopping rule.
QUIET_GRADIENT = 1e-5
QUIET_STEPS = 10
# Columns of the convergence summary.
LOG_STEPS = 5

# Numerics handled as generated code; wider rows go through numpy in Arrow batches.
UNROLL_NUMS = 64
UNROLL_SLOTS = 128


@dataclass(frozen=True)
class LogisticParams:
    reg: float = 1.0
    lr_start: float = 1.0
    lr_speed: float = 0.1
    lam: float = 1.0


@dataclass
class Trained:
    """Weights (numerics first, then slots) with the log of every step."""

    w: np.ndarray
    history: list[tuple] = field(default_factory=list)  # (iter, lr, grad_l1, n)
    converged: bool = False
    seconds: float = 0.0  # this fit's share of the time its rounds took


# ---- scoring ---------------------------------------------------------------------------------

def add_log_prob(encoded: DataFrame, w, d: int, n_cats: int, lam: float = 1.0,
                 out: str = "score_cat") -> DataFrame:
    """Add ln P(categoricals | numerics): the sum of log-sigmoids over all slots.

    Every slot counts as not set, -softplus(x) with x = m/lam; each set slot then adds its x, because
    ln sigmoid(x) - ln sigmoid(-x) = x. Slots share the part b = Wn.n/lam of x, so with E = e^b and
    constant c_i the softplus sum is ln prod(1 + E c_i): polynomials in E with positive
    coefficients, so one exp and a few logs per row whatever the number of slots. Beyond b = cut,
    where every E c_i > 10^5, it is sum(x_i) plus a short series in 1/E. b and E are columns of
    their own, so generated code computes each once.
    """
    cw = [float(x) / lam for x in w[d:]]
    top = max((abs(x) for x in cw), default=0.0)
    cut = top + 12.0
    block = min(16, int(640.0 / (2.0 * top + 14.0)))  # a block's product stays below e^640
    if d > UNROLL_NUMS or len(cw) > UNROLL_SLOTS or block < 1:
        return encoded.withColumn(out, log_prob_slots(F.col("nums"), F.col("slots"), w, d, lam))
    base = dot(F.col("nums"), [float(x) for x in w[:d]]) / F.lit(float(lam))
    if not cw:
        return encoded.withColumn(out, base * 0.0)
    table, b, e = constants(cw), F.col("__b"), F.col("__e")
    slots = F.col("slots")
    picked = total([
        F.when(slots[v].isNull(), 0.0).otherwise(b + F.get(table, slots[v]))
        for v in range(n_cats)
    ])
    rows = encoded.withColumn("__m", base)
    rows = rows.withColumn("__b", F.coalesce("__m", F.lit(0.0)))
    # exp and log count as nullable; without that the generated code has no null checks.
    rows = rows.withColumn("__e", F.coalesce(F.exp(F.least(b, F.lit(cut))), F.lit(0.0)))
    c = np.exp(cw)
    logs = []
    for i in range(0, len(c), block):
        poly = np.ones(1)
        for x in c[i:i + block]:
            poly = np.convolve(poly, [1.0, x])
        logs.append(F.coalesce(F.log(horner(e, poly)), F.lit(0.0)))
    inv = F.exp(-b)
    series = [0.0] + [float((-1) ** (k + 1) * (c ** -k).sum() / k) for k in range(1, 5)]
    far = b * float(len(cw)) + sum(cw) + horner(inv, series)
    rest = F.when(b > cut, far).otherwise(total(logs))
    # A row without its numerics has no score.
    return rows.withColumn(out, F.when(F.col("__m").isNotNull(), picked - rest)).drop(
        "__m", "__b", "__e")


def log_prob_slots(nums: Column, slots: Column, w, d: int, lam: float = 1.0) -> Column:
    """The same value slot by slot, for wide encodings: numpy over Arrow batches."""
    weights = np.asarray(w, dtype=float)

    @F.pandas_udf("double")
    def score(n: pd.Series, s: pd.Series) -> pd.Series:
        x = np.stack(n.to_numpy()) if len(n) else np.zeros((0, d))
        return pd.Series(log_prob_batch(x, s.to_numpy(), weights[None, :], d, np.array([lam]))[:, 0])

    return score(nums, slots)


def log_prob_batch(x: np.ndarray, slots, w: np.ndarray, d: int, lam: np.ndarray) -> np.ndarray:
    """Rows x models log-probabilities, walking the slots so that memory stays small."""
    base = (x @ w[:, :d].T) / lam
    cw = w[:, d:] / lam[:, None]
    out = np.zeros_like(base)
    top = np.abs(cw).max() if cw.size else 0.0
    if not top <= 600.0:
        for i in range(cw.shape[1]):
            out -= np.logaddexp(0.0, base + cw[:, i])
    elif cw.size:
        up, e = base > 0, np.exp(-np.abs(base))
        plus, minus = np.exp(cw), np.exp(-cw)
        size = max(1, min(16, int(640.0 / (top + 1.0))))
        out -= np.where(up, base * cw.shape[1] + cw.sum(axis=1), 0.0)
        for a in range(0, cw.shape[1], size):
            block = np.ones_like(base)
            for i in range(a, min(a + size, cw.shape[1])):
                block *= 1.0 + e * np.where(up, minus[:, i], plus[:, i])
            out -= np.log(block)
    at_all = np.array([list(s) for s in slots], dtype=float).reshape(len(x), -1)
    for v in range(at_all.shape[1] if len(x) else 0):
        at = at_all[:, v]
        seen = np.isfinite(at)
        out[seen] += base[seen] + cw[:, at[seen].astype(int)].T
    return out


# ---- weights ---------------------------------------------------------------------------------

def init_weights(size: int, seed, init: str = "uniform") -> np.ndarray:
    """U(-0.5, 0.5) or zeros."""
    if init == "zeros":
        return np.zeros(size)
    return np.array([uniform_value(i, "w", seed) - 0.5 for i in range(size)])


def weight_names(d: int, offsets, widths) -> list[tuple[str, str]]:
    out = [("num", f"num{j}") for j in range(d)]
    for v, (start, width) in enumerate(zip(offsets, widths)):
        out += [("slot", f"cat{v}={i}") for i in range(width)]
    return out


def weights_frame(spark: SparkSession, w, d: int, offsets, widths) -> DataFrame:
    """(idx, kind, name, w): d + D rows, one per weight."""
    rows = [(i, k, n, float(x)) for i, ((k, n), x) in
            enumerate(zip(weight_names(d, offsets, widths), w))]
    return spark.createDataFrame(rows, "idx int, kind string, name string, w double")


def learning_rate(params: LogisticParams, i: int) -> float:
    """Rate of step i, from 1."""
    return params.lr_start / (1.0 + params.lr_speed * (i - 1))


def rate_rows(steps: DataFrame, params: LogisticParams) -> DataFrame:
    """(i, lr) for each step of a run, ``steps`` being a one-row frame with their number."""
    i = F.col("i")
    rows = steps.select(F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("i"))
    return rows.withColumn("lr", F.lit(params.lr_start) / (1.0 + F.lit(params.lr_speed) * (i - 1)))


def decay(size: int, reg: float) -> float:
    return 2.0 * reg / math.sqrt(size)


def update(w: np.ndarray, grad: np.ndarray, lr: float, reg: float) -> np.ndarray:
    return w - lr * (grad + decay(len(w), reg) * w)


def update_rows(weights: DataFrame, grad: DataFrame, lr: float, reg: float, size: int) -> DataFrame:
    """The same update as a join of (idx, w) and (idx, grad)."""
    g = F.coalesce(F.col("grad"), F.lit(0.0))
    step = F.col("w") - F.lit(float(lr)) * (g + F.lit(decay(size, reg)) * F.col("w"))
    return weights.join(grad.select("idx", "grad"), "idx", "left").withColumn("w_new", step)


# ---- gradient --------------------------------------------------------------------------------

def _pull(w, d: int, lam: float) -> Column:
    """-s z of a masked row, with s = 1/(1 + exp(z W.x / lam))."""
    table = constants([float(x) for x in w])
    m = total([F.col("nums")[j] * table[j] for j in range(d)]) + F.get(table, F.col("slot") + d)
    z = F.col("z").cast("double")
    return -z / (1.0 + F.exp(z * m / F.lit(float(lam))))


def slot_sums(masked: DataFrame, w, d: int, lam: float = 1.0, by=()) -> DataFrame:
    """Per slot: rows, sum of the pull, and its products with each numeric. At most one row per
    slot and map task is shuffled."""
    g = F.col("g")
    return (
        masked.withColumn("g", _pull(w, d, lam)).groupBy(*by, "slot")
        .agg(F.count("*").alias("n"), F.sum(g).alias("g"),
             *[F.sum(g * F.col("nums")[j]).alias(f"g{j}") for j in range(d)])
    )


def _slot_sums_wide(masked: DataFrame, w, d: int, lam: float) -> DataFrame:
    """(idx, g) partial sums by numpy, one small block per Arrow batch; idx -1 carries the count."""
    weights = np.asarray(w, dtype=float)

    def partials(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x, slot = np.stack(pdf["nums"].to_numpy()), pdf["slot"].to_numpy()
            z = pdf["z"].to_numpy(dtype=float)
            g = pull_batch(x, slot, z, weights[None, :], d, np.array([lam]))
            sums = gradient_sums(x, slot, g, d, len(weights))[0]
            yield pd.DataFrame({
                "idx": np.arange(-1, len(weights)), "g": np.concatenate([[len(pdf)], sums]),
            })

    return (
        masked.select("nums", "slot", "z").mapInPandas(partials, "idx int, g double")
        .groupBy("idx").agg(F.sum("g").alias("g"))
    )


def gradient(masked: DataFrame, w, d: int, lam: float = 1.0) -> tuple[np.ndarray, int]:
    """Mean gradient of masked rows, as one job; only d + D sums reach the driver."""
    size = len(w)
    grad, n = np.zeros(size), 0
    if d > UNROLL_NUMS:
        for r in _slot_sums_wide(masked, w, d, lam).collect():
            if r["idx"] < 0:
                n = int(r["g"])
            else:
                grad[r["idx"]] = r["g"]
    else:
        for r in slot_sums(masked, w, d, lam).collect():
            n += r["n"]
            grad[d + r["slot"]] += r["g"]
            for j in range(d):
                grad[j] += r[f"g{j}"]
    return (grad / n if n else grad), n


def gradient_rows(masked: DataFrame, w, d: int, lam: float = 1.0) -> DataFrame:
    """The mean gradient as (idx, grad, n) rows: slot sums give the slot part, their totals the
    numeric part."""
    sums = slot_sums(masked, w, d, lam)
    cells = [F.struct((F.col("slot") + d).alias("idx"), F.col("g").alias("g"))] + [
        F.struct(F.lit(j).alias("idx"), F.col(f"g{j}").alias("g")) for j in range(d)
    ] + [F.struct(F.lit(-1).alias("idx"), F.col("n").cast("double").alias("g"))]
    parts = (
        sums.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
        .groupBy("idx").agg(F.sum("g").alias("g"))
    )
    n = parts.where("idx = -1").select(F.col("g").alias("n"))
    return (
        parts.where("idx >= 0").crossJoin(F.broadcast(n))
        .select("idx", (F.col("g") / F.col("n")).alias("grad"), F.col("n").cast("bigint").alias("n"))
    )


def gradient_all(encoded: DataFrame, w, d: int, lam: float = 1.0) -> DataFrame:
    """The mean gradient over all slots of every row, as (idx, grad, n) rows, n counting the slots.

    A slot that is not set pulls by its sigmoid, a set one by its sigmoid minus 1. So the sums are those of
    the sigmoids, slot by slot, less a count of the set slots: one aggregate over the rows as they are, where
    a task hands over d + D sums. Wide encodings are summed by numpy in Arrow batches."""
    size = len(w)
    slots = size - d
    if slots > UNROLL_SLOTS or d > UNROLL_NUMS:
        parts = _gradient_all_wide(encoded, w, d, lam)
    else:
        table = constants([float(x) for x in w])
        rows = encoded.withColumn("__m", total([F.col("nums")[j] * table[j] for j in range(d)]))
        pull = {f"__s{i}": 1.0 / (1.0 + F.exp((F.col("__m") + table[d + i]) * F.lit(-1.0 / lam))) for i in range(slots)}
        rows = rows.withColumns(pull).withColumn("__set", F.array_compact("slots"))
        all_pulls = total([F.col(c) for c in pull]) - F.size("__set")
        rows = rows.withColumn("__all", all_pulls)
        sums = rows.agg(
            F.count("*").alias("n"),
            F.array(*[F.sum(F.col("nums")[j] * F.col("__all")) for j in range(d)],
                    *[F.sum(F.col(c) - F.array_contains("__set", i).cast("int")) for i, c in enumerate(pull)]).alias("g"))
        parts = sums.select("n", F.posexplode("g").alias("idx", "g"))
    masked = F.col("n") * slots
    return parts.select("idx", (F.col("g") / masked).alias("grad"), masked.cast("bigint").alias("n"))


def _gradient_all_wide(encoded: DataFrame, w, d: int, lam: float) -> DataFrame:
    weights = np.asarray(w, dtype=float)

    def partials(batches):
        n, sums = 0, np.zeros(len(weights))
        for pdf in batches:
            x = np.array(pdf["nums"].tolist(), dtype=float).reshape(len(pdf), d)
            with np.errstate(over="ignore"):
                pull = 1.0 / (1.0 + np.exp(-((x @ weights[:d])[:, None] + weights[None, d:]) / lam))
            for row, slots in enumerate(pdf["slots"]):
                at = np.array([s for s in slots if s is not None and s == s], dtype=int)
                pull[row, at] -= 1.0
            n += len(pdf)
            sums[d:] += pull.sum(axis=0)
            sums[:d] += x.T @ pull.sum(axis=1)
        yield pd.DataFrame({"idx": np.arange(-1, len(weights)), "g": np.concatenate([[n], sums])})

    parts = encoded.select("nums", "slots").mapInPandas(partials, "idx int, g double").groupBy("idx").agg(
        F.sum("g").alias("g"))
    n = parts.where("idx = -1").select(F.col("g").cast("bigint").alias("n"))
    return parts.where("idx >= 0").crossJoin(F.broadcast(n))


# ---- numpy forms, used inside tasks and on small sums ------------------------------------------

def pull_batch(x, slot, z, w, d, lam):
    """Rows x models pulls."""
    m = x @ w[:, :d].T + w[:, d + slot].T
    zc = z[:, None]
    with np.errstate(over="ignore"):
        return -zc / (1.0 + np.exp(zc * m / lam))


def gradient_sums(x, slot, g, d, size):
    """Models x weights sums of a batch."""
    out = np.zeros((g.shape[1], size))
    out[:, :d] = g.T @ x
    for m in range(g.shape[1]):
        out[m, d:] = np.bincount(slot, weights=g[:, m], minlength=size - d)
    return out


class Stopper:
    """Counts consecutive steps with a negligible gradient."""

    def __init__(self, models: int):
        self.quiet = np.zeros(models, dtype=int)

    def active(self):
        return self.quiet < QUIET_STEPS

    def note(self, l1):
        self.quiet = np.where(self.active(), np.where(l1 < QUIET_GRADIENT, self.quiet + 1, 0),
                              self.quiet)


def run_steps(x, slot, z, it, w0, d, params: list[LogisticParams], max_steps: int):
    """All SGD steps of several parameter sets over one pool of minibatches. Steps without rows
    are passed over, as a redraw would."""
    # Rows come in shuffle order; a full sort makes the sums independent of it.
    order = np.lexsort((*x.T[::-1], z, slot, it))
    x, slot, z, it = x[order], slot[order], z[order], it[order]
    cuts = np.flatnonzero(np.diff(it)) + 1
    batches = list(zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(it)]])))
    w = np.repeat(np.asarray(w0, dtype=float)[None, :], len(params), axis=0)
    lam = np.array([p.lam for p in params])
    stop, logs = Stopper(len(params)), [[] for _ in params]
    for i, (a, b) in enumerate(batches[:max_steps], start=1):
        live = stop.active()
        if not live.any():
            break
        g = pull_batch(x[a:b], slot[a:b], z[a:b], w, d, lam)
        grad = gradient_sums(x[a:b], slot[a:b], g, d, w.shape[1]) / (b - a)
        l1 = np.abs(grad).sum(axis=1)
        for m in np.flatnonzero(live):
            lr = learning_rate(params[m], i)
            logs[m].append((i, lr, float(l1[m]), int(b - a)))
            w[m] = update(w[m], grad[m], lr, params[m].reg)
        stop.note(l1)
    return [Trained(w[m], logs[m], not stop.active()[m]) for m in range(len(params))]


# ---- training --------------------------------------------------------------------------------

def draw_pool(encoded: DataFrame, n_slots: int, steps: int, fraction: float, seed,
              groups=None, rates=None) -> DataFrame:
    """(grp, it, nums, slot, z): the masked rows of all minibatches, from one pass."""
    rows = draw_steps(encoded.select("key", "nums", "slots", *(
        ["train_in"] if "train_in" in encoded.columns else [])), steps, fraction, "mb", seed,
        groups=groups, rates=rates)
    slot = uniform_int(n_slots, F.col("key"), "slot", seed, F.col("grp"), F.col("it"))
    rows = rows.withColumn("slot", slot)
    bit = F.array_contains(F.array_compact("slots"), F.col("slot"))
    return rows.select("grp", "it", "nums", "slot",
                       F.when(bit, 1).otherwise(-1).cast("int").alias("z"))


def pool_fits(drawn: int, fraction: float) -> bool:
    """Whether all minibatches together are at most 32 times the table; else each step draws from the
    rows themselves, with the same outcome."""
    return drawn * fraction <= 32


POOL_SCHEMA = "combo int, grp int, w array<double>, it array<int>, lr array<double>, " \
    "grad_l1 array<double>, n array<int>, converged boolean"


def train_pooled(pool: DataFrame, w0: dict[int, np.ndarray], d: int,
                 params: list[LogisticParams], max_steps: int, block: int = 32,
                 scale: dict | None = None) -> DataFrame:
    """Fit every parameter set on every training set in one job: one task per (training set, block
    of parameter sets). The pool of a training set is bounded by steps x minibatch whatever the
    size of the data; callers check that bound. ``scale`` maps a training set to the (low, span) of
    its numerics where the pool holds unscaled ones."""
    blocks = -(-len(params) // block)

    def fit(key, pdf):
        grp, blk = int(key[0]), int(key[1])
        mine = params[blk * block:(blk + 1) * block]
        x = np.stack(pdf["nums"].to_numpy()).astype(float).reshape(len(pdf), d)
        if scale is not None:
            x = (x - scale[grp][0]) / scale[grp][1]
        out = run_steps(x, pdf["slot"].to_numpy(), pdf["z"].to_numpy(dtype=float),
                        pdf["it"].to_numpy(), w0[grp], d, mine, max_steps)
        return pd.DataFrame([{
            "combo": blk * block + m, "grp": grp, "w": t.w,
            "it": [h[0] for h in t.history], "lr": [h[1] for h in t.history],
            "grad_l1": [h[2] for h in t.history], "n": [h[3] for h in t.history],
            "converged": bool(t.converged),
        } for m, t in enumerate(out)])

    rows = pool.withColumn("blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return rows.groupBy("grp", "blk").applyInPandas(fit, POOL_SCHEMA)


def trained_from_row(r) -> Trained:
    # Arrow turns the NaN of a diverged fit into null; a float array turns it back.
    norms = np.array(r["grad_l1"], dtype=float).tolist()
    return Trained(np.array(r["w"], dtype=float), list(zip(r["it"], r["lr"], norms, r["n"])),
                   r["converged"])


class Descent(Rounds):
    """All parameter sets on all training sets, a step per round. A task's message has, per training set
    still going, the rows of its minibatch and the gradient sums of every parameter set. Steps without rows
    are passed over, as a redraw would. ``scale`` maps a training set to the (low, span) of its numerics where
    the pool holds unscaled ones."""

    def __init__(self, w0: dict[int, np.ndarray], d: int, params: list[LogisticParams], max_steps: int,
                 drawn: int, scale: dict | None = None):
        super().__init__()
        self.w = {g: np.repeat(np.asarray(v, dtype=float)[None, :], len(params), axis=0) for g, v in w0.items()}
        self.d, self.params, self.max_steps, self.drawn, self.scale = d, params, max_steps, drawn, scale
        self.size = len(next(iter(w0.values())))
        self.lam = np.array([p.lam for p in params])
        self.stop, self.steps = {g: Stopper(len(params)) for g in w0}, dict.fromkeys(w0, 0)
        self.logs = {(c, g): [] for c in range(len(params)) for g in w0}
        self.seconds = dict.fromkeys(self.logs, 0.0)
        self.step = 1
        self._look()

    def _look(self):
        self.live = [g for g in self.w if self.steps[g] < self.max_steps and self.stop[g].active().any()]
        self.done = not self.live or self.step > self.drawn
        if self.live and self.done:
            self.error = f"only {[self.steps[g] for g in self.live]} of {self.max_steps} drawn steps had rows"

    def rows(self, df):
        return df.where((F.col("it") == self.step) & F.col("grp").isin(self.live))

    def load(self, batches):
        """Blocks {(training set, step): (numerics, slots, signs)}."""
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch["nums"].to_pylist(), dtype=float).reshape(batch.num_rows, self.d)
            slot, z, grp, it = (batch[c].to_numpy() for c in ("slot", "z", "grp", "it"))
            order = np.lexsort((it, grp))
            cuts = np.flatnonzero((np.diff(it[order]) != 0) | (np.diff(grp[order]) != 0)) + 1
            block = {}
            for mine in np.split(order, cuts):
                g = int(grp[mine[0]])
                nums = x[mine]
                if self.scale is not None:
                    nums = (nums - self.scale[g][0]) / self.scale[g][1]
                block[g, int(it[mine[0]])] = (nums, slot[mine], z[mine].astype(float))
            yield block

    def message(self, blocks):
        out = {g: [0, np.zeros((len(self.params), self.size))] for g in self.live}
        for block in blocks:
            for g, sums in out.items():
                x, slot, z = block.get((g, self.step), (None,) * 3)
                if x is not None:
                    pull = pull_batch(x, slot, z, self.w[g], self.d, self.lam)
                    sums[0] += len(x)
                    sums[1] += gradient_sums(x, slot, pull, self.d, self.size)
        return {g: s for g, s in out.items() if s[0]}

    def merge(self, messages):
        out = {}
        for message in messages:
            for g, (n, sums) in message.items():
                before = out.get(g, (0, 0.0))
                out[g] = before[0] + n, before[1] + sums
        return out

    def advance(self, merged):
        fits = [(m, g) for g in merged for m in np.flatnonzero(self.stop[g].active())]
        share = self.lap() / max(1, len(fits))
        for g, (n, grad) in merged.items():
            grad = grad / n
            l1 = np.abs(grad).sum(axis=1)
            self.steps[g] += 1
            for m in np.flatnonzero(self.stop[g].active()):
                lr = learning_rate(self.params[m], self.steps[g])
                self.logs[m, g].append((self.steps[g], lr, float(l1[m]), n))
                self.w[g][m] = update(self.w[g][m], grad[m], lr, self.params[m].reg)
                self.seconds[m, g] += share
            self.stop[g].note(l1)
        self.step += 1
        self._look()

    def outcome(self):
        return {"w": self.w, "logs": self.logs, "seconds": self.seconds,
                "quiet": {g: s.quiet for g, s in self.stop.items()}}

    def take(self, outcome):
        self.w, self.logs, self.seconds = outcome["w"], outcome["logs"], outcome["seconds"]
        for g, quiet in outcome["quiet"].items():
            self.stop[g].quiet = quiet

    def trained(self) -> dict[tuple[int, int], Trained]:
        return {(c, g): Trained(self.w[g][c], log, not self.stop[g].active()[c], self.seconds[c, g])
                for (c, g), log in self.logs.items()}


def train_together(pool: DataFrame, w0: dict[int, np.ndarray], d: int, params: list[LogisticParams],
                   max_steps: int, drawn: int, rows: float, scale: dict | None = None,
                   one_job: bool | None = None) -> dict[tuple[int, int], Trained]:
    """Fit every parameter set on every training set over a pool of about ``rows`` rows, by (combination,
    set): one job whose tasks keep their part of the pool and exchange gradient sums at each step, or a job
    a step where the pool or the session do not allow that."""
    fit = Descent(w0, d, params, max_steps, drawn, scale)
    tasks = tasks_for(pool.sparkSession, rows)
    message = 8 * fit.size * len(params) * len(w0) * 4 / 3
    return run(fit, pool, fit.load, tasks, rows * 8 * (d + 4), message, one_job).trained()


def train_by_steps(gradient_of, w0, d: int, params: LogisticParams, max_steps: int,
                   slots_drawn: int) -> Trained:
    """One aggregate job per step. ``gradient_of(i, w)`` gives the mean gradient of drawn step i and its
    rows, so a minibatch may be any size up to the whole table; the driver holds only the weights."""
    w, log, stop, done = np.asarray(w0, dtype=float), [], Stopper(1), 0
    for i in range(1, slots_drawn + 1):
        if done >= max_steps or not stop.active()[0]:
            break
        grad, n = gradient_of(i, w)
        if n == 0:
            continue
        done += 1
        lr, l1 = learning_rate(params, done), float(np.abs(grad).sum())
        log.append((done, lr, l1, n))
        w = update(w, grad, lr, params.reg)
        stop.note(np.array([l1]))
    if done < max_steps and stop.active()[0]:
        raise RuntimeError(f"only {done} of {max_steps} drawn steps had rows")
    return Trained(w, log, not stop.active()[0])


def train(encoded: DataFrame, n: int, d: int, n_slots: int, params: LogisticParams,
          max_iterations: int = 100, minibatch: int = 100, seed=0, solver: str = "auto",
          slots: str = "random", init: str = "uniform", pool: DataFrame | None = None) -> Trained:
    """Fit the weights: ``max_iterations - 1`` steps.

    ``solver="barrier"`` runs all steps in one job, whose tasks exchange gradient sums; ``"aggregate"`` runs
    a distributed job per step; "auto" takes the first where the session can run all tasks at once and they can
    hold the pool. ``"pooled"`` runs all steps in one task. All draw the same rows and slots, whatever the
    sizes. ``slots="all"`` uses every slot of each row instead of one random slot (a job per step).
    """
    if solver not in ("auto", "barrier", "aggregate", "pooled"):
        raise ValueError("solver must be 'auto', 'barrier', 'aggregate' or 'pooled'")
    steps = max_iterations - 1
    f = minibatch_fraction(n, minibatch)
    drawn = steps_to_draw(steps, n, f)
    w0 = init_weights(d + n_slots, seed, init)
    if steps < 1 or n_slots == 0:
        return Trained(w0)
    if solver == "pooled":
        if slots != "random":
            raise ValueError("the pooled solver draws one slot per row")
        pool = draw_pool(encoded, n_slots, drawn, f, seed) if pool is None else pool
        row = train_pooled(pool, {0: w0}, d, [params], steps).first()
        return trained_from_row(row)
    if slots == "all":
        base = encoded.persist()

        def gradient_of(i, w):
            picked = base if f >= 1 else base.where(
                uniform(F.col("key"), "mb", seed, 0, i, "all") < f)
            grad, n = np.zeros(len(w)), 0
            for r in gradient_all(picked, w, d, params.lam).collect():
                grad[r["idx"]], n = r["grad"] or 0.0, r["n"]
            return grad, n
    elif pool_fits(drawn, f):
        pool = draw_pool(encoded, n_slots, drawn, f, seed) if pool is None else pool
        together = {"auto": None, "aggregate": False, "barrier": True}[solver]
        return train_together(pool, {0: w0}, d, [params], steps, drawn, drawn * f * n, one_job=together)[0, 0]
    else:
        # Minibatches that add up to many times the table: draw from the rows step by step.
        base = encoded.select("key", "nums", "slots").persist()

        def gradient_of(i, w):
            return gradient(_direct_step(base, n_slots, f, seed, i), w, d, params.lam)
    try:
        return train_by_steps(gradient_of, w0, d, params, steps, drawn)
    finally:
        base.unpersist()


def _direct_step(base: DataFrame, n_slots: int, f: float, seed, i: int) -> DataFrame:
    """Step i drawn straight from the rows; picks the same rows and slots as the pool."""
    key = F.col("key")
    first = first_hit(uniform(key, "mb", seed, "first"), f)
    hit = (first == i) | ((first < i) & (uniform(key, "mb", seed, 0, i) < F.lit(float(f))))
    slot = uniform_int(n_slots, key, "slot", seed, 0, i)
    rows = base.where(hit).withColumn("slot", slot)
    bit = F.array_contains(F.array_compact("slots"), F.col("slot"))
    return rows.withColumn("z", F.when(bit, 1).otherwise(-1).cast("int"))


def history_frame(spark: SparkSession, t: Trained) -> DataFrame:
    rows = [(int(i), float(lr), float(g), int(n)) for i, lr, g, n in t.history]
    return spark.createDataFrame(rows, "iter int, lr double, grad_l1 double, n bigint").withColumn(
        "converged", F.lit(bool(t.converged)))


def convergence_log(t: Trained) -> list[float]:
    """ln of the gradient norm in the last steps: the lowest double throughout when training
    converged early, the highest for steps that were not reached."""
    info = np.finfo(float)
    if t.converged:
        return [float(info.min)] * LOG_STEPS
    with np.errstate(divide="ignore"):
        logs = np.log([h[2] for h in t.history[-LOG_STEPS:]]).tolist()
    return [float(info.max)] * (LOG_STEPS - len(logs)) + logs
