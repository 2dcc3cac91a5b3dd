"""Logistic model (one-vs-rest) as Spark jobs: scoring, per-silo gradients, local training.

Parameters are tiny (classes x (features + 1) doubles per silo) and live on the driver
between jobs; rows never leave the executors. Each training step is one distributed
job: every partition computes, per silo, the weighted residual sums ``R^T [X, 1]`` of
its rows (numpy over Arrow batches, ``mapInArrow``) and emits one partial per silo;
a vector-sum aggregation combines partials (map-side first), and the driver collects
only ``silos x parameters`` numbers.

Conventions (public library semantics): OvR multiclass has one coefficient row per
class and weights only the positive class by its class weight; binary has a single
row and weights every sample by the weight of its own class. L2 ``alpha`` applies to
coefficients only. Probabilities: per-class sigmoid, normalised over classes (binary:
``[1 - p, p]``); prediction = first class with the highest score.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 2.220446049250313e-16


@dataclass
class LinearModel:
    coef: np.ndarray       # (rows, F): rows = 1 for binary, C otherwise
    intercept: np.ndarray  # (rows,)
    n_classes: int

    @property
    def binary(self) -> bool:
        return self.n_classes == 2

    @classmethod
    def zeros(cls, n_features: int, n_classes: int) -> LinearModel:
        rows = 1 if n_classes == 2 else n_classes
        return cls(np.zeros((rows, n_features)), np.zeros(rows), n_classes)

    def flat(self) -> np.ndarray:
        """Row-major coefficients, then intercepts."""
        return np.concatenate([self.coef.ravel(), self.intercept])

    @classmethod
    def from_flat(cls, flat: np.ndarray, n_features: int, n_classes: int) -> LinearModel:
        rows = 1 if n_classes == 2 else n_classes
        flat = np.asarray(flat, dtype=np.float64)
        return cls(flat[: rows * n_features].reshape(rows, n_features).copy(), flat[rows * n_features:].copy(), n_classes)


# ------------------------------------------------------------------ scoring (JVM expressions)
def decision_array(model: LinearModel, features: str = "features") -> Column:
    """``z = [<x, w_c> + b_c for every coefficient row]`` as one built-in array expression.

    The weights are a single literal ``array<array<double>>`` (constant-folded once), so the
    expression tree stays small however many classes there are.
    """
    w = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in model.coef])
    b = F.array(*[F.lit(float(v)) for v in model.intercept])
    dots = F.transform(w, lambda wc: F.aggregate(F.zip_with(F.col(features), wc, lambda x, y: x * y),
                                                  F.lit(0.0), lambda acc, v: acc + v))
    return F.zip_with(dots, b, lambda d, bc: d + bc)


def decision_columns(model: LinearModel, features: str = "features") -> list[Column]:
    """Per-row ``z_c`` as separate columns (used by the pure-SQL gradient)."""
    z = decision_array(model, features)
    return [F.element_at(z, c + 1) for c in range(model.coef.shape[0])]


def score(df: DataFrame, model: LinearModel, features: str = "features") -> DataFrame:
    """Adds ``proba`` (array over classes), ``prediction`` and ``p_max``.

    Built in stages (scores, sigmoids, normaliser) so every intermediate is computed once per row.
    """
    out = df.withColumn("_z", decision_array(model, features))
    out = out.withColumn("_s", F.transform("_z", lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z))))
    if model.binary:
        out = out.withColumn("proba", F.array(F.lit(1.0) - F.element_at("_s", 1), F.element_at("_s", 1)))
        out = out.withColumn("prediction", F.when(F.element_at("_z", 1) > 0, F.lit(1)).otherwise(F.lit(0)))
    else:
        k = model.coef.shape[0]
        out = out.withColumn("_t", F.aggregate("_s", F.lit(0.0), lambda a, v: a + v))
        out = out.withColumn("proba", F.when(F.col("_t") > 0, F.transform("_s", lambda p: p / F.col("_t")))
                             .otherwise(F.array_repeat(F.lit(1.0 / k), k)))
        # first class of the largest normalised probability: saturated sigmoids tie
        out = out.withColumn("prediction", (F.array_position("proba", F.array_max("proba")) - 1).cast("int"))
    out = out.withColumn("p_max", F.array_max("proba"))
    return out.drop("_z", "_s", "_t")


def prediction_expr(model: LinearModel, features: str = "features") -> Column:
    """Hard prediction of ``model`` by the largest score (``score`` goes by the probabilities, which
    tie once sigmoids saturate)."""
    z = decision_array(model, features)
    if model.binary:
        return F.when(F.element_at(z, 1) > 0, F.lit(1)).otherwise(F.lit(0))
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def confusion_of_models(sets: DataFrame, models: dict[int, LinearModel], label: str = "label_id",
                        set_col: str = "_set", features: str = "features") -> dict[tuple[int, str], list]:
    """Confusion cells of several models on several row sets from ONE scan.

    Each row gets one prediction per model (an array), unpivoted to (model, prediction)
    and counted per (model, set, true, predicted): at most models x sets x C^2 cells
    reach the driver. Returns ``{(model key, set): [(y, p, count), ...]}``.
    """
    keys = sorted(models)
    preds = F.array(*[prediction_expr(models[k], features) for k in keys])
    long = sets.select(set_col, F.col(label).alias("_y"), F.posexplode(preds).alias("_m", "_p"))
    cells = long.groupBy("_m", set_col, "_y", "_p").agg(F.count(F.lit(1)).alias("_n")).collect()
    out: dict[tuple[int, str], list] = {}
    for r in cells:
        out.setdefault((keys[int(r["_m"])], r[set_col]), []).append((int(r["_y"]), int(r["_p"]), int(r["_n"])))
    return out


def true_class_proba(label: str = "label_id") -> Column:
    return F.element_at(F.col("proba"), F.col(label) + 1)


# ------------------------------------------------------------------ gradients (Arrow partials)
def _batch_matrix(col: pa.ChunkedArray | pa.Array, n_features: int) -> np.ndarray:
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    vals = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return vals.reshape(len(arr), n_features)


_PARTIAL = "grp long, salt long, n double, loss_sum double, grad array<double>"


def _partials(models: dict[int, LinearModel], n_features: int, class_weights: np.ndarray | None,
              shared: bool, features: str, label: str, true_label: str, weight: str | None, group: str):
    """Per-partition function: one (group, n, loss_sum, grad) row per model group seen."""
    keys = sorted(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            if b.num_rows == 0:
                continue
            X = _batch_matrix(b.column(features), n_features)
            y = b.column(label).to_numpy(zero_copy_only=False).astype(np.int64)
            yt = b.column(true_label).to_numpy(zero_copy_only=False).astype(np.int64)
            m = (b.column(weight).to_numpy(zero_copy_only=False).astype(np.float64) if weight
                 else np.ones(len(y)))
            g = None if shared else b.column(group).to_numpy(zero_copy_only=False).astype(np.int64)
            for k in keys:
                sel = slice(None) if shared else (g == k)
                if not shared and not sel.any():
                    continue
                mdl = models[k]
                Xs, ys, yts, ms = X[sel], y[sel], yt[sel], m[sel]
                Z = Xs @ mdl.coef.T + mdl.intercept
                P = 1.0 / (1.0 + np.exp(-Z))
                if mdl.binary:
                    T = (ys != 0).astype(np.float64)[:, None]
                    W = (class_weights[ys] if class_weights is not None else np.ones(len(ys)))[:, None]
                    p1 = P[:, 0]
                    pt = np.where(yts != 0, p1, 1.0 - p1)
                else:
                    C = mdl.n_classes
                    T = np.zeros((len(ys), C))
                    T[np.arange(len(ys)), ys] = 1.0
                    W = np.where(T > 0, class_weights[None, :] if class_weights is not None else 1.0, 1.0)
                    tot = P.sum(axis=1)
                    pt = np.where(tot > 0, P[np.arange(len(yts)), yts] / np.where(tot > 0, tot, 1.0), 1.0 / C)
                R = (P - T) * W * ms[:, None]
                grad = np.concatenate([(R.T @ Xs).ravel(), R.sum(axis=0)])
                loss = float(np.sum(ms * -np.log(np.clip(pt, EPS, 1 - EPS))))
                a = acc.get(k)
                if a is None:
                    acc[k] = [float(ms.sum()), loss, grad]
                else:
                    a[0] += float(ms.sum())
                    a[1] += loss
                    a[2] += grad
        if acc:
            ks = list(acc)
            yield pa.RecordBatch.from_pydict({
                "grp": pa.array(ks, pa.int64()),
                "salt": pa.array([math.isqrt(TaskContext.get().partitionId())] * len(ks), pa.int64()),
                "n": pa.array([acc[k][0] for k in ks], pa.float64()),
                "loss_sum": pa.array([acc[k][1] for k in ks], pa.float64()),
                "grad": pa.array([acc[k][2].tolist() for k in ks], pa.list_(pa.float64())),
            })

    return run


def gradients(df: DataFrame, models: dict[int, LinearModel], n_features: int,
              class_weights: np.ndarray | None = None, shared: bool = False, features: str = "features",
              label: str = "train_label", true_label: str = "label_id", weight: str | None = None,
              group: str = "silo_id") -> dict[int, tuple[float, float, np.ndarray]]:
    """One distributed pass: per model group ``(weighted rows, loss sum, gradient sum)``.

    ``shared=True`` makes every row count for every model (e.g. an alpha sweep over one scan);
    otherwise row ``group`` selects the model (one per silo). A group's partials are added in two
    levels: task p's goes to sum number floor(sqrt(p)) first, so no sum takes more than about
    twice the square root of the number of tasks.
    """
    cols = [features, label, true_label] + ([weight] if weight else []) + ([] if shared else [group])
    fn = _partials(models, n_features, class_weights, shared, features, label, true_label, weight, group)
    return _added_up(df.select(*dict.fromkeys(cols)).mapInArrow(fn, _PARTIAL))


def _added_up(parts: DataFrame) -> dict[int, tuple[float, float, np.ndarray]]:
    """The sums of all tasks' partials by group, in two levels."""
    def added(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("loss_sum").alias("loss_sum"),
                                       vector_to_array(Summarizer.sum(array_to_vector("grad"))).alias("grad"))

    agg = added(added(parts, "grp", "salt"), "grp")
    return {int(r["grp"]): (float(r["n"]), float(r["loss_sum"]), np.asarray(r["grad"])) for r in agg.collect()}


def evaluated_gradients(df: DataFrame, model: LinearModel, groups: Sequence[int], n_features: int, sets: Sequence[str],
                        class_weights: np.ndarray | None = None, weight: str | None = None, part: str = "part",
                        train: str = "train", features: str = "features", label: str = "train_label",
                        true_label: str = "label_id", group: str = "silo_id"):
    """One pass over training and evaluation rows (told apart by ``part``): the gradients of every
    group at ``model`` as ``gradients`` gives them, and for each of ``sets`` the model's confusion
    cells ``[(y, p, count), ..]`` and mean log-loss (as ``score`` and the probabilities give them)."""
    c = model.n_classes
    cols = [features, label, true_label, *([weight] if weight else []), group, part]
    grad_of = _partials({k: model for k in groups}, n_features, class_weights, False, features, label, true_label, weight, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((len(sets), c * c))
        loss = np.zeros(len(sets))

        def training() -> Iterator[pa.RecordBatch]:
            for b in batches:
                where = b.column(part).to_numpy(zero_copy_only=False)
                for i, name in enumerate(sets):
                    some = b.filter(pa.array(where == name))
                    if not some.num_rows:
                        continue
                    z = _batch_matrix(some.column(features), n_features) @ model.coef.T + model.intercept
                    s = 1.0 / (1.0 + np.exp(-z))
                    y = some.column(true_label).to_numpy(zero_copy_only=False).astype(np.int64)
                    if model.binary:
                        prob, best = np.concatenate([1 - s, s], axis=1), (z[:, 0] > 0).astype(np.int64)
                    else:
                        tot = s.sum(axis=1, keepdims=True)
                        prob = np.where(tot > 0, s / np.where(tot > 0, tot, 1.0), 1.0 / c)
                        best = prob.argmax(axis=1)
                    cells[i] += np.bincount(y * c + best, minlength=c * c)
                    loss[i] -= float(np.log(np.clip(prob[np.arange(len(y)), y], EPS, 1 - EPS)).sum())
                yield b.filter(pa.array(where == train))

        yield from grad_of(training())
        salt = math.isqrt(TaskContext.get().partitionId())
        seen = [i for i in range(len(sets)) if cells[i].any()]
        if seen:  # evaluation sets are groups below zero
            yield pa.RecordBatch.from_pydict({
                "grp": pa.array([-1 - i for i in seen], pa.int64()), "salt": pa.array([salt] * len(seen), pa.int64()),
                "n": pa.array([float(cells[i].sum()) for i in seen]), "loss_sum": pa.array([float(loss[i]) for i in seen]),
                "grad": pa.array([cells[i].tolist() for i in seen], pa.list_(pa.float64()))})

    got = _added_up(df.select(*dict.fromkeys(cols)).mapInArrow(run, _PARTIAL))
    told = {}
    for i, name in enumerate(sets):
        if -1 - i in got:
            n, nll, grad = got[-1 - i]
            told[name] = ([(k // c, k % c, int(v)) for k, v in enumerate(grad) if v], nll / n)
    return {k: v for k, v in got.items() if k >= 0}, told


def sgd_step(model: LinearModel, n: float, grad: np.ndarray, lr: float, alpha: float) -> LinearModel:
    """``w <- w - lr * (grad / n + alpha * w)`` on coefficients; intercept without penalty."""
    if n <= 0:
        return model
    rows, nf = model.coef.shape
    gc = grad[: rows * nf].reshape(rows, nf) / n + alpha * model.coef
    gb = grad[rows * nf:] / n
    return LinearModel(model.coef - lr * gc, model.intercept - lr * gb, model.n_classes)


def learning_rate(eta0: float, t: int, power: float = 0.5) -> float:
    """Inverse-scaling schedule ``eta0 / t**power`` (t counts local steps from 1)."""
    return eta0 / (max(1, t) ** power)


def train_local(df: DataFrame, models: dict[int, LinearModel], n_features: int, steps: int, eta0: float,
                alpha: float, first: dict | None = None, **kw) -> tuple[dict[int, LinearModel], dict[int, tuple[float, float]]]:
    """``steps`` full-batch steps for every group at once (one Spark job per step).

    Returns the updated models and per group ``(weighted rows, mean training loss)`` of the
    last pass (measured on the true labels, before that step's update). ``first``: the first
    step's gradients, if a pass has already taken them.
    """
    stats: dict[int, tuple[float, float]] = {}
    for t in range(1, max(1, steps) + 1):
        g = first if t == 1 and first is not None else gradients(df, models, n_features, **kw)
        lr = learning_rate(eta0, t)
        models = {k: (sgd_step(m, g[k][0], g[k][2], lr, alpha) if k in g else m) for k, m in models.items()}
        stats = {k: (v[0], v[1] / v[0] if v[0] else 0.0) for k, v in g.items()}
    return models, stats


class _Descent:
    """L-BFGS of one group, fed one gradient at a time: ``at`` is the point to look at next.

    The objective is convex, so the slope along the search line alone tells too short steps
    from too long ones.
    """

    def __init__(self, x: np.ndarray, memory: int = 10):
        self.at, self.x, self.g, self.memory, self.pairs, self.iterations = x, None, None, memory, [], 0

    def take(self, g: np.ndarray, tol: float) -> bool:
        """The gradient at ``at``; True when it is within ``tol`` of zero everywhere."""
        if np.abs(g).max() <= tol:
            return True
        if self.x is not None:
            slope = float(self.d @ g)
            if slope > -0.5 * self.slope:
                self.hi = self.t
            elif slope < 0.9 * self.slope:
                self.lo = self.t
            if (slope > -0.5 * self.slope or slope < 0.9 * self.slope) and self.hi - self.lo > 1e-12 * self.t:
                self.t = 2 * self.t if self.hi == np.inf else (self.lo + self.hi) / 2
                self.at = self.x + self.t * self.d
                return False
            s, y = self.at - self.x, g - self.g
            if s @ y > 0:
                self.pairs = [*self.pairs[1 - self.memory:], (s, y)]
            self.iterations += 1
        self.x, self.g = self.at, g
        q, back = g.copy(), []
        for s, y in reversed(self.pairs):
            back.append((s @ q) / (s @ y))
            q -= back[-1] * y
        if self.pairs:
            s, y = self.pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.pairs, reversed(back)):
            q += (a - (y @ q) / (s @ y)) * s
        self.d = -q if q @ g > 0 else -g
        self.slope, self.t, self.lo, self.hi = float(self.d @ g), 1.0, 0.0, np.inf
        self.at = self.x + self.d
        return False


def train_to_convergence(df: DataFrame, models: dict[int, LinearModel], n_features: int, alpha: float, tol: float = 1e-4,
                         max_iter: int = 100, seen: dict[int, np.ndarray] | None = None, **kw):
    """Full-batch fits of every group until no component of its gradient exceeds ``tol``.

    One Spark job looks at one point of every unfinished group. ``seen``: per group the classes
    to fit (the rows of others stay as given). A group that has not converged after
    ``max_iter`` L-BFGS iterations keeps its model, with a warning. Returns like ``train_local``.
    """
    fits = {k: _Descent(m.flat()) for k, m in models.items()}
    stats: dict[int, tuple[float, float]] = {}
    todo = set(fits)
    while todo:
        now = {k: LinearModel.from_flat(fits[k].at, n_features, models[k].n_classes) for k in sorted(todo)}
        g = gradients(df, now, n_features, **kw)
        todo &= set(g)
        for k in sorted(todo):
            n, loss, grad = g[k]
            models, stats = {**models, k: now[k]}, {**stats, k: (n, loss / n if n else 0.0)}
            free = np.ones_like(grad)
            if seen is not None and not now[k].binary:
                free = np.concatenate([np.repeat(seen[k], n_features), seen[k]]).astype(np.float64)
            slope = (grad / max(n, 1e-300) + alpha * np.concatenate([now[k].coef.ravel(), np.zeros(len(now[k].intercept))])) * free
            if fits[k].take(slope, tol):
                todo.discard(k)
            elif fits[k].iterations >= max_iter:
                warnings.warn(f"group {k}: not converged after {max_iter} iterations, gradient {np.abs(slope).max():g}", stacklevel=2)
                todo.discard(k)
    return models, stats


# ------------------------------------------------------------------ pure-SQL gradient (reference path)
def gradient_sql(df: DataFrame, model: LinearModel, class_weights: Sequence[float] | None = None,
                 features: str = "features", label: str = "train_label", group: str = "silo_id") -> DataFrame:
    """Same gradient sums as ``gradients`` with built-in expressions only: ``(group, pos, grad, n)``.

    Explodes one row per (row, class, feature) before a partial aggregate: simpler, checkable
    against plain SQL, but more CPU per row than the Arrow path.
    """
    rows, nf = model.coef.shape
    d = df.select(group, label, features, decision_array(model, features).alias("_z"))
    cls = F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("_c")
    d = d.select("*", cls)
    zc = F.element_at("_z", F.col("_c") + 1)
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-zc))
    if model.binary:
        t = (F.col(label) != 0).cast("double")
        cw = F.array(*[F.lit(float(v)) for v in class_weights]) if class_weights is not None else None
        w = F.element_at(cw, F.col(label) + 1) if cw is not None else F.lit(1.0)
    else:
        t = (F.col(label) == F.col("_c")).cast("double")
        cw = F.array(*[F.lit(float(v)) for v in class_weights]) if class_weights is not None else None
        w = F.when(F.col(label) == F.col("_c"), F.element_at(cw, F.col("_c") + 1) if cw is not None else F.lit(1.0)) \
            .otherwise(F.lit(1.0))
    d = d.withColumn("_r", (p - t) * w)
    xs = F.concat(F.col(features), F.array(F.lit(1.0)))
    e = d.select(group, "_c", "_r", F.posexplode(xs).alias("_j", "_x"))
    pos = F.when(F.col("_j") < nf, F.col("_c") * nf + F.col("_j")).otherwise(F.lit(rows * nf) + F.col("_c"))
    g = e.groupBy(group, pos.alias("pos")).agg(F.sum(F.col("_r") * F.col("_x")).alias("grad"))
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, group)
