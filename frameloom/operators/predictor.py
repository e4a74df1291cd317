"""A state predictor that can be fitted: multinomial logistic regression by sums over the tasks' rows.

Each round is one pass: tasks add up the loss and gradient of their rows, classes * (dimensions + 1) + 1 numbers a task,
whatever their rows. The driver steps by limited-memory BFGS; its first metric is a bound on the curvature (Boehning, 1992)
that needs the vectors' covariance alone. Vectors are standardised by the corpus' own figures.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialize, ship
from . import spectral
from .states import label_pairs


@dataclass(frozen=True)
class Logistic:
    """classes, ascending; weights (class, dimension + 1) of (v - mean) / scale and a constant."""

    classes: tuple
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.features(x) @ self.weights.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def sums(model: Logistic, x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient (as the weights) of rows x with classes numbered y."""
    f, p = model.features(x), model.probabilities(x)
    at = np.arange(len(y)), y
    loss = float(-np.log(np.maximum(p[at], 1e-300)).sum())
    p[at] -= 1
    return loss, p.T @ f


def _solver(cov: np.ndarray, scale: np.ndarray, k: int, ridge: float):
    """What divides a gradient by the bound (I - 1 / k) / 2 (x) covariance of the features, plus the ridge."""
    d = len(scale)
    own = np.eye(d + 1)
    own[:d, :d] = cov / np.outer(scale, scale)
    lam, q = np.linalg.eigh(own)
    a, u = np.linalg.eigh((np.eye(k) - 1 / k) / 2)
    under = np.maximum(np.outer(np.maximum(a, 0), np.maximum(lam, 0)) + ridge, 1e-12)
    return lambda g: u @ ((u.T @ g @ q) / under) @ q.T


def _towards(gradient: np.ndarray, pairs: list, solve) -> np.ndarray:
    """The gradient by the inverse curvature that the last steps and turns of the gradient show."""
    q, used = gradient.copy(), []
    for moved, turned in reversed(pairs):
        a = (moved * q).sum() / (moved * turned).sum()
        q -= a * turned
        used.append(a)
    out = solve(q)
    for (moved, turned), a in zip(pairs, reversed(used), strict=True):
        out += moved * (a - (turned * out).sum() / (moved * turned).sum())
    return out


def fit(rows: DataFrame, vector: str, target: str, ridge: float = 1e-4, rounds: int = 200, tolerance: float = 1e-9) -> Logistic:
    """Fit on rows with vector and target; null targets don't count. ridge: the penalty's share of the number of rows. The
    mean loss falls in every round (steps are halved until it does); a fit that doesn't settle is an error."""
    ship(rows.sparkSession)
    own = materialize(rows.select(F.col(vector).cast("array<double>").alias("v"), F.col(target).alias("y")).where("v IS NOT NULL AND y IS NOT NULL"), "labelled")
    try:
        classes = tuple(sorted(r["y"] for r in own.select("y").distinct().collect()))  # as few as the output layer
        if not classes:
            raise ValueError("no labelled rows")
        m = spectral.moments(own, "v")
        spread = np.sqrt(np.maximum(np.diag(m["c00"]), 0))
        model = Logistic(classes, np.zeros((len(classes), len(m["mean"]) + 1)), m["mean"], np.where(spread > 0, spread, 1.0))
        n = m["n"]
        numbered = own.withColumn("k", F.array_position(F.lit(list(classes)), F.col("y")).cast("int") - 1).select("v", "k")

        def measure(model: Logistic):
            sent = own.sparkSession.sparkContext.broadcast(model)

            def run(batches):
                total = None
                for b in batches:
                    for lo in range(0, b.num_rows, 8192):
                        part = b.slice(lo, 8192)
                        x = part.column("v").flatten().to_numpy().reshape(part.num_rows, -1)
                        loss, g = sums(sent.value, x, part.column("k").to_numpy())
                        found = np.concatenate([[loss], g.ravel()])
                        total = found if total is None else total + found
                if total is not None:
                    yield pa.RecordBatch.from_pydict({"sums": [total.tolist()]})

            parts = numbered.mapInArrow(run, "sums array<double>")
            merged = parts.select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).orderBy("at").collect()
            s = np.array([r["x"] for r in merged]) / n
            w = model.weights
            return s[0] + ridge / 2 * (w * w).sum(), s[1:].reshape(w.shape) + ridge * w

        solve = _solver(m["c00"], model.scale, len(classes), ridge)
        (loss, gradient), pairs = measure(model), []
        for _ in range(rounds):
            if (gradient * solve(gradient)).sum() < tolerance:
                return model
            step = -_towards(gradient, pairs, solve)
            size, slope = 1.0, (step * gradient).sum()
            while True:
                tried = Logistic(classes, model.weights + size * step, model.mean, model.scale)
                new_loss, new = measure(tried)
                if new_loss <= loss + 1e-4 * size * slope or size < 1e-6:
                    break
                size /= 2
            moved, turned = tried.weights - model.weights, new - gradient
            if (moved * turned).sum() > 1e-16:
                pairs = [*pairs[-9:], (moved, turned)]
            model, loss, gradient = tried, new_loss, new
        raise RuntimeError(f"the predictor didn't settle in {rounds} rounds")
    finally:
        discard(own)


def predict(rows: DataFrame, vector: str, model: Logistic, out: str = "predicted") -> DataFrame:
    """rows with the likeliest class, ties to the smallest; null where there is no vector. Narrow."""
    ship(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(model)
    kind = "string" if isinstance(model.classes[0], str) else "long"

    @F.pandas_udf(kind)
    def label(column):
        import pandas as pd

        has = column.notna()
        found = pd.Series([None] * len(column), dtype=object)
        if has.any():
            p = sent.value.probabilities(np.stack(column[has].to_list()).astype(float))
            found[has.to_numpy()] = np.array(sent.value.classes, object)[p.argmax(axis=1)]
        return found

    return rows.withColumn(out, label(F.col(vector).cast("array<double>")))


def lagged_fit(vector: str, lag: int, segment: list[str], order: str = "frame", ridge: float = 1e-4) -> Callable:
    """What states.refine takes as fit: learns the label `lag` steps later from the vector, and predicts it for all frames."""

    def learn(frames: DataFrame, label: str):
        model = fit(label_pairs(frames, vector, label, lag, segment, order), vector, "target", ridge)
        return lambda rows: predict(rows, vector, model)

    return learn
