"""A small logistic model: fitted on a bounded sample, applied as a Spark expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> list[float]:
    """Intercept and weights of raw features, by Newton steps on standardised ones; y may be any of 0 to 1.

    Without rows all weights are 0 and every score is a half.
    """
    if not len(y):
        return [0.0] * (x.shape[1] + 1)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    penalty = ridge * np.eye(z.shape[1])
    penalty[0, 0] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + penalty
        step = np.linalg.solve(hessian, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[1:] / scale
    return [float(w[0] - weights @ mean), *map(float, weights)]


def linear(features: str, model: list[float]) -> Column:
    """The model's log-odds from an array column."""
    total = F.lit(model[0])
    for i, w in enumerate(model[1:]):
        total = total + F.col(features)[i] * F.lit(w)
    return total


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), x))))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), p))
    return F.log(p / (1 - p))
