"""Small linear models fitted on a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 250) -> np.ndarray:
    """Logistic regression by accelerated gradient steps; the last weight is the intercept, which is not shrunk.

    With one class only, the weights are zero and the intercept gives that class's smoothed share.
    """
    n = len(y)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1.0)
        return np.concatenate([np.zeros(x.shape[1]), [np.log(share / (1 - share))]])
    x = np.column_stack([x, np.ones(n)]).astype(np.float64)
    shrink = np.full(x.shape[1], ridge / n)
    shrink[-1] = 0
    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v) or 1.0
    step = 1.0 / (1.05 * np.linalg.norm(x.T @ (x @ v)) / (4 * n) + ridge / n)
    w = np.zeros(x.shape[1])
    ahead, momentum = w, 1.0
    for _ in range(rounds):
        slope = x.T @ (sigmoid(x @ ahead) - y) / n + shrink * ahead
        new = ahead - step * slope
        following = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sigmoid(x @ w[:-1] + w[-1])


def out_of_fold(x: np.ndarray, y: np.ndarray, folds: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """For each row, the probability from a model that has not seen its fold."""
    out = np.zeros(len(y))
    for k in np.unique(folds):
        own = folds == k
        out[own] = predict(fit(x[~own], y[~own], ridge), x[own])
    return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1, halfway between the neighbouring probabilities; above all if there are no positives."""
    if not len(y) or y.min() == y.max():
        return 1.1
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[1:] < p[:-1], True)  # equal probabilities fall on one side
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[k] + (p[k + 1] if k + 1 < len(p) else 0.0)) / 2)
