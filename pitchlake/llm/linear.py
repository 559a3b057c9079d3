"""Small dense models, fitted on the driver on bounded samples or on sums over all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, rounds: int = 40) -> np.ndarray:
    """Ridge logistic regression by Newton steps; y may be probabilities. The first column of x is the intercept."""
    n, m = x.shape
    w = np.zeros(m)
    if not n:
        return w
    weight = np.ones(n) if weight is None else weight
    weight = weight / weight.sum()
    penalty = np.full(m, ridge)
    penalty[0] = ridge / 100
    for _ in range(rounds):
        q = sigmoid(x @ w)
        grad = x.T @ (weight * (q - y)) + penalty * w
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def moments(x: np.ndarray) -> np.ndarray:
    """Rows, means and summed squares about them, of the columns."""
    mean = x.mean(0)
    return np.concatenate([[len(x)], mean, ((x - mean) ** 2).sum(0)])


def merged_moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    m = len(x) // 2
    n, d = x[0] + y[0], y[1 : m + 1] - x[1 : m + 1]
    return np.concatenate([[n], x[1 : m + 1] + d * y[0] / n, x[m + 1 :] + y[m + 1 :] + d * d * x[0] * y[0] / n])


def loss_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, log loss, gradient and Hessian (flat) of a logistic model, summed over rows."""
    z = np.clip(x @ w, -35, 35)
    q = sigmoid(z)
    return np.concatenate([[len(x), (np.logaddexp(0, z) - y * z).sum()], x.T @ (q - y), ((x * (q * (1 - q))[:, None]).T @ x).ravel()])


def newton(sums: Callable[[list[np.ndarray]], list[np.ndarray]], start: list[np.ndarray], ridge: float = 1e-3, rounds: int = 40, least: float = 1e-3) -> list[np.ndarray]:
    """Ridge logistic models by damped Newton steps until one is shorter than least (what is left is then some least squared).

    sums gives loss_sums() of all rows for each model at once.
    """
    w, trial, best = list(start), list(start), [None] * len(start)
    step = [np.zeros_like(x) for x in start]
    open_ = [True] * len(start)
    for _ in range(rounds):
        for i, total in enumerate(sums(trial)):
            m = len(w[i])
            if not open_[i] or not total[0]:
                open_[i] = False
                continue
            penalty = np.full(m, ridge)
            penalty[0] = ridge / 100
            loss = total[1] / total[0] + (penalty * trial[i] ** 2).sum() / 2
            if best[i] is not None and loss > best[i] + 1e-12:
                step[i] = step[i] / 2
            else:
                w[i], best[i] = trial[i], loss
                grad = total[2 : 2 + m] / total[0] + penalty * w[i]
                step[i] = -np.linalg.solve(total[2 + m :].reshape(m, m) / total[0] + np.diag(penalty), grad)
            trial[i] = w[i] + step[i]
            if np.abs(step[i]).max() < least:
                w[i], open_[i] = trial[i], False
        if not any(open_):
            break
    return w


class Scaled:
    """Standardises columns; constant columns become 0; adds the intercept."""

    def __init__(self, x: np.ndarray | None = None, mean: np.ndarray | None = None, sd: np.ndarray | None = None):
        if x is not None:
            mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
            sd = x.std(0) if len(x) else np.ones(x.shape[1])
        self.mean = mean
        self.sd = np.where(sd > 1e-9, sd, np.inf)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(x), 1)), np.clip((x - self.mean) / self.sd, -8, 8)])
