"""Logistic regression with an L1 penalty on a bounded sample (accelerated proximal gradient)."""

from __future__ import annotations

import numpy as np


def fit_lasso(
    x: np.ndarray, y: np.ndarray, penalty: float, times: np.ndarray | None = None, rounds: int = 2000
) -> tuple[np.ndarray, float]:
    """``(weights, bias)`` that minimise mean log loss + ``penalty`` * sum of |weights|; line i
    counts ``times[i]`` times. With one class only, the weights are zero and the bias is the smoothed prior.
    """
    k = x.shape[1]
    times = np.ones(len(x)) if times is None else times.astype(float)
    n = times.sum()
    prior = ((times * y).sum() + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not n or not k or y.min() == y.max():
        return np.zeros(k), bias
    step = 4.0 / (np.linalg.norm(x * np.sqrt(times / n)[:, None], 2) + 1) ** 2
    w = np.zeros(k)
    v, c, b, t = w, bias, bias, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ v + c, -35, 35)))
        g = times * (p - y) / n
        w_new = v - step * (x.T @ g)
        w_new = np.sign(w_new) * np.maximum(np.abs(w_new) - step * penalty, 0)
        b_new = c - step * g.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w_new + (t - 1) / t_new * (w_new - w), b_new + (t - 1) / t_new * (b_new - b)
        w, b, t = w_new, b_new, t_new
    return w, float(b)
