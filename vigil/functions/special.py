"""Gamma functions over numpy arrays, for mixtures of gamma distributions inside Arrow batches."""

from __future__ import annotations

import numpy as np

SHIFT = 10  # the asymptotic series are used from here on
LEAVE = 8  # steps between two looks for values that have converged


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function, x > 0."""
    x = np.asarray(x, float)
    back = np.zeros_like(x)
    z = x.copy()
    for _ in range(SHIFT):
        low = z < SHIFT
        back += np.where(low, np.log(np.where(low, z, 1.0)), 0.0)
        z = np.where(low, z + 1, z)
    i = 1 / (z * z)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i / 1188)))) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + series - back


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``log_gamma``."""
    z = np.array(x, float)
    back = np.zeros_like(z)
    for _ in range(SHIFT):
        low = z < SHIFT
        back += np.where(low, 1 / z, 0.0)
        z = np.where(low, z + 1, z)
    i = 1 / (z * z)
    return np.log(z) - 0.5 / z - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132)))) - back


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``digamma``."""
    z = np.array(x, float)
    ahead = np.zeros_like(z)
    for _ in range(SHIFT):
        low = z < SHIFT
        ahead += np.where(low, 1 / (z * z), 0.0)
        z = np.where(low, z + 1, z)
    i = 1 / (z * z)
    return 1 / z + i / 2 + i / z * (1 / 6 - i * (1 / 30 - i * (1 / 42 - i / 30))) + ahead


def gamma_cdf(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    """P(X <= x) for a gamma distribution of rate 1: the series below shape + 1, the continued fraction above.

    Both take some multiple of sqrt(shape) steps near the mean; values that have converged leave the loops."""
    shape, x = np.broadcast_arrays(np.asarray(shape, float), np.asarray(x, float))
    dims, shape, x = x.shape, shape.ravel(), x.ravel()
    front = np.exp(shape * np.log(np.maximum(x, 1e-300)) - x - log_gamma(shape))
    out = np.zeros(len(x))
    low, high = np.flatnonzero((x > 0) & (x < shape + 1)), np.flatnonzero(x >= shape + 1)
    out[low] = front[low] * _series(shape[low], x[low])
    out[high] = 1 - front[high] * _fraction(shape[high], x[high])
    return np.clip(out, 0.0, 1.0).reshape(dims)


def _steps(shape: np.ndarray) -> int:
    return int(200 + 12 * np.sqrt(shape.max(initial=1.0)))


def _series(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = term = total = 1 / shape
    out, live = out.copy(), np.arange(len(x))
    for k in range(1, _steps(shape)):
        term = term * (x / (shape + k))
        total = total + term
        if k % LEAVE == 0 and (done := np.abs(term) < 1e-15 * np.abs(total)).any():
            out[live[done]] = total[done]
            live, shape, x, term, total = (v[~done] for v in (live, shape, x, term, total))
            if not len(live):
                break
    out[live] = total
    return out


def _fraction(shape: np.ndarray, x: np.ndarray) -> np.ndarray:
    tiny = 1e-300
    b = x + 1 - shape
    c = np.full_like(b, 1 / tiny)
    d = 1 / b
    h = d.copy()
    out, live = h.copy(), np.arange(len(x))
    for k in range(1, _steps(shape)):
        a = -k * (k - shape)
        b = b + 2
        d = a * d + b
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = b + a / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        by = d * c
        h = h * by
        if k % LEAVE == 0 and (done := np.abs(by - 1) < 1e-14).any():
            out[live[done]] = h[done]
            live, shape, b, c, d, h = (v[~done] for v in (live, shape, b, c, d, h))
            if not len(live):
                break
    out[live] = h
    return out
