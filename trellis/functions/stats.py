"""Special functions and tests in numpy, for use inside Arrow batches and on small driver data."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def beta_inc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    a, b, x = (np.atleast_1d(np.asarray(v, float)) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    tiny = 1e-300
    c = np.ones_like(y)
    d = 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.nanmax(np.abs(d * c - 1), initial=0) < 1e-15:
            break
    out = np.where(y <= 0, 0.0, np.where(y >= 1, 1.0, front * h))
    return np.where(swap, 1 - out, out)


def binom_upper(k: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P(X >= k) for X binomial."""
    k, n, p = np.broadcast_arrays(np.asarray(k, float), np.asarray(n, float), np.asarray(p, float))
    safe = np.where((k > 0) & (k <= n), k, 1)
    out = beta_inc(safe, np.maximum(n - safe + 1, 1e-9), p)
    return np.where(k <= 0, 1.0, np.where(k > n, 0.0, out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    return beta_inc(np.asarray(df) / 2, np.full_like(np.asarray(df, float), 0.5), np.asarray(df) / (np.asarray(df) + np.asarray(t) ** 2))


def ks_asymptotic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(D, p) of the two-sample Kolmogorov-Smirnov test, asymptotic."""
    n, m = len(x), len(y)
    if not n or not m:
        return float("nan"), float("nan")
    at = np.concatenate([x, y])
    d = float(np.abs(np.searchsorted(np.sort(x), at, "right") / n - np.searchsorted(np.sort(y), at, "right") / m).max())
    z = d * math.sqrt(n * m / (n + m))
    if z < 0.2:
        return d, 1.0
    k = np.arange(1, 101)
    return d, float(min(1.0, max(0.0, 2 * np.sum((-1.0) ** (k - 1) * np.exp(-2 * k**2 * z**2)))))


def digamma(x: float) -> float:
    out = 0.0
    while x < 12:
        out -= 1 / x
        x += 1
    i = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i / 252))


def gamma_fit(mean: float, mean_log: float) -> tuple[float, float]:
    """(shape, rate) of a gamma distribution by maximum likelihood, from mean and mean log."""
    s = math.log(mean) - mean_log
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        e = 1e-5 * a
        step = (math.log(a) - digamma(a) - s) / (1 / a - (digamma(a + e) - digamma(a - e)) / (2 * e))
        a = max(a - step, a / 2)
        if abs(step) < 1e-12 * a:
            break
    return a, a / mean


def _hull(x: np.ndarray, y: np.ndarray, lo: int, hi: int, sign: int) -> list[int]:
    """Which of the points lo to hi carry the convex hull below them (above, for a sign of -1)."""
    out: list[int] = []
    for i in range(lo, hi + 1):
        while len(out) > 1 and sign * (y[out[-1]] - y[out[-2]]) * (x[i] - x[out[-2]]) >= sign * (y[i] - y[out[-2]]) * (x[out[-1]] - x[out[-2]]):
            out.pop()
        out.append(i)
    return out


def dip(x: np.ndarray) -> float:
    """Hartigan's dip: the least distance of the distribution function from a unimodal one.

    Between a convex hull below the steps and a concave one above them, the widest gap tells where
    the mode must lie; what is left of it must be convex and what is right of it concave, and the
    largest misfit there bounds the dip from below. The stretch shrinks until the gap is no wider
    than what has been found. A round is linear in what is left.
    """
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 2 or x[0] == x[-1]:
        return 1 / (2 * n) if n else 0.0
    u, at = np.unique(x, return_index=True)
    below, above = at.astype(float), np.append(at[1:], n).astype(float)  # counts before and after each step
    lo, hi, found = 0, len(u) - 1, 1.0
    while True:
        convex, concave = _hull(u, below, lo, hi, 1), _hull(u, above, lo, hi, -1)
        at_convex = np.interp(u[convex], u[concave], above[concave]) - below[convex]
        at_concave = above[concave] - np.interp(u[concave], u[convex], below[convex])
        if max(at_convex.max(), at_concave.max()) <= found:
            return found / (2 * n)
        if at_convex.max() >= at_concave.max():
            left = convex[int(at_convex.argmax())]
            right = next(c for c in concave if c >= left)
        else:
            right = concave[int(at_concave.argmax())]
            left = next(c for c in reversed(convex) if c <= right)
        # a step at the mode itself is no misfit
        for part, knots, y, other, sign in ((slice(lo, left), convex, below, above, 1), (slice(right + 1, hi + 1), concave, above, below, -1)):
            fit = np.interp(u[part], u[knots], y[knots])
            found = max(found, float((sign * (other[part] - fit)).max(initial=0)))
        if (left, right) == (lo, hi):
            return found / (2 * n)
        lo, hi = left, right


#: Numbers of values for which the distribution of the dip of uniform values is drawn.
DIP_SIZES = (5, 10, 20, 50, 100, 200, 500, 1000)


def dip_p(d: float, n: int, null: dict[int, np.ndarray]) -> float:
    """The p-value of a dip of ``n`` values, from sorted dips of uniform values by size: dips times the root of
    the size are compared, between two sizes by linear interpolation."""
    scaled = d * math.sqrt(n)
    share = lambda k: (len(null[k]) - np.searchsorted(null[k], scaled / math.sqrt(k) - 1e-12) + 1) / (len(null[k]) + 1)
    sizes = sorted(null)
    if n <= sizes[0] or n >= sizes[-1]:
        return float(share(sizes[0] if n <= sizes[0] else sizes[-1]))
    k = next(i for i, size in enumerate(sizes) if size > n)
    low, high = sizes[k - 1], sizes[k]
    at = (n - low) / (high - low)
    return float(share(low) * (1 - at) + share(high) * at)
