"""Distribution functions on NumPy arrays: gamma, beta, normal, t, F and chi-square.

Continued fractions and series as in the standard numerical literature; they
serve the p-values and limits of the statistical operators.
"""

from __future__ import annotations

import math

import numpy as np

EPS, TINY, STEPS = 3e-16, 1e-300, 400
_LGAMMA = np.vectorize(math.lgamma, otypes=[float])


def betainc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(z) + q * np.log1p(-z) + _LGAMMA(p + q) - _LGAMMA(p) - _LGAMMA(q)) / p
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < TINY, TINY, d)
    h = d.copy()
    for m in range(1, STEPS):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < TINY, TINY, d)
            c = 1 + num / np.where(np.abs(c) < TINY, TINY, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < EPS):
            break
    part = np.where(z <= 0, 0.0, front * h)
    return np.where(np.isnan(x), np.nan, np.where(swap, 1 - part, part))


def gammainc(a, x):
    """Regularised lower incomplete gamma function P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    x = np.maximum(x, 0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(-x + a * np.log(x) - _LGAMMA(a))
    term = total = 1 / a
    for n in range(1, STEPS):
        term = term * x / (a + n)
        total = total + term
    series = front * total
    b = x + 1 - a
    c, d = np.full_like(x, 1 / TINY), 1 / np.where(np.abs(b) < TINY, TINY, b)
    h = d
    for i in range(1, STEPS):
        num = -i * (i - a)
        b = b + 2
        d = num * d + b
        d = 1 / np.where(np.abs(d) < TINY, TINY, d)
        c = b + num / np.where(np.abs(c) < TINY, TINY, c)
        h = h * d * c
    return np.where(x <= 0, 0.0, np.where(x < a + 1, series, 1 - front * h))


def norm_cdf(x):
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(-np.asarray(x, float) / math.sqrt(2))


def norm_ppf(p):
    """Inverse of the normal distribution function, by bisection polished with Newton steps."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(200):
        mid = (low + high) / 2
        below = norm_cdf(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where((p <= 0) | (p >= 1), np.where(p <= 0, -np.inf, np.inf), (low + high) / 2)


def t_sf(t, df):
    """Right tail of Student's t."""
    t = np.clip(np.asarray(t, float), -1e150, 1e150)
    tail = 0.5 * betainc(np.asarray(df, float) / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, tail, 1 - tail)


def t_pdf(t, df):
    df = np.asarray(df, float)
    log = _LGAMMA((df + 1) / 2) - _LGAMMA(df / 2) - 0.5 * np.log(df * np.pi) - (df + 1) / 2 * np.log1p(np.square(t) / df)
    return np.exp(log)


def t_isf(p, df):
    """The t whose right tail is ``p`` (p < 0.5): expansion about the normal quantile, then Newton steps on the log tail."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    z = -norm_ppf(p)
    t = z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df**2)
    for _ in range(60):
        tail = np.maximum(t_sf(t, df), TINY)
        step = np.log(tail / p) * tail / np.maximum(t_pdf(t, df), TINY)
        t = t + np.clip(step, -0.5 * np.abs(t) - 0.1, np.abs(t) + 0.1)
        if np.all(np.abs(step) < 1e-10 * (1 + np.abs(t))):
            break
    return t


def f_sf(f, d1, d2):
    f = np.asarray(f, float)
    return betainc(np.asarray(d2, float) / 2, np.asarray(d1, float) / 2, d2 / (d2 + d1 * np.maximum(f, 0)))


def chi2_sf(x, df):
    return 1 - gammainc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def beta_ppf(q, a, b):
    """Inverse of the beta distribution function, by bisection."""
    q, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (q, a, b)))
    low, high = np.zeros(q.shape), np.ones(q.shape)
    for _ in range(100):
        mid = (low + high) / 2
        below = betainc(a, b, mid) < q
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2
