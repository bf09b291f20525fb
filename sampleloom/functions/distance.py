"""Distances and kernels between value arrays, as expressions that stay in the JVM."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x * y))


def squared_euclidean(a, b, weight: list[float] | None = None) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return _total(F.zip_with(d, F.array(*map(F.lit, map(float, weight))), lambda x, w: x * w) if weight else d)


def euclidean(a, b) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a, b) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def chebyshev(a, b) -> Column:
    """Largest absolute difference."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def pnorm(a, b, p: float = 2.0, weight: list[float] | None = None) -> Column:
    """Weighted p-norm, the weight inside the power."""
    d = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if weight:
        d = F.zip_with(d, F.array(*map(F.lit, map(float, weight))), lambda x, w: x * w)
    return F.pow(_total(F.transform(d, lambda x: F.pow(x, F.lit(float(p))))), F.lit(1.0 / p))


def mahalanobis(a, b, w: list[list[float]]) -> Column:
    """sqrt(d' W d) for a given matrix."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    rows = [dot(d, F.array(*map(F.lit, map(float, row)))) for row in w]
    return F.sqrt(dot(d, F.array(*rows)))


def correlation_of(a, b) -> Column:
    """Pearson correlation of two arrays, NULL if either is constant."""
    n = F.size(a)
    ma, mb = _total(a if isinstance(a, Column) else F.col(a)) / n, _total(b if isinstance(b, Column) else F.col(b)) / n
    da, db = F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb)
    return F.try_divide(dot(da, db), F.sqrt(dot(da, da) * dot(db, db)))


def one_minus_correlation(a, b) -> Column:
    """|1 - r|."""
    return F.abs(1 - correlation_of(a, b))


def single_dimension_similarity(a, b, d: int = 0) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.exp(-F.abs(a[d] - b[d]))


def mean_min(one, other) -> Column:
    """Mean of nearest distances between two lists of points, in both directions, as a pair."""
    near = lambda p, q: F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: euclidean(x, y))))
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    return F.array(mean(near(one, other)), mean(near(other, one)))


def corouge(one, other) -> Column:
    """Mean of the two directions' mean nearest distances."""
    m = mean_min(one, other)
    return (m[0] + m[1]) / 2


def streamline_similarity(one, other, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * corouge(one, other))


# --- kernels ---------------------------------------------------------------
def _scaled(a, b, scale) -> Column:
    """Sum of squared differences in units of a length scale (one for all, or one a feature)."""
    if isinstance(scale, int | float):
        return squared_euclidean(a, b) / float(scale) ** 2
    return squared_euclidean(a, b, [1.0 / s**2 for s in scale])


def linear(a, b) -> Column:
    return dot(a, b)


def polynomial(a, b, gamma: float = 1.0, degree: float = 2.0, coef0: float = 1.0) -> Column:
    return F.pow(gamma * dot(a, b) + coef0, F.lit(float(degree)))


def rbf(a, b, sigma: float = 1.0) -> Column:
    """exp(-|x - y|^2 / sigma)."""
    return F.exp(-squared_euclidean(a, b) / sigma)


def rbf_gamma(a, b, gamma: float = 1.0) -> Column:
    return F.exp(-gamma * squared_euclidean(a, b))


def sigmoid(a, b, gamma: float = 1.0, coef0: float = 0.0) -> Column:
    return F.tanh(gamma * dot(a, b) + coef0)


def constant(sigma_0: float = 1.0) -> Column:
    return F.lit(float(sigma_0) ** 2)


def generalized_linear(a, b, sigma_0: float = 1.0, sigma_p: list[float] | None = None) -> Column:
    """x' diag(sigma_p) y + sigma_0^2."""
    x = F.zip_with(a, F.array(*map(F.lit, map(float, sigma_p))), lambda v, w: v * w) if sigma_p else a
    return dot(x, b) + float(sigma_0) ** 2


def exponential(a, b, length_scale=1.0, sigma_f: float = 1.0) -> Column:
    return sigma_f**2 * F.exp(-F.sqrt(_scaled(a, b, length_scale)))


def squared_exponential(a, b, length_scale=1.0, sigma_f: float = 1.0) -> Column:
    return sigma_f**2 * F.exp(-0.5 * _scaled(a, b, length_scale))


def matern_3_2(a, b, length_scale=1.0, sigma_f: float = 1.0) -> Column:
    """With the distance from half the scaled squares."""
    t = F.sqrt(0.5 * _scaled(a, b, length_scale)) * math.sqrt(3)
    return sigma_f**2 * (1 + t) * F.exp(-t)


def matern_5_2(a, b, length_scale=1.0, sigma_f: float = 1.0) -> Column:
    t = F.sqrt(0.5 * _scaled(a, b, length_scale)) * math.sqrt(5)
    return sigma_f**2 * (1 + t + t * t / 3) * F.exp(-t)


def rational_quadratic(a, b, length_scale=1.0, sigma_f: float = 1.0, alpha: float = 0.5) -> Column:
    return sigma_f**2 * F.pow(1 + _scaled(a, b, length_scale) / (2 * alpha), F.lit(-float(alpha)))


def pairwise(left: DataFrame, right: DataFrame, key: str, values: str, fx, block: list[str] | None = None, symmetric: bool = False) -> DataFrame:
    """(id_a, id_b, value) of all pairs within ``block`` columns (e.g. a fold): the result itself is of that size.

    Meant for tables of prototypes, classes or centres; one side is the stated
    query set. ``symmetric`` gives each pair once, id_a < id_b.
    """
    block = block or []
    a = left.select(*block, F.col(key).alias("id_a"), F.col(values).alias("_a"))
    b = right.select(*block, F.col(key).alias("id_b"), F.col(values).alias("_b"))
    on = reduce(lambda p, q: p & q, [F.col("id_a") < F.col("id_b")] if symmetric else [F.lit(True)])
    joined = a.join(b, block).where(on) if block else a.join(b, on)
    return joined.select(*block, "id_a", "id_b", fx(F.col("_a"), F.col("_b")).alias("value"))
