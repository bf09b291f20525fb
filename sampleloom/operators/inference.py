"""Statistical inference: permutation nulls, tests, false discovery, cluster thresholds."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.functions.distributions import beta_ppf, chi2_sf, norm_cdf, norm_ppf, t_sf
from sampleloom.operators.select import ranked
from sampleloom.session import materialised, release


def clipped(p: Column, n: Column) -> Column:
    """Empirical probability kept within [1/(n+2), (n+1)/(n+2)]."""
    return F.greatest(F.least(p, (n + 1) / (n + 2)), F.lit(1.0) / (n + 2))


def tail_probability(left: Column, right: Column, tail: str) -> Column:
    if tail == "left":
        return left
    if tail == "right":
        return right
    if tail == "any":
        return F.least(left, right)
    return F.least(F.lit(1.0), 2 * F.least(left, right))


def null_probability(observed: DataFrame, null: DataFrame, by: list[str], value: str = "value", tail: str = "both", clip: bool = True) -> DataFrame:
    """Probability of observed values under draws of the null, per element; NaN has probability 1.

    The null is one keyed aggregate against the joined observation; no
    permutation is looped over.
    """
    j = null.select(*by, F.col(value).alias("_null")).join(observed.select(*by, value), by)
    counts = j.groupBy(*by, value).agg(F.avg((F.col("_null") <= F.col(value)).cast("double")).alias("_l"), F.avg((F.col("_null") >= F.col(value)).cast("double")).alias("_r"), F.count("*").alias("_n"))
    l, r = (clipped(F.col(c), F.col("_n")) if clip else F.col(c) for c in ("_l", "_r"))
    return counts.select(*by, value, F.when(F.isnan(value), 1.0).otherwise(tail_probability(l, r, tail)).alias("p"))


def normal_probability(x: Column, sd: float = 1.0, tail: str = "both") -> Column:
    """Probability under a fixed normal distribution."""
    udf = F.pandas_udf(lambda s: pd.Series(norm_cdf(s.to_numpy(float) / sd)), "double")
    left = udf(x)
    return tail_probability(left, 1 - left, tail)


def rdist_probability(x: Column, n: int, tail: str = "both") -> Column:
    """Probability of a correlation-like value under the r distribution with n - 1 dimensions."""

    def cdf(s: pd.Series) -> pd.Series:
        r = np.clip(s.to_numpy(float), -1 + 1e-15, 1 - 1e-15)
        t = r * np.sqrt((n - 2) / (1 - r * r))
        return pd.Series(1 - t_sf(t, n - 2))

    left = F.pandas_udf(cdf, "double")(x)
    return tail_probability(left, 1 - left, tail)


def ttest(df: DataFrame, by: list[str], value: str, mean: float = 0.0, alternative: str = "two-sided") -> DataFrame:
    """One-sample t (sample deviation) and p per group."""
    base = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.try_divide(F.col("mean") - mean, F.col("sd") / F.sqrt("n"))

    def tail(s: pd.Series, df_: pd.Series) -> pd.Series:
        x, d = s.to_numpy(float), np.maximum(df_.to_numpy(float), 1)
        p = {"two-sided": lambda: np.minimum(1, 2 * t_sf(np.abs(x), d)), "greater": lambda: t_sf(x, d), "less": lambda: 1 - t_sf(x, d)}[alternative]()
        return pd.Series(p)

    return base.withColumn("t", t).withColumn("p", F.pandas_udf(tail, "double")("t", F.col("n") - 1))


def chisquare(counts: DataFrame, row: str, column: str, n: str = "n", expected: str = "uniform") -> DataFrame:
    """Chi-square of a contingency table against uniform, indep_rows or indep_cols expectations, with p."""
    cells = counts.agg(F.struct(F.sum(n).alias("_t"), F.count("*").alias("_k")))
    j = counts.withColumn("_one", cells.scalar()).select("*", "_one.*").drop("_one")
    if expected == "uniform":
        e = F.col("_t") / F.col("_k")
    else:
        # independent of the rows: each column's sum spread evenly over the rows
        side = column if expected == "indep_rows" else row
        sums = counts.groupBy(side).agg(F.sum(n).alias("_s"), F.count("*").alias("_c"))
        j = j.join(sums, side)
        e = F.col("_s") / F.col("_c")
    j = j.withColumn("_e", e)
    j = j.withColumn("_x", F.when((F.col("_e") == 0) & (F.col(n) > 0), F.raise_error(F.lit("observation where none is expected"))).otherwise(F.coalesce(F.try_divide(F.pow(F.col(n) - F.col("_e"), 2), "_e"), F.lit(0.0))))
    out = j.agg(F.sum("_x").alias("chi2"), (F.count("*") - 1).alias("df"))
    p = F.pandas_udf(lambda x, d: pd.Series(chi2_sf(x.to_numpy(float), np.maximum(d.to_numpy(float), 1))), "double")
    return out.withColumn("p", p("chi2", "df"))


def beta_interval(n: Column, x: Column, alpha: float = 0.05, method: str = "jeffreys") -> tuple[Column, Column]:
    """Bounds of a proportion by quantiles of the beta distribution: jeffreys or clopper-pearson."""
    a, b = (0.5, 0.5) if method == "jeffreys" else (0.0, 1.0)

    def low(k: pd.Series, m: pd.Series) -> pd.Series:
        k, m = k.to_numpy(float), m.to_numpy(float)
        return pd.Series(np.where((k == 0) & (a == 0), 0.0, beta_ppf(alpha / 2, np.maximum(k + a, 1e-9), m - k + b)))

    def high(k: pd.Series, m: pd.Series) -> pd.Series:
        k, m = k.to_numpy(float), m.to_numpy(float)
        return pd.Series(np.where((k == m) & (a == 0), 1.0, beta_ppf(1 - alpha / 2, k + b, np.maximum(m - k + a, 1e-9))))

    return F.pandas_udf(low, "double")(x, n), F.pandas_udf(high, "double")(x, n)


def fdr_curve(df: DataFrame, p: str, key: str, by: list[str] | None = None) -> DataFrame:
    """n p / rank by ascending p, as a running maximum capped at 1.

    Ranks and the maximum are taken within range partitions and completed by
    those before, so a group of any size is shared among tasks.
    """
    by = by or []
    r = ranked(df, by, [p, key], "_pos", "_size").withColumn("_q", F.col(p) * F.col("_size") / (F.col("_pos") + 1))
    local = F.max("_q").over(W.partitionBy(*by, "_part").orderBy("_pos").rowsBetween(W.unboundedPreceding, 0))
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    tops = r.groupBy(*by, "_part").agg(F.max("_q").alias("_top"))
    tops = tops.withColumn("_top", F.max("_top").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    j = r.join(tops, [*by, "_part"])
    return j.withColumn("fdr", F.least(F.lit(1.0), F.greatest(local, F.col("_top")))).drop("_q", "_pos", "_size", "_part", "_top")


def empirical_null(z: np.ndarray, low: float = 0.2, high: float = 0.8) -> tuple[float, float, float]:
    """Mean, deviation and weight of the normal null that the central z values, from quantile ``low`` to ``high``, suggest.

    The logarithm of a normal density is a parabola: one is fitted to the
    logarithms of the central values' counts in bins, as many as Scott's rule
    gives for the range of all.
    """
    z = np.sort(np.asarray(z, float).ravel())
    n = len(z)
    bins = max(10, int(np.ptp(z) * n ** (1 / 3) / (3.5 * (z.std() or 1.0))))
    count, edge = np.histogram(z[int(n * low) : int(n * high)], bins)
    some = count > 0
    if some.sum() < 3:
        return float(z[n // 2]), float(z.std()), 1.0
    middle = (edge[1:] + edge[:-1]) / 2
    bent, slope, top = np.polyfit(middle[some], np.log(count[some]), 2)
    var = -0.5 / min(bent, -1e-12)
    mu = slope * var
    weight = np.exp(top + mu * mu / (2 * var)) * np.sqrt(2 * np.pi * var) / (n * (edge[1] - edge[0]))
    return float(mu), float(np.sqrt(var)), float(min(weight, 1.0))


def empirical_null_fdr(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The z values in order, and the false discovery rate of taking each and all above it, under the empirical null."""
    z = np.sort(np.asarray(z, float).ravel())
    mu, sd, weight = empirical_null(z)
    return z, np.minimum(1.0, weight * (1 - norm_cdf((z - mu) / sd)) * len(z) / np.arange(len(z), 0, -1))


def empirical_null_threshold(z: np.ndarray, alpha: float = 0.05) -> float:
    """The value from which on the false discovery rate stays below ``alpha``, half way to the value before; infinity if none does."""
    z, rate = empirical_null_fdr(z)
    above = len(z) - int(np.argmax(np.append(rate[::-1] >= alpha, True)))
    if above == len(z):
        return float("inf")
    return float(z[above] if above == 0 else (z[above] + z[above - 1]) / 2)


def gaussian_mixture(x: np.ndarray, classes: int = 3, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and deviations of a normal mixture in one dimension, by expectation-maximisation from quantiles."""
    x = np.asarray(x, float)
    m = np.quantile(x, (np.arange(classes) + 0.5) / classes)
    s, w = np.full(classes, x.std() or 1.0), np.ones(classes) / classes
    for _ in range(rounds):
        d = w * np.exp(-0.5 * ((x[:, None] - m) / s) ** 2) / s
        r = d / np.maximum(d.sum(1, keepdims=True), 1e-300)
        k = np.maximum(r.sum(0), 1e-12)
        new = (r * x[:, None]).sum(0) / k
        s = np.maximum(np.sqrt((r * (x[:, None] - new) ** 2).sum(0) / k), 1e-6)
        w, moved, m = k / k.sum(), np.abs(new - m).max(), new
        if moved < 1e-9:
            break
    return w, m, s


def gamma_gaussian(x: np.ndarray, rounds: int = 200) -> dict[str, float]:
    """A normal null and a gamma-distributed positive part, by expectation-maximisation with moments."""
    x = np.asarray(x, float)
    mu, sd, share = float(np.median(x)), float(x.std() or 1), 0.9
    top = x[x > mu + sd] if (x > mu + sd).any() else np.array([mu + sd])
    mean, var = float(top.mean()), float(top.var() or 1)
    for _ in range(rounds):
        shape, scale = max(mean * mean / var, 1e-6), var / max(mean, 1e-12)
        g = np.where(x > 0, np.exp((shape - 1) * np.log(np.maximum(x, 1e-300)) - x / scale - math.lgamma(shape) - shape * math.log(scale)), 0)
        h = np.exp(-0.5 * ((x - mu) / sd) ** 2) / (sd * math.sqrt(2 * math.pi))
        r = (1 - share) * g / np.maximum((1 - share) * g + share * h, 1e-300)
        share = float(1 - r.mean())
        mu = float(((1 - r) * x).sum() / max((1 - r).sum(), 1e-12))
        sd = float(np.sqrt(((1 - r) * (x - mu) ** 2).sum() / max((1 - r).sum(), 1e-12))) or 1e-6
        mean = float((r * x).sum() / max(r.sum(), 1e-12)) or 1e-6
        var = float((r * (x - mean) ** 2).sum() / max(r.sum(), 1e-12)) or 1e-6
    return {"mean": mu, "sd": sd, "share": share, "shape": mean * mean / var, "scale": var / mean}


DISTRIBUTIONS = {
    "norm": lambda x: (lambda m, s: lambda v: norm_cdf((v - m) / s))(x.mean(), x.std() or 1),
    "uniform": lambda x: (lambda a, b: lambda v: np.clip((v - a) / ((b - a) or 1), 0, 1))(x.min(), x.max()),
    "expon": lambda x: (lambda a, s: lambda v: 1 - np.exp(-np.maximum(v - a, 0) / s))(x.min(), (x.mean() - x.min()) or 1),
    "laplace": lambda x: (lambda m, s: lambda v: np.where(v < m, 0.5 * np.exp((v - m) / s), 1 - 0.5 * np.exp(-(v - m) / s)))(np.median(x), np.abs(x - np.median(x)).mean() or 1),
    "logistic": lambda x: (lambda m, s: lambda v: 1 / (1 + np.exp(-(v - m) / s)))(x.mean(), (x.std() or 1) * math.sqrt(3) / math.pi),
}


def match_distribution(x: np.ndarray) -> list[tuple[str, float]]:
    """Candidate distributions, fitted by moments, by their Kolmogorov-Smirnov distance."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    up, down = np.arange(1, n + 1) / n, np.arange(n) / n
    out = [(name, float(max(np.max(up - c), np.max(c - down)))) for name, fit in DISTRIBUTIONS.items() for c in [fit(x)(x)]]
    return sorted(out, key=lambda v: v[1])


# --- clusters --------------------------------------------------------------
def stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round on (a, b): every node linked closer to the smallest it can see."""
    for larger in (True, False):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        seen = both.join(least, "a")
        keep = seen.where("b > a") if larger else seen.where("b <= a").unionByName(seen.select("a", F.col("a").alias("b"), "m"))
        closer = materialised(keep.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        if not larger:
            release(edges)
        edges = closer
    return edges


def connected(edges: DataFrame, nodes: DataFrame, most: int = 50) -> DataFrame:
    """(node, cluster) with the smallest node of each connected part, by star contraction.

    ``edges`` (a, b) over numbers, both directions or one; those with an end that
    is no node are left out. Rounds go on until every node is linked to the root
    of its part alone; lineage is cut by written tables. An error is raised if
    ``most`` rounds don't do, as labels would be those of parts of clusters.
    """
    ends = lambda c: nodes.select(F.col("node").alias(c)).distinct()
    links = materialised(edges.select("a", "b").where("a <> b").join(ends("a"), "a", "left_semi").join(ends("b"), "b", "left_semi").select("a", "b").distinct())
    for _ in range(most):
        up = links.select(F.col("b").alias("a")).distinct()
        open_ends = links.join(up, "a", "left_semi").select("a").unionByName(links.groupBy("a").agg(F.count("*").alias("_n")).where("_n > 1").select("a")).unionByName(links.where("b > a").select("a"))
        if not open_ends.limit(1).count():
            return nodes.join(links, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("cluster"))
        before, links = links, stars(links)
        release(before)
    raise RuntimeError(f"clusters are not joined after {most} rounds")


def threshold_map(draws: DataFrame, p: float = 0.001, by: str = "feature_id", value: str = "value") -> DataFrame:
    """Per feature the value at rank int(n p) from the top of its null draws."""
    n = F.count("*").over(W.partitionBy(by))
    r = F.row_number().over(W.partitionBy(by).orderBy(F.desc(value)))
    k = F.floor(n * F.lit(p)).cast("int")
    checked = F.when(k < 1, F.raise_error(F.lit("too few draws for this probability"))).otherwise(k)
    return draws.withColumn("_k", checked).withColumn("_r", r).where("_r = _k").select(by, F.col(value).alias("threshold"))


def cluster_pvalues(sizes: DataFrame, null_sizes: DataFrame) -> DataFrame:
    """Right-tail probability of each cluster size among null and observed sizes: (size, p)."""
    every = sizes.select("size").unionByName(null_sizes.select("size")).groupBy("size").agg(F.count("*").alias("_n"))
    # distinct sizes only
    w = W.orderBy(F.desc("size"))
    tail = every.withColumn("_a", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return sizes.select("size").distinct().join(tail, "size").select("size", (F.col("_a") / F.col("_t")).alias("p"))


def bootstrap_maps(maps: DataFrame, chunk: str, draws: int, seed: int = 0, by: str = "feature_id", value: str = "value", sample: str = "sample_id") -> DataFrame:
    """Group maps of the null: for each draw one random map of every chunk, averaged. (draw, feature, value)"""
    # maps are listed by chunk and number: a small table beside their values
    listed = maps.select(chunk, sample).distinct().groupBy(chunk).agg(F.array_sort(F.collect_list(sample)).alias("_all"))
    picks = listed.select(chunk, "_all", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    at = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col(chunk)), F.size("_all")).cast("int")
    picks = picks.select(chunk, "draw", F.col("_all")[at].alias(sample))
    return maps.join(picks, [chunk, sample]).groupBy("draw", by).agg(F.avg(value).alias(value))


def cluster_statistics(found: DataFrame, cluster: str = "cluster", value: str = "value") -> DataFrame:
    q = F.percentile(value, F.lit(0.5))
    return found.groupBy(cluster).agg(F.count("*").alias("size"), F.avg(value).alias("mean"), q.alias("median"), F.min(value).alias("min"), F.max(value).alias("max"), F.stddev_pop(value).alias("std"))


def z_quantile(alpha: float) -> float:
    return float(norm_ppf(np.array([1 - alpha / 2]))[0])


def dist_pvalues(x: np.ndarray, n: int, fpp: float | None = None, rounds: int = 10) -> np.ndarray:
    """Two-sided probabilities of values under the r distribution with ``n`` - 1 dimensions.

    Values are centred and scaled to it first; with ``fpp`` the values whose
    probability falls below that are taken for positives and left out of centre
    and scale, until they no longer change.
    """
    x = np.asarray(x, float)
    null = np.ones(len(x), bool)
    for _ in range(rounds if fpp else 1):
        centre, scale = x[null].mean(), x[null].std() or 1.0
        # the r distribution's own deviation
        r = np.clip((x - centre) / scale / np.sqrt(n), -1 + 1e-15, 1 - 1e-15)
        t = np.abs(r) * np.sqrt((n - 2) / (1 - r * r))
        p = np.minimum(1.0, 2 * t_sf(t, n - 2))
        new = p >= fpp if fpp else null
        if not new.any() or (new == null).all():
            break
        null = new
    return p


def repeat_cluster_values(sizes: DataFrame, clusters: DataFrame, value: str, cluster: str = "cluster") -> DataFrame:
    """A cluster's value for every one of its nodes."""
    return clusters.join(sizes.select(cluster, value), cluster)


def auto_null(kind: str | None = "empirical", **fixed):
    """How to get probabilities of observed values from draws: a function (observed, null, by) -> DataFrame.

    ``empirical`` counts draws, ``normal`` and ``rdist`` take a distribution with
    the draws' deviation and the given ``fixed`` parameters; None gives None.
    """
    if kind is None:
        return None
    if kind == "empirical":
        return lambda observed, null, by, tail="both": null_probability(observed, null, by, tail=tail)
    if kind not in ("normal", "rdist"):
        raise ValueError(kind)

    def fitted(observed: DataFrame, null: DataFrame, by: list[str], tail: str = "both") -> DataFrame:
        sd = null.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
        z = (F.col("value") - F.lit(fixed["loc"]) if "loc" in fixed else F.col("value") - F.col("_m"))
        j = observed.join(sd, by).withColumn("_z", F.coalesce(F.try_divide(z, F.lit(fixed["scale"]) if "scale" in fixed else F.col("_s")), F.lit(0.0)))
        p = normal_probability(F.col("_z"), tail=tail) if kind == "normal" else rdist_probability(F.tanh("_z"), fixed.get("n", 10), tail)
        return j.select(*by, "value", p.alias("p"))

    return fitted


def semifrozen(name: str, x: np.ndarray, loc: float | None = None, scale: float | None = None):
    """Cumulative distribution fitted to ``x`` with the parameters that are given held: normal, uniform or exponential."""
    x = np.asarray(x, float)
    if name == "norm":
        m = x.mean() if loc is None else loc
        s = np.sqrt(np.mean((x - m) ** 2)) if scale is None else scale
        return lambda v: norm_cdf((np.asarray(v, float) - m) / (s or 1.0))
    if name == "uniform":
        m = x.min() if loc is None else loc
        s = np.max(x) - m if scale is None else scale
        return lambda v: np.clip((np.asarray(v, float) - m) / (s or 1.0), 0, 1)
    if name == "expon":
        m = x.min() if loc is None else loc
        s = x.mean() - m if scale is None else scale
        return lambda v: 1 - np.exp(-np.maximum(np.asarray(v, float) - m, 0) / (s or 1.0))
    raise ValueError(name)
