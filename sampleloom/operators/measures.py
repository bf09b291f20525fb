"""Statistics per feature or pair of samples: F, correlation, stability, dissimilarity structure, relevance."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sampleloom.functions.distance import pairwise
from sampleloom.functions.distributions import f_sf, t_sf
from sampleloom.operators.aggregate import correlation
from sampleloom.operators.choose import ranks


def anova(long: DataFrame, target: str, by: str = "feature_id", value: str = "value") -> DataFrame:
    """One-way F per feature: (f, df_between, df_within). 0/0 gives 0; no variance within gives infinity.

    From counts, means and variances per feature and class, so one shuffle of
    partial aggregates whatever the number of samples.
    """
    cells = long.groupBy(by, target).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    total = cells.groupBy(by).agg(F.sum("n").alias("_n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("_m"))
    joined = cells.join(total, by)
    part = joined.groupBy(by).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("_m"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.count("*").alias("k"), F.first("_n").alias("n"))
    b, w = F.try_divide("b", F.col("k") - 1), F.try_divide("w", F.col("n") - F.col("k"))
    f = F.when(w == 0, F.when(b == 0, 0.0).otherwise(float("inf"))).otherwise(F.coalesce(b / w, F.lit(0.0)))
    return part.select(by, f.alias("f"), (F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"))


@F.pandas_udf(DoubleType())
def f_probability(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_probability(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided."""
    return pd.Series(np.minimum(1.0, 2 * t_sf(np.abs(t.to_numpy(float)), df.to_numpy(float))))


def compound_anova(long: DataFrame, target: str, by: str = "feature_id", value: str = "value") -> DataFrame:
    """F of each class against the rest, per feature, from the classes' sums alone."""
    cells = long.groupBy(by, target).agg(F.count(value).cast("double").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    total = cells.groupBy(by).agg(*(F.sum(c).alias(f"_{c}") for c in "nsq"))
    j = cells.join(total, by)
    n, s, rn, rs = F.col("n"), F.col("s"), F.col("_n") - F.col("n"), F.col("_s") - F.col("s")
    base = F.pow("_s", F.lit(2)) / F.col("_n")
    between = s * s / n + F.try_divide(rs * rs, rn) - base
    within = F.try_divide(F.col("_q") - s * s / n - F.try_divide(rs * rs, rn), F.col("_n") - 2)
    return j.select(by, target, F.coalesce(F.try_divide(between, within), F.lit(0.0)).alias("f"))


def corrcoef(long: DataFrame, attr: str, by: str = "feature_id", value: str = "value") -> DataFrame:
    """Correlation of each feature with a numeric attribute; 0 where one is constant, 1 where both are."""
    both = (F.stddev_pop(value) == 0) & (F.stddev_pop(attr) == 0)
    r = F.when(both, 1.0).otherwise(F.coalesce(correlation(value, attr), F.lit(0.0)))
    return long.groupBy(by).agg(r.alias("r"), F.count("*").alias("n"))


def corrstability(long: DataFrame, target: str, chunk: str, by: str = "feature_id", value: str = "value") -> DataFrame:
    """Per feature the correlation of class means between chunks: over all pairs of chunks and classes together; 0 where undefined."""
    means = long.groupBy(by, chunk, target).agg(F.avg(value).alias("m"))
    a, b = means.withColumnRenamed("m", "ma").withColumnRenamed(chunk, "ca"), means.withColumnRenamed("m", "mb").withColumnRenamed(chunk, "cb")
    # class means: features x classes x chunks, not samples
    return a.join(b, [by, target]).where("ca < cb").groupBy(by).agg(F.coalesce(correlation("ma", "mb"), F.lit(0.0)).alias("stability"))


def featurewise(long: DataFrame, target: str, fx: Callable[[np.ndarray, np.ndarray], float], by: str = "feature_id", value: str = "value") -> DataFrame:
    """``fx(values, targets)`` per feature over all its samples, for statistics without a plan of their own: one task holds a feature."""
    kind = dict(long.dtypes)[by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: [pdf[by].iloc[0]], "value": [float(fx(pdf[value].to_numpy(float), pdf[target].to_numpy()))]})

    return long.select(by, value, target).groupBy(by).applyInPandas(run, f"{by} {kind}, value double")


def label_distance_correlation(long: DataFrame, target: str, by: str = "feature_id", value: str = "value") -> DataFrame:
    """(by, value): distance correlation of each feature with a numeric label of some distinct values, over all samples.

    In one dimension the sums of distances follow from sorted running sums: the
    distances of a value to all of one label are settled by how many of them lie
    below and what they add up to. Running sums are taken in range partitions
    and completed by those before, so a feature of any size is shared among
    tasks and no pair of samples is formed.
    """
    from sampleloom.operators.generators import uniques
    from sampleloom.operators.select import ranked

    labels = uniques(long, target)
    t, x = F.col("_t"), F.col("_x")
    base = long.select(by, F.col(value).cast("double").alias("_x"), F.col(target).cast("double").alias("_t"), F.monotonically_increasing_id().alias("_tie")).dropna()
    at = ranked(base, [by], ["_x", "_tie"], "_i").drop("_tie")
    own = W.partitionBy(by, "_part").orderBy("_i").rowsBetween(W.unboundedPreceding, 0)
    is_ = [(t == F.lit(float(y))).cast("double") for y in labels]
    running = at.select(by, "_part", "_x", "_t", *(F.sum(h).over(own).alias(f"c{k}") for k, h in enumerate(is_)), *(F.sum(h * x).over(own).alias(f"s{k}") for k, h in enumerate(is_)))
    names = [f"{n}{k}" for n in "cs" for k in range(len(labels))]
    part = at.groupBy(by, "_part").agg(*(F.sum(h).alias(f"c{k}") for k, h in enumerate(is_)), *(F.sum(h * x).alias(f"s{k}") for k, h in enumerate(is_)))
    w = W.partitionBy(by)
    before = w.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    part = part.select(by, "_part", *(F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(f"_b{n}") for n in names), *(F.sum(n).over(w).alias(f"_a{n}") for n in names))
    j = running.join(part, [by, "_part"])
    n = sum((F.col(f"_ac{k}") for k in range(1, len(labels))), F.col("_ac0"))
    # distances to all of one label: those below count x less their sum, those above their sum less x
    to = [x * (2 * (F.col(f"c{k}") + F.col(f"_bc{k}")) - F.col(f"_ac{k}")) + F.col(f"_as{k}") - 2 * (F.col(f"s{k}") + F.col(f"_bs{k}")) for k in range(len(labels))]
    a = sum(to[1:], to[0])
    apart = [F.abs(t - float(y)) for y in labels]
    b = sum((F.col(f"_ac{k}") * d for k, d in enumerate(apart[1:], 1)), F.col("_ac0") * apart[0])
    ab, bb = sum((d * e for d, e in zip(to[1:], apart[1:], strict=True)), to[0] * apart[0]), sum((F.col(f"_ac{k}") * d * d for k, d in enumerate(apart[1:], 1)), F.col("_ac0") * apart[0] * apart[0])
    sums = j.groupBy(by).agg(F.max(n).alias("n"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"), F.sum(a * b).alias("ab"), F.sum(ab).alias("xy"), F.sum(bb).alias("yy"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"))
    n = F.col("n")
    cov = lambda pairs, p, q, pq: pairs / (n * n) + F.col(p) * F.col(q) / F.pow(n, F.lit(4)) - 2 * F.col(pq) / F.pow(n, F.lit(3))
    cxy, cxx, cyy = cov(F.col("xy"), "a", "b", "ab"), cov(2 * n * F.col("sxx") - 2 * F.col("sx") * F.col("sx"), "a", "a", "aa"), cov(F.col("yy"), "b", "b", "bb")
    return sums.select(by, F.when((cxx > 0) & (cyy > 0), F.sqrt(F.greatest(cxy, F.lit(0.0)) / F.sqrt(cxx * cyy))).otherwise(0.0).alias("value"))


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """From doubly centred distance matrices."""
    x, y = (np.asarray(v, float).reshape(len(v), -1) for v in (x, y))

    def centred(v):
        d = np.sqrt(np.maximum(((v[:, None] - v[None]) ** 2).sum(-1), 0))
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    a, b = centred(x), centred(y)
    cov, va, vb = (a * b).mean(), (a * a).mean(), (b * b).mean()
    return float(np.sqrt(max(cov, 0) / np.sqrt(va * vb))) if va * vb > 0 else 0.0


def mutual_information(x: np.ndarray, y: np.ndarray, grid: int = 64) -> float:
    """Mutual information of a feature and class labels by kernel density estimates."""
    x = np.asarray(x, float)
    s = x.std() or 1.0
    at = np.linspace(x.min() - 3 * s, x.max() + 3 * s, grid)
    step = at[1] - at[0]

    def entropy(v):
        h = max(1.06 * (v.std() or s) * len(v) ** -0.2, 1e-12)
        p = np.exp(-0.5 * ((at[:, None] - v[None]) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi))
        p = p[p > 0]
        return -float((p * np.log(p)).sum() * step)

    return entropy(x) - sum(np.mean(y == c) * entropy(x[y == c]) for c in np.unique(y))


# --- dissimilarity structure -----------------------------------------------
def group_means(df: DataFrame, by: list[str], values: str = "features") -> DataFrame:
    """Mean array per group."""
    cells = df.select(*by, F.posexplode(values).alias("_f", "_v")).groupBy(*by, "_f").agg(F.avg("_v").alias("_m"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_f", "_m"))), lambda c: c["_m"]).alias(values))


def pdist(df: DataFrame, key: str, fx, values: str = "features", block: list[str] | None = None, centre: bool = False) -> DataFrame:
    """Condensed dissimilarities (id_a < id_b) of a table of conditions."""
    if centre:
        mean = group_means(df.withColumn("_all", F.lit(1)), ["_all"], values).select(F.col(values).alias("_m"))
        df = df.withColumn("_m", mean.scalar()).withColumn(values, F.zip_with(values, "_m", lambda x, m: x - m)).drop("_m")
    return pairwise(df, df, key, values, fx, block, symmetric=True)


def cdist(train: DataFrame, test: DataFrame, group: str, fx, values: str = "features") -> DataFrame:
    """Distances of all pairs of group means of two datasets."""
    return pairwise(group_means(train, [group], values), group_means(test, [group], values), group, values, fx)


def dsm_correlation(dsm: DataFrame, on: DataFrame, by: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """Correlation of a dissimilarity table with another one (columns id_a, id_b, value / target), by ``by``."""
    by = by or []
    j = dsm.join(on, ["id_a", "id_b"])
    if method == "spearman":
        j = ranks(ranks(j, by, "value", "value_rank"), by, "target", "target_rank")
        return j.groupBy(*by).agg(correlation("value_rank", "target_rank").alias("rho"))
    return j.groupBy(*by).agg(correlation("value", "target").alias("rho"))


def dsm_consistency(dsm: DataFrame, chunk: str, method: str = "pearson") -> DataFrame:
    """Correlation of the chunks' dissimilarities, for each pair of chunks."""
    d = ranks(dsm, [chunk], "value", "value") if method == "spearman" else dsm
    a, b = d.select(F.col(chunk).alias("chunk_a"), "id_a", "id_b", F.col("value").alias("va")), d.select(F.col(chunk).alias("chunk_b"), "id_a", "id_b", F.col("value").alias("vb"))
    return a.join(b, ["id_a", "id_b"]).where("chunk_a < chunk_b").groupBy("chunk_a", "chunk_b").agg(correlation("va", "vb").alias("r"))


def gram(df: DataFrame, columns: list[str | Column], by: list[str] | None = None, intercept: bool = True) -> DataFrame:
    """Sums of products of all pairs of columns, as one aggregate: the sufficient statistics of linear models."""
    xs = ([F.lit(1.0)] if intercept else []) + [F.col(c).cast("double") if isinstance(c, str) else c for c in columns]
    sums = F.array(*(F.sum(xs[i] * xs[j]) for i in range(len(xs)) for j in range(i, len(xs))))
    return df.groupBy(*(by or [])).agg(sums.alias("sums"), F.count("*").alias("n"))


def symmetric(sums, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = sums
    return out + np.triu(out, 1).T


def linear_regression(df: DataFrame, xs: list[str], y: str, by: list[str] | None = None, ridge: float = 0.0, standard: bool = False) -> DataFrame:
    """Coefficients (by, name, beta, t, p) of least squares per group, from sums of products.

    ``ridge`` is added to the diagonal except the intercept's; ``standard`` gives
    coefficients of standardised columns.
    """
    by = by or []
    names = ["intercept", *xs]
    k = len(names) + 1
    schema = ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in by), "name string", "beta double", "t double", "p double"])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = symmetric(r.sums, k)
                a, b, n = g[:-1, :-1], g[:-1, -1], r.n
                if standard:
                    mean = g[0] / n
                    sd = np.sqrt(np.maximum(np.diag(g) / n - mean**2, 0))
                    sd[0] = 1
                    sd[sd == 0] = 1
                    c = (g / n - np.outer(mean, mean)) / np.outer(sd, sd)
                    c[0, :] = c[:, 0] = 0
                    c[0, 0] = 1
                    a, b = c[:-1, :-1] * n, c[:-1, -1] * n
                penalty = np.eye(len(a)) * ridge
                penalty[0, 0] = 0
                inv = np.linalg.pinv(a + penalty)
                beta = inv @ b
                yy = n if standard else g[-1, -1]
                df_ = n - np.linalg.matrix_rank(a)
                s2 = max(yy - beta @ b, 0) / df_ if df_ > 0 else np.nan
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = beta / np.sqrt(s2 * np.diag(inv))
                p = np.where(np.isnan(t), np.nan, 2 * t_sf(np.abs(np.nan_to_num(t)), max(df_, 1)))
                rows += [(*[getattr(r, c) for c in by], nm, *map(float, v)) for nm, v in zip(names, zip(beta, t, p, strict=True), strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "name", "beta", "t", "p"])

    return gram(df, [*xs, y], by).mapInPandas(solve, schema)


# --- relevance -------------------------------------------------------------
def irelief(x: np.ndarray, labels: np.ndarray, width: float = 1.0, threshold: float = 1e-2, most: int = 100) -> np.ndarray:
    """Feature weights by iterated expectation of nearest hits and misses."""
    n, f = x.shape
    w = np.ones(f) / f
    d = np.abs(x[:, None] - x[None])
    same = labels[:, None] == labels[None]
    own = np.eye(n, dtype=bool)
    for _ in range(most):
        dist = d @ w
        # equal samples have no weight, or the iteration would not converge
        k = np.where(dist < 1e-15, 0, np.exp(-dist / width))
        miss, hit = np.where(same, 0, k), np.where(same & ~own, k, 0)
        pm, ph = miss / np.maximum(miss.sum(1, keepdims=True), 1e-300), hit / np.maximum(hit.sum(1, keepdims=True), 1e-300)
        out = 1 - miss.sum(1) / np.maximum((k - np.where(own, k, 0)).sum(1), 1e-300)
        nu = (out[:, None] * (np.einsum("ij,ijf->if", pm, d) - np.einsum("ij,ijf->if", ph, d))).mean(0)
        new = np.maximum(nu, 0)
        new = new / (np.linalg.norm(new) or 1)
        done = np.abs(new - w).sum() < threshold
        w = new
        if done:
            break
    return w


def irelief_online(x: np.ndarray, labels: np.ndarray, a: float = 10.0, width: float = 1.0, rounds: int = 3, seed: int = 0) -> np.ndarray:
    """The stochastic form: one sample at a time, with learning rate 1 / (a t + 1)."""
    n, f = x.shape
    w, pi, t = np.ones(f) / f, np.zeros(f), 0
    for _ in range(rounds):
        for i in np.random.default_rng(seed).permutation(n):
            t += 1
            d = np.abs(x - x[i])
            dist = d @ w
            k = np.where(dist < 1e-15, 0, np.exp(-dist / width))
            miss, hit = np.where(labels == labels[i], 0, k), np.where(labels == labels[i], k, 0)
            part = (miss / max(miss.sum(), 1e-300)) @ d - (hit / max(hit.sum(), 1e-300)) @ d
            pi = pi + (part * (1 - miss.sum() / max(k.sum(), 1e-300)) - pi) / (a * t + 1)
            w = np.maximum(pi, 0)
            w = w / (np.linalg.norm(w) or 1)
    return w


def bounded_sample(df: DataFrame, key: str, most: int) -> pd.DataFrame:
    """At most ``most`` rows, drawn by hash of the key: what iterative fits on one machine see."""
    return df.withColumn("_h", F.xxhash64(F.col(key))).orderBy("_h", key).limit(most).drop("_h").toPandas()


def irelief_weights(df: DataFrame, label: str, queries: Column | None = None, values: str = "features", key: str = "sample_id", width: float = 1.0, threshold: float = 1e-2, rounds: int = 100, block: int = 2048) -> DataFrame:
    """(feature_id, weight) by iterated relief: the stated ``queries`` (all rows if not given) against all rows.

    In each round every partition sums, for each query, the weights of its
    misses and hits and their weighted differences; the sums are added up by
    Spark and only they travel. Queries go in blocks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_k"), F.col(label).alias("_y"), F.col(values).alias("_x"))
    asked = (df if queries is None else df.where(queries)).select(F.col(key).alias("_k"), F.col(label).alias("_y"), F.col(values).alias("_x"))
    parts = max(1, -(-asked.count() // block))
    f = int(rows.select(F.size("_x")).first()[0])
    w = np.ones(f) / f
    for _ in range(rounds):
        nu, n = np.zeros(f), 0
        for b in range(parts):
            few = asked.where(F.pmod(F.xxhash64("_k"), F.lit(parts)) == b).orderBy("_k").toPandas()
            if not len(few):
                continue
            q, qk, qy = np.array(few["_x"].tolist(), float), few["_k"].to_numpy(), few["_y"].to_numpy()

            def run(batches, q=q, qk=qk, qy=qy, w=w):
                total = np.zeros((len(q), 2 * f + 2))
                for pdf in batches:
                    x, k, y = np.array(pdf["_x"].tolist(), float), pdf["_k"].to_numpy(), pdf["_y"].to_numpy()
                    for i in range(len(q)):
                        d = np.abs(x - q[i])
                        dist = d @ w
                        # equal samples have no weight, or the iteration would not converge
                        near = np.where((dist < 1e-15) | (k == qk[i]), 0, np.exp(-dist / width))
                        hit = near * (y == qy[i])
                        miss = near - hit
                        total[i] += np.concatenate([[miss.sum(), hit.sum()], miss @ d, hit @ d])
                yield pd.DataFrame({"i": np.arange(len(q)), "v": total.tolist()})

            sums = rows.mapInPandas(run, "i int, v array<double>").select("i", F.posexplode("v").alias("c", "v")).groupBy("i", "c").agg(F.sum("v").alias("v")).toPandas()
            t = sums.pivot(index="i", columns="c", values="v").sort_index().to_numpy()
            miss, hit = t[:, :1], t[:, 1:2]
            out = 1 - miss / np.maximum(miss + hit, 1e-300)
            nu += (out * (t[:, 2 : f + 2] / np.maximum(miss, 1e-300) - t[:, f + 2 :] / np.maximum(hit, 1e-300))).sum(0)
            n += len(q)
        new = np.maximum(nu / max(n, 1), 0)
        new = new / (np.linalg.norm(new) or 1)
        done, w = np.abs(new - w).sum() < threshold, new
        if done:
            break
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "feature_id int, weight double")


def noise_sensitivity(long: DataFrame, measure: Callable[[DataFrame], DataFrame], scale: float = 1.0, seed: int = 0) -> DataFrame:
    """Change of a measure (a function giving (target_feature, value)) when noise is added to one feature at a time.

    The noisy copies are a fan-out by feature: each carries its own feature's
    values with noise, keyed, in one plan; the measure must be additive over
    features so that the others need no copy.
    """
    clean = measure(long.withColumn("target_feature", F.col("feature_id"))).withColumnRenamed("value", "_clean")
    noisy = measure(long.withColumn("target_feature", F.col("feature_id")).withColumn("value", F.col("value") + scale * F.randn(seed)))
    return noisy.join(clean, "target_feature").select(F.col("target_feature").alias("feature_id"), (F.col("value") - F.col("_clean")).alias("sensitivity"))
