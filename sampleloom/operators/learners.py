"""Learning and prediction as plans: fold-keyed training, prediction by join, cross-validation in one job."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.functions.models import Model, fit_sums
from sampleloom.operators.generators import uniques
from sampleloom.operators.measures import gram, symmetric

LOG_2PI = float(np.log(2 * np.pi))


def fold_roles(df: DataFrame, chunk: str, folds: list) -> DataFrame:
    """Each row once per fold, with ``fold`` and whether it is held out (``test``)."""
    return df.select("*", F.explode(F.array(*map(F.lit, folds))).alias("fold")).withColumn("test", F.col(chunk) == F.col("fold"))


def gnb_model(long: DataFrame, target: str, chunk: str, labels: list, prior: str = "laplacian_smoothing") -> tuple[DataFrame, DataFrame]:
    """Models of naive Bayes for each held-out chunk: (fold, feature_id, m0, v0, m1, v1, ...) and (fold, lp0, lp1, ...).

    Sums per (chunk, class, feature) are taken once; a fold's statistics are the
    total less those of its own chunk, so nothing is fanned out by fold. Classes
    are columns, in order of ``labels``.
    """
    x, t = F.col("value"), F.col(target)
    sums = long.groupBy(F.col(chunk).alias("fold"), "feature_id").agg(*(c for i, y in enumerate(labels) for c in (
        F.coalesce(F.sum(F.when(t == F.lit(y), 1.0)), F.lit(0.0)).alias(f"n{i}"),
        F.coalesce(F.avg(F.when(t == F.lit(y), x)), F.lit(0.0)).alias(f"m{i}"),
        F.coalesce(F.var_pop(F.when(t == F.lit(y), x)), F.lit(0.0)).alias(f"v{i}"),
    )))
    # chunks x features rows
    every = W.partitionBy("feature_id")
    out, sizes = [], []
    for i in range(len(labels)):
        n, m, v = F.col(f"n{i}"), F.col(f"m{i}"), F.col(f"v{i}")
        rest = F.sum(n).over(every) - n
        mean = F.try_divide(F.sum(n * m).over(every) - n * m, rest)
        square = F.try_divide(F.sum(n * (v + m * m)).over(every) - n * (v + m * m), rest)
        sizes.append(rest.alias(f"n{i}"))
        out += [mean.alias(f"m{i}"), F.greatest(square - mean * mean, F.lit(0.0)).alias(f"v{i}")]
    wide = sums.select("fold", "feature_id", *out, *sizes)
    model = wide.select("fold", "feature_id", *(c for i in range(len(labels)) for c in (f"m{i}", f"v{i}")))
    have = [F.col(f"n{i}") for i in range(len(labels))]
    total = sum(have[1:], have[0])
    k = sum(((h > 0).cast("double") for h in have[1:]), (have[0] > 0).cast("double"))
    p = {"laplacian_smoothing": lambda h: (1 + h) / (total + k), "uniform": lambda h: 1 / k, "ratio": lambda h: h / total}[prior]
    counts = wide.groupBy("fold").agg(*(F.max(f"n{i}").alias(f"n{i}") for i in range(len(labels))))
    return model, counts.select("fold", *(F.when(h > 0, F.ln(p(h))).alias(f"lp{i}") for i, h in enumerate(have)))


def gnb_terms(labels: list) -> list:
    """Log probability of ``value`` for each class; without variance it is 0 where the mean is met exactly, else minus infinity."""
    out = []
    for i in range(len(labels)):
        d, v = F.col("value") - F.col(f"m{i}"), F.col(f"v{i}")
        out.append(F.when(v == 0, F.when(d == 0, 0.0).otherwise(float("-inf"))).otherwise(-0.5 * (LOG_2PI + F.ln(v) + d * d / v)).alias(f"s{i}"))
    return out


def best_label(labels: list) -> object:
    """The label with the highest score s + lp, of equals the larger."""
    each = [F.struct((F.col(f"s{i}") + F.col(f"lp{i}")).alias("s"), F.lit(x).alias("label")) for i, x in enumerate(labels)]
    return (F.greatest(*each) if len(each) > 1 else each[0])["label"]


def gnb_folds(long: DataFrame, target: str, chunk: str, prior: str = "laplacian_smoothing", labels: list | None = None) -> DataFrame:
    """Gaussian naive Bayes, leaving out one chunk at a time: (fold, sample_id, target, prediction).

    ``long`` has sample_id, target, chunk, feature_id, value. Each sample meets
    only its own fold's model. Population variances.
    """
    labels = labels or uniques(long, target)
    model, priors = gnb_model(long, target, chunk, labels, prior)
    hit = long.select("sample_id", F.col(target).alias("target"), F.col(chunk).alias("fold"), "feature_id", "value").join(model, ["fold", "feature_id"])
    terms = hit.select("fold", "sample_id", "target", *gnb_terms(labels))
    scores = terms.groupBy("fold", "sample_id", "target").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(labels))))
    return scores.join(F.broadcast(priors), "fold").select("fold", "sample_id", "target", best_label(labels).alias("prediction"))


def wide_gnb_folds(df: DataFrame, key: str, features: list[str], target: str, chunk: str, labels: list | None = None, by: list[str] | None = None) -> DataFrame:
    """The same on a wide table: the models, one row a fold, meet each row by one join and the scores are one compiled projection.

    ``by`` names further keys, such as the repetition of a permutation: models
    and predictions are then made for each, in the same plan.
    """
    by = by or []
    labels = labels or uniques(df, target)
    stats = [f(F.col(c)).alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("m", F.avg), ("v", F.var_pop))]
    cells = df.groupBy(*by, F.col(chunk).alias("fold"), target).agg(F.count("*").cast("double").alias("n"), *stats)
    flat = []
    for j, x in enumerate(labels):
        of = lambda c, x=x: F.coalesce(F.sum(F.when(F.col(target) == F.lit(x), c)), F.lit(0.0))
        flat.append(of(F.col("n")).alias(f"n{j}"))
        for i in range(len(features)):
            m, v = F.col(f"m{i}"), F.col(f"v{i}")
            flat += [of(F.col("n") * m).alias(f"s{i}_{j}"), of(F.col("n") * (v + m * m)).alias(f"q{i}_{j}")]
    # one row a fold: a model is the total less its own chunk
    every = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    wide = cells.groupBy(*by, "fold").agg(*flat)
    less = lambda c: F.sum(c).over(every) - F.col(c)
    merged = [c for j in range(len(labels)) for c in (less(f"n{j}").alias(f"n{j}"), *(F.try_divide(less(f"{k}{i}_{j}"), less(f"n{j}")).alias(f"{n}{i}_{j}") for i in range(len(features)) for k, n in (("s", "m"), ("q", "q"))))]
    model = wide.select(*by, "fold", *merged)
    have = [F.col(f"n{j}") for j in range(len(labels))]
    total, k = sum(have[1:], have[0]), sum(((h > 0).cast("double") for h in have[1:]), (have[0] > 0).cast("double"))
    out = []
    for j in range(len(labels)):
        var = [F.col(f"q{i}_{j}") - F.col(f"m{i}_{j}") * F.col(f"m{i}_{j}") for i in range(len(features))]
        const = F.ln((1 + have[j]) / (total + k)) - 0.5 * sum((LOG_2PI + F.ln(v) for v in var[1:]), LOG_2PI + F.ln(var[0]))
        out += [F.when(have[j] > 0, const).alias(f"c{j}"), *((-0.5 / v).alias(f"w{i}_{j}") for i, v in enumerate(var)), *(F.col(f"m{i}_{j}") for i in range(len(features)))]
    j_ = df.withColumn("fold", F.col(chunk)).join(F.broadcast(model.select(*by, "fold", *out)), [*by, "fold"])

    def score(j: int):
        s = F.col(f"c{j}")
        for i, f in enumerate(features):
            d = F.col(f) - F.col(f"m{i}_{j}")
            s = s + F.col(f"w{i}_{j}") * d * d
        return F.struct(s.alias("s"), F.lit(labels[j]).alias("label"))

    best = F.greatest(*(score(j) for j in range(len(labels)))) if len(labels) > 1 else score(0)
    return j_.select(*by, "fold", F.col(key).alias("sample_id"), F.col(target).alias("target"), best["label"].alias("prediction"))


def nearest_mean(df: DataFrame, means: DataFrame, label: str, values: str = "features") -> DataFrame:
    """Prediction by the nearest class mean (a bounded table: classes x features)."""
    table = means.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("label"), F.col(values).alias("m")))).alias("_means"))
    j = df.withColumn("_means", table.scalar())
    d = F.transform("_means", lambda c: F.struct(F.aggregate(F.zip_with(F.col(values), c["m"], lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x).alias("d"), c["label"].alias("label")))
    return j.withColumn("prediction", F.array_min(d)["label"]).drop("_means")


def neighbours(train: DataFrame, queries: DataFrame, k: int, key: str = "sample_id", values: str = "features", label: str = "target", block: int = 4096, exclude: str | None = None) -> DataFrame:
    """The ``k`` nearest training rows of each query: (query_id, train_id, label, dist, rank), exact.

    The stated queries go in blocks of bounded size against all training rows:
    each training partition keeps the k nearest of each query, so what is
    shuffled is k rows a query and partition, and no pair beyond that exists.
    ``exclude`` names a column (such as a chunk) on which query and neighbour
    must differ.
    """
    keep = [exclude] if exclude else []
    kind = dict(train.dtypes)[label]
    schema = f"query_id long, train_id long, label {kind}, dist double"
    n = queries.count()
    parts = max(1, -(-n // block))
    out = None
    for b in range(parts):
        rows = queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == b).select(key, values, *keep).orderBy(key).toPandas()
        if not len(rows):
            continue
        q = np.array(rows[values].tolist(), float)
        ids, groups = rows[key].to_numpy(), rows[exclude].to_numpy() if exclude else None
        norm = (q * q).sum(1)

        def run(batches, q=q, ids=ids, groups=groups, norm=norm):
            best: pd.DataFrame | None = None
            for pdf in batches:
                x = np.array(pdf[values].tolist(), float)
                d = np.maximum(norm[:, None] + (x * x).sum(1)[None] - 2 * q @ x.T, 0)
                if groups is not None:
                    d[groups[:, None] == pdf[exclude].to_numpy()[None]] = np.inf
                m = min(k + 8, d.shape[1])
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                who = np.repeat(np.arange(len(q)), m)
                near = near.ravel()
                # exact differences for the few that matter: the expansion above rounds
                exact = ((q[who] - x[near]) ** 2).sum(1)
                exact[np.isinf(d[who, near])] = np.inf
                part = pd.DataFrame({"query_id": ids[who], "train_id": pdf[key].to_numpy()[near], "label": pdf[label].to_numpy()[near], "dist": exact})
                part = part[np.isfinite(part["dist"])]
                best = part if best is None else pd.concat([best, part])
                best = best.sort_values(["query_id", "dist", "train_id"]).groupby("query_id").head(k)
            if best is not None:
                yield best

        found = train.select(key, values, label, *keep).mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = train.sparkSession.createDataFrame([], schema)
    w = W.partitionBy("query_id").orderBy("dist", "train_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_predict(near: DataFrame, weighted: bool = False) -> DataFrame:
    """Votes of the neighbours; of equal classes the one nearest on average, then the smaller label.

    ``weighted`` votes count by nearness: each by the share of all neighbours'
    distances that is not its own.
    """
    if weighted:
        whole = F.sum("dist").over(W.partitionBy("query_id"))
        near = near.withColumn("_v", F.coalesce(1 - F.try_divide("dist", whole), F.lit(1.0)))
    count = F.sum("_v") if weighted else F.count("*")
    votes = near.groupBy("query_id", "label").agg(count.alias("votes"), F.avg("dist").alias("mean_dist"))
    best = F.min_by("label", F.struct(-F.col("votes"), F.col("mean_dist"), F.col("label")))
    return votes.groupBy("query_id").agg(best.alias("prediction"))


def vote(df: DataFrame, key: str, prediction: str) -> DataFrame:
    """Majority of member predictions; ties give the smallest label."""
    n = df.groupBy(key, prediction).agg(F.count("*").alias("_n"))
    return n.groupBy(key).agg(F.min_by(prediction, F.struct(-F.col("_n"), F.col(prediction))).alias("prediction"))


def ridge(df: DataFrame, features: list[str], y: str, lm: float | None = None, by: list[str] | None = None) -> DataFrame:
    """Coefficients (by, name, beta): the penalty is lm squared, the intercept free; from sums of products."""
    by = by or []
    lm = 0.05 * len(features) if lm is None else lm
    k = len(features) + 2
    schema = ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in by), "name string, beta double"])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = symmetric(r.sums, k)
                a = g[:-1, :-1] + np.diag([0.0] + [lm * lm] * len(features))
                beta = np.linalg.pinv(a) @ g[:-1, -1]
                rows += [(*[getattr(r, c) for c in by], n, float(b)) for n, b in zip(["intercept", *features], beta, strict=True)]
            yield pd.DataFrame(rows, columns=[*by, "name", "beta"])

    return gram(df, [*features, y], by).mapInPandas(solve, schema)


def discriminant(df: DataFrame, features: list[str], target: str, quadratic: bool = False, by: list[str] | None = None) -> DataFrame:
    """Models (by, model) of linear or quadratic discriminants, from sums of products per class: no class is gathered."""
    by = by or []
    from sampleloom.functions.models import LDA

    k = len(features) + 1
    sums = gram(df, features, [*by, target])
    grouped = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(target).alias("label"), "n", "sums"))).alias("classes"))
    schema = ", ".join([*(f"{c} {dict(df.dtypes)[c]}" for c in by), "model binary"])

    def solve(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                g = [symmetric(c["sums"], k) for c in r.classes]
                n = np.array([c["n"] for c in r.classes], float)
                means = np.array([x[0, 1:] / c for x, c in zip(g, n, strict=True)])
                covs = [x[1:, 1:] / c - np.outer(u, u) for x, c, u in zip(g, n, means, strict=True)]
                m = LDA(quadratic).fit_classes(np.array([c["label"] for c in r.classes]), n, means, covs)
                rows.append((*[getattr(r, c) for c in by], pickle.dumps(m)))
            yield pd.DataFrame(rows, columns=[*by, "model"])

    return grouped.mapInPandas(solve, schema)


def fit_folds(df: DataFrame, make: Callable[[], Model], target: str, chunk: str, values: str = "features", key: str = "sample_id", most: int = 2000) -> DataFrame:
    """(fold, model): a model per held-out chunk, each fitted in one task on a bounded sample.

    ``most`` bounds the training rows of a fold: those with the smallest hashes.
    Which rows they are doesn't depend on how the data lie.
    """
    folds = F.array(*map(F.lit, uniques(df, chunk)))
    # the bounded sample is drawn per chunk before the fan-out, so that fold copies stay small
    w = W.partitionBy(chunk).orderBy(F.xxhash64(key), key)
    drawn = df.select(key, chunk, target, values).withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most)
    train = drawn.select("*", F.explode(F.filter(folds, lambda f: f != F.col(chunk))).alias("fold"))
    kind = dict(df.dtypes)[chunk]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_i", key]).head(most).sort_values(key)
        model = make().fit(np.array(pdf[values].tolist(), float), pdf[target].to_numpy())
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "model": [pickle.dumps(model)]})

    return train.groupBy("fold").applyInPandas(fit, f"fold {kind}, model binary")


def moments_by(df: DataFrame, keys: list[str], values: str | Column) -> dict[tuple, tuple[int, np.ndarray, np.ndarray]]:
    """For each combination of ``keys``: number, mean and scatter matrix of the arrays in ``values``, over all rows.

    Partitions give sums and products, which Spark adds up; what the driver sees
    is of the size of keys x features squared.
    """
    types = dict(df.dtypes)

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for k, part in pdf.groupby(keys, dropna=False):
                x = np.array(part["_x"].tolist(), float)
                row = np.concatenate([[len(x)], x.sum(0), (x.T @ x)[np.triu_indices(x.shape[1])]])
                sums[k] = row + sums[k] if k in sums else row
        if sums:
            yield pd.DataFrame([(*k, v.tolist()) for k, v in sums.items()], columns=[*keys, "x"])

    parts = df.select(*keys, (F.col(values) if isinstance(values, str) else values).alias("_x")).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "x array<double>"]))
    cells = parts.select(*keys, F.posexplode("x").alias("_i", "_v")).groupBy(*keys, "_i").agg(F.sum("_v").alias("_v")).toPandas()
    out = {}
    for k, part in cells.groupby(keys):
        v = part.sort_values("_i")["_v"].to_numpy()
        f = int((np.sqrt(8 * len(v) + 1) - 3) / 2)
        mean = v[1 : f + 1] / v[0]
        out[tuple(k)] = (int(v[0]), mean, symmetric(v[f + 1 :], f) - v[0] * np.outer(mean, mean))
    return out


def _added(parts: list[tuple]) -> tuple[int, np.ndarray, np.ndarray]:
    """Moments of several parts together."""
    n = sum(p[0] for p in parts)
    mean = sum(p[0] * p[1] for p in parts) / n
    return n, mean, sum(p[2] + p[0] * np.outer(p[1] - mean, p[1] - mean) for p in parts)


def fit_folds_exactly(df: DataFrame, make: Callable[[], Model], target: str, chunk: str, values: str = "features") -> dict:
    """A model for each held-out chunk, of models that sums over all rows settle: no row is left out and none travels."""
    out = {}
    if make().sums == "classes":
        parts = moments_by(df, [chunk, target], values)
        for fold in sorted({k[0] for k in parts}):
            labels = sorted({k[1] for k in parts if k[0] != fold})
            each = [_added([p for k, p in parts.items() if k[0] != fold and k[1] == y]) for y in labels]
            n = np.array([e[0] for e in each], float)
            out[fold] = make().fit_classes(np.array(labels), n, np.array([e[1] for e in each]), [e[2] / e[0] for e in each])
        return out
    parts = moments_by(df, [chunk], F.concat(values, F.array(F.col(target).cast("double"))))
    for (fold,) in sorted(parts):
        out[fold] = fit_sums(make(), *_added([p for k, p in parts.items() if k[0] != fold]))
    return out


def predict_folds(df: DataFrame, models: DataFrame | dict, target: str, chunk: str, values: str = "features", key: str = "sample_id", kind: str | None = None) -> DataFrame:
    """(fold, sample_id, target, prediction) of every row by the model that has not seen its chunk.

    The models, one a chunk and each of bounded size, are broadcast; no row carries one.
    """
    kind, types = kind or dict(df.dtypes)[target], dict(df.dtypes)
    if isinstance(models, DataFrame):
        models = {r["fold"]: pickle.loads(r["model"]) for r in models.collect()}
    known = df.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for pdf in batches:
            for fold, part in pdf.groupby(chunk):
                if fold in known.value:
                    p = known.value[fold].predict(np.array(part[values].tolist(), float))
                    yield pd.DataFrame({"fold": part[chunk].to_numpy(), "sample_id": part[key].to_numpy(), "target": part[target].to_numpy(), "prediction": p})

    return df.select(key, chunk, target, values).mapInPandas(run, f"fold {types[chunk]}, sample_id {types[key]}, target {types[target]}, prediction {kind}")


def cross_validate(df: DataFrame, make: Callable[[], Model], target: str, chunk: str, errors: dict, **kwargs) -> DataFrame:
    """Errors per fold: train on all other chunks, predict the held-out one. ``errors`` maps names to aggregates of (p, t).

    Models that sums settle are fitted to all rows, the others as :func:`fit_folds` says.
    """
    kind = "double" if make().regression else None
    models = fit_folds_exactly(df, make, target, chunk, kwargs.get("values", "features")) if make().sums else fit_folds(df, make, target, chunk, **kwargs)
    predicted = predict_folds(df, models, target, chunk, kind=kind)
    return predicted.groupBy("fold").agg(*(f("prediction", "target").alias(n) for n, f in errors.items()))


# --- sensitivities -----------------------------------------------------------
def sensitivities(models: DataFrame) -> DataFrame:
    """(fold, component, feature_id, weight) of fitted models that have weights; others raise."""

    def run(batches):
        for pdf in batches:
            rows = []
            for fold, raw in zip(pdf["fold"], pdf["model"], strict=True):
                m = pickle.loads(raw)
                w = np.asarray(m.weights, float)
                # one row a component: a class, a pair of classes, or the regression itself
                w = w[None] if w.ndim == 1 else w.T if type(m).__name__ == "SMLR" else w
                rows += [(fold, c, f, float(v)) for c, row in enumerate(w) for f, v in enumerate(row)]
            yield pd.DataFrame(rows, columns=["fold", "component", "feature_id", "weight"])

    return models.mapInPandas(run, f"fold {dict(models.dtypes)['fold']}, component int, feature_id int, weight double")


def gnb_weights(long: DataFrame, target: str) -> DataFrame:
    """(label_a, label_b, feature_id, weight) of common-variance naive Bayes: (mean_b - mean_a) / variance, for each pair of classes."""
    cells = long.groupBy(target, "feature_id").agg(F.count("*").cast("double").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    common = cells.groupBy("feature_id").agg((F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("var"))
    a, b = cells.select(F.col(target).alias("label_a"), "feature_id", F.col("m").alias("ma")), cells.select(F.col(target).alias("label_b"), "feature_id", F.col("m").alias("mb"))
    # classes x features, not samples
    pairs = a.join(b, "feature_id").where("label_a < label_b").join(common, "feature_id")
    return pairs.select("label_a", "label_b", "feature_id", F.try_divide(F.col("mb") - F.col("ma"), F.col("var")).alias("weight"))


def binary_labels(sensitivity: DataFrame, labels: list) -> DataFrame:
    """Components of one-against-one models named by their pair of labels."""
    pairs = [(i, a, b) for i, (a, b) in enumerate((x, y) for k, x in enumerate(labels) for y in labels[k + 1 :])]
    names = F.create_map(*(F.lit(v) for i, a, b in pairs for v in (i, f"{a}|{b}")))
    return sensitivity.withColumn("pair", names[F.col("component")])
