"""Whole analyses from the operators: permutation tests, cluster thresholds, event models, preprocessing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.functions.distance import pairwise
from sampleloom.operators import errors as er
from sampleloom.operators import generators as ge
from sampleloom.operators import inference as inf
from sampleloom.operators import learners as le
from sampleloom.operators import measures as me
from sampleloom.operators import neighborhood as ne
from sampleloom.operators import ordered as od
from sampleloom.operators import select as se
from sampleloom.operators.choose import ranks
from sampleloom.session import materialised


def repeated_measure(df: DataFrame, generator: Callable[[DataFrame], DataFrame], measure: Callable[[DataFrame, list[str]], DataFrame], key: str, callback: Callable[[DataFrame, DataFrame], None] | None = None) -> DataFrame:
    """A measure on every dataset that a generator makes: one plan keyed by the generator's column.

    ``callback`` is called with what was generated and the results, keyed alike.
    """
    made = generator(df)
    out = measure(made, [key])
    if callback:
        callback(made, out)
    return out


def combined_scores(parts: list[DataFrame], combine=F.avg, by: str = "feature_id", value: str = "value") -> DataFrame:
    """Scores of several measures (by, value) put together by an aggregate."""
    every = parts[0].select(by, value)
    for p in parts[1:]:
        every = every.unionByName(p.select(by, value))
    return every.groupBy(by).agg(combine(value).alias(value))


def static_measure(spark, rows: list[tuple], schema: str) -> Callable[..., DataFrame]:
    """A measure whose results are given: whatever it is called with, it returns them."""
    return lambda *_: spark.createDataFrame(rows, schema)


def proxy_measure(measure: Callable[[DataFrame], DataFrame], before: Callable[[DataFrame], DataFrame] = lambda x: x, after: Callable[[DataFrame], DataFrame] = lambda x: x) -> Callable[[DataFrame], DataFrame]:
    """A measure behind steps before and after it."""
    return lambda df: after(measure(before(df)))


def transfer(train: DataFrame, test: DataFrame, fit: Callable[[DataFrame], DataFrame], apply: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """A measure trained on one dataset and called on another; an empty side raises."""
    if train.isEmpty() or test.isEmpty():
        raise ValueError("nothing to train on or to measure")
    return apply(fit(train), test)


def permutation_test(df: DataFrame, key: str, features: list[str], target: str, chunk: str, count: int = 20, seed: int = 0, tail: str = "left") -> DataFrame:
    """Cross-validated error of naive Bayes and its probability under permuted targets: (error, p).

    Targets are permuted within chunks; true and permuted labels, all folds and
    repetitions are keys of one plan.
    """
    few = df.select(key, *features, target, chunk)
    null = ge.permute(few, [target], key, [chunk], count, seed).withColumn("rep", F.col("rep") + 1)
    every = few.withColumn("rep", F.lit(0)).unionByName(null)
    predicted = le.wide_gnb_folds(every, key, features, target, chunk, ge.uniques(few, target), ["rep"])
    error = materialised(predicted.groupBy("rep").agg(er.mean_mismatch("prediction", "target").alias("value")).withColumn("element", F.lit(0)))
    observed = error.where("rep = 0").select("element", "value")
    p = inf.null_probability(observed, error.where("rep > 0").select("element", "value"), ["element"], tail=tail)
    return p.select(F.col("value").alias("error"), "p")


def balanced_cv(df: DataFrame, key: str, features: list[str], target: str, chunk: str, repetitions: int = 5, seed: int = 0) -> DataFrame:
    """Error per repetition and fold, each repetition on a balanced draw of every chunk."""
    drawn = ge.balance(df.select(key, *features, target, chunk), target, key, "equal", [chunk], repetitions, seed, apply=True)
    predicted = le.wide_gnb_folds(drawn, key, features, target, chunk, ge.uniques(df, target), ["rep"])
    return predicted.groupBy("rep", "fold").agg(er.mean_mismatch("prediction", "target").alias("error"))


def cluster_threshold(observed: DataFrame, maps: DataFrame, chunk: str, grid: DataFrame, coords: list[str], draws: int = 100, p: float = 0.05, seed: int = 0, correction: str = "fdr") -> DataFrame:
    """Clusters of an observed map (feature_id, value) above bootstrapped thresholds: (cluster, statistics, p, p_corrected).

    Null group maps average one random map of every chunk. Their values give the
    threshold of each feature, their own clusters the null of cluster sizes.
    Clusters of all draws are found together: nodes are (draw, feature).
    """
    null = materialised(inf.bootstrap_maps(maps, chunk, draws, seed))
    limit = inf.threshold_map(null, p)
    every = null.select("draw", "feature_id", "value").unionByName(observed.select(F.lit(-1).alias("draw"), "feature_id", "value"))
    on = materialised(every.join(limit, "feature_id").where("value > threshold").select("draw", "feature_id", "value"))
    n = grid.count() + 1
    code = lambda f: ((F.col("draw") + 1) * n + F.col(f)).cast("long")
    near = ne.neighbours(grid, coords, 1.0).where("center_id < feature_id")
    a = on.select("draw", F.col("feature_id").alias("center_id"))
    edges = a.join(near, "center_id").join(on.select("draw", "feature_id"), ["draw", "feature_id"]).select(code("center_id").alias("a"), code("feature_id").alias("b"))
    label = inf.connected(edges, on.select(code("feature_id").alias("node")))
    found = materialised(on.withColumn("node", code("feature_id")).join(label, "node"))
    sizes = found.groupBy("draw", "cluster").agg(F.count("*").cast("int").alias("size"))
    stats = inf.cluster_statistics(found.where("draw = -1"))
    ps = inf.cluster_pvalues(sizes.where("draw = -1"), sizes.where("draw >= 0"))
    out = stats.join(ps.withColumn("size", F.col("size").cast("long")), "size")
    if correction == "fwe":
        # a family-wise rate from the largest cluster of each draw
        top = sizes.where("draw >= 0").groupBy("draw").agg(F.max("size").alias("top"))
        above = stats.select("cluster", "size").join(top, F.col("top") >= F.col("size"), "left").groupBy("cluster").agg(F.count("top").alias("_c"))
        return out.join(above, "cluster").withColumn("p_corrected", F.least(F.lit(1.0), (F.col("_c") + 1) / F.lit(draws + 1))).drop("_c")
    return inf.fdr_curve(out, "p", "cluster").withColumnRenamed("fdr", "p_corrected")


def event_model(values: DataFrame, events: DataFrame, by: list[str], time: str, value: str, condition: str) -> DataFrame:
    """Least-squares response amplitude of each condition: (by, name, beta, t, p).

    Regressors are the events' boxes convolved with the haemodynamic response.
    """
    names = ge.uniques(events, condition)
    x = od.hrf_design(values.select(*by, time).distinct(), events, by, time, condition)
    wide = x.groupBy(*by, time).agg(*(F.coalesce(F.sum(F.when(F.col(condition) == F.lit(n), F.col("x"))), F.lit(0.0)).alias(f"x_{i}") for i, n in enumerate(names)))
    j = values.join(wide, [*by, time], "left").na.fill(0.0, [f"x_{i}" for i in range(len(names))])
    fit = me.linear_regression(j, [f"x_{i}" for i in range(len(names))], value, by)
    label = F.create_map(*(F.lit(v) for i, n in enumerate(names) for v in (f"x_{i}", str(n))))
    return fit.withColumn("name", F.coalesce(label[F.col("name")], F.col("name")))


def contrast(betas: DataFrame, by: list[str], weights: dict[str, float]) -> DataFrame:
    """Weighted sum of fitted amplitudes."""
    w = F.create_map(*(F.lit(v) for kv in weights.items() for v in kv))
    return betas.groupBy(*by).agg(F.sum(F.col("beta") * F.coalesce(w[F.col("name")], F.lit(0.0))).alias("effect"))


def dsm_regression(dsm: DataFrame, predictors: dict[str, DataFrame], rank: bool = False) -> DataFrame:
    """Standardised coefficients of a dissimilarity table on predictor tables (id_a, id_b, value)."""
    out = dsm
    for n, p in predictors.items():
        out = out.join(p.select("id_a", "id_b", F.col("value").alias(n)), ["id_a", "id_b"])
    if rank:
        for n in ("value", *predictors):
            out = ranks(out, [], n, "_r").drop(n).withColumnRenamed("_r", n)
    return me.linear_regression(out, list(predictors), "value", standard=True)


def preprocess(df: DataFrame, key: str, value: str, chunk: str | None = None, position: str | None = None, smooth: tuple | None = None, normalise: bool = True) -> DataFrame:
    """Detrending, filtering and normalisation, in that order, of one value column; groups without variance are left out."""
    by = [chunk] if chunk else []
    out = df
    if position:
        out = od.detrend_linear(out, value, position, by)
    if smooth:
        b, a = smooth
        series = od.per_series(out, by, position or key, value, lambda x: od.filtfilt(b, a, x) if len(x) > 3 * len(b) else x)
        out = series.withColumnRenamed("value", value)
    if normalise:
        out = od.zscore(out, [value], chunk)
    if by:
        varying = out.groupBy(*by).agg((F.max(value) > F.min(value)).alias("_v")).where("_v").drop("_v")
        out = out.join(varying, by, "left_semi")
    return out


def searchlight_alignment(cells: DataFrame, near: DataFrame, key: str = "sample_id", subject: str = "subject") -> DataFrame:
    """Local alignments of all neighbourhoods summed to one sparse projection a subject: (subject, feature_in, feature_out, w).

    ``cells``: (subject, sample_id, feature_id, value), features common to all.
    """
    from sampleloom.operators.mappers import hyperalign_groups

    local = cells.join(near, "feature_id").groupBy("center_id", subject, key).agg(F.array_sort(F.collect_list(F.struct("feature_id", "value"))).alias("c"))
    ids = near.groupBy("center_id").agg(F.array_sort(F.collect_list("feature_id")).alias("ids"))
    rows = local.select("center_id", subject, key, F.transform("c", lambda c: c["value"]).alias("features"))
    w = hyperalign_groups(rows, "center_id", subject, key=key).join(ids, "center_id")
    named = w.select(subject, F.col("ids")[F.col("i")].alias("feature_in"), F.col("ids")[F.col("j")].alias("feature_out"), "w")
    return named.groupBy(subject, "feature_in", "feature_out").agg(F.sum("w").alias("w"))


def apply_alignment(cells: DataFrame, projection: DataFrame, subject: str = "subject", key: str = "sample_id") -> DataFrame:
    """Cells through a sparse projection: a join and a sum."""
    j = cells.join(projection.withColumnRenamed("feature_in", "feature_id"), [subject, "feature_id"])
    return j.groupBy(subject, key, F.col("feature_out").alias("feature_id")).agg(F.sum(F.col("value") * F.col("w")).alias("value"))


def connectivity_cells(cells: DataFrame, seeds: DataFrame, subject: str = "subject", key: str = "sample_id") -> DataFrame:
    """Correlation of each feature's series with each seed's mean series: the cells that connectivity alignment aligns."""
    z = od.zscore_long(cells, subject)
    s = z.join(seeds, "feature_id").groupBy(subject, key, "seed_id").agg(F.avg("value").alias("s"))
    r = z.join(s, [subject, key]).groupBy(subject, "seed_id", "feature_id").agg(F.avg(F.col("value") * F.col("s")).alias("value"))
    return r.select(subject, F.col("seed_id").alias(key), "feature_id", "value")


def ml_cross_validate(df: DataFrame, estimator, target: str, chunk: str, values: str = "features", key: str = "sample_id") -> DataFrame:
    """Any pyspark.ml estimator, leaving out one chunk at a time: (fold, sample_id, target, prediction).

    Fits are jobs of their own, one a distinct chunk.
    """
    from pyspark.ml.functions import array_to_vector

    base = df.select(key, chunk, F.col(target).cast("double").alias("label"), array_to_vector(values).alias("features"))
    out = None
    for fold in ge.uniques(df, chunk):
        model = estimator.fit(base.where(F.col(chunk) != F.lit(fold)))
        part = model.transform(base.where(F.col(chunk) == F.lit(fold))).select(F.lit(fold).alias("fold"), F.col(key).alias("sample_id"), F.col("label").alias("target"), "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def kernel_matrix(df: DataFrame, key: str, fx, values: str = "features") -> DataFrame:
    """Kernel of all pairs of a table of prototypes, written once: later calls read slices of it by id."""
    return materialised(pairwise(df, df, key, values, fx))


def kernel_slice(kernel: DataFrame, rows: DataFrame, columns: DataFrame, key: str) -> DataFrame:
    """The part of a stored kernel for given ids; unknown ids raise."""
    known = kernel.select(F.col("id_a").alias(key)).distinct()
    if rows.select(key).unionByName(columns.select(key)).join(known, key, "left_anti").limit(1).count():
        raise KeyError("the kernel lacks some of the ids")
    return kernel.join(rows.select(F.col(key).alias("id_a")), "id_a", "left_semi").join(columns.select(F.col(key).alias("id_b")), "id_b", "left_semi")


def motion_summary(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Quality statistics of motion parameters over runs."""
    from sampleloom.operators.aggregate import boxplot_stats

    flat = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("parameter"), F.col(c).alias("value")) for c in columns))).alias("x")).select(*by, "x.*")
    return boxplot_stats(flat, [*by, "parameter"], "value")


def dump(df: DataFrame, path: str, form: str = "txt") -> None:
    """Samples or attributes to text, JSON or Parquet."""
    {"txt": lambda w: w.csv(path, sep=" "), "csv": lambda w: w.csv(path, header=True), "json": lambda w: w.json(path), "parquet": lambda w: w.parquet(path)}[form](df.write)


def curve_fit(df: DataFrame, value: str, fx: Callable[[np.ndarray, np.ndarray], np.ndarray], params: list[float], bins: int = 20) -> np.ndarray:
    """Parameters of a curve fitted to a histogram that Spark counts (``bins`` rows reach the driver)."""
    from sampleloom.functions.generate import least_squares

    low, high = df.agg(F.min(value), F.max(value)).first()
    width = (high - low) / bins or 1.0
    slot = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    counts = {r[0]: r[1] for r in df.groupBy(slot.alias("b")).count().collect()}
    y = np.array([counts.get(i, 0) for i in range(bins)], float)
    x = low + (np.arange(bins) + 0.5) * width
    return least_squares(fx, np.array(params), x, y)


def select_rows(df: DataFrame, samples: str | None = None, start: int | None = None, stop: int | None = None, step: int | None = None, drop: list[str] | None = None) -> DataFrame:
    """Rows by expression or slice, named attributes dropped."""
    out = df if samples is None else df.where(se.expression(df, samples))
    if (start, stop, step) != (None, None, None):
        out = se.take_samples(out, slice(start, stop, step))
    return out.drop(*(drop or []))
