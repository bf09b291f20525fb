"""Aggregation along samples or features, contingency tables and summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.operators.select import join_same, ranked


def merge_unique(c: Column | str) -> Column:
    """An attribute's merged value: itself if all are equal, else the sorted distinct values joined by ``+``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat_ws("+", F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")))


def merge_first(c: str, order: str) -> Column:
    """The first element in order."""
    return F.min_by(c, order)


def fx_samples(df: DataFrame, by: list[str], fx: dict[str, Column], merge: list[str] | None = None, order: str | None = "uattrs", key: str | None = None) -> DataFrame:
    """Aggregates per combination of attributes, the others merged.

    ``order='uattrs'`` sorts with the LAST attribute most significant,
    ``'occurrence'`` by the first row in order of ``key``.
    """
    out = [c.alias(n) for n, c in fx.items()] + [merge_unique(m).alias(m) for m in merge or []]
    if order == "occurrence":
        return df.groupBy(*by).agg(*out, F.min(key).alias("_first")).orderBy("_first").drop("_first")
    done = df.groupBy(*by).agg(*out)
    return done.orderBy(*reversed(by)) if order == "uattrs" and by else done


def over_features(values: Column | str, fx: str = "mean") -> Column:
    """Aggregate of a sample's values: mean, sum, sumofabs, maxofabs, l1, l2, nonzero."""
    v = F.col(values) if isinstance(values, str) else values
    total: Callable[[Callable], Column] = lambda f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    return {
        "sum": lambda: total(lambda x: x),
        "mean": lambda: F.try_divide(total(lambda x: x), F.size(v)),
        "sumofabs": lambda: total(F.abs),
        "maxofabs": lambda: F.array_max(F.transform(v, F.abs)),
        "l1": lambda: total(F.abs),
        "l2": lambda: F.sqrt(total(lambda x: x * x)),
        "nonzero": lambda: F.size(F.filter(v, lambda x: x != 0)),
    }[fx]()


def mean_removed(values: Column | str) -> Column:
    """A sample's values less their mean."""
    v = F.col(values) if isinstance(values, str) else values
    m = over_features(v, "mean")
    return F.transform(v, lambda x: x - m)


def normed(values: Column | str, norm: float = 1.0, kind: str = "l2") -> Column:
    """Values scaled to a norm; NULL elements where the norm is 0."""
    v = F.col(values) if isinstance(values, str) else values
    n = over_features(v, kind)
    return F.transform(v, lambda x: F.try_divide(x * norm, n))


def nanmean(c: str) -> Column:
    """Mean without NaN."""
    return F.avg(F.when(~F.isnan(c), F.col(c)))


def contingency(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """Counts of every pair of values, zeros included."""
    counts = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    # the values of one axis as an array: the grid is the table that is asked for
    grid = counts.select(rows).distinct().withColumn("_all", counts.agg(F.collect_set(columns)).scalar()).select(rows, F.explode("_all").alias(columns))
    return grid.join(counts, [rows, columns], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def summary_targets(df: DataFrame, target: str, chunk: str) -> DataFrame:
    """Mean, deviation, extremes and number of non-zero counts, per target over chunks and per chunk over targets."""
    table = contingency(df, chunk, target)
    stats = [F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"), F.count_if(F.col("n") > 0).alias("nonzero")]
    a = table.groupBy(F.col(target).cast("string").alias("value")).agg(*stats).withColumn("axis", F.lit("target"))
    b = table.groupBy(F.col(chunk).cast("string").alias("value")).agg(*stats).withColumn("axis", F.lit("chunk"))
    return a.unionByName(b)


def transitions(df: DataFrame, attr: str, order: list[str], by: list[str], k: int = 1) -> DataFrame:
    """How often each value is followed, ``k`` places on, by each other; places and partners are joined, not windowed."""
    at = ranked(df.select(*by, *order, F.col(attr).alias("value")), by, order, "_i").select(*by, "_i", "value")
    after = at.select(*by, (F.col("_i") - k).alias("_i"), F.col("value").alias("following"))
    return join_same(at, after, [*by, "_i"]).where("following is not null").groupBy("value", "following").agg(F.count("*").alias("n"))


def circular_autocorrelation(df: DataFrame, value: str, order: list[str], by: list[str], shifts: int) -> DataFrame:
    """Correlation of each sequence with itself turned by 1 to ``shifts`` places."""
    at = ranked(df.select(*by, *order, F.col(value).cast("double").alias("v")), by, order, "i", "n").select(*by, "v", "i", "n")
    turned = at.select(*by, F.col("v").alias("_turned"), F.explode(F.sequence(F.lit(1), F.lit(shifts))).alias("shift"), "i", "n")
    turned = turned.withColumn("i", F.pmod(F.col("i") - F.col("shift"), "n")).drop("n").where("shift > 0")
    return at.join(turned, [*by, "i"]).where("shift < n").groupBy(*by, "shift").agg(correlation("v", "_turned").alias("r"))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation, NULL where either is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def boxplot_stats(df: DataFrame, by: list[str], value: str, k: float = 3.0, least: float | None = None, series: str | None = None) -> DataFrame:
    """Mean, median, deviation, extremes, quartiles and number per group, without NaN and outliers.

    An outlier lies further than ``k`` deviations from its group's mean (and
    above ``least``, if given). With ``series`` all values of a series that has
    an outlier are left out.
    """
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    base = fine.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    out = F.abs(F.col(value) - F.col("_m")) > k * F.col("_s")
    if least is not None:
        out = out & (F.col(value) > least)
    kept = fine.join(base, by)
    kept = kept.where(~out) if series is None else kept.join(kept.where(out).select(series).distinct(), series, "left_anti")
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    done = kept.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n"), q.alias("q"))
    return done.select(*by, "mean", F.col("q")[1].alias("median"), "std", "min", "max", F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "n")


def binomial_ci(n: Column, x: Column, z: float, method: str = "wilson") -> tuple[Column, Column]:
    """Confidence bounds of a proportion of ``x`` in ``n``: the closed-form methods, ``z`` the normal quantile.

    wald, wilson, agresti-coull, arc-sine (without the continuity terms, which
    are 0 in the original's integer arithmetic), logit and anscombe.
    """
    p = F.try_divide(x, n)
    if method == "wald":
        d = z * F.sqrt(p * (1 - p) / n)
        return p - d, p + d
    if method in ("wilson", "agresti-coull"):
        n2 = n + z * z
        mid = (x + z * z / 2) / n2
        d = z * F.sqrt(p * (1 - p) * n + z * z / 4) / n2 if method == "wilson" else z * F.sqrt(mid * (1 - mid) / n2)
        return mid - d, mid + d
    if method == "arc-sine":
        d = z / (2 * F.sqrt(n))
        return F.pow(F.sin(F.asin(F.sqrt(p)) - d), 2), F.pow(F.sin(F.asin(F.sqrt(p)) + d), 2)
    if method in ("logit", "anscombe"):
        a, b = (x, n - x) if method == "logit" else (x + 0.5, n - x + 0.5)
        mid = F.ln(F.try_divide(a, b))
        var = F.try_divide(n, x * (n - x)) if method == "logit" else (n + 1) * (n + 2) / (n * (x + 1) * (n - x + 1))
        low, high = mid - z * F.sqrt(var), mid + z * F.sqrt(var)
        return F.exp(low) / (1 + F.exp(low)), F.exp(high) / (1 + F.exp(high))
    raise ValueError(method)


def design_labels(names: list[str], baseline: str, test: Callable[[Column], Column] = lambda c: c > 0) -> Column:
    """Name of the single regressor column that passes ``test``; the baseline if none, an error if several."""
    hits = F.filter(F.array(*(F.when(test(F.col(n)), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return F.when(F.size(hits) == 0, F.lit(baseline)).when(F.size(hits) == 1, hits[0]).otherwise(F.raise_error(F.lit("more than one regressor is active")))


def map_overlap(df: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Of maps (map_id, feature_id, selected): share of features selected in at least ``threshold`` of the maps, and of those selected otherwise."""
    share = df.groupBy("feature_id").agg(F.avg(F.col("selected").cast("double")).alias("s"))
    return share.agg(F.avg((F.col("s") >= threshold).cast("double")).alias("overlap"), F.avg(((F.col("s") > 0) & (F.col("s") < threshold)).cast("double")).alias("spread"))
