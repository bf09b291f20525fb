"""Errors of predictions, confusion tables and their statistics."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.functions.distributions import t_sf
from sampleloom.operators.aggregate import correlation
from sampleloom.session import checkpointed, partitions_for


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- aggregates over (predicted, target) -----------------------------------
def mean_power(x) -> Column:
    return F.avg(_c(x) * _c(x))


def root_mean_power(x) -> Column:
    return F.sqrt(mean_power(x))


def rms_error(p, t) -> Column:
    return F.sqrt(F.avg(F.pow(_c(p) - _c(t), 2)))


def mismatch(p, t) -> Column:
    return F.count_if(_c(p) != _c(t))


def mean_mismatch(p, t) -> Column:
    return F.avg((_c(p) != _c(t)).cast("double"))


def match_accuracy(p, t) -> Column:
    return F.count_if(_c(p) == _c(t))


def mean_match(p, t) -> Column:
    return F.avg((_c(p) == _c(t)).cast("double"))


def corr_error(p, t) -> Column:
    """1 - r; r is 0 where a side is constant."""
    return 1 - F.coalesce(correlation(p, t), F.lit(0.0))


def relative_rms_error(p, t) -> Column:
    return F.try_divide(rms_error(p, t), root_mean_power(t))


def variance_1sv(p, t) -> Column:
    """Share of the variance of the cloud (predicted, target) along its first axis: from the 2 x 2 scatter matrix."""
    a, b, c = F.var_pop(_c(p)), F.var_pop(_c(t)), F.covar_pop(_c(p), _c(t))
    return F.try_divide((a + b) / 2 + F.sqrt(F.pow((a - b) / 2, 2) + c * c), a + b)


def corr_error_probability(df: DataFrame, p: str, t: str, by: list[str] | None = None) -> DataFrame:
    """(by, r, p): correlation of predictions and targets and the two-sided probability of none."""
    base = df.groupBy(*(by or [])).agg(F.coalesce(correlation(p, t), F.lit(0.0)).alias("r"), F.count(F.when(F.col(p).isNotNull() & F.col(t).isNotNull(), 1)).alias("_n"))

    def prob(r: pd.Series, n: pd.Series) -> pd.Series:
        d, x = np.maximum(n.to_numpy(float) - 2, 1), np.clip(r.to_numpy(float), -1 + 1e-15, 1 - 1e-15)
        return pd.Series(np.where(n.to_numpy() > 2, np.minimum(1.0, 2 * t_sf(np.abs(x) * np.sqrt(d / (1 - x * x)), d)), 1.0))

    return base.withColumn("p", F.pandas_udf(prob, "double")("r", "_n")).drop("_n")


def classifier_error(train: DataFrame, test: DataFrame, fit, predict, target: str, error=None) -> DataFrame:
    """(error) of a model trained on one table and tried on another: ``fit(train)``, ``predict(model, test)`` with a prediction column."""
    return predict(fit(train), test).agg((error or mean_mismatch)("prediction", target).alias("error"))


def confusion_error(counts: DataFrame) -> DataFrame:
    """(error) of counts by prediction and target."""
    wrong = F.sum(F.when(F.col("prediction") != F.col("target"), F.col("n")).otherwise(0))
    return counts.agg(F.try_divide(wrong, F.sum("n")).alias("error"))


ERRORS = {"mean_mismatch_error": mean_mismatch, "mismatch_error": mismatch, "match_accuracy": match_accuracy, "mean_match_accuracy": mean_match, "rms_error": rms_error, "corr_error": corr_error, "relative_rms_error": relative_rms_error, "variance_1sv": variance_1sv}


def mean_tpr(df: DataFrame, p: str, t: str, by: list[str] | None = None) -> DataFrame:
    """Mean over targets of the share predicted right, and its complement.

    A label that is predicted but no target has no such share: it raises an error.
    """
    by = by or []
    rate = df.groupBy(*by, t).agg(F.avg((F.col(p) == F.col(t)).cast("double")).alias("r"))
    # labels by group, not rows
    only = df.where(F.col(p).isNotNull()).select(*by, F.col(p).alias(t)).distinct().join(rate.select(*by, t), [*by, t], "left_anti")
    rate = rate.unionByName(only.withColumn("r", F.raise_error(F.concat(F.lit("predicted, but no target: "), F.col(t).cast("string"))).cast("double")))
    return rate.groupBy(*by).agg(F.avg("r").alias("mean_tpr"), (1 - F.avg("r")).alias("mean_fnr"))


def auc(df: DataFrame, estimate: str, positive: Column, key: str, by: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids over the estimates from high to low, ties not grouped.

    Equal to the share of pairs ranked right: each negative sees the positives
    above it, those of its own range partition and those of earlier ones.
    """
    by = by or []
    order = [F.col("_e").desc(), F.col("_key").desc()]
    flat = df.select(*by, positive.cast("int").alias("_y"), F.col(estimate).alias("_e"), F.col(key).alias("_key"))
    part = checkpointed(flat.repartitionByRange(partitions_for(df.sparkSession), *by, *order).withColumn("_part", F.spark_partition_id()))
    above = F.sum("_y").over(W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    local = part.withColumn("_tp", above).groupBy(*by, "_part").agg(F.sum("_y").alias("pos"), (F.count("*") - F.sum("_y")).alias("neg"), F.sum(F.when(F.col("_y") == 0, F.col("_tp")).otherwise(0)).alias("hits"))
    # one row a group and partition
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("pos").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = local.withColumn("hits", F.col("hits") + F.col("neg") * before)
    return whole.groupBy(*by).agg(F.try_divide(F.sum("hits"), F.sum("pos") * F.sum("neg")).alias("auc"))


def roc(df: DataFrame, label: str, estimates: str, labels: list, key: str, by: list[str] | None = None) -> DataFrame:
    """AUC of each label against the rest, from an array of estimates in order of ``labels``."""
    parts = F.array(*(F.struct(F.lit(x).alias("of"), F.col(estimates)[i].alias("e"), (F.col(label) == F.lit(x)).alias("y")) for i, x in enumerate(labels)))
    flat = df.select(*(by or []), key, F.explode(parts).alias("x")).select(*(by or []), key, "x.*")
    return auc(flat, "e", F.col("y"), key, [*(by or []), "of"])


# --- confusion -------------------------------------------------------------
def confusion(df: DataFrame, p: str = "prediction", t: str = "target", by: list[str] | None = None) -> DataFrame:
    """Counts by prediction and target; mergeable, so sets are added by a sum."""
    return df.groupBy(*(by or []), F.col(p).alias("prediction"), F.col(t).alias("target")).agg(F.count("*").alias("n"))


def confusion_matrix(counts: DataFrame, labels: list) -> DataFrame:
    """Rows = predictions, columns = targets."""
    return counts.groupBy("prediction").pivot("target", labels).agg(F.coalesce(F.sum("n"), F.lit(0))).na.fill(0)


def confusion_stats(counts: DataFrame) -> DataFrame:
    """Per label: TP FP FN TN P N P' N' TPR PPV NPV FDR SPC F1 MCC, and overall ACC.

    TN is the number of correct predictions of OTHER labels. TPR is 0 without
    samples, MCC is 0 with a 0 denominator, other undefined ratios are NULL.
    """
    row = counts.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("pred"), F.sum(F.when(F.col("prediction") == F.col("target"), F.col("n")).otherwise(0)).alias("tp1"))
    col = counts.groupBy(F.col("target").alias("label")).agg(F.sum("n").alias("p"))
    j = row.join(col, "label", "full").select("label", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("pred", "tp1", "p")))
    total = counts.agg(F.struct(F.sum("n").alias("total"), F.sum(F.when(F.col("prediction") == F.col("target"), F.col("n")).otherwise(0)).alias("right")))
    j = j.withColumn("_one", total.scalar()).select("*", "_one.*").drop("_one")
    tp, pred, pos = F.col("tp1"), F.col("pred"), F.col("p")
    tn = F.col("right") - tp
    fp, fn = pred - tp, pos - tp
    out = j.select("label", tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), pos.alias("p"), (fp + tn).alias("n"), pred.alias("p_"), (tn + fn).alias("n_"), "total", "right")
    d = lambda a, b: F.try_divide(a, b)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return out.select("label", "tp", "fp", "fn", "tn", "p", "n", "p_", "n_", F.coalesce(d(tp, F.col("p")), F.lit(0.0)).alias("tpr"), d(tp, tp + fp).alias("ppv"), d(tn, tn + fn).alias("npv"), d(fp, tp + fp).alias("fdr"), d(tn, fp + tn).alias("spc"), d(2 * tp, 2 * tp + fp + fn).alias("f1"), F.coalesce(d(tp * tn - fp * fn, den), F.lit(0.0)).alias("mcc"), d(F.col("right"), F.col("total")).alias("acc"))


def regression_stats(df: DataFrame, p: str, t: str, sets: str | None = None) -> DataFrame:
    """Per set, and pooled (set NULL): 1 - r, its RMSE, root mean powers and deviations of both sides."""
    aggs = [corr_error(p, t).alias("cce"), rms_error(p, t).alias("rmse"), root_mean_power(t).alias("rmp_t"), root_mean_power(p).alias("rmp_p"), F.stddev_pop(t).alias("std_t"), F.stddev_pop(p).alias("std_p"), F.try_divide(rms_error(p, t), root_mean_power(t)).alias("rmse_rmp")]
    pooled = df.agg(*aggs)
    if sets is None:
        return pooled
    kind = dict(df.dtypes)[sets]
    return df.groupBy(sets).agg(*aggs).unionByName(pooled.select(F.lit(None).cast(kind).alias(sets), *pooled.columns))


def pairwise_accuracy(df: DataFrame, pair: str, p: str, t: str) -> DataFrame:
    """Hits, misses and accuracy per pair of classes of one-against-one predictions; only samples of the pair count."""
    first, second = F.split(pair, "\\|")[0], F.split(pair, "\\|")[1]
    own = df.where((F.col(t) == first) | (F.col(t) == second))
    hit = F.count_if(F.col(p) == F.col(t))
    return own.groupBy(pair).agg(hit.alias("hits"), (F.count("*") - hit).alias("misses"), F.avg((F.col(p) == F.col(t)).cast("double")).alias("acc"))


def set_partitions(items: list) -> list[list[tuple]]:
    """All partitions of a small set into groups."""
    if not items:
        return [[]]
    head, out = items[0], []
    for k in range(len(items)):
        for others in combinations(items[1:], k):
            rest = [x for x in items[1:] if x not in others]
            out += [[(head, *others), *p] for p in set_partitions(rest)]
    return out


lgamma = np.vectorize(math.lgamma, otypes=[float])


def log_beta(a: np.ndarray) -> np.ndarray:
    """Logarithm of the multivariate beta function of each row."""
    return lgamma(a).sum(-1) - lgamma(a.sum(-1))


def dirichlet_multinomial(x: np.ndarray, a: np.ndarray) -> float:
    """Log likelihood of counts under a multinomial whose probabilities have a Dirichlet prior ``a``."""
    ways = math.lgamma(float(np.sum(x)) + 1) - np.sum(lgamma(np.asarray(x) + 1))
    return float(ways + log_beta(np.asarray(a) + x) - log_beta(np.asarray(a, float)))


def confusion_likelihood(counts: np.ndarray, groups: list[tuple], alpha: np.ndarray) -> float:
    """Log likelihood of a confusion table if classes of one group can't be told apart.

    Given its total, a row is laid out in the columns in as many ways as its
    multinomial coefficient says. Each row has probabilities, Dirichlet
    distributed, over its columns with those of its group taken as one; where a
    row falls inside the group has probabilities that all rows of the group
    share. Integrated over, a Dirichlet prior is a quotient of beta functions.
    """
    counts, alpha = np.asarray(counts, float), np.asarray(alpha, float)
    total = float(np.sum(lgamma(counts.sum(1) + 1)) - np.sum(lgamma(counts + 1)))
    for g in groups:
        rows, apart = list(g), [c for c in range(counts.shape[1]) if c not in g]
        merged = lambda x: np.column_stack([x[rows][:, rows].sum(1), x[rows][:, apart]])  # noqa: B023, E731
        inside = lambda x: x[rows][:, rows].sum(0)  # noqa: B023, E731
        for part in (merged, inside):
            total += float(np.sum(log_beta(part(alpha) + part(counts)) - log_beta(part(alpha))))
    return total


def bayes_confusion(counts: np.ndarray, alpha: np.ndarray | None = None, hypotheses: list | None = None, prior: np.ndarray | None = None) -> list[tuple[list[tuple], float, float]]:
    """(groups, log likelihood, posterior) of each hypothesis on which classes can be told apart, the likeliest first.

    Without ``hypotheses`` all groupings of the classes are judged, so it is for
    tables of some classes.
    """
    counts = np.asarray(counts, float)
    alpha = np.ones_like(counts) if alpha is None else alpha
    hypotheses = hypotheses or set_partitions(list(range(len(counts))))
    logs = np.array([confusion_likelihood(counts, h, alpha) for h in hypotheses])
    weighted = logs + np.log(np.full(len(logs), 1 / len(logs)) if prior is None else prior)
    p = np.exp(weighted - weighted.max())
    return sorted(zip(hypotheses, logs.tolist(), (p / p.sum()).tolist(), strict=True), key=lambda x: -x[2])
