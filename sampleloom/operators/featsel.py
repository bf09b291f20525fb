"""Feature selection: by sensitivity, incremental, recursive, inside partitions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sampleloom.operators.choose import Best, stop_stale, tail


def by_sensitivity(long: DataFrame, scores: DataFrame, score: str, fraction: float = 0.05, mode: str = "discard", which: str = "lower") -> DataFrame:
    """Cells of the chosen features; by default the lowest 5 % are dropped."""
    kept = tail(scores, score, fraction=fraction, which=which, mode=mode).select("feature_id")
    return long.join(kept, "feature_id", "left_semi")


def combine(selections: list[DataFrame], method: str = "union") -> DataFrame:
    """Union or intersection of feature ids."""
    return reduce(DataFrame.unionByName, selections).distinct() if method == "union" else reduce(DataFrame.intersect, selections)


def split_probability(long: DataFrame, label: str, scores: Callable[[DataFrame], DataFrame], fraction: float = 0.05) -> DataFrame:
    """Features chosen by the combined probabilities (sum of -ln p) of scores per label; ``scores`` gives (label, feature_id, p)."""
    total = scores(long).groupBy("feature_id").agg(F.sum(-F.ln(F.greatest("p", F.lit(1e-300)))).alias("score"))
    return tail(total, "score", fraction=fraction, which="upper", mode="select").select("feature_id")


def rfe(error: Callable[[list[int]], float], sensitivity: Callable[[list[int]], np.ndarray], features: list[int], drop: float | int = 0.05, least: int = 1, stop: Callable | None = None) -> tuple[list[int], list[float], list[list[int]]]:
    """Recursive elimination: the best set, the errors and the sets tried.

    A loop over steps on the driver; ``error`` and ``sensitivity`` are plans over
    the data for the current set.
    """
    best, stop = Best(last=True), stop or stop_stale(10)
    errors, sets, now = [], [], list(features)
    while now:
        errors.append(error(now))
        sets.append(list(now))
        if stop(errors) or len(now) <= least:
            break
        s = np.abs(sensitivity(now))
        n = max(1, int(len(now) * drop)) if isinstance(drop, float) else drop
        gone = set(np.argsort(s, kind="stable")[: min(n, len(now) - least)].tolist())
        now = [f for i, f in enumerate(now) if i not in gone]
    return sets[best.index(errors)], errors, sets


def ifs(errors: Callable[[list[int], list[int]], list[float]], features: list[int], stop: Callable | None = None) -> tuple[list[int], list[float]]:
    """Forward selection: the candidate with the least error joins, until the best lies some steps back.

    ``errors(chosen, candidates)`` judges all candidates in one keyed job.
    """
    stop, chosen, history, left = stop or stop_stale(3), [], [], list(features)
    while left:
        e = errors(chosen, left)
        i = int(np.argmin(e))
        chosen.append(left.pop(i))
        history.append(float(e[i]))
        if stop(history):
            break
    return chosen[: Best().index(history) + 1], history


def split_rfe(x: np.ndarray, y: np.ndarray, parts: list[np.ndarray], make, drop: float = 0.2, least: int = 1) -> tuple[list[int], dict[int, float]]:
    """Elimination inside partitions: the number of features with the least mean error, then a fit on all data (bounded sample)."""
    total: dict[int, list[float]] = {}
    weigh = lambda m: np.abs(np.atleast_2d(m.weights)).sum(0) if np.ndim(m.weights) == 1 or np.atleast_2d(m.weights).shape[1] == np.size(m.weights) else np.abs(m.weights).sum(0 if m.weights.shape[0] < m.weights.shape[1] else 1)

    def order(xx, yy, record=None):
        now, sets = list(range(xx.shape[1])), []
        while True:
            m = make().fit(xx[:, now], yy)
            sets.append(list(now))
            if record is not None:
                record(now, m)
            if len(now) <= least:
                return sets
            w = weigh(m)
            gone = set(np.argsort(w, kind="stable")[: min(max(1, int(len(now) * drop)), len(now) - least)].tolist())
            now = [f for i, f in enumerate(now) if i not in gone]

    for test in parts:
        train = np.setdiff1d(np.arange(len(y)), test)
        order(x[train], y[train], lambda now, m, t=test: total.setdefault(len(now), []).append(float(np.mean(m.predict(x[t][:, now]) != y[t]))))
    means = {k: float(np.mean(v)) for k, v in total.items()}
    n = min(means, key=lambda k: (means[k], k))
    return next(s for s in order(x, y) if len(s) == n), means
