"""Choosing elements: tails, ranges, winners, and rules for when to stop."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tail(df: DataFrame, score: str, n: int | None = None, fraction: float | None = None, which: str = "lower", mode: str = "discard", tie: str = "feature_id") -> DataFrame:
    """``n`` elements, or max(1, floor(fraction * count)), at one tail: those (select) or the others (discard); ties by ``tie``.

    The default discards the lower tail.
    """
    if n is None:
        n = max(1, int(df.count() * fraction))
    order = [F.col(score).asc() if which == "lower" else F.col(score).desc(), F.col(tie).asc()]
    # a top-n plan: partial tops per partition, never a sort of everything
    part = df.orderBy(*order).limit(n)
    return part if mode == "select" else df.join(part.select(tie), tie, "left_anti")


def in_range(c: str, lower: float | None = None, upper: float | None = None, inclusive: bool = False, mode: str = "select") -> Column:
    """Whether a score is kept: within bounds; outside them if lower >= upper; not zero without bounds."""
    x = F.col(c)
    if lower is None and upper is None:
        ok = x != 0
    else:
        above = F.lit(True) if lower is None else (x >= lower if inclusive else x > lower)
        below = F.lit(True) if upper is None else (x <= upper if inclusive else x < upper)
        ok = (above | below) if lower is not None and upper is not None and lower >= upper else (above & below)
    return ok if mode == "select" else ~ok


def feature_winner(values: str) -> Column:
    """Place of a sample's first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def feature_loser(values: str) -> Column:
    return F.array_position(values, F.array_min(values)) - 1


def sample_winner(long: DataFrame, by: str = "feature_id", element: str = "sample_id", value: str = "value", lowest: bool = False) -> DataFrame:
    """Per feature the sample with the largest (smallest) value, the first of equals."""
    key = F.struct(F.col(value) if lowest else -F.col(value), F.col(element))
    return long.groupBy(by).agg(F.min_by(element, key).alias("winner"))


def group_winner(long: DataFrame, group: str, by: str = "feature_id", value: str = "value", lowest: bool = False) -> DataFrame:
    """Per feature the group with the largest (smallest) mean."""
    means = long.groupBy(by, group).agg(F.avg(value).alias("_m"))
    return sample_winner(means, by, group, "_m", lowest)


def ranks(df: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Ranks from 1 with ties averaged."""
    w = W.partitionBy(*by)
    low = F.rank().over(w.orderBy(value))
    same = F.count("*").over(W.partitionBy(*by, value))
    return df.withColumn(name, low + (same - 1) / 2)


# --- stopping rules over a history of errors -------------------------------
@dataclass
class Best:
    """Whether the last value is the best of a history; of equals, the first or the last."""

    func: Callable = min
    last: bool = False

    def index(self, history: list[float]) -> int:
        best = self.func(history)
        return len(history) - 1 - history[::-1].index(best) if self.last else history.index(best)

    def __call__(self, history: list[float]) -> bool:
        return bool(history) and self.index(history) == len(history) - 1


def stop_below(threshold: float) -> Callable[[list[float]], bool]:
    return lambda history: bool(history) and history[-1] < threshold


def stop_after(steps: int) -> Callable[[list[float]], bool]:
    return lambda history: len(history) >= steps


def stop_stale(steps: int = 10, best: Best | None = None) -> Callable[[list[float]], bool]:
    """Once the best lies ``steps`` or more back."""
    best = best or Best()
    return lambda history: bool(history) and len(history) - 1 - best.index(history) >= steps


def stop_any(rules: list, mode: str = "or") -> Callable[[list[float]], bool]:
    return lambda history: (any if mode == "or" else all)(r(history) for r in rules)


def history_maps(spark, history: list[int]) -> DataFrame:
    """(step, feature_id, kept) from the step at which each feature was dropped."""
    df = spark.createDataFrame(list(enumerate(history)), "feature_id int, gone int")
    return df.select(F.explode(F.sequence(F.lit(0), F.lit(max(history, default=0)))).alias("step"), "feature_id", (F.col("gone") >= F.col("step")).alias("kept"))


def ncombinations(n: int, k: int) -> int:
    return math.comb(n, k)
