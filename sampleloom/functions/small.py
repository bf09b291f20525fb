"""Small functions of values, arrays and names, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def identity(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def one_minus(c: Column | str) -> Column:
    """1 - x, of a number."""
    return 1 - identity(c)


def one_minus_each(values: Column | str) -> Column:
    """1 - x of each element."""
    return F.transform(values, lambda x: 1 - x)


def grand_mean(df: DataFrame, values: str = "features") -> DataFrame:
    """(grand_mean): the mean over all samples and features, from sums that each partition takes for itself."""
    part = df.agg(F.sum(F.aggregate(values, F.lit(0.0), lambda a, x: a + x)).alias("s"), F.sum(F.size(values)).alias("n"))
    return part.select(F.try_divide("s", "n").alias("grand_mean"))


def content_hash(*columns: str) -> Column:
    """Hash of a row's content, the same for equal rows wherever they lie."""
    return F.xxhash64(*columns)


def in_volume(coordinates: Column | str, shape: list[int]) -> Column:
    """Whether each coordinate is 0 or more and less than the volume's extent."""
    c = identity(coordinates)
    inside = F.size(c) == len(shape)
    for i, n in enumerate(shape):
        inside = inside & (c[i] >= 0) & (c[i] < n)
    return inside


def where_equal(values: Column | str, x) -> Column:
    """Places, from 0, of the elements equal to ``x``; NULL equals NULL."""
    return F.filter(F.transform(values, lambda v, i: F.when(v.eqNullSafe(F.lit(x)), i)), lambda i: i.isNotNull())


def mask_slice(mask: Column | str) -> Column:
    """(start, stop, step) that selects what a boolean array does, or NULL if no slice does; an empty mask is (0, 0, 1)."""
    at = where_equal(mask, True)
    n = F.size(at)
    step = F.when(n > 1, at[1] - at[0]).otherwise(1)
    even = F.forall(F.transform(at, lambda p, i: p == at[0] + i * step), lambda ok: ok)
    whole = lambda a, b, c: F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"), c.cast("int").alias("step"))
    return F.when(n == 0, whole(F.lit(0), F.lit(0), F.lit(1))).when(even, whole(at[0], at[n - 1] + 1, step))


def version_parts(c: Column | str) -> Column:
    """A version's numbers and words in order, as text: separators gone, digits apart from letters."""
    return F.regexp_extract_all(identity(c), F.lit(r"(\d+|[A-Za-z]+)"), 1)


def version_tuple(version: str) -> tuple:
    """The same of one version, numbers as such."""
    return tuple(int(x) if x.isdigit() else x for x in re.findall(r"\d+|[A-Za-z]+", version))
