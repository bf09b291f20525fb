"""Stacking of annotated matrices along samples or features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.dataset import ID, VALUES, Dataset


def vstack(parts: list[DataFrame]) -> DataFrame:
    """Samples appended, with ``ds_index`` for where each came from; the columns must be the same."""
    if not parts:
        raise ValueError("nothing to stack")
    if any(set(p.columns) != set(parts[0].columns) for p in parts):
        raise ValueError("sample attributes differ")
    if len(parts) == 1:
        return parts[0]
    return reduce(DataFrame.unionByName, (p.withColumn("ds_index", F.lit(i)) for i, p in enumerate(parts)))


def merge_attrs(parts: list[dict], policy=None) -> dict:
    """Attributes of the whole: None, a part's number, ``unique``, ``uniques``, ``drop_nonunique`` or ``all``."""
    if policy is None:
        return {}
    if isinstance(policy, int) and not isinstance(policy, bool):
        return dict(parts[policy])
    keys = sorted({k for p in parts for k in p})
    out = {}
    for k in keys:
        values = [p.get(k) for p in parts]
        same = all(k in p for p in parts) and all(v == values[0] for v in values)
        if policy == "all":
            out[k] = tuple(values)
        elif policy == "uniques":
            out[k] = tuple(dict.fromkeys(v for v in values if v is not None))
        elif same:
            out[k] = values[0]
        elif policy in ("unique", True):
            raise ValueError(f"attribute {k} differs")
    return out


def hstack(parts: list[DataFrame], order: list[str]) -> DataFrame:
    """Features appended by position: the n-th samples of all parts, in ``order``, become one.

    Sample attributes of the first part are kept.
    """
    from sampleloom.operators.select import positions

    numbered = [positions(p, order) for p in parts]
    out = numbered[0]
    for k, p in enumerate(numbered[1:], 1):
        out = out.join(p.select("pos", F.col(VALUES).alias(f"_v{k}")), "pos", "full")
    values = [F.col(VALUES), *(F.col(f"_v{k}") for k in range(1, len(parts)))]
    whole = reduce(lambda a, b: a & b, (v.isNotNull() for v in values))
    checked = F.when(whole, F.concat(*values)).otherwise(F.raise_error(F.lit("parts differ in their number of samples")))
    return out.select(*(c for c in parts[0].columns if c != VALUES), checked.alias(VALUES))


def stack_by_sample_attribute(df: DataFrame, attr: str, values: list, order: list[str], value: str = VALUES) -> DataFrame:
    """Samples of each attribute value side by side: the n-th of every value form one row, in the order of ``values``."""
    at = df.withColumn("pos", (F.row_number().over(W.partitionBy(attr).orderBy(*order)) - 1).cast("long"))
    # the number of values is that of columns, so the map is small
    cells = at.groupBy("pos").agg(F.map_from_entries(F.collect_list(F.struct(attr, value))).alias("m"))
    row = [F.col("m")[F.lit(v)] for v in values]
    missing = reduce(lambda a, b: a | b, (c.isNull() for c in row))
    side = F.concat(*row) if dict(df.dtypes)[value].startswith("array") else F.array(*row)
    return cells.select("pos", F.when(missing, F.raise_error(F.lit("unequal counts"))).otherwise(side).alias(VALUES))


def stack_by_feature_attribute(ds: Dataset, attr: str) -> DataFrame:
    """Feature groups below each other: (sample_id, attr, features), one row for each sample and attribute value."""
    cells = ds.long().join(ds.features.select("feature_id", attr), "feature_id")
    grouped = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
    return cells.groupBy(ID, *ds.sa, attr).agg(F.transform(grouped, lambda c: c["value"]).alias(VALUES))


def hstack_padded(parts: list[DataFrame], key: str, filler: float = float("nan")) -> DataFrame:
    """Features appended for samples of equal ``key``; a part that lacks a sample gives as many fillers as it has features."""
    one = [p.select(F.col(key), F.col(VALUES).alias(f"_v{k}")) for k, p in enumerate(parts)]
    out = reduce(lambda a, b: a.join(b, key, "full"), one)
    # the size of each part's feature axis
    width = [p.select(F.size(VALUES).alias("n")).agg(F.max("n")).scalar() for p in parts]
    values = [F.coalesce(F.col(f"_v{k}"), F.array_repeat(F.lit(float(filler)), w)) for k, w in enumerate(width)]
    return out.select(key, F.concat(*values).alias(VALUES))
