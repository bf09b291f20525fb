"""Selection of samples and features: by attribute, expression, position and content."""

from __future__ import annotations

import re
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sampleloom.dataset import ID, VALUES, Dataset
from sampleloom.session import checkpointed, materialised, partitions_for


def match(df: DataFrame, wanted: dict, strict: bool = True) -> DataFrame:
    """Rows that have one of the listed values in every named column.

    With ``strict`` a listed value that no row has raises. A NULL in the list
    matches NULL.
    """
    conditions = []
    for name, values in wanted.items():
        if name not in df.columns:
            raise KeyError(name)
        values = list(values) if isinstance(values, list | tuple | set) else [values]
        if strict:
            have = {r[0] for r in df.where(_among(name, values)).select(name).distinct().collect()}
            if missing := [v for v in values if v not in have]:
                raise ValueError(f"no {name} is {missing}")
        conditions.append(_among(name, values))
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def _among(name: str, values: list) -> Column:
    c = F.col(name).isin([v for v in values if v is not None])
    return c | F.col(name).isNull() if None in values else c


COMPARE = {"eq": "__eq__", "ne": "__ne__", "ge": "__ge__", "le": "__le__", "gt": "__gt__", "lt": "__lt__"}


def expression(df: DataFrame, text: str) -> Column:
    """Predicate ``ATTR OP VALUE [and|or ATTR OP VALUE]...``, folded strictly from left to right.

    OP is eq, ne, ge, le, gt or lt; the value is cast to the attribute's type,
    and raises if it can't be.
    """
    words = re.findall(r"'[^']*'|\"[^\"]*\"|\S+", text)
    if len(words) % 4 != 3:
        raise ValueError(f"not of the form ATTR OP VALUE [and|or ...]: {text}")
    result = None
    for i in range(0, len(words), 4):
        name, op, value = words[i : i + 3]
        kind = dict(df.dtypes)[name]
        if kind in ("double", "float") or kind.startswith("decimal"):
            typed = float(value)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            typed = int(value)
        else:
            typed = value.strip("'\"")
        p = getattr(F.col(name), COMPARE[op])(F.lit(typed))
        result = p if result is None else (result & p) if words[i - 1] == "and" else (result | p)
        if i and words[i - 1] not in ("and", "or"):
            raise ValueError(words[i - 1])
    return result


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the keys appear once."""
    renamed = right.select(*(F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)))
    return left.join(renamed, on, how).drop(*(f"_j{i}" for i in range(len(keys))))


def ranked(df: DataFrame, by: list[str], order: list, name: str = "pos", total: str | None = None) -> DataFrame:
    """With each row's place from 0 within its group, and ``_part``: a rank that no single task computes.

    The rows are range-partitioned by group and order and sorted, the one
    exchange of all rows. A row's number in its partition then tells its place
    among its group's rows there; the count of the group's rows in partitions
    before comes from a table of one row a group and partition. A group of any
    size is thus shared among tasks. ``total`` also gives the group's size.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(partitions_for(spark), *by, *order).sortWithinPartitions(*by, *order)
    # 33 bits of a row's number are its place in the partition, the others the partition
    ranged = checkpointed(ranged.withColumn("_row", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_part", F.shiftright("_row", 33).cast("int"))
    key = [*by, "_part"]
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    counts = ranged.groupBy(*key).agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    prior = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # written, so that its size is known when the join is planned
    table = materialised(counts.select(*key, (prior - F.col("_first")).alias("_before"), F.sum("_n").over(group).alias("_total")))
    joined = join_same(ranged, table, key)
    out = joined.withColumn(name, (F.col("_before") + F.col("_row")).cast("long"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.drop("_before", "_total", "_row")


def marked_changes(df: DataFrame, attrs: list[str], order: list, by: list[str]) -> DataFrame:
    """With ``_pos`` (place in the sequence), ``_new`` (1 where a run of equal attributes begins) and ``_run`` (its number from 0).

    Neighbours and numbers are found within range partitions and completed from
    a table of one row a sequence and partition, so a sequence of any length is
    shared among tasks.
    """
    r = ranked(df, by, order, "_pos")
    key = [*by, "_part"]
    value = F.struct(*(F.col(a).alias(f"a{i}") for i, a in enumerate(attrs)))
    local = W.partitionBy(*key).orderBy("_pos")
    group = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    lasts = r.groupBy(*key).agg(F.max_by(value, "_pos").alias("_last"))
    lasts = lasts.withColumn("_prior", F.lag("_last").over(group.orderBy("_part"))).drop("_last")
    r = join_same(r, lasts, key).withColumn("_prev", F.coalesce(F.lag(value).over(local), F.col("_prior")))
    r = r.withColumn("_new", F.when((F.col("_pos") == 0) | ~value.eqNullSafe(F.col("_prev")), 1).otherwise(0)).drop("_prev", "_prior")
    sums = r.groupBy(*key).agg(F.sum("_new").alias("_s"))
    sums = sums.withColumn("_sum", F.coalesce(F.sum("_s").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    r = join_same(r, sums, key)
    return r.withColumn("_run", F.col("_sum") + F.sum("_new").over(local.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_sum", "_part")


def positions(samples: DataFrame, order: list[str] | None = None) -> DataFrame:
    """With ``pos``: each sample's place from 0 in the order of its id."""
    return ranked(samples, [], order or [ID]).drop("_part")


def take_samples(samples: DataFrame, which) -> DataFrame:
    """Samples by place: an int, a list (order and repeats kept, ``place`` tells them), a mask column or a slice."""
    if isinstance(which, Column):
        return samples.where(which)
    if isinstance(which, str):
        return samples.where(expression(samples, which))
    at = positions(samples)
    if isinstance(which, int):
        which = [which]
    if isinstance(which, slice):
        n = None if all(x is None or x >= 0 for x in (which.start, which.stop)) and (which.step or 1) > 0 else at.count()
        start, stop, step = which.indices(n if n is not None else 1 << 62)
        if step < 0:
            raise ValueError("order is that of sample_id; a negative step would not show")
        return at.where((F.col("pos") >= start) & (F.col("pos") < stop) & ((F.col("pos") - start) % step == 0)).drop("pos")
    spark = samples.sparkSession
    table = spark.createDataFrame([(i, int(p)) for i, p in enumerate(which)], "place long, pos long")
    return at.join(table, "pos").drop("pos")


def keep_features(ds: Dataset, which) -> Dataset:
    """Features by id: the values in the order given, the feature table renumbered, the old ids in ``mapped_from``."""
    if isinstance(which, int):
        which = [which]
    if isinstance(which, slice):
        n = ds.features.count()
        which = range(n)[which]
    which = [int(i) for i in which]
    samples = ds.samples.withColumn(VALUES, F.array(*(F.col(VALUES)[i] for i in which)))
    features = None
    if ds.features is not None:
        new = ds.features.sparkSession.createDataFrame([(i, k) for k, i in enumerate(which)], "feature_id int, _new int")
        features = ds.features.join(F.broadcast(new), "feature_id").drop("feature_id").withColumnRenamed("_new", "feature_id")
    return replace(ds, samples=samples, features=features, attrs=ds.attrs | {"mapped_from": which})


def reverse_selection(samples: DataFrame, kept: list[int], n: int, filler: float = 0.0) -> DataFrame:
    """Back to ``n`` features: unselected ones hold ``filler``."""
    at = {f: i for i, f in enumerate(kept)}
    return samples.withColumn(VALUES, F.array(*(F.col(VALUES)[at[f]] if f in at else F.lit(float(filler)) for f in range(n))))


def invariant_features(long: DataFrame) -> DataFrame:
    """feature_id of the features that vary: smallest and largest value differ."""
    return long.groupBy("feature_id").agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo <> hi").select("feature_id")


def finite_features(long: DataFrame) -> DataFrame:
    """feature_id of the features that are finite (no NULL, NaN, infinity) in all samples."""
    fine = F.coalesce(~F.isnan("value") & (F.abs("value") < float("inf")), F.lit(False))
    return long.groupBy("feature_id").agg(F.bool_and(fine).alias("ok")).where("ok").select("feature_id")


def semi(long: DataFrame, features: DataFrame) -> DataFrame:
    return long.join(features, "feature_id", "left_semi")


def samples_by_attr(df: DataFrame, attr: str, values: list, sort: bool = True, key: str = ID) -> DataFrame:
    """Ids of the samples whose attribute is among ``values``, in order of id or of the values listed."""
    hit = df.where(F.col(attr).isin(values)).select(key, attr)
    order = [key] if sort else [F.array_position(F.array(*map(F.lit, values)), F.col(attr)), F.col(key)]
    return hit.orderBy(*order)


def strip_boundaries(df: DataFrame, attr: str, pre: int, post: int, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Without ``pre`` samples before and ``post`` after each change of an attribute along the order.

    ``by`` names the sequences to look at separately (such as a run).
    """
    by = by or []
    marked = marked_changes(df, [attr], order, by)
    # a change at place c drops the places c - pre to c + post - 1
    gone = marked.where("_new = 1 and _pos > 0").select(*by, F.explode(F.sequence(F.col("_pos") - pre, F.col("_pos") + post - 1)).alias("_pos")).distinct() if pre + post > 0 else None
    out = marked.drop("_new", "_run")
    if gone is not None:
        out = join_same(out, gone.withColumn("_gone", F.lit(True)), [*by, "_pos"], "left").where("_gone is null").drop("_gone")
    return out.drop("_pos")


def apply_selection(df: DataFrame, marker: str = "balanced_set") -> DataFrame:
    """Rows whose boolean marker is true, without the marker."""
    if dict(df.dtypes)[marker] != "boolean":
        raise ValueError(f"{marker} is not boolean")
    return df.where(F.col(marker)).drop(marker)


def sift(df: DataFrame, set_key: str, rules: list[tuple[str, dict]]) -> DataFrame:
    """Sets that pass all rules: ``(attr, {uvalues, balanced})``, each narrowing what the next sees.

    ``uvalues``: after narrowing to them, the set holds exactly these values.
    ``balanced``: whether all of them have equal counts.
    """
    narrowed, passing = df, df.select(set_key).distinct()
    for attr, rule in rules:
        values = list(rule["uvalues"])
        narrowed = narrowed.where(F.col(attr).isin(values))
        counts = narrowed.groupBy(set_key, attr).count()
        state = counts.groupBy(set_key).agg(F.count("*").alias("k"), (F.min("count") == F.max("count")).alias("even"))
        ok = F.col("k") == len(set(values))
        if "balanced" in rule:
            ok = ok & (F.col("even") == F.lit(bool(rule["balanced"])))
        passing = passing.join(state.where(ok), set_key, "left_semi")
    return df.join(passing, set_key, "left_semi")


def limit_filter(limit, name: str = "limit_group") -> Column:
    """What a ``limit`` means: None = one group, a column = its values, several = their combination, a dict = an OR of its matches."""
    if limit is None:
        return F.lit(True).alias(name)
    if isinstance(limit, str):
        return F.col(limit).alias(name)
    if isinstance(limit, dict):
        return reduce(lambda a, b: a | b, (F.col(k).isin(list(v) if isinstance(v, list | tuple | set) else [v]) for k, v in limit.items())).alias(name)
    return F.struct(*limit).alias(name)


def attribute_map(df: DataFrame, attr: str) -> DataFrame:
    """(attr, code): literal values numbered from 0 in sorted order."""
    # distinct labels: a dimension table
    return df.select(attr).where(F.col(attr).isNotNull()).distinct().withColumn("code", (F.row_number().over(W.orderBy(attr)) - 1).cast("long"))


def to_numeric(df: DataFrame, attr: str, mapping: DataFrame, strict: bool = True) -> DataFrame:
    """With ``code`` for the attribute; ``strict`` raises for values that the mapping lacks."""
    if strict and df.where(F.col(attr).isNotNull()).join(mapping, attr, "left_anti").limit(1).count():
        raise KeyError(f"values of {attr} are not in the mapping")
    return df.join(mapping, attr, "left")


def to_literal(df: DataFrame, code: str, mapping: DataFrame, attr: str, collisions: str | None = None) -> DataFrame:
    """Back to literals; codes of several literals raise, or give a list with ``tuple``, or one with ``lucky``."""
    pairs = mapping.groupBy("code").agg(F.array_sort(F.collect_set(attr)).alias("all"))
    if collisions is None and pairs.where(F.size("all") > 1).limit(1).count():
        raise ValueError("several literals share a code")
    value = F.col("all") if collisions == "tuple" else F.col("all")[0]
    return df.join(pairs.select(F.col("code").alias(code), value.alias(attr)), code, "left")
