"""The annotated matrix: samples with attributes, features with attributes, and attributes of the whole.

Three layouts hold the same matrix. *array*: one row a sample, its values in
``features`` (ARRAY<DOUBLE>, place = feature_id); good for sample-wise work.
*long*: (sample_id, feature_id, value); good for feature-wise work. *wide*: a
DOUBLE column for each feature; best for some dozens of features, as Catalyst
prunes and compiles it. ``sample_id`` gives the order of samples.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ID, VALUES = "sample_id", "features"


@dataclass(frozen=True)
class Dataset:
    """``samples`` in array layout, ``features`` (feature_id and attributes) and free-form ``attrs``."""

    samples: DataFrame
    features: DataFrame | None = None
    attrs: dict[str, Any] = field(default_factory=dict)

    # --- construction -------------------------------------------------
    @staticmethod
    def from_wide(df: DataFrame, key: str, columns: list[str], sa: dict[str, str | Column] | None = None, attrs: dict | None = None) -> Dataset:
        """From a table whose ``columns`` are the features; ``sa`` names sample attributes and their source."""
        spark = df.sparkSession
        chosen = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (sa or {}).items()]
        samples = df.select(F.col(key).alias(ID), *chosen, F.array(*(F.col(c).cast("double") for c in columns)).alias(VALUES))
        return Dataset(samples, spark.createDataFrame(list(enumerate(columns)), "feature_id int, name string"), attrs or {})

    @staticmethod
    def from_array(df: DataFrame, key: str, values: str, sa: dict[str, str | Column] | None = None, features: DataFrame | None = None) -> Dataset:
        chosen = [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in (sa or {}).items()]
        return Dataset(df.select(F.col(key).alias(ID), *chosen, F.transform(values, lambda x: x.cast("double")).alias(VALUES)), features)

    @staticmethod
    def from_long(df: DataFrame, sa: list[str] | None = None, features: DataFrame | None = None) -> Dataset:
        """From (sample_id, sa..., feature_id, value); the values come in order of feature_id."""
        cells = F.array_sort(F.collect_list(F.struct("feature_id", "value")))
        samples = df.groupBy(ID, *(sa or [])).agg(F.transform(cells, lambda c: c["value"]).alias(VALUES))
        return Dataset(samples, features)

    # --- layouts ------------------------------------------------------
    @property
    def sa(self) -> list[str]:
        return [c for c in self.samples.columns if c not in (ID, VALUES)]

    def long(self, sa: Iterable[str] | None = None) -> DataFrame:
        keep = self.sa if sa is None else list(sa)
        return self.samples.select(ID, *keep, F.posexplode(VALUES).alias("feature_id", "value"))

    def wide(self, n: int, prefix: str = "f") -> DataFrame:
        return self.samples.select(ID, *self.sa, *(F.col(VALUES)[i].alias(f"{prefix}{i}") for i in range(n)))

    # --- attributes ---------------------------------------------------
    def find_collection(self, name: str) -> str:
        """``sa``, ``fa`` or ``a``: where the attribute is, searched in that order."""
        if name in self.sa:
            return "sa"
        if self.features is not None and name in self.features.columns:
            return "fa"
        if name in self.attrs:
            return "a"
        raise KeyError(name)

    def get_attr(self, name: str):
        """The attribute called ``sa.x``, ``fa.x``, ``a.x`` or ``x``, and its collection."""
        where, _, plain = name.partition(".")
        if where not in ("sa", "fa", "a") or not plain:
            where, plain = self.find_collection(name), name
        if where == "a":
            return self.attrs[plain], where
        return (self.samples.select(ID, plain) if where == "sa" else self.features.select("feature_id", plain)), where

    def set_attr(self, name: str, value) -> Dataset:
        """With an attribute set; a plain value is the same for the whole axis."""
        where, _, plain = name.partition(".")
        column = value if isinstance(value, Column) else F.lit(value)
        if where == "sa":
            return replace(self, samples=self.samples.withColumn(plain, column))
        if where == "fa":
            return replace(self, features=self.features.withColumn(plain, column))
        return replace(self, attrs=self.attrs | {plain or where: value})

    def unique(self, name: str) -> DataFrame:
        """Distinct values of an attribute, sorted."""
        values, where = self.get_attr(name)
        plain = name.rpartition(".")[2]
        if where == "a":
            raise ValueError("attributes of the whole have one value")
        return values.select(plain).distinct().orderBy(plain)

    def copy(self, sa: list[str] | None = None, fa: list[str] | None = None, a: list[str] | None = None) -> Dataset:
        """With the named attributes only; None keeps all, an empty list none."""
        samples = self.samples if sa is None else self.samples.select(ID, *sa, VALUES)
        features = self.features if fa is None or self.features is None else self.features.select("feature_id", *fa)
        return Dataset(samples, features, dict(self.attrs) if a is None else {k: self.attrs[k] for k in a})

    def init_origids(self, which: str = "samples", mode: str = "new", attr: str = "origids") -> Dataset:
        """With unique ids of origin for samples, features or both."""
        out = self
        for axis, key in (("samples", "sa"), ("features", "fa")):
            if which not in (axis, "both"):
                continue
            table, key_column = (out.samples, ID) if key == "sa" else (out.features, "feature_id")
            if attr in table.columns:
                if mode == "raise":
                    raise ValueError(f"{axis} have {attr} already")
                if mode == "existing":
                    continue
            out = out.set_attr(f"{key}.{attr}", F.concat(F.lit(axis[0] + "-"), F.col(key_column).cast("string")))
        return out

    # --- selection ----------------------------------------------------
    def select(self, sadict: dict | None = None, fadict: dict | None = None, strict: bool = True) -> Dataset:
        """Samples and features whose attributes have one of the listed values, for all listed attributes."""
        from sampleloom.operators.select import keep_features, match

        if sadict is None and fadict is None:
            raise ValueError("give sadict, fadict or both")
        out = self
        if sadict is not None:
            out = replace(out, samples=match(out.samples, sadict, strict))
        if fadict is not None:
            chosen = match(self.features, fadict, strict).select("feature_id").orderBy("feature_id")
            # the feature axis is a dimension table: its ids are the schema of the values
            out = keep_features(out, [r[0] for r in chosen.collect()])
        return out

    def __getitem__(self, key) -> Dataset:
        from sampleloom.operators.select import keep_features, take_samples

        rows, columns = key if isinstance(key, tuple) else (key, None)
        out = self
        if isinstance(rows, dict):
            out = out.select(rows)
        elif not (isinstance(rows, slice) and rows == slice(None)):
            out = replace(out, samples=take_samples(out.samples, rows))
        if isinstance(columns, dict):
            out = out.select(None, columns)
        elif columns is not None and not (isinstance(columns, slice) and columns == slice(None)):
            out = keep_features(out, columns)
        return out

    def get_mapped(self, mapper) -> Dataset:
        """Through a mapper, which is kept in ``attrs['mapper']`` for the way back."""
        done = mapper(self)
        return replace(done, attrs=done.attrs | {"mapper": [*self.attrs.get("mapper", []), mapper]})

    # --- storage ------------------------------------------------------
    def save(self, path: str, mode: str = "error", compression: str = "zstd") -> None:
        """As Parquet tables of samples and features with a JSON side file."""
        self.samples.write.mode(mode).option("compression", compression).parquet(f"{path}/samples")
        if self.features is not None:
            self.features.write.mode(mode).option("compression", compression).parquet(f"{path}/features")
        spark = self.samples.sparkSession
        plain = {k: v for k, v in self.attrs.items() if isinstance(v, str | int | float | bool | list | dict | None)}
        has = json.dumps({"attrs": plain, "features": self.features is not None}, default=str)
        spark.createDataFrame([(has,)], "value string").coalesce(1).write.mode(mode).text(f"{path}/attrs")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Dataset:
        side = json.loads(spark.read.text(f"{path}/attrs", wholetext=False).first()[0])
        features = spark.read.parquet(f"{path}/features") if side["features"] else None
        return Dataset(spark.read.parquet(f"{path}/samples"), features, side["attrs"])

    @staticmethod
    def from_npz(spark: SparkSession, path: str) -> Dataset:
        """From an archive of arrays: ``samples``, ``sa.x``, ``fa.x`` and ``a.x``. For files that one machine holds."""
        with np.load(path, allow_pickle=False) as f:
            data = {k: f[k] for k in f.files}
        matrix = np.atleast_2d(data["samples"].astype(float))
        sa = {k[3:]: v.tolist() for k, v in data.items() if k.startswith("sa.")}
        fa = {k[3:]: v.tolist() for k, v in data.items() if k.startswith("fa.")}
        rows = [(i, *(v[i] for v in sa.values()), row.tolist()) for i, row in enumerate(matrix)]
        samples = spark.createDataFrame(rows, [ID, *sa, VALUES])
        features = spark.createDataFrame([(i, *(v[i] for v in fa.values())) for i in range(matrix.shape[1])], ["feature_id", *fa])
        return Dataset(samples, features, {k[2:]: v.tolist() for k, v in data.items() if k.startswith("a.")})

    def to_npz(self, path: str) -> None:
        """As an archive of arrays; for matrices that one machine holds."""
        pdf = self.samples.orderBy(ID).toPandas()
        out = {"samples": np.array(pdf[VALUES].tolist(), float)} | {f"sa.{c}": pdf[c].to_numpy().astype(str) if pdf[c].dtype == object else pdf[c].to_numpy() for c in self.sa}
        if self.features is not None:
            fa = self.features.orderBy("feature_id").toPandas()
            out |= {f"fa.{c}": fa[c].to_numpy().astype(str) if fa[c].dtype == object else fa[c].to_numpy() for c in fa.columns}
        np.savez_compressed(path, **out)

    def to_pandas(self, sas: list[str] | None = None):
        """Wide pandas frame, rows indexed by the (named) sample attributes as text."""
        import pandas as pd

        pdf = self.samples.orderBy(ID).toPandas()
        index = pd.MultiIndex.from_arrays([pdf[c].astype(str) for c in sorted(sas or [ID, *self.sa])], names=sorted(sas or [ID, *self.sa]))
        return pd.DataFrame(np.array(pdf[VALUES].tolist(), float), index=index)
