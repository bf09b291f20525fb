"""Writers: LightSVM lines, column files, exclusion logs, full grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sampleloom.operators.generators import uniques


def svm_labels(df: DataFrame, label: str, domain: str | None = None) -> tuple[DataFrame, dict | None]:
    """With ``_label`` as LightSVM wants it: numbers for regression, -1 / +1 for two classes, else 1 to n; and the mapping."""
    kind = dict(df.dtypes)[label]
    if domain is None:
        domain = "regression" if kind in ("double", "float") else None
    if domain == "regression":
        return df.withColumn("_label", F.col(label).cast("string")), None
    values = uniques(df, label)
    domain = domain or ("binary" if len(values) == 2 else "multiclass")
    codes = dict(zip(values, (-1, 1) if domain == "binary" else range(1, len(values) + 1), strict=True))
    mapping = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    return df.withColumn("_label", mapping[F.col(label)].cast("string")), codes


def svm_line(values: str = "features", label: Column | str = "_label") -> Column:
    cells = F.transform(values, lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x.cast("string")))
    return F.concat_ws(" ", F.col(label) if isinstance(label, str) else label, F.array_join(cells, " "))


def write_light_svm(df: DataFrame, path: str, label: str, values: str = "features", domain: str | None = None) -> dict | None:
    named, codes = svm_labels(df, label, domain)
    named.select(svm_line(values).alias("value")).write.text(path)
    return codes


def write_columns(df: DataFrame, path: str, sep: str = " ", header: bool = True, order: list[str] | None = None) -> None:
    df.select(*(order or df.columns)).write.csv(path, sep=sep, header=header)


def log_exclusions(df: DataFrame, path: str, marker: str = "balanced_set", append: bool = True) -> DataFrame:
    """Writes the rows whose marker is false; gives the table unchanged."""
    if dict(df.dtypes)[marker] != "boolean":
        raise ValueError(f"{marker} is not boolean")
    df.where(~F.col(marker)).write.mode("append" if append else "overwrite").json(path)
    return df


def full_grid(values: DataFrame, shape: tuple[int, int, int], filler: float = 0.0, value: str = "value") -> DataFrame:
    """Every voxel (i, j, k) of a volume, absent ones with ``filler``: what an image writer needs."""
    n = shape[0] * shape[1] * shape[2]
    grid = values.sparkSession.range(n).selectExpr(f"cast(id div {shape[1] * shape[2]} as int) i", f"cast((id div {shape[2]}) % {shape[1]} as int) j", f"cast(id % {shape[2]} as int) k")
    return grid.join(values, ["i", "j", "k"], "left").withColumn(value, F.coalesce(value, F.lit(float(filler))))


def niml_text(df: DataFrame, labels: list[str], stats: list[str], node: str = "node", values: str = "values") -> str:
    """A NIML dataset in text form, of a surface's data that one machine holds."""
    rows = df.orderBy(node).select(node, values).collect()
    data = "\n".join(" ".join(f"{v:.10g}" for v in r[1]) for r in rows)
    index = "\n".join(str(r[0]) for r in rows)
    atr = lambda name, x: f'<AFNI_atr atr_name="{name}" ni_type="String" ni_dimen="1" >\n"{";".join(x)}"\n</AFNI_atr>\n'
    return (
        '<AFNI_dataset dset_type="Node_Bucket" ni_form="ni_group" >\n'
        f'<SPARSE_DATA data_type="Node_Bucket_data" ni_type="{len(labels)}*float" ni_dimen="{len(rows)}" >\n{data}\n</SPARSE_DATA>\n'
        f'<INDEX_LIST data_type="Node_Bucket_node_indices" ni_type="int" ni_dimen="{len(rows)}" >\n{index}\n</INDEX_LIST>\n' + atr("COLMS_LABS", labels) + atr("COLMS_STATSYM", stats) + "</AFNI_dataset>\n"
    )


def safe_write(df: DataFrame, path: str) -> None:
    """Parquet that is there as a whole or not at all: written beside its place and put there by renaming; what was there goes."""
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    beside, place = fs_path(path.rstrip("/") + ".part"), fs_path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(beside.toString())
    fs.delete(place, True)
    if not fs.rename(beside, place):
        raise OSError(f"{beside} can't be renamed")
