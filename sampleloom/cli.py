"""Command line: ``python -m sampleloom.cli COMMAND ...`` on Parquet datasets."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampleloom.operators import errors as er
from sampleloom.operators import generators as ge
from sampleloom.operators import inference as inf
from sampleloom.operators import learners as le
from sampleloom.operators import mappers
from sampleloom.operators import ordered as od
from sampleloom.operators import select as se
from sampleloom.operators import stack as st
from sampleloom.plans import pipelines as pl


def partition_specs(text: str, df: DataFrame, chunk: str) -> list:
    """``oddeven``, ``half``, ``group-N`` or ``n-N``; ``:attr`` names another attribute."""
    name, _, attr = text.partition(":")
    values = ge.uniques(df, attr or chunk)
    if name == "oddeven":
        return ge.odd_even(values)
    if name == "half":
        return ge.halves(values)
    kind, _, n = name.partition("-")
    if kind == "group":
        return ge.n_groups([(r[0], r[1]) for r in df.groupBy(attr or chunk).count().collect()], int(n))
    if kind == "n":
        return ge.n_fold(values, float(n) if "." in n else int(n))
    raise ValueError(f"unknown partitioner {text}")


def error_function(name: str):
    return er.ERRORS[name]


def load(spark: SparkSession, paths: list[str]) -> DataFrame:
    return st.vstack([spark.read.parquet(p) for p in paths])


def make_dataset(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """Samples in array layout from a table with header, an archive of arrays, LightSVM lines or an image."""
    from sampleloom.dataset import Dataset
    from sampleloom.sources import images, text

    (path,) = args.input
    if args.form == "npz":
        return Dataset.from_npz(spark, path).samples
    if args.form == "svm":
        rows = text.light_svm(spark, path).withColumnRenamed("label", "targets")
        return se.ranked(rows.withColumn("_id", F.monotonically_increasing_id()), [], ["_id"], "sample_id").drop("_id", "_part")
    if args.form == "nifti":
        cells, _ = images.image_dataset(spark, path)
        return Dataset.from_long(cells, ["time_coords"]).samples
    table = text.inferred(spark, path)
    attrs = {n: c for n, c in (("targets", args.targets), ("chunks", args.chunks)) if c and c in table.columns}
    return Dataset.from_wide(table, args.key, args.features, attrs).samples


def searchlight(args: argparse.Namespace, df: DataFrame) -> DataFrame:
    """A measure around every voxel of a grid of ``--shape``, within ``--radius``: naive Bayes, nearest means or plain means."""
    from sampleloom.dataset import Dataset
    from sampleloom.operators import neighborhood as ne

    grid = mappers.flat_coordinates(df.sparkSession, tuple(args.shape), [f"d{i}" for i in range(len(args.shape))])
    near = ne.neighbours(grid, [f"d{i}_indices" for i in range(len(args.shape))], args.radius)
    long = Dataset(df).long([c for c in (args.targets, args.chunks) if c])
    if args.measure == "mean":
        return ne.mean_searchlight(long, near)
    return {"gnb": ne.gnb_searchlight, "m1nn": ne.m1nn_searchlight}[args.measure](long, near, args.targets, args.chunks)


def hyperalign(args: argparse.Namespace, spark: SparkSession) -> DataFrame:
    """(subject, i, j, w): projections of several datasets, one an input, to their common space."""
    parts = [spark.read.parquet(p).select(F.lit(0).alias("group"), F.lit(i).alias("subject"), args.key, "features") for i, p in enumerate(args.input)]
    return mappers.hyperalign_groups(reduce(DataFrame.unionByName, parts), "group", "subject", key=args.key).drop("group")


def cross_validate(args: argparse.Namespace, df: DataFrame) -> DataFrame:
    """Errors by fold of any model of the registry on samples in array layout, or of naive Bayes on columns."""
    error = error_function(args.errorfx)
    if args.learner:
        from sampleloom.functions.models import REGISTRY

        make = REGISTRY[args.learner][1]
        return le.cross_validate(df, make, args.targets, args.chunks, {"error": error}, key=args.key)
    if args.permutations:
        return pl.permutation_test(df, args.key, args.features, args.targets, args.chunks, args.permutations)
    p = le.wide_gnb_folds(df, args.key, args.features, args.targets, args.chunks)
    return p.groupBy("fold").agg(error("prediction", "target").alias("error"))


def run(args: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    if args.command == "info":
        from sampleloom.functions.models import REGISTRY

        return spark.createDataFrame([(n, sorted(t)) for n, (t, _) in REGISTRY.items()], "model string, tags array<string>")
    if args.command == "mkds":
        return make_dataset(args, spark)
    if args.command == "hyperalign":
        return hyperalign(args, spark)
    df = load(spark, args.input)
    if args.command == "select":
        return pl.select_rows(df, args.samples, args.start, args.stop, args.step, args.drop)
    if args.command == "preproc":
        return pl.preprocess(df, args.key, args.value, args.chunks, args.position)
    if args.command == "describe":
        return df.describe()
    if args.command == "dump":
        pl.dump(df, args.output, args.form)
        return None
    if args.command == "ttest":
        return inf.ttest(df, args.by, args.value, args.mean, args.alternative)
    if args.command == "mkevds":
        return od.find_events(df, args.attrs, [args.key], args.by)
    if args.command == "crossval":
        return cross_validate(args, df)
    if args.command == "searchlight":
        return searchlight(args, df)
    if args.command == "atlas":
        from sampleloom.operators import neighborhood as ne

        return ne.label_points(df, spark.read.parquet(args.atlas), args.attrs)
    if args.command == "exec":
        # a script of the user's own, with the input as ``df``; what it leaves there is the result
        names = {"df": df, "spark": spark, "F": F}
        with open(args.script) as f:
            exec(compile(f.read(), args.script, "exec"), names)  # noqa: S102
        return names["df"]
    raise ValueError(args.command)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sampleloom", description=__doc__)
    p.add_argument("command", choices=["mkds", "select", "preproc", "describe", "dump", "ttest", "mkevds", "crossval", "searchlight", "hyperalign", "atlas", "exec", "info"])
    p.add_argument("-i", "--input", nargs="+", default=[])
    p.add_argument("-o", "--output")
    p.add_argument("--key", default="sample_id")
    p.add_argument("--value", default="value")
    p.add_argument("--by", nargs="*", default=[])
    p.add_argument("--attrs", nargs="*", default=[])
    p.add_argument("--features", nargs="*", default=[])
    p.add_argument("--targets", default="targets")
    p.add_argument("--chunks")
    p.add_argument("--position")
    p.add_argument("--samples")
    p.add_argument("--drop", nargs="*")
    p.add_argument("--form", default="txt")
    p.add_argument("--errorfx", default="mean_mismatch_error")
    p.add_argument("--alternative", default="two-sided")
    p.add_argument("--permutations", type=int, default=0)
    p.add_argument("--mean", type=float, default=0.0)
    p.add_argument("--learner", help="a model's name, see info")
    p.add_argument("--measure", default="gnb", choices=["gnb", "m1nn", "mean"])
    p.add_argument("--shape", nargs="*", type=int, default=[])
    p.add_argument("--radius", type=float, default=1.0)
    p.add_argument("--atlas")
    p.add_argument("--script")
    for n in ("start", "stop", "step"):
        p.add_argument(f"--{n}", type=int)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    out = run(args, spark)
    if out is not None:
        if args.output:
            out.write.mode("overwrite").parquet(args.output)
        else:
            out.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
