import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom import cli
from sampleloom.functions import generate as gen
from sampleloom.functions.distance import linear, squared_euclidean
from sampleloom.operators import ordered as od
from sampleloom.plans import pipelines as pl


@pytest.fixture(scope="module")
def wide(spark):
    df = gen.normal_features(spark, 60, 2, 3, 4, 6.0, seed=1)
    return df.select("sample_id", "targets", "chunks", *(F.col("features")[i].alias(f"f{i}") for i in range(3))).cache()


def test_permutation_test(wide):
    r = pl.permutation_test(wide, "sample_id", ["f0", "f1", "f2"], "targets", "chunks", 19).first()
    assert r.error < 0.3 and r.p < 0.1
    noise = wide.withColumn("f0", F.rand(1)).withColumn("f1", F.rand(2)).withColumn("f2", F.rand(3))
    assert pl.permutation_test(noise, "sample_id", ["f0", "f1", "f2"], "targets", "chunks", 19).first().p > 0.05


def test_balanced(wide):
    assert pl.balanced_cv(wide, "sample_id", ["f0", "f1"], "targets", "chunks", 2).count() == 8


def test_clusters(spark):
    grid = spark.createDataFrame([(i * 6 + j, i, j) for i in range(6) for j in range(6)], "feature_id int, x int, y int")
    rng = np.random.default_rng(0)
    maps = spark.createDataFrame([(c * 10 + s, c, f, float(v)) for c in range(5) for s in range(6) for f, v in enumerate(rng.normal(size=36))], "sample_id int, chunk int, feature_id int, value double")
    on = {0, 1, 6, 7, 12}
    observed = spark.createDataFrame([(f, 10.0 if f in on else -10.0) for f in range(36)], "feature_id int, value double")
    for correction in ("fdr", "fwe"):
        rows = pl.cluster_threshold(observed, maps, "chunk", grid, ["x", "y"], 40, 0.05, correction=correction).collect()
        assert len(rows) == 1 and rows[0]["size"] == 5 and rows[0].p < 0.05 and rows[0].p_corrected < 0.1


def test_event_model(spark):
    times = spark.createDataFrame([("r", float(t)) for t in range(0, 200, 2)], "run string, t double")
    events = spark.createDataFrame([(i, "r", 5.0 + 20 * i, 4.0, "ab"[i % 2]) for i in range(9)], "event_id int, run string, onset double, duration double, c string")
    x = od.hrf_design(times, events, ["run"], "t", "c").groupBy("run", "t").agg(F.sum(F.when(F.col("c") == "a", 3.0).otherwise(-1.0) * F.col("x")).alias("y"))
    y = times.join(x, ["run", "t"], "left").na.fill(0.0)
    fit = pl.event_model(y, events, ["run"], "t", "y", "c")
    b = {r.name: r.beta for r in fit.collect()}
    assert abs(b["a"] - 3) < 1e-6 and abs(b["b"] + 1) < 1e-6
    assert abs(pl.contrast(fit, ["run"], {"a": 1.0, "b": -1.0}).first().effect - 4) < 1e-6


def test_alignment_and_connectivity(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(30, 4))
    rows = [(s, i, f, float((base @ gen.random_rotation(4, s))[i, f])) for s in range(3) for i in range(30) for f in range(4)]
    c = spark.createDataFrame(rows, "subject int, sample_id int, feature_id int, value double")
    near = spark.createDataFrame([(0, f) for f in range(4)], "center_id int, feature_id int")
    proj = pl.searchlight_alignment(c, near)
    assert proj.count() == 3 * 16
    out = pl.apply_alignment(od.zscore_long(c, "subject"), proj).groupBy("sample_id", "feature_id").agg(F.stddev_pop("value").alias("s"))
    assert out.agg(F.avg("s")).first()[0] < 0.35
    k = pl.connectivity_cells(c, spark.createDataFrame([(0, 0)], "seed_id int, feature_id int"))
    assert k.count() == 12 and k.agg(F.max(F.abs("value"))).first()[0] <= 1.0 + 1e-9


def test_kernels_and_regression(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, float(i * i)]) for i in range(5)], "k int, features array<double>")
    m = pl.kernel_matrix(df, "k", linear)
    assert pl.kernel_slice(m, df.where("k < 2"), df, "k").count() == 10
    with pytest.raises(KeyError):
        pl.kernel_slice(m, df.select((F.col("k") + 3).alias("k")), df, "k")
    from sampleloom.operators.measures import pdist

    d = pdist(df, "k", squared_euclidean)
    b = {r.name: r.beta for r in pl.dsm_regression(d, {"same": d}, rank=True).collect()}
    assert abs(b["same"] - 1) < 1e-9


def test_preprocess_and_tools(spark, tmp_path):
    df = spark.createDataFrame([("a", i, 2.0 * i + (i % 2)) for i in range(20)] + [("b", i, 1.0) for i in range(5)], "chunk string, k int, v double")
    out = pl.preprocess(df, "k", "v", "chunk", "k")
    assert out.select("chunk").distinct().count() == 1 and abs(out.agg(F.stddev_pop("v")).first()[0] - 1) < 1e-9
    assert pl.preprocess(df, "k", "v", "chunk", "k", smooth=([0.5, 0.5], [1.0])).count() == 20
    assert pl.motion_summary(df.withColumn("w", F.col("v")), ["chunk"], ["v", "w"]).count() == 4
    p = pl.curve_fit(spark.range(2000).select(F.randn(1).alias("x")), "x", lambda q, t: q[0] * np.exp(-((t - q[1]) ** 2) / (2 * q[2] ** 2)), [100.0, 0.1, 2.0])
    assert abs(abs(p[2]) - 1) < 0.25
    with pytest.raises(ValueError):
        pl.transfer(df.limit(0), df, lambda x: x, lambda m, x: x)


def test_command_line(spark, wide, tmp_path):
    wide.write.parquet(str(tmp_path / "in"))
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cli.main(["select", "-i", src, "-o", out, "--samples", "targets eq L0 and chunks lt 2", "--drop", "f2"])
    got = spark.read.parquet(out)
    assert got.count() == 30 and "f2" not in got.columns
    cli.main(["crossval", "-i", src, "-o", out, "--features", "f0", "f1", "--chunks", "chunks"])
    assert spark.read.parquet(out).count() == 4
    for extra in (["crossval", "--features", "f0", "--chunks", "chunks", "--permutations", "3"], ["describe"], ["ttest", "--by", "targets", "--value", "f0"], ["mkevds", "--attrs", "targets", "--by", "chunks"], ["preproc", "--value", "f0", "--chunks", "chunks", "--position", "sample_id"]):
        cli.main([extra[0], "-i", src, "-o", out, *extra[1:]])
        assert spark.read.parquet(out).count() > 0
    cli.main(["info", "-o", out])
    cli.main(["dump", "-i", src, "-o", str(tmp_path / "txt"), "--form", "csv"])
    for text, n in (("oddeven", 2), ("half", 2), ("group-2", 2), ("n-1", 4), ("n-2:chunks", 6)):
        assert len(cli.partition_specs(text, wide, "chunks")) == n


def test_winding_clusters_stay_whole(spark):
    from sampleloom.operators import inference as inf

    rng = np.random.default_rng(0)
    for order in ([0, *range(99, 0, -1)], rng.permutation(1000).tolist()):
        edges = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "a long, b long")
        rows = inf.connected(edges, spark.range(len(order) + 1).withColumnRenamed("id", "node")).groupBy("cluster").count().collect()
        assert {tuple(r) for r in rows} == {(0, len(order)), (len(order), 1)}
    with pytest.raises(RuntimeError):
        inf.connected(edges, spark.range(1000).withColumnRenamed("id", "node"), most=1)
