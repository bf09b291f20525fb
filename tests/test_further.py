import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom import cli
from sampleloom.functions import generate as gen
from sampleloom.functions import small
from sampleloom.operators import errors as er
from sampleloom.operators import inference as inf
from sampleloom.operators import mappers as ma
from sampleloom.operators import neighborhood as ne
from sampleloom.operators import ordered as od
from sampleloom.sources import images, text


def test_images_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(3, 4, 2, 5))
    (tmp_path / "a.nii").write_bytes(images.nifti_bytes(x, (2.0, 2.0, 3.0, 2.5)))
    (tmp_path / "b.nii.gz").write_bytes(images.nifti_bytes(x[..., 0], compressed=True))
    got = images.nifti(spark, str(tmp_path / "a.nii")).collect()
    assert len(got) == x.size and all(abs(x[r.i, r.j, r.k, r.t] - r.value) < 1e-12 for r in got)
    assert images.nifti(spark, str(tmp_path / "b.nii.gz")).count() == 24
    head = images.image_headers(spark, str(tmp_path / "a.nii")).first()
    assert head["shape"] == [3, 4, 2, 5] and head["sizes"] == [2.0, 2.0, 3.0, 2.5]
    mask = spark.createDataFrame([(0, 0, 0), (2, 3, 1)], "i int, j int, k int")
    cells, features = images.image_dataset(spark, str(tmp_path / "a.nii"), mask, spark.createDataFrame([(0, "x")], "sample_id long, targets string"))
    assert features.count() == 2 and cells.count() == 10 and {r.time_coords for r in cells.collect()} == {0.0, 2.5, 5.0, 7.5, 10.0}
    images.write_nifti(images.nifti(spark, str(tmp_path / "a.nii"), mask), str(tmp_path / "c.nii"), (3, 4, 2))
    back = {(r.i, r.j, r.k, r.t): r.value for r in images.nifti(spark, str(tmp_path / "c.nii")).collect()}
    assert back[0, 0, 0, 1] == x[0, 0, 0, 1] and back[1, 0, 0, 0] == 0
    (tmp_path / "bad.nii").write_bytes(b"0" * 400)
    with pytest.raises(Exception, match="NIfTI"):
        images.nifti(spark, str(tmp_path / "bad.nii")).count()


def test_wavelets_invert_and_keep_energy():
    x = np.random.default_rng(1).normal(size=64)
    for w in od.SCALING:
        h = np.array(od.SCALING[w])
        assert abs((h**2).sum() - 1) < 1e-12 and abs(h.sum() - math.sqrt(2)) < 1e-12
        parts = od.wavelet_transform(x, w, 3)
        assert np.allclose(od.wavelet_inverse(parts, w), x) and abs(sum((p**2).sum() for p in parts) - (x**2).sum()) < 1e-9
        assert abs((od.wavelet_packet(x, w, 2) ** 2).sum() - (x**2).sum()) < 1e-9
    # two vanishing moments: a straight line has no detail but at the seam
    assert np.abs(od.dwt_step(np.arange(32.0), "db2")[1][:-1]).max() < 1e-9


def test_probability_of_correlation(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=50)
    df = spark.createDataFrame([(float(x), float(0.5 * x + e)) for x, e in zip(a, rng.normal(size=50), strict=True)], "p double, t double")
    row = er.corr_error_probability(df, "p", "t").first()
    r = np.corrcoef(a, [x.t for x in df.collect()])[0, 1]
    t = abs(r) * math.sqrt(48 / (1 - r * r))
    u = np.linspace(t, t + 200, 2_000_001)
    dens = (1 + u * u / 48) ** -24.5 * math.gamma(24.5) / (math.sqrt(48 * math.pi) * math.gamma(24))
    assert abs(row.r - r) < 1e-9 and abs(row.p - 2 * np.trapezoid(dens, u)) < 1e-6
    assert er.corr_error_probability(df.limit(1), "p", "t").first().p == 1.0


def test_errors_of_models_and_tables(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "sample_id long, target int")
    e = er.classifier_error(df, df, lambda d: 1, lambda m, d: d.withColumn("prediction", F.lit(m)), "target").first().error
    counts = er.confusion(df.withColumn("prediction", F.lit(1)), "prediction", "target")
    assert abs(e - 2 / 3) < 1e-9 and abs(er.confusion_error(counts).first().error - e) < 1e-9
    assert er.confusion_error(counts.limit(0)).first().error is None


def test_null_distributions(spark):
    draws = spark.createDataFrame([(0, float(x)) for x in np.random.default_rng(3).normal(2, 3, 4000)], "e int, value double")
    seen = spark.createDataFrame([(0, 11.0), (0, 2.0)], "e int, value double")
    p = {r.value: r.p for r in inf.auto_null("normal")(seen, draws, ["e"]).collect()}
    assert abs(p[11.0] - math.erfc(3 / math.sqrt(2))) < 1e-3 and p[2.0] > 0.9
    held = {r.value: r.p for r in inf.auto_null("normal", loc=2.0, scale=9.0)(seen, draws, ["e"]).collect()}
    assert abs(held[11.0] - math.erfc(1 / math.sqrt(2))) < 1e-9
    assert inf.auto_null(None) is None and {r.value for r in inf.auto_null("rdist", n=12)(seen, draws, ["e"]).collect()} == {11.0, 2.0}
    with pytest.raises(ValueError):
        inf.auto_null("what")
    x = np.random.default_rng(4).exponential(2.0, 500) + 1
    assert abs(inf.semifrozen("expon", x, loc=1.0)(3.0) - (1 - math.exp(-1))) < 0.05
    assert inf.semifrozen("norm", x, loc=0.0, scale=1.0)(0.0) == 0.5 and inf.semifrozen("uniform", np.array([0.0, 4.0]))(1.0) == 0.25
    nodes = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, cluster long")
    v = inf.repeat_cluster_values(spark.createDataFrame([(1, 0.5), (3, 0.1)], "cluster long, p double"), nodes, "p")
    assert {(r.node, r.p) for r in v.collect()} == {(1, 0.5), (2, 0.5), (3, 0.1)}


def test_local_transforms_and_responses(spark):
    df = spark.createDataFrame([(i, np.eye(6)[i].tolist()) for i in range(6)] + [(6, [0.0] * 6)], "sample_id long, features array<double>")
    near = spark.createDataFrame([(c, f) for c in (0, 1, 2) for f in (2 * c, 2 * c + 1)], "center_id int, feature_id int")
    rows = {r.sample_id: np.array(r.features) for r in gen.local_random_affine(df, near, 6, shift=0.5, seed=1).collect()}
    m = np.array([rows[i] - rows[6] for i in range(6)])
    for c in range(3):
        block = m[2 * c : 2 * c + 2, 2 * c : 2 * c + 2]
        assert np.allclose(block @ block.T, np.eye(2) * (block @ block.T)[0, 0])
        m[2 * c : 2 * c + 2, 2 * c : 2 * c + 2] = 0
    assert np.allclose(m, 0) and np.abs(rows[6]).max() <= 0.5
    ev = spark.createDataFrame([("a", 10.0, 2.0, "x")], "run string, onset double, duration double, condition string")
    y = gen.response_dataset(spark, ev, ["run"], 2.0, 60.0, 100.0, 5.0, 0.0).orderBy("time_coords").toPandas()
    assert len(y) == 30 and (y["noise"] == 100).all() and 14 <= y["time_coords"][y["value"].idxmax()] <= 18 and abs(y["value"][0] - 100) < 1e-9


def test_small_functions(spark):
    df = spark.createDataFrame([(1, [True, False, True, False]), (2, [False] * 4), (3, [True, True, False, True]), (4, [False, True, False, False])], "k int, m array<boolean>")
    got = {r.k: r.s for r in df.select("k", small.mask_slice("m").alias("s")).collect()}
    assert tuple(got[1]) == (0, 3, 2) and tuple(got[2]) == (0, 0, 1) and got[3] is None and tuple(got[4]) == (1, 2, 1)
    assert small.version_tuple("1.10rc2") == (1, 10, "rc", 2)
    v = spark.createDataFrame([([1.0, None, 3.0],)], "v array<double>")
    assert v.select(small.where_equal("v", None).alias("a"), small.one_minus_each("v").alias("b")).first() == ([1], [0.0, None, -2.0])
    nested = spark.createDataFrame([([[1, 2], [3, 4]],)], "v array<array<int>>")
    assert nested.select(ma.add_axis("v", 0, 2).alias("a"), ma.add_axis("v", 1, 2).alias("b"), ma.add_axis("v", 2, 2).alias("c")).first() == ([[[1, 2], [3, 4]]], [[[1, 2]], [[3, 4]]], [[[1], [2]], [[3], [4]]])


def test_neighbourhoods_are_stored(spark, tmp_path):
    made = []
    grid = ma.flat_coordinates(spark, (3, 3), ["x", "y"])
    make = lambda: made.append(1) or ne.neighbours(grid, ["x_indices", "y_indices"], 1.0)
    a, b = (ne.stored_neighbours(spark, str(tmp_path / "near"), make).count() for _ in range(2))
    assert a == b == 33 and len(made) == 1


def test_fir_equals_both_passes(spark):
    rng = np.random.default_rng(5)
    series = {"a": rng.normal(size=500), "b": rng.normal(size=30), "c": rng.normal(size=3)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in series.items() for i, v in enumerate(x)], "s string, n long, x double").repartition(5)
    taps = [0.1, 0.2, 0.4, 0.2, 0.1]
    got = {}
    for r in od.zero_phase_fir(df, ["s"], "n", "x", taps, block=64).collect():
        got.setdefault(r.s, {})[r.pos] = r.value
    for k in "ab":
        assert np.allclose([got[k][i] for i in range(len(series[k]))], od.filtfilt(taps, [1.0], series[k]))
    assert [got["c"][i] for i in range(3)] == series["c"].tolist()


def test_detrend_with_regressors(spark):
    rng = np.random.default_rng(6)
    n = 400
    r, y = rng.normal(size=n), rng.normal(size=n)
    x = od.legendre(n, 3)
    full = y + x @ [1, 2, -3, 0.5] + 4 * r
    df = spark.createDataFrame([("g", i, float(full[i]), float(r[i])) for i in range(n)] + [("one", 0, 7.0, 1.0)], "g string, i long, v double, r double").repartition(4)
    got = {(q.g, q.i): q.v for q in od.detrend(df, ["v"], "i", ["g"], 3, ["r"]).collect()}
    a = np.column_stack([x, r])
    want = full - a @ np.linalg.lstsq(a, full, rcond=None)[0]
    assert np.allclose([got["g", i] for i in range(n)], want, atol=1e-8) and abs(got["one", 0]) < 1e-9


def test_events_of_any_length_cover(spark):
    pts = spark.createDataFrame([("r", float(t)) for t in range(0, 2000, 7)], "run string, t double")
    spans = spark.createDataFrame([("r", 3.0, 9.0, 1), ("r", 0.0, 1e12, 2), ("r", 500.0, 900.5, 3), ("r", 5.0, 5.0, 4), ("q", 0.0, 1e9, 5)], "run string, a double, b double, k int")
    got = {(r.t, r.k) for r in od.covering(pts, spans, ["run"], "t", "a", "b", 2.0).collect()}
    assert got == {(p.t, s.k) for p in pts.collect() for s in spans.collect() if p.run == s.run and s.a <= p.t < s.b}
    assert od.covering(pts, spans.limit(0), ["run"], "t", "a", "b", 2.0).count() == 0


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(1, 5001)))
    (tmp_path / "b.txt").write_text("x\n\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = text.raw_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {(r.line_no, r.line) for r in rows if r.path.endswith("a.txt")} == {(i, f"line {i}") for i in range(1, 5001)}
    assert sorted((r.line_no, r.line) for r in rows if r.path.endswith("b.txt")) == [(1, "x"), (2, ""), (3, "y")]


def test_command_line(spark, tmp_path):
    call = lambda *a: cli.run(cli.parser().parse_args(list(a)), spark)
    rng = np.random.default_rng(7)
    rows = ["id,f0,f1,f2,f3,kind,run"] + [f"{i},{','.join(f'{v:.4f}' for v in rng.normal(size=4) + 2 * (i % 2))},{i % 2},{i % 3}" for i in range(60)]
    (tmp_path / "t.csv").write_text("\n".join(rows))
    call("mkds", "-i", str(tmp_path / "t.csv"), "--key", "id", "--features", "f0", "f1", "f2", "f3", "--targets", "kind", "--chunks", "run").write.parquet(str(tmp_path / "ds"))
    ds = str(tmp_path / "ds")
    assert spark.read.parquet(ds).count() == 60
    for learner in ("lda", "svm"):
        e = call("crossval", "-i", ds, "--chunks", "chunks", "--learner", learner).collect()
        assert len(e) == 3 and all(r.error < 0.1 for r in e)
    sl = call("searchlight", "-i", ds, "--chunks", "chunks", "--shape", "2", "2", "--radius", "1").collect()
    assert {(r.center_id, r.fold) for r in sl} == {(c, f) for c in range(4) for f in range(3)} and all(r.error < 0.3 for r in sl)
    assert call("searchlight", "-i", ds, "--shape", "2", "2", "--measure", "mean").count() == 4
    w = call("hyperalign", "-i", ds, ds).collect()
    assert len(w) == 2 * 16
    (tmp_path / "s.py").write_text("df = df.where('targets = 1')")
    assert call("exec", "-i", ds, "--script", str(tmp_path / "s.py")).count() == 30
    spark.createDataFrame([(1, "one")], "targets int, label string").write.parquet(str(tmp_path / "atlas"))
    got = call("atlas", "-i", ds, "--atlas", str(tmp_path / "atlas"), "--attrs", "targets")
    assert got.where("label = 'one'").count() == 30 and got.count() == 60
    assert call("info").where("model = 'nu-svm'").count() == 1


def test_surfaces_round_trip(spark, tmp_path):
    rng = np.random.default_rng(8)
    xyz, stat = rng.normal(size=(7, 3)), rng.normal(size=7)
    (tmp_path / "a.gii").write_text(images.gifti_text([xyz, stat]))
    got = images.gifti(spark, str(tmp_path / "a.gii")).collect()
    assert all(abs((xyz[r.node, r.component] if r.array == 0 else stat[r.node]) - r.value) < 1e-12 for r in got) and len(got) == 28
    text_form = '<GIFTI><DataArray Intent="x" DataType="NIFTI_TYPE_FLOAT32" ArrayIndexingOrder="ColumnMajorOrder" Dim0="2" Dim1="2" Encoding="ASCII"><Data>1 2 3 4</Data></DataArray></GIFTI>'
    (tmp_path / "b.gii").write_text(text_form)
    assert {(r.node, r.component): r.value for r in images.any_dataset(spark, str(tmp_path / "b.gii")).collect()} == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 3.0, (1, 1): 4.0}
    (tmp_path / "t.csv").write_text("a,b\n1,x\n")
    assert images.any_dataset(spark, str(tmp_path / "t.csv")).first() == (1, "x")
    with pytest.raises(ValueError):
        images.any_dataset(spark, "x.mat")


def test_component_folder(spark, tmp_path):
    (tmp_path / "melodic_IC.nii").write_bytes(images.nifti_bytes(np.arange(8.0).reshape(2, 2, 1, 2)))
    (tmp_path / "melodic_mix").write_text("0.5 1.5\n2.5 3.5\n")
    maps, mix = images.component_results(spark, str(tmp_path))
    assert maps.count() == 8 and sorted(r["values"] for r in mix.collect()) == [[0.5, 1.5], [2.5, 3.5]]


def test_safe_writes_and_released_tables(spark, tmp_path):
    from pathlib import Path

    from sampleloom.session import materialised, release
    from sampleloom.sources import sinks

    path = str(tmp_path / "out")
    for n in (3, 5):
        sinks.safe_write(spark.range(n), path)
        assert spark.read.parquet(path).count() == n and not Path(path + ".part").exists()
    df = materialised(spark.range(4))
    place = df._written_to.removeprefix("file:")
    assert Path(place).exists() and df.count() == 4
    release(df)
    assert not Path(place).exists()
    release(spark.range(1))  # not a written table


def test_empirical_null_and_its_rates():
    rng = np.random.default_rng(9)
    z = np.append(rng.normal(0.3, 1.4, 20_000), rng.normal(9, 1, 600))
    mu, sd, weight = inf.empirical_null(z)
    assert abs(mu - 0.3) < 0.1 and abs(sd - 1.4) < 0.1 and 0.9 < weight <= 1
    order, rate = inf.empirical_null_fdr(z)
    assert (np.diff(order) >= 0).all() and rate[0] > 0.9 and rate[-1] < 1e-6
    cut = inf.empirical_null_threshold(z, 0.05)
    false = (z[:20_000] > cut).sum() / max((z > cut).sum(), 1)
    assert 4 < cut < 8 and false < 0.08
    assert inf.empirical_null_threshold(rng.normal(size=3000), 1e-9) == math.inf


def test_labels_only_predicted_raise(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "a"), ("b", "b")], "p string, t string")
    assert abs(er.mean_tpr(df, "p", "t").first().mean_tpr - 0.75) < 1e-9
    with pytest.raises(Exception, match="no target: c"):
        er.mean_tpr(df.unionByName(spark.createDataFrame([("c", "a")], "p string, t string")), "p", "t").collect()
