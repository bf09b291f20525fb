"""Hand-checkable cases of the engine's own operators."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sampleloom.dataset import Dataset
from sampleloom.functions import distributions as di
from sampleloom.functions import generate as gen
from sampleloom.functions import models as mo
from sampleloom.operators import aggregate as ag
from sampleloom.operators import choose as ch
from sampleloom.operators import errors as er
from sampleloom.operators import featsel as fs
from sampleloom.operators import generators as ge
from sampleloom.operators import inference as inf
from sampleloom.operators import learners as le
from sampleloom.operators import mappers as ma
from sampleloom.operators import measures as me
from sampleloom.operators import neighborhood as ne
from sampleloom.operators import ordered as od
from sampleloom.operators import select as se
from sampleloom.operators import stack as st


def array_ds(spark, rows, sa="targets int, chunks int"):
    return Dataset(spark.createDataFrame(rows, f"sample_id long, {sa}, features array<double>"), spark.createDataFrame([(i, f"f{i}") for i in range(len(rows[0][-1]))], "feature_id int, name string"))


@pytest.fixture
def eight(spark):
    return array_ds(spark, [(i, i % 2, i // 4, [float(3 * i + k) for k in range(3)]) for i in range(8)])


def test_group_mean(eight):
    got = ag.fx_samples(eight.wide(3), ["targets", "chunks"], {f"f{i}": F.avg(f"f{i}") for i in range(3)}).collect()
    assert [(r.targets, r.chunks, r.f0, r.f1, r.f2) for r in got] == [(0, 0, 3, 4, 5), (1, 0, 6, 7, 8), (0, 1, 15, 16, 17), (1, 1, 18, 19, 20)]


def test_group_mean_in_order_of_occurrence(spark):
    df = spark.createDataFrame([(i, 1 - i % 2, i // 4, float(i)) for i in range(8)], "k long, t int, c int, v double")
    got = ag.fx_samples(df, ["t", "c"], {"v": F.avg("v")}, order="occurrence", key="k").collect()
    assert [(r.t, r.v) for r in got] == [(1, 1), (0, 2), (1, 5), (0, 6)]


def test_dataset_model(spark, eight, tmp_path):
    assert eight.find_collection("targets") == "sa" and eight.find_collection("name") == "fa"
    with pytest.raises(KeyError):
        eight.find_collection("nothing")
    some = eight.set_attr("sa.subject", "s1").set_attr("a.title", "x").select({"targets": [1]}, {"name": ["f2", "f0"]})
    rows = some.samples.orderBy("sample_id").collect()
    assert [r.sample_id for r in rows] == [1, 3, 5, 7] and rows[0].features == [3.0, 5.0] and rows[0].subject == "s1"
    with pytest.raises(ValueError):
        eight.select({"targets": [9]})
    assert eight.select({"targets": [0, 9]}, strict=False).samples.count() == 4
    assert [r.sample_id for r in eight[[5, 1, 1]].samples.orderBy("place").collect()] == [5, 1, 1]
    assert [r.sample_id for r in eight[2:7:2].samples.orderBy("sample_id").collect()] == [2, 4, 6]
    some.save(str(tmp_path / "ds"))
    back = Dataset.load(spark, str(tmp_path / "ds"))
    assert back.attrs["title"] == "x" and back.samples.count() == 4
    eight.to_npz(str(tmp_path / "x.npz"))
    npz = Dataset.from_npz(spark, str(tmp_path / "x.npz"))
    assert npz.samples.orderBy("sample_id").first().features == [0.0, 1.0, 2.0]
    assert eight.init_origids("both").samples.columns[-1] == "origids"
    assert Dataset.from_long(eight.long(), ["targets"]).samples.orderBy("sample_id").first().features == [0.0, 1.0, 2.0]
    assert se.reverse_selection(some.samples, some.attrs["mapped_from"], 3).first().features[1] == 0.0


def test_expression_folds_left(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (0, 1, 1)], "a int, b int, c int")
    assert df.where(se.expression(df, "a eq 1 or b eq 1 and c eq 1")).count() == 1
    with pytest.raises(ValueError):
        se.expression(df, "a eq x")


def test_strip_and_runs(spark):
    df = spark.createDataFrame([("r", i, "aaabbbbcc"[i]) for i in range(9)], "run string, k int, t string")
    assert [r.k for r in se.strip_boundaries(df, "t", 1, 1, ["k"], ["run"]).orderBy("k").collect()] == [0, 1, 4, 5, 8]
    events = od.find_events(spark.createDataFrame([("r", i, i // 5 % 5, i // 25) for i in range(75)], "run string, k int, t int, c int"), ["t", "c"], ["k"], ["run"]).orderBy("onset").collect()
    assert len(events) == 15 and [e.onset for e in events] == list(range(0, 75, 5)) and {e.duration for e in events} == {5}
    with pytest.raises(ValueError):
        od.break_points(spark.createDataFrame([("r", i, "aba"[i]) for i in range(3)], "run string, k int, t string"), "t", ["k"], ["run"], True)
    assert od.labels_to_chunks(list("aabbbabaab")) == [0, 0, 0, 0, 0, 1, 1, 2, 2, 2] and od.labels_to_chunks(list("ababa")) == [0, 0, 1, 1, 1]
    assert od.labels_to_chunks(list("axbxa"), {"x"}) == [0] * 5
    assert od.coarse_groups([(c, 10) for c in range(6)], 3) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2, 5: 2}


def test_boxcar(spark):
    df = spark.createDataFrame([("r", i, float(i)) for i in range(75)], "run string, pos int, v double")
    starts = spark.createDataFrame([("r", b, b * 5) for b in range(15)], "run string, box int, start int")
    assert [r.mean for r in od.boxcar_mean(df, starts, 5, ["run"], "v").orderBy("box").collect()] == [2 + 5 * i for i in range(15)]


def test_zscore(spark):
    x = [0, 1, 3, 4, 2, 2, 3, 1, 1, 3, 3, 1, 2, 2, 2, 2]
    df = spark.createDataFrame([(i, float(v), "c", 7.0) for i, v in enumerate(x)], "k int, v double, chunk string, flat double")
    got = od.zscore(df, ["v", "flat"], "chunk").orderBy("k").collect()
    assert [round(r.v, 9) for r in got] == [v - 2 for v in x] and {r.flat for r in got} == {0.0}


def test_as_of_and_labels(spark):
    left = spark.createDataFrame([("u", t) for t in (0.5, 2.0, 2.4, 9.0)], "u string, t double")
    right = spark.createDataFrame([("u", 1.0, 10), ("u", 2.0, 20), ("u", 3.0, 30)], "u string, at double, v int")
    for slot in (None, 1.5):
        got = {how: [r.v for r in od.as_of(left, right, ["u"], "t", "at", "v", how, slot).orderBy("t").collect()] for how in ("prev", "next", "closest")}
        assert got == {"prev": [None, 20, 20, 30], "next": [10, 20, 30, None], "closest": [10, 20, 20, 30]}
    s = spark.createDataFrame([("u", i, float(i)) for i in range(10)], "u string, sample_id int, t double")
    e = spark.createDataFrame([(1, "u", 1.5, 3.0, "a"), (2, "u", 3.0, 2.0, "b")], "event_id int, u string, onset double, duration double, c string")
    lab = [r.c for r in od.label_samples(s, e, ["u"], "t", "c", "rest", width=2.0).orderBy("sample_id").collect()]
    assert lab == ["rest", "a", "a", "b", "b", "rest", "rest", "rest", "rest", "rest"]


def test_signals():
    x = np.sin(np.arange(64) / 5)
    assert np.allclose(od.fft_resample(od.fft_resample(x, 128), 64), x, atol=1e-9)
    assert np.allclose(od.filtfilt([1.0], [1.0], x), x)
    assert np.allclose(od.filtfilt([0.5, 0.5], [1.0], np.ones(20)), 1)
    assert np.isclose((od.haar_packet(x, 3) ** 2).sum(), (x**2).sum())
    assert np.isclose(sum((p**2).sum() for p in od.haar_dwt(x)), (x**2).sum())
    y = od.legendre(50, 2)
    assert np.allclose(y[:, 1], np.linspace(-1, 1, 50))


def test_confusion_and_errors(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 2, 2, 2, 3, 3, 3], [1, 2, 1, 2, 2, 2, 3, 2, 1], strict=True)), "target int, prediction int")
    m = er.confusion_matrix(er.confusion(df), [1, 2, 3]).orderBy("prediction").collect()
    assert [list(r)[1:] for r in m] == [[2, 0, 1], [1, 3, 1], [0, 0, 1]]
    s = {r.label: r for r in er.confusion_stats(er.confusion(df)).collect()}
    assert (s[1].tp, s[1].tn, s[1].fp, s[1].fn) == (2, 4, 1, 1) and abs(s[1].acc - 6 / 9) < 1e-12
    assert abs(er.mean_tpr(df, "prediction", "target").first().mean_tpr - (2 / 3 + 1 + 1 / 3) / 3) < 1e-12
    a = spark.createDataFrame([(0, -1.0, 0), (1, -1.0, 0), (2, 1.0, 1), (3, 1.0, 1)], "k int, e double, t int")
    assert er.auc(a, "e", F.col("t") > 0, "k").first().auc == 1.0
    assert er.auc(a, "e", F.col("t") == 0, "k").first().auc == 0.0
    p = er.bayes_confusion(np.array([[20, 1, 1], [1, 10, 11], [1, 12, 9]]))
    assert p[0][0] == [(0,), (1, 2)] and abs(sum(x[2] for x in p) - 1) < 1e-9
    assert abs(er.dirichlet_multinomial(np.array([2, 0]), np.array([1.0, 1.0])) - np.log(1 / 3)) < 1e-12
    # all classes alike: rows and columns independent, each table of one row has the same chance as its column totals
    one = er.bayes_confusion(np.array([[3, 1], [2, 2]]), hypotheses=[[(0, 1)], [(0,), (1,)]])
    assert len(one) == 2
    assert len(er.set_partitions(list(range(4)))) == 15


def test_winners(spark):
    v = [(5 * i + 6) % 12 for i in range(12)]
    ds = array_ds(spark, [(i, i // 2, 0, [float(x) for x in v[3 * i : 3 * i + 3]]) for i in range(4)])
    s = ds.samples.select("sample_id", ch.feature_winner("features").alias("w"), ch.feature_loser("features").alias("l")).orderBy("sample_id").collect()
    assert [r.w for r in s] == [1, 0, 2, 1] and [r.l for r in s] == [2, 1, 0, 2]
    assert [r.winner for r in ch.sample_winner(ds.long()).orderBy("feature_id").collect()] == [1, 0, 2]
    assert [r.winner for r in ch.sample_winner(ds.long(), lowest=True).orderBy("feature_id").collect()] == [2, 1, 3]
    assert [r.winner for r in ch.group_winner(ds.long(), "targets").orderBy("feature_id").collect()] == [0, 0, 0]
    assert [r.winner for r in ch.group_winner(ds.long(), "targets", lowest=True).orderBy("feature_id").collect()] == [1, 0, 0]


def test_selectors_and_stops(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(10)], "feature_id int, s double")
    assert sorted(r.feature_id for r in ch.tail(df, "s", fraction=0.3).collect()) == list(range(3, 10))
    assert sorted(r.feature_id for r in df.where(ch.in_range("s", 7, 2)).collect()) == [0, 1, 8, 9]
    assert df.where(ch.in_range("s")).count() == 9
    assert ch.Best()([3, 2, 1]) and not ch.Best()([1, 1]) and ch.Best(last=True)([1, 1])
    assert ch.stop_stale(2)([1, 2, 3]) and not ch.stop_stale(2)([3, 2, 1])
    assert ch.stop_any([ch.stop_below(0.1), ch.stop_after(5)], "and")([1, 1, 1, 1, 0.05])
    h = ch.history_maps(spark, [0, 2, 1]).where("kept").count()
    assert h == 1 + 3 + 2


def test_generators(spark):
    specs = ge.n_fold([0, 1, 2, 3], 2)
    assert [s[1] for s in specs] == [list(c) for c in itertools.combinations(range(4), 2)]
    df = spark.createDataFrame([(i, i % 4, "ab"[i % 3 == 0]) for i in range(40)], "k long, c int, t string")
    p = ge.partitions(df, "c", ge.n_fold([0, 1, 2, 3]))
    assert {(r.partitions_set, r.n) for r in p.where("partitions = 2").groupBy("partitions_set").agg(F.count("*").alias("n")).collect()} == {(i, 10) for i in range(4)}
    b = ge.balance(df, "t", "k", limit=["c"], count=3, seed=5)
    counts = b.where("balanced_set").groupBy("rep", "c", "t").count().collect()
    assert len({(r.rep, r.c): 0 for r in counts}) == 12
    for g in {(r.rep, r.c) for r in counts}:
        assert len({r["count"] for r in counts if (r.rep, r.c) == g}) == 1
    assert b.count() == 120
    part = ge.balance(df, "t", "k", 2, among=F.col("c") < 2, include_offlimit=True)
    assert part.where("balanced_set and c < 2").count() == 4 and part.where("balanced_set and c >= 2").count() == 20
    m = ge.permute(df, ["t"], "k", ["c"], 2, 1).groupBy("rep", "c", "t").count().collect()
    o = {(r.c, r.t): r["count"] for r in df.groupBy("c", "t").count().collect()}
    assert all(o[r.c, r.t] == r["count"] for r in m)
    assert ge.permute_values(df, "t", 2).groupBy("rep").count().count() == 2
    assert ge.permute_chunks(df, "t", "c", "k").count() == 40
    assert ge.splitter(df, "c", [1, 1, 0]).count() == 30
    assert ge.choose_specs(list(range(10)), 3) == [0, 3, 7] and len(ge.choose_specs(list(range(10)), 3, "random")) == 3
    assert len(list(ge.random_combinations(list("abcde"), 2, 4))) == 4 and len(set(ge.random_product(5, [1, 2], [3, 4, 5]))) == 5
    assert ge.odd_even([2, 4, 5], True) == [[None, [5]], [None, [2, 4]]] and ge.odd_even([2, 4, 5]) == [[None, [4]], [None, [2, 5]]]
    assert ge.n_groups([(c, 5) for c in range(4)], 2) == [[None, [0, 1]], [None, [2, 3]]]
    kept = se.sift(p, "partitions_set", [("partitions", {"uvalues": [2]}), ("t", {"uvalues": ["a", "b"]})])
    assert kept.select("partitions_set").distinct().count() == 4


def test_stacking(spark, eight):
    a = eight.samples.select("sample_id", "features")
    assert st.vstack([a, a]).count() == 16
    with pytest.raises(ValueError):
        st.vstack([a, a.drop("features")])
    h = st.hstack([a, a], ["sample_id"]).orderBy("sample_id").first()
    assert h.features == [0, 1, 2, 0, 1, 2]
    with pytest.raises(Exception):  # noqa: B017
        st.hstack([a, a.limit(3)], ["sample_id"]).collect()
    s = st.stack_by_sample_attribute(eight.samples, "chunks", [0, 1], ["sample_id"]).orderBy("pos").first()
    assert s.features == [0, 1, 2, 12, 13, 14]
    assert st.merge_attrs([{"a": 1, "b": 2}, {"a": 1, "b": 3}], "drop_nonunique") == {"a": 1}


def test_spheres(spark):
    assert set(ne.sphere_offsets(1, 2)) == {(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)}
    assert (0, 0) not in ne.sphere_offsets(1, 2, inner=0, centre=False)
    assert len(ne.sphere_offsets(1, 3)) == 7
    grid = spark.createDataFrame([(i * 4 + j, i, j) for i in range(4) for j in range(4)], "feature_id int, x int, y int")
    near = ne.neighbours(grid, ["x", "y"], 1.0)
    assert sorted((r.feature_id // 4, r.feature_id % 4) for r in near.where("center_id = 9").collect()) == [(1, 1), (2, 0), (2, 1), (2, 2), (3, 1)]
    with pytest.raises(ValueError):
        ne.unique_coordinates(grid.unionByName(grid), ["x", "y"])
    seeds = ne.scatter([(i,) for i in range(7)], ne.sphere_offsets(1, 1))
    assert seeds == [6, 4, 2, 0]
    s = ne.Surface([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0]], [[0, 1, 2], [1, 3, 2]])
    assert abs(s.face_areas().sum() - 1) < 1e-12 and s.dijkstra(0)[3] == 2.0 and len(s.split()) == 1
    assert {r.feature_id for r in ne.surface_neighbours(spark, s, 1.0, centres=[0]).collect()} == {0, 1, 2}
    assert np.allclose(s.node_normals()[:, 2], 1) and len(s.merge(s).v) == 8


def test_nearest_reference(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 5.0)], "k int, x double, y double")
    ref = spark.createDataFrame([("a", 0.9, 0.0), ("b", 0.0, 0.5)], "label string, x double, y double")
    got = {r.k: r.label for r in ne.nearest_reference(p, ref, ["x", "y"], 1.0, "k").collect()}
    assert got == {1: "b", 2: None}


def test_measures(spark):
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(60, 4)), np.arange(60) % 3
    x[:, 0] += t
    ds = array_ds(spark, [(i, int(t[i]), i % 5, x[i].tolist()) for i in range(60)])
    f = {r.feature_id: r.f for r in me.anova(ds.long(), "targets").collect()}
    for j in range(4):
        g = [x[t == c, j] for c in range(3)]
        b, w = sum(len(v) * (v.mean() - x[:, j].mean()) ** 2 for v in g) / 2, sum(((v - v.mean()) ** 2).sum() for v in g) / 57
        assert abs(f[j] - b / w) < 1e-9
    assert me.corrcoef(ds.long(), "targets").where("feature_id = 0").first().r > 0.3
    assert me.distance_correlation(np.arange(20), np.arange(20)) == pytest.approx(1)
    assert me.mutual_information(x[:, 0], t) > me.mutual_information(x[:, 1], t)
    w = me.irelief(x, t)
    assert np.argmax(w) == 0 and np.argmax(me.irelief_online(x, t)) == 0
    beta = {r.name: r.beta for r in me.linear_regression(ds.wide(4), ["f1", "f2"], "f0").collect()}
    want = np.linalg.lstsq(np.column_stack([np.ones(60), x[:, 1:3]]), x[:, 0], rcond=None)[0]
    assert np.allclose([beta["intercept"], beta["f1"], beta["f2"]], want)
    noise = me.noise_sensitivity(ds.long(), lambda df: df.groupBy("target_feature").agg(F.stddev_pop("value").alias("value")))
    assert noise.where("sensitivity > 0").count() == 4


def test_learners(spark):
    df = gen.normal_features(spark, 60, 3, 6, 5, 8.0, seed=3, partitions=2).withColumnRenamed("targets", "target").withColumnRenamed("chunks", "chunk").cache()
    ds = Dataset(df)
    p = le.gnb_folds(ds.long(), "target", "chunk")
    rows = df.toPandas()
    x, y, c = np.array(rows.features.tolist()), rows.target.to_numpy(), rows.chunk.to_numpy()
    want = {}
    for fold in range(5):
        m = mo.GNB().fit(x[c != fold], y[c != fold])
        want |= dict(zip(rows.sample_id[c == fold], m.predict(x[c == fold]), strict=True))
    assert {r.sample_id: r.prediction for r in p.collect()} == want
    wide = ds.wide(6).withColumnRenamed("sample_id", "k")
    q = le.wide_gnb_folds(wide, "k", [f"f{i}" for i in range(6)], "target", "chunk")
    assert {r.sample_id: r.prediction for r in q.collect()} == want
    for name in ("lda", "qda", "svm", "smlr", "knn"):
        e = le.cross_validate(df, mo.REGISTRY[name][1], "target", "chunk", {"error": er.mean_mismatch})
        assert e.agg(F.avg("error")).first()[0] < 0.35, name
    import pickle

    m = pickle.loads(le.discriminant(ds.wide(6), [f"f{i}" for i in range(6)], "target").first().model)
    assert (m.predict(x) == mo.LDA().fit(x, y).predict(x)).all()
    near = le.neighbours(df.withColumn("t", F.col("target")), df.where("sample_id < 5"), 3, label="target")
    d = ((x[rows.sample_id < 5][:, None] - x[None]) ** 2).sum(-1)
    order = np.argsort(d[0], kind="stable")[:3]
    assert [r.train_id for r in near.where("query_id = 0").orderBy("rank").collect()] == rows.sample_id.to_numpy()[order].tolist()
    assert le.knn_predict(near).count() == 5
    df.unpersist()


def test_models_in_memory():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    for m in (mo.Ridge(0.01), mo.BLR(100.0, 0.1), mo.ElasticNet(1e-4, 0.5), mo.LARS()):
        assert np.allclose(m.fit(x, y).predict(x), y, atol=0.05), m
    assert np.corrcoef(mo.GPR("linear", 0.1).fit(x, y - y.mean()).predict(x), y)[0, 1] > 0.99
    assert np.corrcoef(mo.SVR(10.0, 0.05).fit(x, y).predict(x), y)[0, 1] > 0.95
    lab = np.where(y > 3, "p", "n")
    assert (mo.PLR(0.01).fit(x, lab).predict(x) == lab).mean() > 0.95
    assert (mo.SVM(10.0).fit(x, lab).predict(x) == lab).mean() > 0.95
    assert (mo.SVM(10.0, "rbf").fit(x, lab).predict(x) == lab).mean() > 0.95
    three = np.digitize(y, [2, 4])
    for m in (mo.Multiclass(lambda: mo.PLR(0.01)), mo.SMLR(0.01), mo.Combined(mo.LDA(), mo.GNB(), mo.KNN(3)), mo.RegressionAsClassifier(mo.Ridge(0.01)), mo.Mapped(mo.LDA(), lambda a, b: lambda v: v[:, :2]), mo.SplitModel(mo.LDA, lambda n: [np.arange(k, n, 4) for k in range(4)])):
        assert (m.fit(x, three).predict(x) == three).mean() > 0.7, m
    tree = mo.Tree(mo.LDA(), {"low": ([0, 1], mo.LDA()), "high": ([2], None)})
    assert (tree.fit(x, three).predict(x) == three).mean() > 0.7
    assert set(mo.Binary(mo.PLR(), [0, 1], [2]).fit(x, three).predict(x)) == {"0+1", "2"}
    assert (mo.SameSign().predict(np.array([[1, 2], [1, -1], [0, 1]])) == [1, -1, 1]).all()
    assert (mo.Less1().predict(np.array([[1, 0], [2, 0]])) == [1, -1]).all()
    assert mo.find_models("linear", "!regression", "has_sensitivity") == ["smlr", "plr", "svm", "nu-svm"]
    with pytest.raises(NotImplementedError):
        mo.Multiclass(mo.PLR, "1-vs-all")
    assert mo.select_model([mo.GPR(length_scale=s) for s in (0.01, 2.0)], x, y - y.mean()).kernel[1]["length_scale"] == 2.0


def test_mappers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(50, 4)) @ np.diag([3, 2, 1, 0.5])
    ds = array_ds(spark, [(i, 0, 0, x[i].tolist()) for i in range(50)])
    p, s = ma.svd(ds.samples)
    assert np.allclose(s, np.linalg.svd(x - x.mean(0), compute_uv=False))
    back = p.reverse(p.forward(ds.samples)).orderBy("sample_id").toPandas()
    assert np.allclose(np.array(back.features.tolist()), x)
    r = gen.random_rotation(4, 1)
    y = 2.5 * (x - x.mean(0)) @ r + 1
    m = ma.Procrustes().fit(x, y)
    assert np.allclose(m.forward(x), y) and np.allclose(m.reverse(y), x)
    data = [x @ gen.random_rotation(4, k) + 0.01 * rng.normal(size=x.shape) for k in range(3)]
    maps, _ = ma.hyperalign(data)
    aligned = [f.forward(d) for f, d in zip(maps, data, strict=True)]
    for extra in ({"alpha": 0.5}, {"dims": 2}, {"zscore_all": True}, {"equal_weight": True}, {"reference": 1, "rounds": 2}):
        m, _ = ma.hyperalign(data, **extra)
        a, b = (f.forward(d) for f, d in list(zip(m, data, strict=True))[:2])
        assert np.corrcoef(a.ravel(), b.ravel())[0, 1] > 0.9, extra
        assert np.allclose(m[0].forward(data[0]) - m[0].forward(np.zeros((1, 4))), data[0] @ m[0].matrix)
    assert np.corrcoef(aligned[0].ravel(), aligned[1].ravel())[0, 1] > 0.9
    assert min(ma.segment_accuracy([x, x + 0.001], 6)) == 1.0
    assert ma.off_diagonal(np.zeros((5, 5)), 2, 1.0).tolist() == [[0, 1, 0, 0, 0], [1, 0, 1, 0, 0], [1, 1, 0, 1, 0], [0, 1, 1, 0, 1], [0, 0, 1, 1, 0]]
    sources = np.column_stack([np.sign(np.sin(np.arange(400) / 7)), rng.uniform(-1, 1, 400)])
    got = (sources @ [[1, 0.5], [0.3, 1]]) @ ma.ica(sources @ [[1, 0.5], [0.3, 1]], 2)
    assert max(abs(np.corrcoef(got[:, 0], sources[:, k])[0, 1]) for k in range(2)) > 0.95
    assert ma.lle(x, 6, 2).shape == (50, 2)
    units = ma.SOM((3, 3), 3, 0.1).fit(x).forward(ds.samples)
    assert units.count() == 50 and units.agg(F.max("row")).first()[0] <= 2
    assert ma.flat_coordinates(spark, (2, 3), ["a", "b"], {"a": ["x", "y"]}).where("a = 'y'").count() == 3
    assert [round(v, 6) for v in ma.feature_scores([x, x])[0]] == [50.0] * 4


def test_inference(spark):
    assert np.allclose(di.t_sf(2.228138852, 10), 0.025) and np.allclose(di.norm_ppf(np.array([0.975])), 1.959963985)
    assert np.allclose(di.chi2_sf(3.841458821, 1), 0.05, atol=1e-9) and np.allclose(di.f_sf(4.0, 3, 20), 0.0220769997)
    assert np.allclose(di.betainc(2, 3, di.beta_ppf(0.3, 2, 3)), 0.3)
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 5)], "g string, v double")
    r = inf.ttest(df, ["g"], "v", 0.0).first()
    assert abs(r.t - 3 / (np.sqrt(2.5) / np.sqrt(5))) < 1e-9 and abs(r.p - 0.0132) < 1e-3
    null = spark.createDataFrame([("a", float(v)) for v in range(98)], "g string, value double")
    obs = spark.createDataFrame([("a", 500.0)], "g string, value double")
    assert abs(inf.null_probability(obs, null, ["g"], tail="right").first().p - 0.01) < 1e-12
    f = inf.fdr_curve(spark.createDataFrame([(1, 0.01), (2, 0.02), (3, 0.03), (4, 0.5)], "k int, p double"), "p", "k").orderBy("k").collect()
    assert [round(x.fdr, 4) for x in f] == [0.04, 0.04, 0.04, 0.5]
    edges = spark.createDataFrame([(i, i + 1) for i in range(20) if i != 10], "a int, b int")
    nodes = spark.range(21).select(F.col("id").cast("int").alias("node"))
    assert sorted(r["count"] for r in inf.connected(edges, nodes).groupBy("cluster").count().collect()) == [10, 11]
    with pytest.raises(Exception):  # noqa: B017
        inf.threshold_map(null.withColumnRenamed("g", "feature_id"), 0.001).collect()
    rng = np.random.default_rng(0)
    mu, sd, p0 = inf.empirical_null(np.append(rng.normal(0.2, 1.1, 5000), rng.normal(6, 1, 100)))
    assert abs(mu - 0.2) < 0.2 and abs(sd - 1.1) < 0.3
    w, m, s = inf.gaussian_mixture(np.concatenate([rng.normal(c, 0.3, 300) for c in (-4, 0, 4)]))
    assert np.allclose(sorted(m), [-4, 0, 4], atol=0.2)
    assert inf.match_distribution(rng.normal(size=500))[0][0] in ("norm", "logistic")
    assert inf.gamma_gaussian(np.append(rng.normal(0, 1, 2000), rng.gamma(9, 1, 200)))["share"] > 0.7
    sizes = spark.createDataFrame([(3,), (1,)], "size int")
    assert {r["size"]: r.p for r in inf.cluster_pvalues(sizes, spark.createDataFrame([(1,), (1,), (2,)], "size int")).collect()} == {3: 0.2, 1: 1.0}


def test_feature_selection():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(90, 6))
    y = (x[:, 0] + x[:, 3] > 0).astype(int)

    def error(now):
        m = mo.LDA().fit(x[:60][:, now], y[:60])
        return float(np.mean(m.predict(x[60:][:, now]) != y[60:]))

    best, errors, sets = fs.rfe(error, lambda now: np.abs(np.corrcoef(x[:, now].T, y)[-1, :-1]), list(range(6)), drop=1)
    assert {0, 3} <= set(best) and len(sets[0]) == 6
    chosen, history = fs.ifs(lambda have, left: [error([*have, c]) for c in left], list(range(6)))
    assert {0, 3} <= set(chosen)
    kept, means = fs.split_rfe(x, y, [np.arange(k, 90, 3) for k in range(3)], lambda: mo.PLR(0.1))
    assert {0, 3} <= set(kept) and 6 in means


def test_generated_sets(spark):
    assert [tuple(r.features) for r in gen.dumb(spark).orderBy("sample_id").collect()][:3] == [(1, 0), (1, 1), (2, 0)]
    assert {r.targets for r in gen.dumb(spark).collect()} == {1, 2, 3} and {r.targets for r in gen.dumb(spark, 2).collect()} == {0, 1}
    assert abs(gen.normal_features(spark, normalize=True).agg(F.max(F.array_max(F.transform("features", F.abs)))).first()[0] - 1) < 1e-9
    assert gen.wr1996(spark, 50).count() == 50
    assert gen.sine(spark, 20, 2).count() == gen.chirp(spark, 20).count() == gen.linear(spark, 20).count() == 20
    assert gen.linear_noise(spark, 12, slope=[1.0, 2.0]).count() == 12
    assert gen.pure_multivariate(spark, 5).groupBy("targets").count().count() == 2
    assert gen.plane_points(spark, 5, [lambda x: x, lambda x: -x]).count() == 10
    assert gen.multiple_chunks(lambda c: gen.dumb(spark), 3).count() == 72
    assert gen.random_affine(gen.dumb(spark), 2).count() == 24
    assert len(gen.autocorrelated_noise(np.zeros(50), 10, 1)) == 50
    p = gen.least_squares(lambda q, t: q[0] * np.exp(-q[1] * t), [1.0, 0.5], np.linspace(0, 3, 40), 2 * np.exp(-1.3 * np.linspace(0, 3, 40)))
    assert np.allclose(p, [2, 1.3], atol=1e-5)


def test_random_seeds_are_stable(spark):
    df = spark.createDataFrame([(i, i % 2) for i in range(50)], "k long, t int")
    a = ge.balance(df, "t", "k", 5, seed=3, apply=True)
    assert {r.k for r in a.collect()} == {r.k for r in ge.balance(df.orderBy(F.desc("k")), "t", "k", 5, seed=3, apply=True).collect()}
    assert a.count() == 10
    random.seed(0)
